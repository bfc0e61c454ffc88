"""Packing, licences, media, pieces and toxicity against libraries, brute force and round trips."""

import hashlib
import json
import os
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from namelode.llm import op02_packing as packing
from namelode.llm import op03_licenses as licenses
from namelode.llm import op07_toxicity as toxicity
from namelode.llm import op08_media as media
from namelode.llm import op10_pieces as pieces

SMALL = "/root/testdata/sf0.001"
BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a b", "a  b   c ", "a\nb\tc", "ñ漢字😀 \x00 x", "▁a ▁▁b", "</s> <s> <unk> x", "a <|endoftext|> b", "<0x41>", "\r\n", "it's  'll\n\n x\t\ty ", "x" * 300, "word " * 9000, " " * 70 + "x" + " " * 19, "a b c"]
DOCS = "doc_id long, text string, length string, labels int, media int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(ODD)] + [(None, "null id", "x", 1, 2), (3, "  a b", "x", 1, 2)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def check_packing(rows, texts, capacity=2048):
    tokenizer = packing.ids_of(BPE).library
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(r["length"] for r in rows) / (capacity * len(by_sequence))


def test_packing(spark, docs):
    assert check_packing(packing.op2_query(spark, SMALL).collect(), docs) > 0.98


def test_packing_edges(spark, odd):
    texts = {i: t for i, t in enumerate(ODD) if i != 3} | {None: "null id"}
    check_packing(packing.packed(odd.where("doc_id is null or doc_id <> 3"), BPE).collect(), texts)
    assert packing.packed(odd, BPE).where("doc_id = 3").count() == 2
    assert packing.packed(odd.limit(0), BPE).count() == 0


def test_plan_takes_every_piece_once():
    rng = np.random.default_rng(3)
    for n, high in ((1, 64), (30, 64), (3000, 64), (2000, 7)):
        demand = {int(s): int(k) for s, k in zip(*np.unique(rng.integers(1, high + 1, n), return_counts=True))}
        filled, taken = {}, {s: [] for s in demand}
        for size, lo, hi, base, each in packing.plan(demand, 64):
            taken[size] += range(lo, hi)
            for j in range(lo, hi):
                filled[base + (j - lo) // each] = filled.get(base + (j - lo) // each, 0) + size
        assert all(sorted(taken[s]) == list(range(k)) for s, k in demand.items()) and max(filled.values()) <= 64
        assert len(filled) <= sum(s * k for s, k in demand.items()) / 64 * 1.05 + 3


def test_pieces(spark, docs, odd):
    library = pieces.codec(SPM).library

    def want(text):
        ids = library.encode(text or "", add_eos=True)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    for r in pieces.op10_query(spark, SMALL).collect():
        assert tuple(r)[1:4] == want(docs[r["doc_id"]]) and r["repaired"] == 0
    got = pieces.piece_digests(odd, SPM).collect()
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, [(i, *want(t)) for i, t in enumerate(ODD)] + [(None, *want("null id")), (3, *want("  a b"))]))
    assert pieces.piece_digests(odd.limit(0), SPM).count() == 0


def test_agendas_agree():
    own = pieces.codec(SPM)
    rng = np.random.default_rng(5)
    for _ in range(300):
        chunk = "▁" + "".join(rng.choice(list("abcdeinrstéß▁."), rng.integers(1, 30)))
        ids = own.encode_chunk(chunk)
        assert own.merged(list(chunk)) == own.merged_short(list(chunk))
        assert own.decode_ids(ids) == chunk.replace("▁", " ")[1:]


def test_license_base_places(spark, docs):
    for r in licenses.op3_query(spark, SMALL).collect():
        text = re.sub("[A-Z]", lambda m: m.group().lower(), docs[r["doc_id"]] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = next_row(row, x, b, i)
    return row[-1]


def next_row(row, x, b, i):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_fuzzy_notices_are_all_found():
    scanner, rng = licenses.Scanner(), np.random.default_rng(7)
    for i, (notice, label, most) in enumerate(scanner.notices):
        letters = [j for j, c in enumerate(notice) if not c.isdigit()]  # numbers are never edited
        for _ in range(10):
            changed = list(notice)
            for _ in range(rng.integers(0, most + 1)):
                changed[rng.choice(letters)] = rng.choice(list("qxz"))
            changed = "".join(changed)
            assert edits(changed, notice) <= most
            got = scanner.scan(f"lorem ipsum {changed} dolor")
            assert label in got[5].split(","), (notice, changed)
    assert scanner.scan("under the mitt lizenze and more")[5] in ("", "mit") and scanner.scan(None)[:7] == (0, 0, None, None, "", "", 0.0)
    assert scanner.scan("Under the MIT License. " * 3)[:4] == (12, 3, 0, 8)


def test_license_edges(odd):
    got = licenses.license_scan(odd)
    assert got.count() == len(ODD) + 2 and licenses.license_scan(odd.limit(0)).count() == 0


def test_media_round_trip(spark, docs, odd):
    def check(rows, texts):
        for r in rows:
            raw = (texts[r["doc_id"]] or "").encode()
            payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))

    rows = media.op8_query(spark, SMALL).collect()
    check(rows, docs)
    assert len(rows) == len(docs)
    rows = media.media_columns(odd, range_bytes=500).collect()
    check(rows, {i: t for i, t in enumerate(ODD)} | {None: "null id"})
    assert len(rows) == len(ODD) + 2 and media.media_columns(odd.limit(0)).count() == 0


def test_media_members_are_retried_alone(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}" * 100) for i in range(9)], "doc_id long, text string").coalesce(1)
    manifest = media.write_archives(docs, f"file://{tmp_path}/a")
    reader = media.ArchiveReader({"manifest": manifest.inputFiles()[0].rpartition("/")[0], "retries": "3"})
    failures, opened = {}, reader.open

    class Flaky:
        def __init__(self, f):
            self.f, self.at = f, 0

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.at = at
            self.f.seek(at)

        def read(self, n):
            if n == 30 and failures.setdefault(self.at, 0) < 2:
                failures[self.at] += 1
                raise OSError("lost")
            return self.f.read(n)

    part = reader.partitions()[0]
    infos = reader.directory(part.ranges[0][0])
    monkeypatch.setattr(reader, "open", lambda a: Flaky(opened(a)))
    monkeypatch.setattr(reader, "directory", lambda a: infos)
    assert sum(len(b) for b in reader.read(part)) == 9 and set(failures.values()) == {2}
    with pytest.raises(ValueError):
        media.samples_of(media.png_of(b"a" * 576).replace(b"IDAT", b"IDAX"))


def test_toxicity(spark):
    base = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    got = toxicity.op7_query(spark, base).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(got) == 1000 and np.mean([p == t for p, t in held]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_deobfuscation(spark):
    clean = "a stupid idiot is a moron and the clown is a loser as the pathetic scum is trash " * 20
    rows = [(i, clean) for i in range(5)] + [(9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = np.zeros(toxicity.CLASSES**3)
    for r in toxicity.trigram_counts(docs).collect():
        counts[r["gram"]] = r["n"]
    model = toxicity.Model(toxicity.costs_of(counts))
    for seen, meant in {"m0r0n": "moron", "st.u.p.i.d": "stupid", "idiooooot": "idiot", "cl0wn!!": "clown", "p@thetic": "pathetic", "$cum": "scum", "l-o-s-e-r": "loser", "1d1ot": "idiot", "is": "is", "###": ""}.items():
        assert model.restore(seen) == meant
    assert "idiot" in model.restored("you i d i o t there").split()
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] < 0.5 for r in toxicity.toxicity(docs, empty).collect()] == [True] * 7


def test_spaced_and_long_insults():
    clean = "a stupid idiot is a moron and you are the clown who is a loser or a stupid person as the pathetic scum is trash "
    docs = [clean * 20]
    c = np.concatenate([[0, 0], toxicity.classes_of(docs[0]), [0]])
    c = c[np.concatenate([[True, True], (c[2:] > 0) | (c[1:-1] > 0)])]
    counts = np.bincount((c[:-2] * toxicity.CLASSES + c[1:-1]) * toxicity.CLASSES + c[2:], minlength=toxicity.CLASSES**3)
    weights = {w: 5.0 for w in ("stupid", "loser", "idiot", "moron")}
    model = toxicity.Model(toxicity.costs_of(counts), weights)
    for text in ("you are a s t u p i d person", "he is a l o s e r", "y o u i d i o t", "y o u  a r e  a  m o r o n", "a\ts\tt\tu\tp\ti\td", "i\nd\ni\no\nt", "s  t  u  p  i  d", "a  $  t  u  p  1  d"):
        assert model.total(text)[1] == 1, text
    assert model.total("st" + "u" * 100 + "pid")[1] == 1 and model.restore("-".join("stupid") + "-" * 80 + "!") == "stupid"
    assert model.total("-----".join("m0r0n") + "." * 70 + "x")[1] == 0
    assert len(model.restore("m0ron" * 20_000)) == 100_000
    assert [model.total(t)[1] for t in ("a b c", "1 2 3\n4", "you are a person", "")] == [0] * 4


def test_words_in_parts():
    """A space is an edge of the lattice anywhere in a known word, however many parts it makes and however they are disguised."""
    clean = "a stupid idiot is a moron and you are the clown who is a loser or a stupid person as the pathetic scum is trash "
    c = np.concatenate([[0, 0], toxicity.classes_of(clean * 20), [0]])
    c = c[np.concatenate([[True, True], (c[2:] > 0) | (c[1:-1] > 0)])]
    counts = np.bincount((c[:-2] * toxicity.CLASSES + c[1:-1]) * toxicity.CLASSES + c[2:], minlength=toxicity.CLASSES**3)
    insults = ("stupid", "idiot", "clown", "loser", "moron", "pathetic")
    model = toxicity.Model(toxicity.costs_of(counts), {w: 5.0 for w in insults})
    for word in insults:
        n = len(word)
        for cuts in ((i, j) for i in range(1, n) for j in range(i, n)):
            parts = [p for p in (word[: cuts[0]], word[cuts[0] : cuts[1]], word[cuts[1] :]) if p]
            for how in (" ".join, "  ".join, lambda p: " ".join(p).translate(str.maketrans("oi", "01")), lambda p: " ".join(p).upper() + "!"):
                assert model.total(f"you are the {how(parts)} here")[1] == 1, (word, parts)
    assert model.total("you id - io - t")[1] == 1 and model.total("stu u u pid and st up")[1] == 0
    assert model.total("of the st. upid. And id, iot")[1] == 0  # the end of a part of a sentence is no space within a word
    assert model.total("are you the person who is as the lo and ser or id and iot")[1] == 0
    started = time.perf_counter()
    assert model.total("id " * 50_000 + "- " * 50_000 + "i" * 50_000)[1] == 0 and model.total("id " + "io " * 50_000)[1] == 0
    assert time.perf_counter() - started < 20


def paths_of(word, i=0, out=""):
    """Every reading of an obfuscated word with the sum of its prices."""
    if i == len(word):
        yield 0.0, out
        return
    c = word[i]
    if c == " ":
        options = [(" ", 0.0), ("", 0.0)]
    elif c in "\t\n":
        options = [(" ", 0.0), ("", 2.0 if c == "\n" else 0.5)]
    else:
        options = [(c, 0.0)] * c.isalpha() + [(x, 1.0) for x in toxicity.LEET.get(c, "")]
        if c.isdigit():
            options.append(("", 8.0))
        elif not c.isalpha():
            options.append(("", 2.0 if c in toxicity.LEET else 0.5))
        elif i and word[i - 1] == c:
            options.append(("", 0.0 if i > 1 and word[i - 2] == c else 1.5))
    for letter, price in options:
        if letter != " " or (out and out[-1] != " "):
            for cost, whole in paths_of(word, i + 1, out + letter):
                yield price + cost, whole


def test_decoder_against_all_paths():
    rng = np.random.default_rng(5)
    for trial in range(300):
        costs = rng.uniform(0.1, 6, (toxicity.CLASSES,) * 3).astype(np.float32)
        word = "".join(rng.choice(list("aabbil1!0@-. \n\té"), rng.integers(1, 8)))
        best = {}
        for price, out in paths_of(word):
            c = [0, 0, *(toxicity.char_class(x) if x != " " else 0 for x in out)]
            c += [0] * (c[-1] > 0)
            total = price + sum(float(costs[x, y, z]) for x, y, z in zip(c, c[1:], c[2:]))
            best[out.strip()] = min(total, best.get(out.strip(), np.inf))
        assert best[toxicity.decode(word, costs)] == pytest.approx(min(best.values())), word


def test_notice_before_a_better_one():
    words = "gnu generl public license version 2 gnu general public license version 2 gnu general publc license version 2"
    spans = licenses.Scanner().scan(words)[-1]
    assert [(s["label"], s["word"], s["edits"]) for s in spans if s["label"] == "gpl-2"] == [("gpl-2", 0, 1), ("gpl-2", 6, 0), ("gpl-2", 12, 1)]


def test_whole_texts_are_decoded(monkeypatch):
    own = pieces.Codec(SPM)
    before = own.digests(["one two three", ""])
    assert [r[2] for r in before] == [hashlib.sha256(t).hexdigest() for t in (b"one two three", b"")]

    class Library:
        def encode(self, texts, num_threads):
            return []

        def decode(self, ids):
            return "decoded" if ids else []

    monkeypatch.setattr(own, "library", Library())
    assert own.digests(["one two three"])[0][2] == hashlib.sha256(b"decoded").hexdigest()


def test_plan_beside_a_session(tmp_path):
    """The plan must not stand still in a process that has started a JVM, whatever the threads of its BLAS."""
    code = "from namelode.session import local_session; local_session(1).range(3).count(); from namelode.llm.op02_packing import plan; print(len(plan({s: 7 * s % 90 + 1 for s in range(1, 257)}, 256)) > 0)"
    env = {k: v for k, v in os.environ.items() if not k.endswith("_NUM_THREADS")}
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.split()[-1:] == ["True"], done.stderr[-500:]


def test_inverse():
    a = np.random.default_rng(8).random((60, 60)) - 0.5
    assert np.abs(packing.times(packing.inverted(a), a[:, 7]) - np.eye(60)[7]).max() < 1e-8
    assert np.abs(packing.times(a[3], packing.inverted(a)) - np.eye(60)[3]).max() < 1e-8


def test_long_white_space_and_other_vocabularies(tmp_path):
    own = packing.ids_of(BPE)
    for text in (" " * 3_000_000, "\n" * 3_000_000, "a" + " \n" * 300_000 + "b  c", "x <|endoftext|> y", " " * 50_000):
        assert own.encode(text) == own.slow(text)
    spec = json.load(open(BPE, encoding="utf-8"))
    changes = [{"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "Lowercase"}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}]
    for i, change in enumerate(changes):  # the library takes what the fast encoder does not know
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(spec | change))
        other = packing.Ids(str(path))
        assert other.fast is None and other.encode("Some  text, it's HERE") == other.slow("Some  text, it's HERE")


def test_scores_of_disguised_words(spark):
    """Held-out toxic documents whose insults are disguised keep their verdict; clean ones with as much noise stay clean."""
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").selectExpr("cast(doc_id as bigint) as doc_id", "text")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.fit(docs, labels)
    insults = [w for w in model.weights if w.isalpha() and len(w) > 3]
    assert len(insults) >= 8
    disguise = [lambda w: w.translate(str.maketrans("oiase", "01@$3")), lambda w: ".".join(w), lambda w: w[:2] + w[2] * 5 + w[3:], lambda w: " ".join(w), lambda w: "".join(c + c for c in w), lambda w: f"{w[:2]} {w[2:]}", lambda w: "  ".join(w), lambda w: f"{w[:2]} {w[2:4]} {w[4:]}"]
    rows = docs.join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    telling = [r for r in held if r["toxic"] and any(w in r["text"].lower() for w in insults)]
    assert telling and len(telling) >= 0.6 * sum(r["toxic"] for r in held)  # the rest are labels without a telling word
    for k, how in enumerate(disguise):
        changed = [re.sub("|".join(insults), lambda m: how(m.group().lower()), r["text"], flags=re.I) for r in telling]
        assert sum(model.score(model.total(t)[0]) >= 0.5 for t in changed) >= 0.9 * len(telling), k
    clean = [r["text"] for r in held if not r["toxic"]]
    noisy = [re.sub(r"\b\w{5}\b", lambda m: disguise[i % len(disguise)](m.group().lower()), t) for i, t in enumerate(clean)]
    assert sum(model.score(model.total(t)[0]) >= 0.5 for t in noisy) <= 0.02 * len(noisy)


def test_evidence(spark):
    assert toxicity.least_evidence({1: 1000, 3: 10}, 0.1, 1.0) == pytest.approx(np.log(10))
    filler = [f"n{i}" for i in range(400)]
    rng = np.random.default_rng(4)
    fresh = lambda n: " ".join(rng.choice(filler, n))
    copied = f"{fresh(5)} rareword {fresh(5)}"
    rows = [(i, f"{fresh(8)} insult {fresh(8)} {copied if i < 20 else ''}") for i in range(40)] + [(100 + i, fresh(20)) for i in range(160)]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int"))
    assert "insult" in model.weights and "rareword" not in model.weights  # copies of one place count once
    twice = docs.union(docs)
    again = toxicity.fit(twice, spark.createDataFrame([(i, int(i < 100)) for i, _ in rows] * 2, "doc_id long, toxic int"))
    assert again.weights == model.weights


def spans_by_brute_force(scanner, words):
    """(label, first word, edits) of every run of whole words within a notice's edits and with its numbers, chosen as the scanner chooses."""
    places = [m.span() for m in re.finditer("[^ ]+", words)]
    kept = []
    for i, (notice, label, k) in enumerate(scanner.notices):
        found = []
        for x, (a, _) in enumerate(places):
            for _, b in places[x:]:
                if b - a > len(notice) + k:
                    break
                if b - a >= len(notice) - k and re.findall("[0-9]+", words[a:b]) == re.findall("[0-9]+", notice) and (e := edits(words[a:b], notice)) <= k:
                    found.append((e, a, b))
        own = []
        for e, a, b in sorted(found):
            if all(b <= c or d <= a for _, c, d in own):
                own.append((e, a, b))
        kept += [(e / len(notice), a, b, i, e, label) for e, a, b in own]
    out = []
    for x in sorted(kept):
        if all(x[2] <= y[1] or y[2] <= x[1] or y[0] == x[0] for y in out):
            out.append(x)
    return sorted((label, words.count(" ", 0, a), e) for _, a, _, _, e, label in out)


def test_spans_against_brute_force():
    scanner, rng = licenses.Scanner(), np.random.default_rng(9)
    notices = [n for n, _, _ in scanner.notices]
    texts = ["gnu lesser general public licence gnu lesser general public license", "under the bsd licence under the bsd license", "thunder the mit licensed", "gnu general public license version 4", "licensed under cc by sa 4 0 licensed under cc by nc 4 0", "under the mit license under the mit licens under the mi license"]
    for _ in range(25):
        parts = []
        for _ in range(rng.integers(1, 5)):
            changed = list(notices[rng.integers(len(notices))])
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(len(changed))
                changed[at : at + 1] = [[], ["x"], [changed[at], "q"], [" "]][rng.integers(4)]
            parts += [" ".join(rng.choice(["lorem", "the", "license", "2", "under"], rng.integers(0, 4))), "".join(changed)]
        texts.append(licenses.normal(" ".join(parts)))
    for text in texts:
        got = sorted((s["label"], s["word"], s["edits"]) for s in scanner.scan(text)[-1])
        assert got == spans_by_brute_force(scanner, text), text


@pytest.mark.parametrize("text", ["under the mit licens ", "permission is hereby ", "license", "under the "])
def test_scan_takes_linear_time(text):
    scanner = licenses.Scanner()
    started = time.perf_counter()
    scanner.scan(text * (1_000_000 // len(text)))
    assert time.perf_counter() - started < 30


def feature_by_hand(payload):
    width, height = 576, len(payload) // 576
    mean = sum(payload) / len(payload)
    deviation = (sum((x - mean) ** 2 for x in payload) / len(payload)) ** 0.5
    bits = ""
    for i in range(8):
        a = int(height * i / 8)
        b = max(int(height * (i + 1) / 8), a + 1)
        cells = [sum(payload[y * width + x] for y in range(a, b) for x in range(c * 64, c * 64 + 64)) for c in range(9)]
        bits += "".join("1" if y > x else "0" for x, y in zip(cells, cells[1:]))
    return f"{mean:.4f}:{deviation:.4f}:{int(bits, 2):016x}"


def test_media_by_hand(spark):
    rng = np.random.default_rng(2)
    texts = {i: "".join(rng.choice(list("abcdefgh é\n"), n)) for i, n in enumerate([0, 1, 100, 700, 3000, 9000])}
    for r in media.media_columns(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        png = media.png_of(payload)
        lines = zlib.decompress(png[8 + 25 + 8 : -12 - 4])  # between the header and the end stands one data chunk
        assert png[:8] == b"\x89PNG\r\n\x1a\n" and png[12:16] == b"IHDR" and [int.from_bytes(png[i : i + 4], "big") for i in (16, 20)] == [576, len(payload) // 576]
        assert b"".join(lines[i + 1 : i + 577] for i in range(0, len(lines), 577)) == payload and not any(lines[::577])
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(png), hashlib.sha256(png).hexdigest(), feature_by_hand(payload))


def test_partitions_are_few():
    archives = [(f"a{i}", 1000 + i) for i in range(500)]
    whole = {(a, 0, n) for a, n in archives}
    for step, most in ((300, 10**6), (10, 20), (5000, 10**6)):
        parts = media.planned(archives, step, most)
        joined = {}
        for a, x, y in (r for p in parts for r in p.ranges):
            assert joined.setdefault(a, 0) == x < y
            joined[a] = y
        assert {(a, 0, n) for a, n in joined.items()} == whole
        assert len(parts) <= (21 if most == 20 else 5 * len(archives)) and (most == 20 or all(len(p.ranges) == 1 for p in parts))
    assert media.planned([], 10) == []
