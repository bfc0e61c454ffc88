"""Jaccard classes, components, repeated passages and the pipeline against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from namelode.llm import op04_jaccard as jaccard
from namelode.llm import op06_chains as chains
from namelode.llm import shingles
from namelode.llm.components import components

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, component_id long, n int, fp string, rep long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 1, "x", 9) for i, t in rows], DOCS).repartition(3)


def shingle_set(text, width):
    words = (text or "").translate({i: " " for i in range(9, 14)}).translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def classes(rows, width, num, den):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    best = {i: i for i, _ in rows if i is not None}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                best[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


def near_copies(seed, n_groups=6):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for g in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 8, 25])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                at = rng.randrange(len(text))
                text[at : at + rng.choice([0, 1])] = [rng.choice(words)] * rng.choice([0, 1])
            rows.append(" ".join(text) if rng.random() < 0.9 else "  ".join(text).upper())
    passage = [rng.choice(words) for _ in range(40)]
    rows += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(1, 60))]) for _ in range(15)]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,width,num", [(1, 4, 85), (2, 5, 80)])
def test_classes(spark, monkeypatch, seed, width, num):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)  # so that large groups take many blocks, and far sets cross them
    rows = near_copies(seed)
    got = jaccard.jaccard_classes(frame(spark, rows), width, num, 100).collect()
    assert sorted(tuple(r) for r in got) == classes(rows, width, num, 100)


def test_classes_of_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (7, "one two"), (8, "é É"), (9, "a b c d e f " * 3000), (10, "a b c d e f " * 3001)]
    got = jaccard.jaccard_classes(frame(spark, rows), 4, 85, 100).collect()
    want = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 9}
    assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got}[3] == 0
    with_null = jaccard.jaccard_classes(frame(spark, [(None, "p q r s t"), (3, "p q r s t"), (None, "u")]), 4, 85, 100).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in with_null) == [(0, 0), (0, 3), (3, 3)]
    assert jaccard.jaccard_classes(frame(spark, rows).limit(0), 4, 85, 100).count() == 0


def test_classes_in_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SMALL}/documents.parquet'")
    assert sorted(tuple(r) for r in jaccard.op4_query(spark, SMALL).collect()) == sorted(con.sql(jaccard.OP4_SQL).fetchall())


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    off = ~np.eye(30, dtype=bool)
    assert (jaccard.intersections(sets, sets)[off] == np.array(want)[off]).all()
    assert (jaccard.intersections(sets[:7], sets[7:]) == np.array(want)[:7, 7:]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    best = {}

    def root(i):
        while best.setdefault(i, i) != i:
            i = best[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        best[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in list(best) if root(i) != i}


def test_word_hashes_do_not_see_blocks(monkeypatch):
    texts = [b"", b"a", b"one two  three", "é ñ ".encode() * 50, b"x" * 5000 + b" y"]
    whole = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "BLOCK", 16)
    parts = shingles.word_hashes(texts)
    assert [len(w) for w in whole] == [0, 1, 3, 100, 2] and all((a == b).all() for a, b in zip(whole, parts))
    assert len({h for w in whole for h in w.tolist()}) == 1 + 3 + 2 + 2


def passage_rows(seed=3):
    rng = random.Random(seed)
    fresh = lambda n: [f"v{rng.randrange(100_000)}" for _ in range(n)]
    exact, fuzzy = fresh(55), fresh(120)
    changed = [w if i % 20 else "changed" for i, w in enumerate(fuzzy)]
    rows = {1: fresh(80), 2: fresh(30) + exact + fresh(20), 3: exact + fresh(70), 4: fresh(10) + fuzzy, 5: fresh(40) + changed, 6: fresh(300), 7: fresh(3), 8: fresh(25) + fresh(5), 9: fresh(20) + exact}
    return {i: " ".join(w) for i, w in rows.items()}, exact, changed


def test_passages(spark):
    texts, exact, changed = passage_rows()
    docs = frame(spark, list(texts.items()))
    got = chains.repeated_passages(docs)
    rows = got.collect()
    assert {(r["doc_id"], r["source_id"]) for r in rows} == {(3, 2), (9, 2), (5, 4)}
    by = {r["doc_id"]: r for r in rows}
    assert texts[3].split()[by[3]["passage_start"] : by[3]["passage_end"]] == exact and texts[2].split()[by[3]["source_start"] : by[3]["source_end"]] == exact
    assert by[5]["edits"] >= 4 and by[5]["passage_end"] - by[5]["passage_start"] >= 110
    left = {r["doc_id"]: r["text"] for r in chains.without_passages(docs, got).collect()}
    assert set(left) == set(texts) and all(left[i] == texts[i] for i in (1, 2, 4, 6, 7, 8)) and left[3] == " ".join(texts[3].split()[55:])


def test_passages_of_edge_rows(spark):
    texts, _, _ = passage_rows()
    rows = [(1, None), (2, ""), (None, texts[2]), (3, texts[2]), (4, texts[2]), (4, texts[2]), (5, "z " * 20_000)]
    docs = frame(spark, rows)
    got = chains.repeated_passages(docs)
    assert {(r["doc_id"], r["source_id"]) for r in got.collect()} == {(4, 3)}
    assert sorted((r["doc_id"] or 0) for r in chains.without_passages(docs, got).collect()) == [0, 1, 2, 3, 5]
    assert chains.repeated_passages(docs.limit(0)).count() == 0


def test_chains_are_the_best():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(1, 25))
        pos, other = rng.integers(0, 60, n), rng.integers(0, 60, n)
        score = {}
        for j in np.lexsort((-other, pos)):  # the same recurrence by comparing all earlier matches
            before = [score[i] - chains.GAP_COST * (pos[j] - pos[i] + other[j] - other[i]) for i in score if pos[i] < pos[j] and other[i] < other[j]]
            score[j] = chains.SEED + max([0, *before])
        own = chains.best_chains(pos, other)
        assert sorted(i for c in own for i in c) == list(range(n))
        first = own[0]
        value = len(first) * chains.SEED - sum(chains.GAP_COST * (pos[b] - pos[a] + other[b] - other[a]) for a, b in zip(first, first[1:]))
        assert value == pytest.approx(max(score.values()))
    assert chains.gap_edits(np.array([1, 2, 3]), np.array([1, 3, 4])) == 2


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
    kept, stages = docs, dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "ngram_jaccard", "substring_dedup"):
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = spark.createDataFrame(stages[name](spark, kept, SMALL).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert kept.columns == docs.columns and set(after) <= set(before)
        if name == "toxicity":
            assert len(set(before) - set(after)) >= 0.5 * len(toxic) and len(set(before) - set(after) - toxic) < 0.15 * len(texts)
        if name == "ngram_jaccard":
            want = {i for i, _, c in classes(sorted(before.items()), 5, 80, 100) if i == c}
            assert set(after) == want
    rows = stages["packing"](spark, kept, SMALL).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept.collect()}


def test_passages_around_own_words(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(1_000_000)}" for _ in range(n)]
    head, foot, line, rows, want = fresh(55), fresh(55), fresh(12), {}, {}
    rows[1] = head + fresh(5) + foot + fresh(5) + line
    for i, (own, tail) in enumerate([(20, foot), (30, foot), (40, foot), (55, foot), (20, line), (30, line)], 2):
        rows[i] = head + fresh(own) + tail
        want[i] = {*range(55), *(range(55 + own, 110 + own) if tail is foot else ())}
    rows[9], want[9] = foot + fresh(30) + head, {*range(55), *range(85, 140)}
    got = {}
    for r in chains.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows.items()])).where("source_id = 1").collect():
        got.setdefault(r["doc_id"], set()).update(range(r["passage_start"], r["passage_end"]))
    assert {i: w - got.get(i, set()) for i, w in want.items()} == {i: set() for i in want}
    assert all(not got[i] - w for i, w in want.items() if i > 2)


def edited(rng, words, share):
    out = []
    for w in words:
        kind = rng.random() / share
        out += [w] if kind >= 1 else [f"e{rng.randrange(1_000_000)}"] if kind < 1 / 3 else [f"e{rng.randrange(1_000_000)}", w] if kind < 2 / 3 else []
    return out


def test_edited_passages(spark):
    rng, rows, planted = random.Random(12), {}, {}
    fresh = lambda n: [f"x{rng.randrange(1_000_000)}" for _ in range(n)]
    for i in range(240):
        size, share = (52, 60, 80)[i % 3], (0.05, 0.08, 0.1)[i // 3 % 3]
        base = fresh(size)
        copy = edited(rng, base, share)
        rows[i], rows[1000 + i], planted[1000 + i] = fresh(30) + base + fresh(30), fresh(40) + copy + fresh(40), len(copy)
    found = {}
    for r in chains.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows.items()])).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["passage_start"], r["passage_end"]))
    share = [len(found.get(i, set()) & set(range(40, 40 + n))) / n for i, n in planted.items()]
    print("found", sum(x > 0.5 for x in share) / len(share), "words", sum(share) / len(share))
    assert set(found) <= set(planted)
    assert sum(x > 0.5 for x in share) >= 0.95 * len(share)


def lost_stretches(rows, covered):
    """By brute force: stretches of MIN_WORDS words or more, all in runs of MIN_PART words that an earlier document has, that
    are not covered; and how many there are."""
    lost, total, seen = {}, 0, set()
    for i in sorted(rows):
        runs = [tuple(rows[i][k : k + chains.MIN_PART]) for k in range(len(rows[i]) - chains.MIN_PART + 1)]
        words = sorted({k + j for k, run in enumerate(runs) if run in seen for j in range(chains.MIN_PART)})
        for a in [w for w, before in zip(words, [-2, *words]) if w - 1 != before]:
            b = a
            own = covered.get(i, set())
            inside = set(words[words.index(a) :])
            while b in inside:
                b += 1
            if b - a >= chains.MIN_WORDS:
                total += 1
                if set(range(a, b)) - own:
                    lost.setdefault(i, []).append((a, b, len(set(range(a, b)) - own)))
        seen.update(runs)
    return lost, total


def test_exact_passages_of_the_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    covered = {}
    for r in chains.op6_query(spark, SMALL).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["passage_start"], r["passage_end"]))
    rows = {r["doc_id"]: [w for w in re.split("[\x20\x09-\x0d]+", (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})) if w] for r in docs.collect()}
    lost, total = lost_stretches(rows, covered)
    assert total > 10 and not lost


def test_few_places_a_chunk(spark, monkeypatch):
    """A seed that many documents of a chunk have in one context goes to its bucket once; nothing else changes."""
    rng = random.Random(21)
    fresh = lambda n: [f"h{rng.randrange(1_000_000)}" for _ in range(n)]
    shared = fresh(80)
    rows = [(i, " ".join(fresh(20) + shared + fresh(20))) for i in range(60)] + [(i, " ".join(shared[20:70] + fresh(30))) for i in range(60, 80)] + [(90, "z " * 3000), (91, "z " * 3000)]
    found = {}
    for hot in (10_000, 4):
        monkeypatch.setattr(chains, "HOT", hot)
        got = chains.repeated_passages(frame(spark, rows)).collect()
        assert all(r["source_id"] < r["doc_id"] for r in got)
        found[hot] = {(r["doc_id"], r["passage_start"], r["passage_end"]) for r in got}
    assert found[4] == found[10_000] and {d for d, _, _ in found[4]} == {*range(1, 80), 91}
    assert (91, 0, 3000) in found[4] and all(b - a == (80 if d < 60 else 50 if d < 80 else 3000) for d, a, b in found[4])


def test_passages_of_lines_seen_elsewhere(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"y{rng.randrange(1_000_000)}" for _ in range(n)]
    shared, rows = fresh(63), {}
    for i in range(53):  # each seed of the passage is first seen in a stray run under MIN_PART words
        rows[i] = fresh(20) + shared[i : i + 11] + fresh(20)
    rows |= {900: fresh(20) + shared + fresh(20), 901: fresh(30) + shared + fresh(10)}
    lines = [fresh(9) for _ in range(40)]
    for i in range(100, 400):
        rows[i] = fresh(15) + [w for _ in range(3) for w in rng.choice(lines) + fresh(2)]
    for i in range(400, 440):
        passage = [w for line in rng.sample(lines, 7) for w in line]
        rows[1000 + 2 * i], rows[1001 + 2 * i] = fresh(20) + passage, fresh(30) + passage + fresh(10)
    covered = {}
    for r in chains.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows.items()])).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["passage_start"], r["passage_end"]))
    lost, _ = lost_stretches(rows, covered)
    assert len(covered) > 40 and not lost


def test_ids_that_repeat(spark):
    text = {x: " ".join(f"{x}{i}" for i in range(30)) for x in "abz"}
    rows = [(1, text["a"]), (5, text["a"]), (5, text["b"]), (9, text["b"]), (5, text["z"]), (7, text["z"] + " more"), (8, None), (8, text["a"][:9])]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_classes(frame(spark, rows), 4, 85, 100).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (7, 1), (8, 8)}


def test_blocks_of_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 600)
    rows = near_copies(5, 4)
    got = jaccard.jaccard_classes(frame(spark, rows), 4, 85, 100).collect()
    assert sorted(tuple(r) for r in got) == classes(rows, 4, 85, 100)


def test_hot_nodes_are_broadcast(spark, monkeypatch):
    from namelode.llm import components as module

    monkeypatch.setattr(module, "HOT_DEGREE", 3)
    monkeypatch.setattr(module, "HOT_NODES", 40)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 100) for i in range(1, 60)] + [(59, 159), (200, 201), (201, 202)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(1, 60), *range(100, 160)]}, 201: 200, 202: 200}


def test_empty_buckets_cost_nothing():
    docs = [(1, 3, b"x", np.array([5, 9, 1 << 47], np.uint64)), (2, 1, b"y", np.array([9], np.uint64))]
    rows = shingles.chunk_rows(0, docs, 40)
    assert len(rows) == 1 + 2 and sorted(r[0] for r in rows[1:]) == [0, 1 << 39]


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on its own input: what toxicity drops are the operator's verdicts, what passages lose is what brute force finds."""
    from namelode.llm import op07_toxicity as toxicity

    base, stages = "/root/testdata/sf0.01", dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{base}/documents.parquet").where("doc_id % 3 = 0")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{base}/labels.parquet"))
    verdicts = {r["doc_id"]: r["score"] < 0.5 for r in toxicity.toxicity(docs, model).collect()}
    assert {r["doc_id"] for r in stages["toxicity"](spark, docs, base).collect()} == {i for i, ok in verdicts.items() if ok}
    left = {r["doc_id"]: r["text"] for r in stages["ngram_jaccard"](spark, docs, base).collect()}
    assert set(left) == {i for i, _, c in classes(sorted(texts.items()), 5, 80, 100) if i == c}
    cut = {r["doc_id"]: words_of(r["text"]) for r in stages["substring_dedup"](spark, docs, base).collect()}
    rows = {i: words_of(t) for i, t in texts.items()}
    covered = {}
    for r in chains.repeated_passages(docs).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["passage_start"], r["passage_end"]))
    lost, total = lost_stretches(rows, covered)
    assert total > 20 and not lost
    assert cut == {i: own for i, w in rows.items() if (own := [x for k, x in enumerate(w) if k not in covered.get(i, ())]) or not covered.get(i)}


def test_pipeline_of_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, cuts string, cut_id long, tokens string, score double, component_id string"
    rng = random.Random(31)
    long = " ".join(f"word{rng.randrange(5000)}" for _ in range(60_000))
    rest = lambda i: ("en", None if i % 2 else "web", 1, "x", i, "y", 0.5, "z")
    rows = [(i, t, *rest(i)) for i, t in enumerate([None, "", " \n", "one", "a b c d e f g", long, long + " end", "ONE"])] + [(None, "no id", *rest(8)), (None, None, *rest(9)), (3, "one", *rest(3)), (3, "one", *rest(3))]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i == 4)) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
        assert docs.columns == [x.split()[0] for x in schema.split(", ")], name
    left = docs.collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(["0", "1", "2", "3", "4", "5", "None", "None"]) and {r["text"] for r in left if r["doc_id"] == 5} == {long}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {None, 0, 1, 2, 3, 4, 5}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_keeps_rows_that_only_share_an_id(spark):
    """Two rows of one id: near copies are one document, other texts are documents of their own and lose only their own passages."""
    text = {x: " ".join(f"{x}{i}" for i in range(60)) for x in "abcd"}
    rows = [(1, text["a"]), (1, text["b"]), (1, text["a"]), (2, text["b"]), (3, text["c"]), (3, text["d"] + " " + text["a"]), (3, text["c"] + " more"), (None, text["a"]), (None, text["a"])]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, own_id long, gone string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    left = stages["ngram_jaccard"](spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"][:2], r["own_id"]) for r in left if r["doc_id"]) == [("1", "a0", 1), ("1", "b0", 1), ("3", "c0", 3), ("3", "d0", 3)] and sum(r["doc_id"] is None for r in left) == 2
    cut = stages["substring_dedup"](spark, docs.where("text not like 'c%more'"), "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in cut if r["doc_id"]) == [("1", text["a"]), ("1", text["b"]), ("3", text["c"]), ("3", text["d"])]
    assert cut[0].asDict().keys() == {"doc_id", "text", "own_id", "gone"}


def test_fuzzy_passages_whose_words_were_first_seen_elsewhere(spark):
    """Every run between two changed words has an earlier owner that shares nothing else."""
    rng = random.Random(12)
    fresh = lambda n: [f"u{rng.randrange(1_000_000)}" for _ in range(n)]
    rows, want = {}, set()
    for k in range(6):  # as told: every tenth word; then with gaps of other sizes
        passage = fresh(120)
        cuts = list(range(9, 120, 10)) if k == 0 else sorted(rng.sample(range(5, 115), 9))
        runs = [passage[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, 120])]
        for i, run in enumerate(runs):
            rows[1000 * k + i] = fresh(30) + run + fresh(30)
        rows[1000 * k + 500] = fresh(40) + passage + fresh(40)
        rows[1000 * k + 600] = fresh(40) + [f"changed{k}x{i}" if i in cuts else w for i, w in enumerate(passage)] + fresh(40)
        want.add((1000 * k + 600, 1000 * k + 500))
    got = chains.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows.items()])).collect()
    pairs = {(r["doc_id"], r["source_id"]): r for r in got}
    assert set(pairs) >= want and all(d % 1000 >= 500 for d, _ in pairs)
    first = pairs[600, 500]
    assert (first["passage_start"], first["passage_end"]) == (40, 159)


def edited(rng, first, count, *, center):
    """Texts that differ from one text by a tenth, so from each other by more than links allow; a pair in each ten is alike but for a word."""
    words = [f"g{first}w{i}" for i in range(140)]
    rows = [(first, " ".join(words))] if center else []
    for i in range(len(rows), count):
        text = list(words)
        for j, at in enumerate(rng.sample(range(140), rng.choice([9, 12, 15]))):
            text[at] = f"n{first + i}w{j}"
        rows.append((first + i, " ".join(text)) if i % 10 else (first + i, rows[-1][1] + " more" if rows else " ".join(text)))
    return rows


@pytest.mark.parametrize("center", [True, False])
def test_lists_without_links_to_their_first_leader(spark, monkeypatch, center):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard, "SIDES", 3)
    rng = random.Random(5)
    rows = edited(rng, 1000, 90, center=center) + edited(rng, 2000, 40, center=not center)
    got = jaccard.jaccard_classes(frame(spark, rows), 1, 80, 100).collect()
    assert sorted(map(tuple, got)) == classes(rows, 1, 80, 100)


def test_sets_read_grow_with_the_list(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    plain = jaccard.read_sets
    read = []
    for count in (150, 600):
        seen = spark.sparkContext.accumulator(0)

        def counting(table, seen=seen, plain=plain):
            seen.add(table.num_rows)
            return plain(table)

        monkeypatch.setattr(jaccard, "read_sets", counting)
        rows = edited(random.Random(7), 1, count, center=True)
        jaccard.jaccard_classes(frame(spark, rows), 1, 80, 100).write.format("noop").mode("overwrite").save()
        read.append(seen.value)
    assert read[0] >= 150 and read[1] <= 6 * read[0], read
