"""Spelling variants, mixing and vector codes: SQL on the small tables, brute force and edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_native import SMALL, same, sql_rows

from namelode.llm import op11_variants as variants
from namelode.llm import op12_mixing as mixing
from namelode.llm import op13_codes as codes

DOCS = "doc_id long, text string, source string, word string, n int, size string, key int, target string, slice int"
ODD = ("extra", 3, "s", 1, "t", 2)  # columns whose names the operators use themselves


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *ODD) for r in rows], DOCS)


# variants


def test_variants(spark):
    same(variants.op11_query(spark, SMALL), sql_rows(variants.OP11_SQL, "documents"))


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_brute_force(counts, ratio=10):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [2, 5, 10_000])
def test_variants_against_all_pairs(spark, most):
    """Few letters make crowded blocks and repeated letters; the bound on blocks must not show."""
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"a" * 300, "a" * 301, "b" + "a" * 300}
    counts = {w: rng.choice([2, 3, 20, 40, 400, 4000]) for w in words}
    got = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), most=most).collect()
    assert sorted(map(tuple, got), key=str) == variants_by_brute_force(counts)


def test_words_of_texts(spark):
    texts = [(1, "Sunlight ÀÉÜsunlight sun-light sunlight2sunlight"), (1, "Sunlight ÀÉÜsunlight sun-light sunlight2sunlight"), (None, "sunlight SUNLIGHT"), (3, None), (4, ""), (5, "x" * 200_000), (6, "x" * 200_000)] + [(i, "wonderful river") for i in range(10, 110)]
    want = Counter()
    for doc, text in texts:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(variants.CAPITALS, variants.SMALL))
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    got = variants.spelling_variants(docs_of(spark, [(d, t, "s") for d, t in texts])).collect()
    assert {r["word"]: r["n"] for r in got} == want and {w for w in want if w.startswith("wond")} and got[0].asDict().keys() == {"word", "form", "root", "n", "n_near", "form_n"}
    assert sorted(map(tuple, got), key=str) == variants_by_brute_force(want)
    assert variants.spelling_variants(docs_of(spark, [])).count() == 0


# mixing


def test_mixing(spark):
    same(mixing.op12_query(spark, SMALL), sql_rows(mixing.OP12_SQL, "documents"))


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    """Water filling in fractions."""
    from fractions import Fraction

    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total, stopped = {s: weights[i % len(weights)] for i, s in enumerate(order)}, Fraction(sum(sizes.values())), set()
    while True:
        left, share = total - sum(most * sizes[s] for s in stopped), sum(weight[s] for s in order if s not in stopped)
        over = {s for s in order if s not in stopped and left * weight[s] / share > most * sizes[s]}
        if not over:
            return {s: Fraction(most * sizes[s]) if s in stopped else left * weight[s] / share for s in order}
        stopped |= over


def test_mixing_edges(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["a", "b", "é", "Z"])) for i in range(400)]
    rows += [(None, "one two", None)] * 30 + [(7, "\x1cone\xa0two\t three\n", None), (8, None, "empty"), (9, " \t", "empty"), (10, "x " * 50_000, "hot"), (11, "a b", "tiny")] + [(12, "same row", "hot")] * 200
    got = mixing.mixed(docs_of(spark, rows), seed=3).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs_of(spark, rows[::-1]), seed=3).collect()))
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = targets_by_hand({s: sizes[s] for s in {r["source"] for r in got}})
    assert sum(sizes.values()) == pytest.approx(float(sum(want.values())))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
    assert all(taken[s] == int(want[s]) or abs(taken[s] - float(want[s])) < 1 for s in want)
    for s in want:  # a row is repeated once more than another at most, but for the one that is cut
        passes = {r["taken"] // r["size"] for r in got if r["source"] == s and r["size"]}
        assert not passes or max(passes) - min(passes) <= 1
    assert next(r["size"] for r in got if r["doc_id"] == 7) == 2 and {r["target"] for r in got if r["source"] == "empty"} == {0.0}
    assert mixing.mixed(docs_of(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mixed(docs_of(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]
    assert [r["taken"] for r in mixing.mixed(docs_of(spark, [(1, "a b c", None)])).collect()] == [3]
    with pytest.raises(ValueError):
        mixing.mixed(docs_of(spark, rows), weights=(1, 0))


def test_mixing_orders_by_hash_not_by_place(spark):
    rows = [(i, "a b c d", "hot") for i in range(300)] + [(1000 + i, "a", "small") for i in range(3)]
    got = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs_of(spark, rows), weights=(1, 5)).collect()}
    whole = [i for i in range(300) if got[i] == 4]
    assert sum(got[i] for i in range(300)) == 1203 - 9 and whole != list(range(len(whole)))
    assert {got[1000 + i] for i in range(3)} == {3}


# codes


def test_codes(spark):
    same(codes.op13_query(spark, SMALL), sql_rows(codes.OP13_SQL, "embeddings"))


def codes_by_brute_force(rows, parts, entries, rounds):
    """id, label, code and error by comparing everything, in Python's whole numbers."""
    import math

    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=1) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), y) for i, v, y in kept]
    cut = lambda v: [v[p * width // parts : (p + 1) * width // parts] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, next(x[1] for x in rows if x[0] == r[0])))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        found = [[min((far(x, e), j) for j, e in enumerate(books[p])) for p, x in enumerate(cut(v))] for _, v, _ in kept]
        if turn < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    own = [cut(v)[p] for (_, v, _), f in zip(kept, found) if f[p][1] == j]
                    if own:
                        books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    return sorted((str(i), str(y), "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for (i, _, y), f in zip(kept, found)), books


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")


@pytest.mark.parametrize("kind", ["plain", "ties", "few", "ragged", "huge"])
def test_codes_against_all_distances(spark, kind):
    rng = random.Random(kind)
    n, d = (5, 8) if kind == "few" else (250, 8)
    number = {"ties": lambda: rng.choice([-1, 0, 1]) / 256, "huge": lambda: rng.choice([1.0, -3e18, 2.5e30])}.get(kind, lambda: rng.gauss(0, 1))
    rows = [(i, [number() for _ in range(rng.randint(0, 9) if kind == "ragged" else d)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(1000, None, 1), (1001, [1.0, None] * 4, 1), (1002, [float("nan")] * d, None), (1003, [float("inf")] * d, 2)]
    coded, books = codes.product_codes(vectors_of(spark, rows), parts=4, entries=16, rounds=2)
    want, want_books = codes_by_brute_force(rows, 4, 16, 2)
    got = coded.collect()
    assert sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"]) for r in got) == [(*w[:3], min(w[3], codes.LONGEST)) for w in want]
    assert [[list(map(int, e)) for e in p] for p in books] == want_books
    sums = Counter()
    for r in got:
        sums[r["label"]] += r["error"]
    assert all(r["label_error"] == min(sums[r["label"]], codes.LONGEST) for r in codes.with_label_errors(coded).collect())


def test_codes_edges(spark):
    assert codes.product_codes(vectors_of(spark, []))[0].count() == 0
    coded, books = codes.product_codes(vectors_of(spark, [(None, [1.0] * 16, None), (1, [1.0] * 16, None), (1, [1.0] * 16, None), (2, [], 1)]))
    assert sorted((r["vec_id"] or 0, r["code"], r["error"]) for r in coded.collect()) == [(0, "00" * 16, 0), (1, "00" * 16, 0), (1, "00" * 16, 0), (2, "02" * 16, 0)] and books.shape == (16, 4, 1)
    with pytest.raises(ValueError):
        codes.product_codes(vectors_of(spark, []), entries=257)


def test_bounds_spare_distances():
    """Bounds stay true through the rounds, and most entries are passed over by them."""
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 3, (2000, 1)) * 400 + rng.integers(-40, 40, (2000, 4))
    book, shape = codes.Book(x[:64].reshape(1, 64, 4).copy()), (len(x), 64)
    code, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), codes.LONGEST >> 2), np.zeros(shape, np.uint8)
    for turn in range(3):
        if turn:
            entries = book.entries.copy()
            for j in range(64):
                if (code == j).any():
                    entries[0, j] = x[code == j].sum(0) // (code == j).sum()
            moved = np.ceil(np.sqrt(((entries - book.entries) ** 2).sum(-1))).astype(np.int64)
            book = codes.Book(entries, moved, book.step)
            upper, lower = codes.shifted(book, 0, code, upper, lower)
        d = ((x[:, None] - book.entries[0]) ** 2).sum(-1)
        assert turn == 0 or ((upper**2 >= d[np.arange(len(x)), code]).all() and ((lower.astype(np.int64) * int(book.step[0])) ** 2 <= d).all())
        known, computed = codes.nearest(x, book.entries[0], book.apart[0], int(book.step[0]), code, upper, lower)
        assert (known == d.min(1)).all() and (code == d.argmin(1)).all()
        assert turn == 0 or computed < 0.25 * d.size
    assert codes.whole(pa.array([[1.5, -0.001], [2.0]], pa.list_(pa.float64())), 2).tolist() == [[384, -1], [512, 0]]
