"""Packing by cutting-stock column generation.

Tokenizing cuts each document into full pieces of the sequence length and one rest, so texts are tokenized once. Only the
histogram of piece lengths, at most one row a length class, reaches the driver. There a linear program over patterns (which
pieces share a sequence) is solved by the revised simplex method; an unbounded-knapsack dynamic program over the sequence
length prices new patterns until none improves the bound by more than GAP. Pattern counts are rounded down and what is left,
at most a few items a pattern, is packed best-fit decreasing. Patterns say how many sequences take how many pieces of each
class: a piece's rank within its class, computed by distributed counting, tells its sequence.

A class is a length rounded up to a multiple of a unit, the largest of UNITS that costs no more than ROUNDING of all tokens
as padding; so long pieces make few wide classes and short ones narrow classes. A sequence whose length is a power of two needs no padding; the plan does not count on that.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running_offsets, small_batches, tidy, written

UNITS, ROUNDING, GAP, DRIFT = (16, 8, 4, 2, 1), 4e-3, 1e-3, 1e-9
BATCH_COLUMNS = 4
BUCKET_ROWS = 4096
LEAST_BUCKETS, LEAST_ROWS = 512, 64  # a class is dealt over so many buckets even if it is small, down to so few rows each
LONG_SPACE = 20_000
MEMO_CHUNKS, MEMO_LENGTH = 150_000, 200
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
WIDE = re.compile(r"\s{%d}" % LONG_SPACE)
_loaded: dict[str, Ids] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Ids(dict):
    """Ids of whole texts as little-endian bytes; a memo of chunk -> its ids.

    A pre-token never goes on across a single space before a word, so a text without double spaces is the chunks between
    its single spaces. Texts with double spaces are encoded whole. The tokenizers library itself takes texts that name a
    special token or hold very long white space (the fast encoder would overflow its stack), and all texts of a file that
    is no plain byte-level vocabulary with merges in the order of the ids.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: what ByteLevel splits by

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self.fast_encoder(spec)
        self.old: dict[str, bytes] = {}

    def fast_encoder(self, spec: dict):
        import tiktoken

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and spec.get("normalizer") is None
        plain &= model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain:
            return None
        vocab, alphabet = model["vocab"], byte_alphabet()
        made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])) or any(c not in alphabet for p in vocab if p not in self.special for c in p):
            return None
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in vocab.items() if piece not in self.special}
        if any(bytes([b]) not in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("pieces", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def slow(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.pop(key, None)) is None:
            value = np.array(self.fast.encode_ordinary(key), "<u4").tobytes()
        if len(key) <= MEMO_LENGTH:  # so that the memo's bytes are bounded too
            self[key] = value
        return value

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.special) or (len(text) > LONG_SPACE and WIDE.search(text)):
            return self.slow(text)
        if "  " in text:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[" " + w] for w in rest])

    def trim(self) -> None:
        if len(self) > MEMO_CHUNKS:
            self.old = dict(self)
            self.clear()


def ids_of(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ids_of(tokenizer)
        for batch in batches:
            rows = []
            own.trim()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.encode(text.as_py() or "") + end
                n = len(ids) // 4
                rows += [(doc_id, a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)]), n) for a in range(0, n, capacity)]
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in PIECES.split(", ")])
        own.clear()
        own.old.clear()

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(tidy(run), PIECES)


def unit_of(lengths: dict[int, int], capacity: int) -> int:
    total = sum(n * k for n, k in lengths.items())
    waste = lambda u: sum((-n % u) * k for n, k in lengths.items())
    return next((u for u in UNITS if capacity % u == 0 and waste(u) <= ROUNDING * total), 1)


def priced_patterns(sizes: np.ndarray, worth: np.ndarray, capacity: int, most: int = BATCH_COLUMNS) -> tuple[float, list[np.ndarray]]:
    """The unbounded knapsack over sizes (ascending): its best value, and the best patterns that begin with different sizes."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        if k := upto[w]:
            value = worth[:k] + best[w - sizes[:k]]
            i = value.argmax()
            if value[i] > best[w - 1]:
                best[w], took[w] = value[i], i
                continue
        best[w] = best[w - 1]
    begun = worth + best[capacity - sizes]
    out = []
    for i in np.argsort(-begun, kind="stable")[:most]:
        counts, w = np.zeros(len(sizes), np.int64), capacity - int(sizes[i])
        counts[i] = 1
        while w > 0:
            if took[w] >= 0:
                counts[took[w]] += 1
                w -= int(sizes[took[w]])
            else:
                w -= 1
        out.append(counts)
    return float(best[capacity]), out


# The driver's matrix products and inverses are plain loops of numpy: the threads of a BLAS library can stand still for ever in
# a process that has started a JVM.


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of a vector and a matrix, or of a matrix and a vector."""
    return np.einsum("i,ij->j", a, b) if a.ndim == 1 else np.einsum("ij,j->i", a, b)


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots."""
    n = len(a)
    work = np.concatenate([a, np.eye(n)], 1)
    for i in range(n):
        p = i + int(np.abs(work[i:, i]).argmax())
        work[[i, p]] = work[[p, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        rows = np.flatnonzero(factor)
        work[rows] -= factor[rows, None] * work[i]
    return work[:, n:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = 8000) -> list[tuple[float, np.ndarray]]:
    """Patterns and how often to use each: the linear program's optimum up to gap (any stop leaves a feasible plan)."""
    m = len(sizes)
    unit = np.eye(m)
    basis, cost = unit * (capacity // sizes)[:, None], np.ones(m)  # a row a pattern; a pattern costs a sequence, a surplus nothing
    inverse = np.diag(1.0 / (capacity // sizes))
    use = times(inverse, demand)
    ideal = float((sizes * demand).sum()) / capacity

    def enter(column: np.ndarray, price: float) -> bool:
        nonlocal use, inverse
        if (times(cost, inverse) * column).sum() <= price + 1e-9:
            return False
        step = times(inverse, column)
        able = step > 1e-9
        ratio = np.where(able, use / np.where(able, step, 1), np.inf)
        r = int(ratio.argmin())
        if np.isfinite(ratio[r]):
            use = np.maximum(use - ratio[r] * step, 0)
            use[r] = ratio[r]
            row = inverse[r] / step[r]
            inverse -= step[:, None] * row
            inverse[r] = row
            basis[r], cost[r] = column, price
        return True

    center, pull, bound = sizes / capacity, 0.95, ideal  # prices by size alone are feasible; pulled towards them, prices settle sooner
    paid = lambda: float((cost * use).sum())
    since = paid()
    for turn in range(rounds):
        for i in np.flatnonzero(times(cost, inverse) < -1e-9):  # more of a class than asked for is allowed
            enter(-unit[i], 0.0)
        worth = pull * center + (1 - pull) * np.maximum(times(cost, inverse), 0)
        value, columns = priced_patterns(sizes, worth, capacity)
        bound = max(bound, float((worth * demand).sum()) / value)
        if paid() <= bound * (1 + gap):
            break
        if not any([enter(c, 1.0) for c in columns]):
            if pull == 0:
                break
            pull = 0 if pull < 0.1 else pull / 2
        if turn % 100 == 99:
            if np.abs(times(use, basis) - demand).max() > DRIFT * demand.max():  # against rounding errors
                inverse = inverted(basis.T)
                use = np.maximum(times(inverse, demand), 0)
            if (last := since - paid()) < max(gap / 5 * since, 0.05) and pull == 0:
                break
            pull, since = 0 if last < max(gap * since, 0.5) else pull, paid()
    return [(float(u), p.astype(np.int64)) for u, p, c in zip(use, basis, cost) if u > 1e-9 and c]


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    bins: list[np.ndarray] = []
    by_space: dict[int, list[int]] = {}
    for i in np.argsort(-sizes):
        for _ in range(int(left[i])):
            space = min((s for s, b in by_space.items() if s >= sizes[i] and b), default=None)
            if space is None:
                bins.append(np.zeros(len(sizes), np.int64))
                at, space = len(bins) - 1, capacity
            else:
                at = by_space[space].pop()
            bins[at][i] += 1
            by_space.setdefault(space - int(sizes[i]), []).append(at)
    return bins


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, last rank + 1, first sequence, pieces a sequence) for runs of ranks within each class."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes], np.int64)
    counted = [(int(u + 1e-6), p) for u, p in column_generation(sizes, demand.astype(float), capacity)]
    made = sum((n * p for n, p in counted), np.zeros(len(sizes), np.int64))
    counted += [(1, b) for b in best_fit(sizes, np.maximum(demand - made, 0), capacity)]
    rows, used, sequence = [], np.zeros(len(sizes), np.int64), 0
    for n, pattern in counted:
        if not n:
            continue
        for i in np.flatnonzero(pattern):
            until = min(int(used[i] + n * pattern[i]), int(demand[i]))
            if until > used[i]:
                rows.append((int(sizes[i]), int(used[i]), until, sequence, int(pattern[i])))
                used[i] = until
        sequence += n
    return rows


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Null and empty texts are the end id alone. Ids may be null or repeat: every row's ids are packed. An empty table gives
    an empty result. Other columns are not read. tokenizer: a file that every executor can open.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = written(pieces_of(docs, tokenizer, capacity, id_col=id_col, text_col=text_col), "pieces")
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each length up to the capacity at most
    unit, histogram = unit_of(lengths, capacity), Counter()
    for n, k in lengths.items():
        histogram[-(-n // unit)] += k
    pieces = pieces.withColumn("size", F.expr(f"(length + {unit - 1}L) div {unit}L"))
    classes = spark.createDataFrame([(s, max(-(-n // BUCKET_ROWS), min(-(-n // LEAST_ROWS), LEAST_BUCKETS))) for s, n in histogram.items()], "c_size long, buckets long")
    runs = spark.createDataFrame(plan(histogram, capacity // unit), "r_size long, lo long, hi long, base long, each long")
    keyed = pieces.join(F.broadcast(classes), F.col("size") == F.col("c_size")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32")).withColumn("bucket", F.pmod("h", "buckets"))
    counts = running_offsets(keyed.groupBy("size", "bucket").agg(F.count("*").alias("n")), ["size"], "bucket", "n").select(F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), "before")
    ties = ["h", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = keyed.join(counts, (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket"))).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("size", "bucket").orderBy(*ties)) - 1
    )
    placed = ranked.join(F.broadcast(runs), (F.col("size") == F.col("r_size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - lo) div each"))
    within = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
