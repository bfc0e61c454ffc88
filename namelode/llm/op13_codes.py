"""Product codes of vectors: Lloyd rounds for each part position, with Elkan's bounds.

Every vector is cut into equal consecutive parts, and each part position has a codebook of its own. Between rounds each part
keeps an upper bound of the distance to its entry and a lower bound of the distance to every entry. When entries move, the
upper bound grows and the lower ones shrink by the movement. An entry is passed over only if a bound says that it is
strictly farther than the part's own entry; all others are compared by whole squared distances, so ties go to the lower
index and the result is that of comparing everything.

All bounds are whole numbers, rounded to the safe side: upper ones up, lower ones down to multiples of a step that lets a byte
hold them (``step``; a longer distance is kept as 255 steps). State is one table in the shared folder a round; the codebooks and
their distances are broadcast (entries * components numbers, whatever the number of vectors).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SLICE_ROWS = 4096
EXACT = 1 << 50  # squared distances up to here are 64-bit numbers, and their roots are right in floating point
LONGEST = (1 << 63) - 1
STATE = "vec_id long, label string, v array<double>, code binary, upper binary, lower binary"


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(256 * x), ending in zeros: 64-bit numbers, or whole numbers of any size where those may not do."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(vectors.offsets.to_numpy())
    small = np.abs(flat).max(initial=0) < 1 << 40
    out = np.zeros((len(vectors), width), np.int64 if small else object)
    out[np.arange(width) < lengths[:, None]] = np.floor(256.0 * flat).astype(np.int64) if small else [math.floor(256 * x) if abs(x) < 1 << 60 else 256 * int(x) for x in flat.tolist()]
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def root_down(x: np.ndarray) -> np.ndarray:
    return np.floor(np.sqrt(x)).astype(np.int64)


def root_up(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.sqrt(x)).astype(np.int64)


@dataclass
class Book:
    """The entries (parts, entries, components of a part), how far they have moved, and the bounds between them."""

    entries: np.ndarray
    moved: np.ndarray | None = None
    step: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.most = max((abs(int(x)) for x in (self.entries.max(initial=0), self.entries.min(initial=0))), default=0)
        if self.is_small(self.most):
            self.entries = self.entries.astype(np.int64)
            self.apart = root_down(squared(self.entries[:, :, None], self.entries[:, None]))
            if self.step is None:  # so that a byte spans the codebook
                self.step = self.apart.max(axis=(1, 2), initial=0) // 255 + 1

    def is_small(self, most: int) -> bool:
        return 4 * max(most, 1) ** 2 * self.entries.shape[2] < EXACT


def all_distances(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance, in whole numbers of any size and without bounds."""
    x, entries = x.astype(object), entries.astype(object)
    best, code = squared(x, entries[0]), np.zeros(len(x), np.int64)
    for j in range(1, len(entries)):
        d = squared(x, entries[j])
        nearer = (d < best).astype(bool)
        best[nearer], code[nearer] = d[nearer], j
    return code, best


def nearest(x: np.ndarray, entries: np.ndarray, apart: np.ndarray, step: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
    """Brings code, upper and lower up to date for these entries; the squared distances, and how many were computed.

    upper and lower hold bounds for ``entries`` before; lower counts in steps.
    """
    known = np.full(len(x), -1, np.int64)  # the squared distance to the own entry, where it has been computed
    computed = 0

    def tighten(rows: np.ndarray) -> int:
        known[rows] = squared(x[rows], entries[code[rows]])
        upper[rows] = root_up(known[rows])
        return len(rows)

    for j in range(len(entries)):
        may = lambda rows: rows[(code[rows] != j) & (upper[rows] >= lower[rows, j].astype(np.int64) * step) & (2 * upper[rows] >= apart[code[rows], j])]
        rows = may(np.arange(len(x)))
        loose = rows[known[rows] < 0]
        if len(loose):
            computed += tighten(loose)
            rows = may(rows)
        if not len(rows):
            continue
        d = squared(x[rows], entries[j])
        computed += len(rows)
        lower[rows, j] = np.minimum(root_down(d) // step, 255)
        nearer = (d < known[rows]) | ((d == known[rows]) & (j < code[rows]))
        gone = rows[nearer]
        lower[gone, code[gone]] = np.minimum(root_down(known[gone]) // step, 255)
        code[gone], known[gone] = j, d[nearer]
        upper[gone] = root_up(known[gone])
    computed += tighten(np.flatnonzero(known < 0))
    return known, computed


def shifted(book: Book, p: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of part p after the entries have moved."""
    moved, step = book.moved[p], int(book.step[p])
    low = np.maximum(lower.astype(np.int64) * step - moved, 0) // step
    return upper + moved[code], low.astype(np.uint8)


def assigned(batch: pa.RecordBatch, book: Book, final: bool) -> pa.RecordBatch:
    """The rows' state after one assignment, or their codes and errors."""
    parts, k, size = book.entries.shape
    n, x = len(batch), whole(batch.column("v"), parts * size)
    small = x.dtype != object and book.is_small(max(book.most, int(np.abs(x).max(initial=0))))
    took = lambda name, kind, *shape: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, *shape).copy()
    before = book.moved is not None
    codes = took("code", np.uint8, parts) if before else np.zeros((n, parts), np.uint8)
    uppers = took("upper", np.int64, parts) if before else np.full((n, parts), LONGEST >> 2)
    lowers = took("lower", np.uint8, parts, k) if before else np.zeros((n, parts, k), np.uint8)
    error = np.zeros(n, object)
    for p in range(parts):
        own = x[:, p * size : (p + 1) * size]
        if small:
            code, upper, lower = codes[:, p].astype(np.int64), uppers[:, p], lowers[:, p]
            if before:
                upper, lower = shifted(book, p, code, upper, lower)
            d, _ = nearest(own, book.entries[p], book.apart[p], int(book.step[p]), code, upper, lower)
        else:  # no bounds are kept for such rows
            code, d = all_distances(own, book.entries[p])
            upper, lower = np.full(n, LONGEST >> 2), np.zeros((n, k), np.uint8)
        codes[:, p], uppers[:, p], lowers[:, p] = code, upper, lower
        error += d
    if final:
        return pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(int(e), LONGEST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])
    kept = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (codes, uppers, lowers)]
    return pa.record_batch([batch.column("vec_id"), batch.column("label"), batch.column("v"), *kept], ["vec_id", "label", "v", "code", "upper", "lower"])


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def one_round(rows: DataFrame, book: Broadcast, final: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield assigned(batch, book.value, final)

    return rows.mapInArrow(run, "vec_id long, label string, code string, error long" if final else STATE)


def moved_on(state: DataFrame, book: Book) -> Book:
    """The next codebook: each entry becomes the mean of its parts, components rounded down; unused ones stay.

    A task adds up its own rows, so at most a row a component of the codebook leaves it.
    """
    parts, k, size = book.entries.shape
    width = parts * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, size), object), np.zeros((parts, k), np.int64)
        for batch in sliced(batches):
            x = whole(batch.column("v"), width)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), parts)
            for p in range(parts):
                own = np.zeros((k, size), x.dtype)
                np.add.at(own, codes[:, p], x[:, p * size : (p + 1) * size])
                sums[p] += own
                counts[p] += np.bincount(codes[:, p], minlength=k)
        used = np.flatnonzero(np.repeat(counts.ravel(), size))
        out = [pa.array(used, pa.int64()), pa.array([Decimal(int(s)) for s in sums.ravel()[used]], pa.decimal128(38, 0)), pa.array(np.repeat(counts.ravel(), size)[used], pa.int64())]
        yield pa.record_batch(out, ["place", "total", "n"])

    found = state.select("v", "code").mapInArrow(run, "place long, total decimal(38,0), n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    entries = book.entries.astype(object).ravel()
    for r in found.collect():  # a row a component of the codebook
        entries[r["place"]] = int(r["total"]) // r["n"]
    entries = entries.reshape(book.entries.shape)
    moved = np.array([[math.isqrt(int(s) - 1) + 1 if s else 0 for s in part] for part in squared(entries, book.entries.astype(object))], object)
    bound = LONGEST >> 2
    return Book(entries, np.minimum(moved, bound).astype(np.int64), book.step)


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def product_codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label (as string), code, error of every usable vector, and the codebooks (parts, entries, components of a part).

    Vectors that are null or hold nulls or non-finite components take no part. Shorter vectors than the longest, and all of
    them where its length is no multiple of ``parts``, count as if zeros followed. Codebooks start from the smallest ids (null
    ids last, then by vector; rows that repeat an id each count); with fewer rows there are fewer entries. Rows that repeat are
    each coded. Components may be of any size; an error, or a label's errors, beyond a long are told as the largest long. An empty table gives an
    empty result and no entries. Other columns are not read.
    """
    if not (0 < parts and 0 < entries <= 256 and rounds >= 0):
        raise ValueError("parts and entries must be positive, a code is a byte")
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    width = -(-max(1, rows.agg(F.max(F.size("v"))).head()[0] or 0) // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    if not len(first):
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), np.zeros((parts, 0, width // parts), np.int64)
    book = Book(whole(first, width).reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    state = rows
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(book)
        now = written(one_round(state, shared, False), "bounds")
        forget(state)
        shared.destroy()
        state, book = now, moved_on(now, book)
    coded = written(one_round(state, spark.sparkContext.broadcast(book), True), "codes")
    forget(state)
    return coded, book.entries


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the errors of its label together (null labels too). Labels' sums are joined, no label is gathered."""
    sums = coded.groupBy(F.col("label").alias("own")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("own"))).drop("own")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def op13_query(spark, sf_dir: str) -> DataFrame:
    coded, books = product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assign_sql(book: str) -> str:
    return f"""SELECT r, p, x, best.e AS e, best.d AS d FROM (SELECT r, t.p AS p, x,
    min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS best
    FROM parts t JOIN {book} b ON t.p = b.p GROUP BY r, t.p, x)"""


def _update_sql(assigned: str, book: str) -> str:
    return f"""SELECT b.p AS p, b.e AS e, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (SELECT p, e, list(mean ORDER BY i) AS c FROM
    (SELECT p, e, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS mean FROM (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM {assigned}, (SELECT unnest(range(1, 5)) AS i) GROUP BY p, e, i))
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e"""


#: For vectors of 64 components, which the tables hold.
OP13_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[4 * p + 1 : 4 * p + 4] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 64),
assigned0 AS MATERIALIZED ({_assign_sql("book0")}),
book1 AS MATERIALIZED ({_update_sql("assigned0", "book0")}),
assigned1 AS MATERIALIZED ({_assign_sql("book1")}),
book2 AS MATERIALIZED ({_update_sql("assigned1", "book1")}),
assigned2 AS MATERIALIZED ({_assign_sql("book2")}),
codes AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM assigned2 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM codes JOIN kept USING (r), digest
"""
