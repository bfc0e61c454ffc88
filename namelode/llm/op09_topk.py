"""Exact top-k inner products by MaxScore.

A dimension is a query term; its posting list in a shard holds the vectors that are not zero there, with their values (a list
that nearly all vectors are in is kept as a column). For each query the terms are ordered by how much they can add (the
larger of q*min and q*max over the shard). The terms whose bounds together stay under the k-th best score known so far are
non-essential: no vector gets in by them alone. The lists of the essential terms are traversed first, and only the vectors
that they hold are candidates. The others are probed, most telling first, only for candidates whose score so far plus the
bounds left still competes.

Queries are broadcast in blocks of bounded bytes. Each task reads its vectors once a block, a shard of bounded size at a time,
and carries each query's k best, and so its threshold, from shard to shard; a window merges the tasks' results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD_ROWS = 16_384
BLOCK_BYTES = 32 << 20
PROBE_TERMS = 8
SPARSE = 0.25
EXACT = 2.0**53
OUT = "query_id long, vec_id long, score long"


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows floor(256 * x); shorter vectors end in zeros."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width))
    out[np.arange(width) < lengths[:, None]] = np.floor(256.0 * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


class Shard:
    """The posting lists of some vectors (rows: vectors), and what each dimension can add."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.low, self.high = (f(0, initial=0) for f in (vectors.min, vectors.max)) if len(vectors) else (np.zeros(vectors.shape[1]),) * 2
        self.lists = []
        for column in np.ascontiguousarray(vectors.T):
            rows = np.flatnonzero(column)
            self.lists.append((rows, column[rows]) if len(rows) < SPARSE * len(column) else (None, column))

    def traverse(self, query: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the terms' lists add up to for each vector, and the vectors that are in any of them."""
        score, seen = np.zeros(len(self.ids), self.vectors.dtype), np.zeros(len(self.ids), bool)
        for t in terms:
            rows, values = self.lists[t]
            if rows is None:
                score += query[t] * values
                seen[:] = True
            else:
                score[rows] += query[t] * values
                seen[rows] = True
        return score, np.flatnonzero(seen)

    def probe(self, query: np.ndarray, terms: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (self.vectors[rows[:, None], terms] * query[terms]).sum(1)


def kth(scores: np.ndarray, k: int):
    """The k-th best of scores; minus infinity if there are fewer."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf


def maxscore(query: np.ndarray, own: int, shard: Shard, k: int, theta: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (rows of the shard, not of id ``own``) that may be among the k best, and their scores. theta: a k-th best score
    known already; vectors under it are left out, those that tie with it stay."""
    bound = np.maximum(query * shard.low, query * shard.high)
    order = np.argsort(-bound, kind="stable")
    left = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # of this term and all after it
    first = np.flatnonzero(shard.ids[: 8 * k] != own)
    theta = max(theta, kth(shard.probe(query, order, first), k))
    e = int((left[:-1] >= theta).sum())  # left falls, so the essential terms are the first
    score, rows = shard.traverse(query, order[:e])
    if e == len(order):  # every list counts: vectors in none of them score 0
        rows = np.arange(len(shard.ids))
    rows = rows[(shard.ids[rows] != own) & (score[rows] + left[e] >= theta)]
    have = score[rows]
    if e < len(order) and len(rows) > k:  # those that lead on the essential terms give a better k-th score to prune by
        lead = np.argpartition(-have, k - 1)[:k]
        theta = max(theta, (have[lead] + shard.probe(query, order[e:], rows[lead])).min())
    for i in range(e, len(order), PROBE_TERMS):
        have = have + shard.probe(query, order[i : i + PROBE_TERMS], rows)
        keep = have + left[min(i + PROBE_TERMS, len(order))] >= theta
        rows, have = rows[keep], have[keep]
    if len(rows) > k:
        keep = have >= kth(have, k)
        rows, have = rows[keep], have[keep]
    return rows, have


def exact_type(widest: float) -> type:
    """Floating point while all sums are exact in it, else whole numbers of any size."""
    return np.float64 if widest < EXACT else object


def as_exact(rows: np.ndarray, kind: type) -> np.ndarray:
    return rows if kind is np.float64 else np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape)


class Best:
    """The k best so far of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = ids, queries, k
        self.found: list[list[tuple]] = [[] for _ in ids]

    def take(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        width = max(vectors.shape[1], self.queries.shape[1])
        vectors, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, self.queries))
        kind = exact_type(float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(width, 1))
        shard, queries = Shard(as_exact(vectors, kind), ids), as_exact(queries, kind)
        for own, query, found in zip(self.query_ids.tolist(), queries, self.found):
            theta = -found[-1][0] if len(found) >= self.k else -np.inf
            rows, scores = maxscore(query, own, shard, self.k, theta)
            if len(rows):
                found[:] = sorted([*found, *zip([-int(s) for s in scores], ids[rows].tolist())])[: self.k]

    def table(self) -> pa.RecordBatch:
        rows = [(q, v, -s) for q, found in zip(self.query_ids.tolist(), self.found) for s, v in found]
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], ["query_id", "vec_id", "score"])


def search(rows: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """Each task's k best rows for each of the asked queries (a table of bounded size)."""
    width = max(asked["v"].combine_chunks().value_lengths().to_pylist(), default=0)
    shared = rows.sparkSession.sparkContext.broadcast((asked["vec_id"].to_numpy(), matrix(asked["v"], width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*shared.value, k)
        own: list[pa.RecordBatch] = []

        def flush() -> None:
            table = pa.Table.from_batches(own)
            width = max(table["v"].combine_chunks().value_lengths().to_pylist(), default=0)
            best.take(matrix(table["v"], width), table["vec_id"].to_numpy())
            own.clear()

        for batch in batches:
            for i in range(0, len(batch), SHARD_ROWS):
                own.append(batch.slice(i, SHARD_ROWS))
                if sum(map(len, own)) >= SHARD_ROWS:
                    flush()
        if own:
            flush()
        yield best.table()

    return rows.mapInArrow(run, OUT)


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k best rows of embeddings, ties to the smaller id.

    Null ids and vectors that are null or hold nulls or non-finite components take no part. A query never finds rows of its
    own id; an id repeated among queries is asked once, with the smallest of its vectors, while repeated candidates each
    count. Vectors of unequal lengths are compared as if zeros followed; an empty vector scores 0. Scores are exact whatever
    the size of the components; one that no long can hold is an error. Other columns are not read.
    """
    spark = embeddings.sparkSession
    usable = F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    pick = lambda t: t.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(usable)
    rows, asked = pick(embeddings), pick(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, size = asked.agg(F.count("*"), F.sum(F.size("v") * 8 + 16)).head()
    blocks = max(1, -(-int(size or 0) // BLOCK_BYTES))
    # the work is rows times queries, so vectors are dealt evenly; with several blocks they are dealt once, into a table
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // (8 * SHARD_ROWS)))
    rows = rows.repartition(shards)
    if blocks > 1:
        rows, asked = written(rows, "vectors"), written(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "queries")
    found = None
    for b in range(blocks):
        part = search(rows, (asked if blocks == 1 else asked.where(F.col("block") == b).drop("block")).toArrow(), k)
        part = part if blocks == 1 else written(part, "found")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
