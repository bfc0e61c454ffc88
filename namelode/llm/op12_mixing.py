"""Mixing sources to target weights: each source gives its budget of words, taken from its rows in a random order.

Rows get hash-random keys and are range-sorted by source and key. The words in front of a row are the sum of the slices
before its own, from a table with a row a slice and source, and of the rows before it in its slice. A source's budget is cut
out of that order: as many whole passes as it holds, then the rows up to the budget's last word, of which the last row gives only
the words that are left. So each source gives its target, rounded down, and a row is repeated once more at most than another.

Targets are the shares of the weights, but at most ``most`` times what a source has; what is cut off there goes to the others by
weight (water filling). Only sums over all sources come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, hash60, running_offsets, written
from .op01_sharding import CRC_SQL

WEIGHTS = (5, 2, 1)
MOST = 3
SLICE_ROWS = 50_000


SPACE = r"\x20\x09-\x0D"


def words_in(text: Column) -> Column:
    """How many runs of anything but ASCII white space; 0 for null. Each becomes one byte, so no list of words is built."""
    marks = F.rtrim(F.regexp_replace(text, rf"[{SPACE}]*+[^{SPACE}]++", "x"), F.lit(" \t\n\v\f\r"))
    return F.coalesce(F.octet_length(marks), F.lit(0)).cast("long")


def weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """sources with weight: the weights in turn by the source's place in code-point order, null last.

    Places are counted over ranges of sources, so that any number of them can be told apart.
    """
    ranged = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = running_offsets(ranged.groupBy("part").agg(F.count("*").alias("n")), [], "part", "n").select(F.col("part").alias("own_part"), "before")  # a row a task
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return ranged.join(before, F.col("part") == F.col("own_part")).select("source", "source_size", weight.cast("long").alias("weight"))


def with_targets(sources: DataFrame, most: int) -> DataFrame:
    """sources (source, source_size, weight) with target.

    Each turn stops the sources whose share of what is left is over ``most`` times their size; a turn brings one row to the driver.
    """
    cap = F.col("source_size") * most
    total = int(sources.agg(F.sum("source_size")).head()[0] or 0)
    left, free, stopped = total, None, F.lit(False)
    while True:
        row = sources.agg(F.sum(F.when(stopped, cap)), F.sum(F.when(~stopped, F.col("weight"))), F.count(F.when(stopped, 1))).head()
        left, share, count = total - int(row[0] or 0), int(row[1] or 0), row[2]
        if count == free or not share:
            break
        # whole numbers beyond a long, so that a tie is a tie
        over = F.col("weight").cast("decimal(38,0)") * F.lit(left).cast("decimal(20,0)") > cap.cast("decimal(38,0)") * F.lit(share).cast("decimal(18,0)")
        free, stopped = count, over
    by_weight = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(max(share, 1)))
    return sources.withColumn("target", F.when(stopped, cap.cast("double")).otherwise(by_weight))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each row the mix takes, repeats counted.

    The order depends on seed, id and text alone, so runs agree; rows that agree in both are alike in their sizes, and which of
    them is cut does not show. A null text has size 0, null ids are hashed as such, a null source is a source, the last. Repeated rows
    are rows of their own. Sources without words have target 0; an empty table gives an empty result. Other columns are not read.
    """
    if min(weights, default=0) < 1 or most < 1:
        raise ValueError("weights and most must be positive")
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(text).alias("size"), hash60(F.lit(seed), F.col(id_col), F.coalesce(F.crc32(text.cast("binary")), F.lit(0))).alias("key"))
    rows = written(rows, "sized")  # the texts are read once
    slices = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE_ROWS))
    # equal rows come in any order, so that many of them are still dealt over slices
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")]
    ranged = written(rows.withColumn("tie", F.rand(seed)).repartitionByRange(slices, *order, "tie").drop("tie").withColumn("slice", F.spark_partition_id()), "ranged")
    forget(rows)
    sums = running_offsets(ranged.groupBy("source", "slice").agg(F.sum("size").alias("n")), ["source"], "slice", "n")
    sources = written(weighted(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights), "weights")
    targets = with_targets(sources, most).withColumnRenamed("source", "t_source").drop("weight")
    own = sums.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), "before").join(targets, F.col("s_source").eqNullSafe(F.col("t_source")))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("slice", "source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("inside", inside).join(own, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
    passes = F.expr("cast(floor(target) as bigint) div greatest(source_size, 1L)")
    rest = F.floor("target") - passes * F.col("source_size")
    part = F.greatest(F.least(rest - F.col("before") - F.col("inside"), F.col("size")), F.lit(0))
    return placed.select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"))


def op12_query(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP12_SQL = f"""
WITH {CRC_SQL},
base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(crc, 0)::VARCHAR), 1, 15))::BIGINT AS key
  FROM documents LEFT JOIN crcs ON text = crc_text),
sources AS (SELECT source, sum(size)::BIGINT AS s, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w FROM base GROUP BY source),
filled AS (SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY 30 * s // w RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(w) OVER (ORDER BY 30 * s // w RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM sources),
rest AS (SELECT sum(s) - coalesce(sum(3 * s) FILTER (w * lft > 3 * s * share), 0) AS lft, sum(w) FILTER (w * lft <= 3 * s * share) AS share FROM filled),
targets AS (SELECT source, s, CASE WHEN w * f.lft > 3 * s * f.share THEN (3 * s)::DOUBLE ELSE w::DOUBLE * r.lft::DOUBLE / r.share::DOUBLE END AS target FROM filled f, rest r),
cut AS (SELECT b.*, t.s, t.target, floor(target)::BIGINT // greatest(s, 1) AS passes,
    coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s AS source_size, target, (passes * size + greatest(least(floor(target)::BIGINT - passes * s - before, size), 0))::BIGINT AS taken FROM cut
"""
