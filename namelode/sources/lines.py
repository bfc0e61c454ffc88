"""Domain lists: text files with one name a line, and lines in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def read_lines(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """file, line_no (position order within the file), raw. Lines end at \\n only. strict: bad UTF-8 raises.

    A file is split for reading, so line_no orders lines but has gaps; ``numbered`` makes it dense.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"))
    if strict:
        lines = lines.withColumn("raw", F.when(F.is_valid_utf8("raw"), F.col("raw")).otherwise(F.raise_error(F.lit("a line is not UTF-8"))))
    # within a block rows come in file order, and the lower bits of the increasing id count them
    return lines.select("file", (F.col("block") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("line_no"), "raw")


def across_files(lines: DataFrame) -> DataFrame:
    """lines with a line_no that orders the lines of all files: files by name, lines by place. That of the first file stays."""
    files = lines.select("file").distinct()
    number = (F.row_number().over(Window.orderBy("file")) - 1).cast("long")  # a row a file
    within = F.when(number < 1 << 19, F.shiftleft(number, 44)).otherwise(F.raise_error(F.lit("more than 2^19 files")).cast("long"))
    numbered = files.select(F.col("file").alias("f"), within.alias("first"))
    place = F.when(F.col("line_no") < 1 << 44, F.col("line_no")).otherwise(F.raise_error(F.lit("a file of 16 TB or more")).cast("long"))
    return lines.join(numbered, F.col("file") == F.col("f")).select("file", (F.col("first") + place).alias("line_no"), "raw")


def lines_of(spark: SparkSession, raw: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(raw, 1)), "line_no long, raw string")


def scan(lines: DataFrame) -> DataFrame:
    """The lines that can be domains, trimmed (column s)."""
    return lines.withColumn("s", T.trim(F.col("raw"))).where(T.is_line(F.col("s")))


def count_lines(lines: DataFrame) -> DataFrame:
    return lines.select(T.trim(F.col("raw")).alias("s")).where(T.is_counted(F.col("s"))).agg(F.count("*").alias("n_lines"))


def batch_ids(scanned: DataFrame, order: str, size: int) -> DataFrame:
    """batch: scanned lines in order, size at a time, the last batch may be smaller.

    Ranks are global, so this sorts by range first and numbers within ranges.
    """
    parts = scanned.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    return parts.join(counts.select("part", "before"), "part").withColumn("batch", F.floor(place / size).cast("long")).drop("part", "before")
