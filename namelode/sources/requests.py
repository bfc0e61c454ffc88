"""Search requests as rows: qid, q, tld, lim, min_match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LIMIT = 50
QUERIES = "qid int, q string, tld string, lim int, min_match int"
BULK = "queries array<struct<q:string,tld:string,min_match:int>>, limit int"


def query_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return with_defaults(spark.createDataFrame(rows, QUERIES))


def with_defaults(queries: DataFrame) -> DataFrame:
    return queries.withColumn("lim", F.coalesce("lim", F.lit(DEFAULT_LIMIT))).withColumn("min_match", F.coalesce("min_match", F.lit(1)))


def from_json(bodies: DataFrame, column: str = "body", *keep: str) -> DataFrame:
    """The queries of bulk request bodies, numbered in their order, after the columns ``keep`` of their body; the limit is shared."""
    parsed = bodies.select(*keep, F.from_json(column, BULK).alias("b")).select(*keep, "b.limit", F.posexplode("b.queries").alias("qid", "x"))
    return with_defaults(parsed.select(*keep, F.col("qid").cast("int"), "x.q", "x.tld", F.col("limit").alias("lim"), "x.min_match"))
