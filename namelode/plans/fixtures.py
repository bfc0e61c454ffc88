"""Domain lists made from the tables part and pages, with made-up edge cases, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segment import LookupSegmenter
from ..sources.requests import query_rows, with_defaults

EDGES = ["", "# comment", "nodot", ".com", "com.", "123456.com", "12345.com", "1.com", "aaaaa.net", "aaaa.net", "ababa.net", "1-2-3.org", "a-1-2.org", "-----.org", "1.2.com", "a.b.co.uk", "example.com..", "Example.COM", "example.com.", "x1" * 31 + "y.com", "x1" * 32 + ".com", "ab." * 90 + "com", "my-domain.net", "abc123.com"]
QUERIES = [(0, "gear", None, 5, None), (1, "small gear", "com", 3, None), (2, "red red bolt", None, 4, 2), (3, "small gear", "de", 50, None), (4, "gear", "io", 7, 0), (5, "  SMALL   Gear ", None, 5, None), (6, "zzzz", None, 5, None), (7, "gear", "", 5, None), (8, "small-gear", None, 5, None), (9, "  ", None, 5, None), (10, "blue widget", None, None, None)]
LOOKUPS = [(0, "Small-Gear.COM."), (1, "absent.example"), (2, "nodot"), (3, "example.com"), (4, "A.B.co.UK")]
NEW_LINES = [(5_000_001, "fresh-gear.com"), (5_000_002, "Fresh-Gear.com."), (5_000_003, "777777.com"), (5_000_004, "brandnew.io")]
GONE_LINES = [(5_000_001, "absent.example"), (5_000_002, "123456.com")]
FIRST_ADDED = 10_000_000


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, lbl, sfx, toks of each part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, name = F.col("p_partkey"), F.col("p_name")
    kind = key % 4
    lbl = F.when(kind == 0, F.replace(name, F.lit(" "), F.lit("-"))).when(kind == 1, F.replace(name, F.lit(" "), F.lit(""))).when(kind == 2, F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("-"), key.cast("string"))).otherwise(F.concat(F.replace(name, F.lit(" "), F.lit("")), key.cast("string")))
    sfx = F.element_at(F.array(*map(F.lit, ("com", "net", "org", "io", "de"))), (key % 5 + 1).cast("int"))
    toks = F.when(kind >= 2, F.concat(name, F.lit(" "), key.cast("string"))).otherwise(name)
    return part.select(key.alias("seq"), lbl.alias("lbl"), sfx.alias("sfx"), toks.alias("toks"))


def raw_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, raw."""
    seq, full = F.col("seq"), F.concat("lbl", F.lit("."), "sfx")
    parts = base(spark, sf_dir).select("seq", F.concat(F.when(seq % 13 == 0, "  ").otherwise(""), F.when(seq % 7 == 0, F.upper(full)).otherwise(full), F.when(seq % 11 == 0, ".").otherwise("")).alias("raw"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") + 1_000_000).alias("seq"), F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("raw"))
    edges = spark.createDataFrame([(2_000_000 + i, raw) for i, raw in enumerate(EDGES, 1)], "seq long, raw string")
    return parts.unionByName(pages).unionByName(edges)


def segmenter(spark: SparkSession, sf_dir: str) -> LookupSegmenter:
    parts = base(spark, sf_dir).select(F.col("lbl").alias("label"), F.split("toks", " ").alias("tokens"))
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract(host, r"^(.*)\.([^.]*)$", 1).alias("label"))
    return LookupSegmenter(parts.unionByName(pages.select("label", F.split("label", "[.-]").alias("tokens"))).dropDuplicates(["label"]))


def queries(spark: SparkSession) -> DataFrame:
    return query_rows(spark, QUERIES)


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each part: its name's words in several spellings, and settings made from its numbers."""
    key, name = F.col("p_partkey"), F.col("p_name")
    q = F.when(key % 5 == 0, F.upper(name)).when(key % 5 == 1, F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit(" \t")))).when(key % 5 == 2, F.concat(name, F.lit(" "), name)).when(key % 5 == 3, F.lit(" ")).otherwise(F.split(name, " ")[0])
    tld = F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, "com").otherwise("")
    return with_defaults(spark.read.parquet(f"{sf_dir}/part.parquet").select(key.cast("int").alias("qid"), q.alias("q"), tld.alias("tld"), F.when(key % 4 != 0, F.col("p_size").cast("int")).alias("lim"), F.when(key % 7 != 0, (key % 3).cast("int")).alias("min_match")))


def sync_lines(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """adds and removes (line_no, raw)."""
    own = docs.where("doc_seq < 1000000").select(F.col("doc_seq").alias("line_no"), F.col("domain_exact").alias("raw"))
    adds = own.where("line_no % 10 in (3, 4) and line_no % 3 = 0").unionByName(spark.createDataFrame(NEW_LINES, "line_no long, raw string"))
    return adds, own.where("line_no % 10 = 3").unionByName(spark.createDataFrame(GONE_LINES, "line_no long, raw string"))
