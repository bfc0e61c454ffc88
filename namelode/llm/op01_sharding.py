"""Sharding by proportional stratified interleaving, with built-in functions only.

Rows of each source are put in a seeded random order and get the fractional rank (2r-1)/(2n). Sorting all rows by that
number interleaves the sources in proportion, so cutting the sorted rows into equal runs gives shards that all have the
mixture of the whole. The law kept is ``rows``: shard sizes differ by one row at most. Groups (equal texts) are not kept
together: a group that holds a third of all rows would break the law, and each copy is a row of its source's share.

Both rankings are distributed. A row's rank is the number of rows in smaller hash buckets, from a table of bucket counts,
plus its place within its bucket; so a source that holds a third of the rows is dealt over as many tasks as any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash60, running_offsets

ROW_BYTES = 16
BUCKET_ROWS = 100_000
MIN_BUCKET_BITS = 10


def bucket_bits(rows: int) -> int:
    return max(MIN_BUCKET_BITS, (max(1, rows // BUCKET_ROWS) - 1).bit_length())


def stratified_shards(docs: DataFrame, n_shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    Null texts have size 16 and CRC 0; a null source is a stratum of its own; null ids are ranked like any value. Repeated
    rows are each placed. With fewer rows than shards some shards stay empty; an empty table gives an empty result. Other
    columns are not read, whatever their names.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("source"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        # the text as well, so that rows without an id, or of one id, do not meet in one bucket
        hash60(F.lit(seed), F.col(id_col), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0))).alias("h"),
    )
    total = docs.count()
    bits = bucket_bits(total)
    rows = rows.withColumn("bucket", F.shiftright("h", 60 - bits))
    counts = running_offsets(rows.groupBy("source", "bucket").agg(F.count("*").alias("n")), ["source"], "bucket", "n")
    counts = counts.select(F.col("source").alias("c_source"), F.col("bucket").alias("c_bucket"), "before", "total")
    ties = ["h", "doc_id", "size", "text_crc32"]
    ranked = (
        rows.join(counts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket")))
        .withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("source", "bucket").orderBy(*ties)))
        .withColumn("frac", (2 * F.col("r") - 1) / (2 * F.col("total")))
        .select("doc_id", "source", "size", "text_crc32", "h", "frac", F.floor(F.col("frac") * (1 << bits)).alias("slice"))
    )
    before = running_offsets(ranked.groupBy("slice").agg(F.count("*").alias("n")), [], "slice", "n").select(F.col("slice").alias("c_slice"), F.col("before").alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("slice").orderBy("frac", F.col("source").asc_nulls_first(), *ties)) - 1
    placed = ranked.join(before, F.col("slice") == F.col("c_slice")).withColumn("place", place)
    placed = placed.withColumn("shard", F.expr(f"cast((place * {n_shards}L) div {max(total, 1)}L as int)"))
    start = F.expr(f"(cast(shard as bigint) * {total}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    return stratified_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 in SQL: a table of 256 entries from the polynomial, then one step a byte.
CRC_TABLE_SQL = """
crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i))"""


def crc_of(text: str) -> str:
    """SQL for the CRC-32 of an SQL expression's UTF-8, beside crc_table."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


CRC_SQL = f"""{CRC_TABLE_SQL},
crcs AS (SELECT text AS crc_text, {crc_of("text")} AS crc
  FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), crc_table)"""

OP1_SQL = f"""
WITH {CRC_SQL},
base AS (SELECT doc_id, source, coalesce(strlen(text), 0)::BIGINT + 16 AS size, coalesce(crc, 0)::BIGINT AS text_crc32,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(crc, 0)::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents LEFT JOIN crcs ON text = crc_text),
ranked AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS frac FROM base),
placed AS (SELECT *, row_number() OVER (ORDER BY frac, source NULLS FIRST, h, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS n FROM ranked),
cut AS (SELECT *, (place * 40) // n AS shard FROM placed)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (place - (shard * n + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cut
"""
