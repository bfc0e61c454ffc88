"""WARC revisits: a not-modified capture takes its content from the latest earlier full response of the same URL.

An as-of join by canonical URL in built-in functions. The last response of each URL and time is aggregated first, so captures
that share a time are one row. The times of a URL are cut into as many slices as it has BUCKET_ROWS of them, so a URL with a
third of all captures is dealt over many tasks. The last response of each slice is aggregated, a window over slices carries
it into later ones, and within a slice a window finds the rest. The revisits are then joined with their URL and time, the
validators are compared and the headers that a not-modified answer may change are taken from it.

The capture table is read from WARC files by ``warc_records``; the registered query makes one from ``pages``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4096
#: Header fields that a 304 answer updates in a stored response (HTTP caching); the content's own fields stay.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and user, a port that is not the scheme's own, path without a last slash, sorted query
    without utm_ fields. The scheme does not count."""
    part = lambda n: F.regexp_extract(url, r"^([A-Za-z]+)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)(?::0*([0-9]*))?", n)
    host, port = F.regexp_replace(F.lower(part(2)), r"^www\.", ""), part(3)
    own = F.when(F.lower(part(1)) == "https", "443").otherwise("80")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    fields = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, F.when((port != "") & (port != own), F.concat(F.lit(":"), port)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def header_map(block: Column) -> Column:
    """Fields of a header block by lower-cased name; of repeated names the last stays."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])))


def merged_headers(stored: Column, revisit: Column) -> Column:
    """The stored fields, with permitted ones of the revisit in their place or added; 'name: value' lines by name."""
    names = F.array_sort(F.array_union(F.map_keys(stored), F.filter(F.map_keys(revisit), lambda n: n.isin(PERMITTED))))
    value = lambda n: F.coalesce(F.when(n.isin(PERMITTED), F.element_at(revisit, n)), F.element_at(stored, n))
    return F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(": "), value(n))), "\n")


def plain_tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records: record_id, kind (response or revisit), url, ts, headers, digest. A row for each revisit: record_id, canonical,
    outcome, source_id, source_ts, digest, headers.

    outcome: ``resolved`` (entity tags equal by weak comparison, or, where the revisit has none, the same Last-Modified),
    ``validator_mismatch`` (the latest earlier response has others), ``no_validator`` (the revisit has neither) or
    ``no_response`` (nothing earlier). Only resolved revisits have a digest and merged headers. Earlier is a smaller ts; of
    responses at one ts the largest record_id counts. Rows with a null url or ts are never joined: such revisits are
    ``no_response``. Repeated rows each give a row. Other columns are not read.
    """
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), header_map(F.col("headers")).alias("fields"), "digest")
    usable = rows.where("canonical is not null and ts is not null")
    response = F.when(F.col("kind") == "response", F.struct("ts", "record_id", F.element_at("fields", "etag").alias("etag"), F.element_at("fields", "last-modified").alias("modified"), "digest", F.map_entries("fields").alias("fields")))
    # of all captures of a URL at one time only the last response counts, so the windows run over times, not captures
    times = usable.withColumn("full", response).groupBy("canonical", "ts").agg(F.max("full").alias("best"))
    spans = times.groupBy("canonical").agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.ceil(F.count("*") / BUCKET_ROWS).alias("slices")).withColumnRenamed("canonical", "c")
    keyed = times.join(spans, F.col("canonical") == F.col("c")).withColumn("slice", F.floor((F.col("ts") - F.col("low")) * F.col("slices") / (F.col("high") - F.col("low") + 1))).drop("c", "low", "high", "slices")
    last = keyed.where("best is not null").groupBy("canonical", "slice").agg(F.max("best").alias("best"))
    slices = keyed.select("canonical", "slice").distinct().join(last, ["canonical", "slice"], "left")
    before = lambda order: F.last("best", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    carried = slices.withColumn("carry", before(Window.partitionBy("canonical").orderBy("slice"))).select(F.col("canonical").alias("c"), F.col("slice").alias("s"), "carry")
    near = keyed.withColumn("near", before(Window.partitionBy("canonical", "slice").orderBy("ts")))
    known = near.join(carried, (F.col("canonical") == F.col("c")) & (F.col("slice") == F.col("s"))).select(F.col("canonical").alias("k"), F.col("ts").alias("t"), F.coalesce("near", "carry").alias("source"))
    found = usable.where("kind = 'revisit'").join(known, (F.col("canonical") == F.col("k")) & (F.col("ts") == F.col("t"))).select("record_id", "canonical", "fields", "source")
    lost = rows.where("kind = 'revisit' and (canonical is null or ts is null)").select("record_id", "canonical", "fields").withColumn("source", F.lit(None).cast(found.schema["source"].dataType))
    every = found.unionByName(lost)
    etag, modified = F.element_at("fields", "etag"), F.element_at("fields", "last-modified")
    same = F.when(etag.isNotNull(), plain_tag(etag) == plain_tag(F.col("source.etag"))).otherwise(modified == F.col("source.modified"))
    outcome = F.when(F.col("source").isNull(), "no_response").when(etag.isNull() & modified.isNull(), "no_validator").when(F.coalesce(same, F.lit(False)), "resolved").otherwise("validator_mismatch")
    done = every.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return done.select("record_id", "canonical", "outcome", F.col("source.record_id").alias("source_id"), F.col("source.ts").alias("source_ts"), F.when(ok, F.col("source.digest")).alias("digest"), F.when(ok, merged_headers(F.map_from_entries("source.fields"), F.col("fields"))).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture history of pages: each is fetched, some are fetched again changed, and all are revisited at another spelling
    of their URL, some too early or with other validators."""
    p = F.col("page_id")
    tag = lambda version: F.concat(F.lit('"'), F.substring(F.md5(F.concat("html", F.lit(version))), 1, 16), F.lit('"'))
    day = lambda n: F.concat(F.lit("day "), n.cast("string"))
    block = lambda *fields: F.concat_ws("\r\n", *[F.concat(F.lit(k + ": "), v) for k, v in fields])
    ts = 1000 * (p % 1009)
    spelled = F.regexp_replace(F.regexp_replace("url", "^https?://(?:www[.])?([^/?#]*)", "HTTP://WWW.$1:80"), "[?].*$", "?utm_medium=mail")
    spelled = F.concat(F.when(F.col("url").contains("?"), F.col("url")).otherwise(spelled), F.when(F.col("url").contains("#"), "").otherwise("#part"))
    full = lambda n, at, version: F.struct((4 * p + n).alias("record_id"), F.lit("response").alias("kind"), F.col("url"), at.alias("ts"), block(("ETag", tag(version)), ("Last-Modified", day(p % 50)), ("Content-Type", F.lit("text/html")), ("Date", day(at))).alias("headers"), F.md5(F.concat("html", F.lit(version))).alias("digest"))
    asked = F.when(p % 11 == 0, F.lit('"other"')).when(p % 5 == 0, tag("b")).otherwise(F.concat(F.lit("W/"), tag("a")))
    at = F.when(p % 7 == 0, ts - 5).otherwise(ts + 500)
    revisit = F.struct((4 * p + 2).alias("record_id"), F.lit("revisit").alias("kind"), spelled.alias("url"), at.alias("ts"), F.when(p % 3 == 1, block(("Last-Modified", day(p % 50)), ("Content-Type", F.lit("text/plain")), ("Date", day(at)))).when(p % 13 == 0, block(("Date", day(at)))).otherwise(block(("ETag", asked), ("Cache-Control", F.lit("max-age=60")), ("Content-Length", F.lit("0")), ("Date", day(at)))).alias("headers"), F.lit(None).cast("string").alias("digest"))
    again = F.when(p % 5 == 0, F.array(full(1, ts + 300, "b")))
    return pages.select(F.inline(F.concat(F.array(full(0, ts, "a"), revisit), F.coalesce(again, F.array().cast(full_type())))))


RECORDS = "record_id long, kind string, url string, ts long, headers string, digest string"


def records_of(stream, name: str) -> Iterator[tuple]:
    """The response and revisit records of a WARC stream: id (of the record's own), kind, url, ts (milliseconds), the HTTP header
    block, the payload's digest. Bodies are passed over in bounded pieces, and hashed where the record names no digest."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record where one should begin: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        left = int(fields["content-length"])
        kind = fields.get("warc-type")
        wanted = kind in ("response", "revisit") and fields.get("content-type", "application/http").startswith("application/http")
        head, digest = [], hashlib.sha1()
        while wanted and left and (line := stream.readline(left)):  # the HTTP header block, up to its empty line
            left -= len(line)
            if not line.strip():
                break
            head.append(line)
        while left:
            piece = stream.read(min(left, 1 << 20))
            if not piece:
                raise ValueError(f"{name}: the last record is cut off")
            digest.update(piece)
            left -= len(piece)
        if kind in ("response", "revisit"):
            at = datetime.fromisoformat(fields["warc-date"].replace("Z", "+00:00"))
            own = int(hashlib.md5(fields.get("warc-record-id", "").encode()).hexdigest()[:15], 16)
            said = fields.get("warc-payload-digest") or (f"sha1:{base64.b32encode(digest.digest()).decode()}" if kind == "response" else None)
            yield own, kind, fields.get("warc-target-uri", "").strip("<>") or None, int(at.timestamp() * 1000), b"".join(head[1:]).decode("latin-1"), said


def warc_records(paths: DataFrame) -> DataFrame:
    """The capture table of WARC files (column path, plain or .gz), for resolve_revisits. A task reads a file from end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        names, types = [x.split()[0] for x in RECORDS.split(", ")], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)
                    found = records_of(stream, path)
                    while rows := list(itertools.islice(found, 1000)):
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return paths.select("path").mapInArrow(run, RECORDS)


def full_type() -> str:
    return "array<struct<record_id:bigint,kind:string,url:string,ts:bigint,headers:string,digest:string>>"


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP5_SQL = r"""
WITH p AS (SELECT *, 1000 * (page_id % 1009) AS t, '"' || substr(md5(html || 'a'), 1, 16) || '"' AS tag_a, '"' || substr(md5(html || 'b'), 1, 16) || '"' AS tag_b, 'day ' || (page_id % 50) AS modified FROM pages),
responses AS (SELECT 4 * page_id AS record_id, url, t AS ts, tag_a AS etag, modified, md5(html || 'a') AS digest FROM p
  UNION ALL SELECT 4 * page_id + 1, url, t + 300, tag_b, modified, md5(html || 'b') FROM p WHERE page_id % 5 = 0),
revisits AS (SELECT 4 * page_id + 2 AS record_id, url || CASE WHEN url LIKE '%#%' THEN '' ELSE '#x' END AS url, CASE WHEN page_id % 7 = 0 THEN t - 5 ELSE t + 500 END AS ts,
    CASE WHEN page_id % 3 = 1 OR page_id % 13 = 0 THEN NULL WHEN page_id % 11 = 0 THEN '"other"' WHEN page_id % 5 = 0 THEN tag_b ELSE tag_a END AS asked,
    CASE WHEN page_id % 3 = 1 THEN modified END AS asked_modified, NOT (page_id % 3 = 1 OR page_id % 13 = 0) AS has_cache FROM p),
a AS (SELECT url, regexp_extract(url, '^([A-Za-z]+)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)(?::0*([0-9]*))?', ['scheme', 'host', 'port']) AS a FROM (SELECT url FROM responses UNION SELECT url FROM revisits)),
c AS (SELECT url, regexp_replace(lower(a.host), '^www\.', '') || CASE WHEN a.port NOT IN ('', CASE WHEN lower(a.scheme) = 'https' THEN '443' ELSE '80' END) THEN ':' || a.port ELSE '' END || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS head,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query
  FROM a),
k AS (SELECT url, head || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM c),
r AS (SELECT revisits.*, canonical FROM revisits JOIN k USING (url)), s AS (SELECT responses.*, canonical FROM responses JOIN k USING (url)),
j AS (SELECT r.record_id, r.canonical, r.ts, asked, asked_modified, has_cache, s.record_id AS source_id, s.ts AS source_ts, s.etag, s.modified, s.digest,
    CASE WHEN s.record_id IS NULL THEN 'no_response' WHEN asked IS NULL AND asked_modified IS NULL THEN 'no_validator' WHEN coalesce(asked = s.etag, asked_modified = s.modified) THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM r ASOF LEFT JOIN s ON r.canonical = s.canonical AND r.ts > s.ts)
SELECT record_id, canonical, outcome, source_id, source_ts, CASE WHEN outcome = 'resolved' THEN digest END AS digest,
  CASE WHEN outcome = 'resolved' THEN (CASE WHEN has_cache THEN 'cache-control: max-age=60' || chr(10) ELSE '' END) || 'content-type: text/html' || chr(10) || 'date: day ' || ts || chr(10) ||
    'etag: ' || CASE WHEN asked IS NULL THEN etag WHEN asked = etag AND source_id % 4 = 0 THEN 'W/' || etag ELSE etag END || chr(10) || 'last-modified: ' || modified END AS headers
FROM j
"""
