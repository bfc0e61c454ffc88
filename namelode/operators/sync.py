"""The daily sync: removals, then additions that replace earlier documents of the same name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lines import scan
from .index import DOCS
from .normalize import normalize, with_status
from .segment import Segmenter, add_tokens


@dataclass(frozen=True)
class Delta:
    removed: DataFrame
    requests: DataFrame
    added: DataFrame
    filtered: DataFrame


def removals(lines: DataFrame) -> DataFrame:
    """Names to remove, one row a request: they must be valid, junk or not."""
    return normalize(scan(lines), "s").where("reject_reason is null").select("domain_exact")


def last_wins(rows: DataFrame) -> DataFrame:
    """One row a name, the one of the largest line_no; only the winner is gathered."""
    columns = [c for c in rows.columns if c != "domain_exact"]
    return rows.groupBy("domain_exact").agg(F.max_by(F.struct(*columns), "line_no").alias("w")).select("domain_exact", "w.*")


def additions(lines: DataFrame, segmenter: Segmenter, first_seq: int) -> DataFrame:
    """docs to add, one a name; doc_seq goes on from first_seq by line_no."""
    valid = last_wins(with_status(normalize(scan(lines), "s")).where("status = 'ok'"))
    return add_tokens(valid, segmenter).withColumn("doc_seq", F.lit(first_seq) + F.col("line_no")).select(*DOCS)


def delta(adds: DataFrame, removes: DataFrame, segmenter: Segmenter, first_seq: int) -> Delta:
    requests = removals(removes)
    judged = with_status(normalize(scan(adds), "s"))
    return Delta(requests.distinct(), requests, additions(adds, segmenter, first_seq), judged.where("status like 'junk%'"))


def apply(docs: DataFrame, change: Delta) -> DataFrame:
    """Removed names go first, then added ones replace what is left: a name in both files ends present."""
    gone = change.removed.unionByName(change.added.select("domain_exact")).distinct()
    return docs.join(gone, "domain_exact", "left_anti").select(*DOCS).unionByName(change.added)


def summary(docs: DataFrame, change: Delta) -> DataFrame:
    """initial, delete_requests, rows_removed, added, filtered, final, net_change, counted together in one pass over each list."""
    removed = change.removed.select("domain_exact", F.lit(True).alias("out"))
    names = change.added.select("domain_exact", F.lit(True).alias("new"))  # one row a name
    have = docs.select("domain_exact").join(removed, "domain_exact", "left").join(names, "domain_exact", "left").select(F.lit("have").alias("kind"), "out", "new")
    rows = have
    for kind, listed in (("requests", change.requests), ("added", change.added), ("filtered", change.filtered)):
        rows = rows.unionByName(listed.select(F.lit(kind).alias("kind")), allowMissingColumns=True)
    of = lambda kind, *more: F.count(F.when(F.expr(" and ".join([f"kind = '{kind}'", *more])), 1))
    counts = rows.agg(of("have").alias("initial"), of("requests").alias("delete_requests"), of("have", "out").alias("rows_removed"), of("added").alias("added"), of("filtered").alias("filtered"), (of("have", "out is null", "new is null") + of("added")).alias("final"))
    return counts.withColumn("net_change", F.col("final") - F.col("initial"))


def requested(change: Delta) -> dict:
    """delete_requests and filtered: what was asked for and what was turned down, whatever the index holds."""
    return {"delete_requests": change.requests.count(), "filtered": change.filtered.count()}
