"""Normalizing and judging domain names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.idna import to_ascii_column


class InvalidDomain(ValueError):
    pass


def normalize(rows: DataFrame, column: str = "raw", idna: bool = True) -> DataFrame:
    """Adds domain_exact, label, tld, len, has_hyphen and reject_reason (null for valid names).

    Only names that are not ASCII go through Python; ASCII names are their own ASCII form. They are gathered into as many partitions as
    their size asks for first, for every task with a Python step holds a worker, whether it has rows or not. The name and its parts are
    generated, not projected: a later filter on them would else repeat their expressions many times over.
    """
    rows = rows.select("*", F.explode(F.array(F.lower(T.strip_dot(T.trim(F.col(column)))))).alias("domain_exact"))
    if idna:
        ascii_only = T.is_ascii(F.col("domain_exact"))
        rows = rows.where(ascii_only | F.col("domain_exact").isNull()).unionByName(rows.where(~ascii_only).hint("rebalance").withColumn("domain_exact", to_ascii_column("domain_exact")))
    domain = F.col("domain_exact")
    rows = rows.select("*", F.inline(F.array(F.struct(T.label_of(domain).alias("label"), T.tld_of(domain).alias("tld")))))
    label = F.col("label")
    reason = F.when(label.isNull(), "no_dot").when(F.octet_length(label) > T.MAX_LABEL_BYTES, "label_too_long").when(label == "", "empty_label")
    return rows.withColumn("len", F.octet_length(label)).withColumn("has_hyphen", label.contains("-")).withColumn("reject_reason", reason)


def with_status(normalized: DataFrame) -> DataFrame:
    """status: the reason of rejection, the kind of junk, or ok."""
    label = F.col("label")
    return normalized.withColumn("status", F.coalesce("reject_reason", F.when(T.is_repeat_junk(label), "junk_repeat").when(T.is_numeric_junk(label), "junk_numeric").otherwise("ok")))
