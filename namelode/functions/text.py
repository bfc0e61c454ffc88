"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LINE_BYTES = 253
MAX_LABEL_BYTES = 63
MAX_TERM_BYTES = 40


def trim(c: Column) -> Column:
    """Unicode white space at both ends goes."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_dot(c: Column) -> Column:
    return F.regexp_replace(c, r"\.$", "")


def is_line(c: Column) -> Column:
    """Whether a trimmed line can be a domain: not blank, no comment, with a dot, at most 253 bytes."""
    return (c != "") & ~c.startswith("#") & c.contains(".") & (F.octet_length(c) <= MAX_LINE_BYTES)


def is_counted(c: Column) -> Column:
    """The progress estimate does not look at the length."""
    return (c != "") & ~c.startswith("#") & c.contains(".")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def label_of(domain: Column) -> Column:
    return F.when(domain.contains("."), F.regexp_extract(domain, r"(?s)^(.*)\.([^.]*)$", 1))


def tld_of(domain: Column) -> Column:
    return F.when(domain.contains("."), F.regexp_extract(domain, r"(?s)^(.*)\.([^.]*)$", 2))


def is_numeric_junk(label: Column) -> Column:
    """A digit first and nothing but digits and hyphens; this includes labels of digits alone."""
    return label.rlike("^[0-9][0-9-]*$")


def is_repeat_junk(label: Column) -> Column:
    return (F.octet_length(label) >= 5) & (F.replace(label, F.substring(label, 1, 1), F.lit("")) == "")


def is_junk(label: Column) -> Column:
    return is_numeric_junk(label) | is_repeat_junk(label)


def id48(domain: Column) -> Column:
    """The first six bytes of the MD5, as a number."""
    return F.conv(F.substring(F.md5(domain), 1, 12), 16, 10).cast("bigint")


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def split_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def query_tokens(q: Column) -> Column:
    """Lower case first, then white space; duplicates stay."""
    return split_tokens(F.lower(q))


def index_terms(tokens: Column) -> Column:
    """Lower-cased runs of letters and digits under 40 bytes, duplicates included."""
    flat = F.flatten(F.transform(tokens, lambda t: F.split(F.lower(t), r"[^\p{L}\p{N}]+")))
    return F.filter(flat, lambda t: (t != "") & (F.octet_length(t) < MAX_TERM_BYTES))


def combined_score(match_count: Column, length: Column, bm25: Column) -> Column:
    return match_count.cast("double") / 10 * 100 + (1 - length.cast("double") / 63) * 10 + F.least(bm25, F.lit(20.0)) / 20


def cache_key(q: Column, tld: Column, limit: Column, min_match: Column) -> Column:
    return F.concat_ws("|", F.concat(F.lit("search:"), q), F.coalesce(tld, F.lit("any")), limit.cast("string"), F.coalesce(min_match, F.lit(1)).cast("string"))


def facet_path(tld: Column) -> Column:
    return F.concat(F.lit("/"), tld)
