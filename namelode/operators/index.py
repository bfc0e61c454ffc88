"""The tables of an index: docs, postings and their statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .normalize import normalize, with_status
from .segment import Segmenter, add_tokens

DOCS = ["doc_seq", "domain_exact", "label", "tld", "len", "has_hyphen", "tokens"]


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    corpus: DataFrame
    terms: DataFrame
    #: Of a stored index: postings in blocks, how many documents of blocks may be gone at most, and the documents of
    #: some rows' doc_seqs. held: what searches keep until ``release``.
    blocks: DataFrame | None = None
    slack: int = 0
    docs_of: Callable[[DataFrame], DataFrame] | None = None
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()


def build_docs(lines: DataFrame, segmenter: Segmenter, order: str = "doc_seq", idna: bool = True) -> DataFrame:
    """docs of scanned lines (doc_seq, s): valid names that are no junk, as often as they come."""
    valid = with_status(normalize(lines, "s", idna)).where("status = 'ok'")
    return add_tokens(valid, segmenter).select(F.col(order).alias("doc_seq"), *DOCS[1:])


def postings_of(docs: DataFrame) -> DataFrame:
    """token, doc_seq, tf, dl: how often a term is in a document, and the document's number of terms.

    tf is counted inside each row, so nothing is shuffled here.
    """
    terms = docs.select("doc_seq", T.index_terms(F.col("tokens")).alias("terms")).where(F.size("terms") > 0)
    each = terms.select("doc_seq", "terms", F.explode(F.array_distinct("terms")).alias("token"))
    return each.select("token", "doc_seq", F.size(F.filter("terms", lambda t: t == F.col("token"))).alias("tf"), F.size("terms").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """n and avgdl over all documents, those without terms included."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(T.index_terms(F.col("tokens"))).cast("double")).alias("avgdl"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count("*").alias("df"))


def index_of(docs: DataFrame) -> Index:
    postings = postings_of(docs)
    return Index(docs, postings, corpus_stats(docs), term_stats(postings))
