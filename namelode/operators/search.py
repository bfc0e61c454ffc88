"""Ranked search: candidates by BM25, then match counts, an early stop, and hyphenated and plain names in turn.

One plan serves one query or many. The order of steps is the semantics: the top-level domain is looked at only after the
candidates have been cut by score, and ranks are carried as columns, never as row order.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import MOST_CANDIDATES
from .index import Index, term_stats

K1, B = 1.2, 0.75
RESULT = ["qid", "pos", "domain", "label", "tld", "length", "has_hyphen", "tokens", "match_count", "score", "total_candidates"]


def tokenized(queries: DataFrame) -> DataFrame:
    """queries with qtokens, n_tokens and candidate_limit; blank queries go."""
    n = F.col("n_tokens")
    rows = queries.withColumn("qtokens", T.query_tokens(F.col("q"))).withColumn("n_tokens", F.size("qtokens")).where("n_tokens > 0")
    return rows.withColumn("candidate_limit", F.least(F.col("lim") * F.when(n == 1, 20).otherwise(50), F.when(F.col("tld").isNull(), 1000).otherwise(MOST_CANDIDATES)))


def query_tokens(queries: DataFrame) -> DataFrame:
    """qid, token, times: each token with how often the query has it."""
    return queries.select("qid", F.explode("qtokens").alias("token")).groupBy("qid", "token").agg(F.count("*").alias("times"))


def weighted(rows: DataFrame) -> DataFrame:
    """rows (times, df, tf, dl, n_docs, avgdl) with w, what a posting adds to the score."""
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return rows.withColumn("w", F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))


def asked_tokens(queries: DataFrame, terms: DataFrame, corpus: DataFrame) -> DataFrame:
    return query_tokens(queries).join(terms, "token").crossJoin(F.broadcast(corpus.withColumnRenamed("n", "n_docs")))  # one row


def scored(queries: DataFrame, index: Index) -> DataFrame:
    """qid, doc_seq, score for documents with any token of the query. Only the query's tokens' postings are read and counted.

    A stored index leaves out documents that can't be among the query's candidates.
    """
    if index.blocks is not None:
        return scored_by_blocks(queries, index)
    own = index.postings.join(query_tokens(queries).select("token").distinct(), "token", "left_semi")
    rows = weighted(own.join(asked_tokens(queries, term_stats(own), index.corpus), "token"))
    return rows.groupBy("qid", "doc_seq").agg(F.round(F.sum("w"), 6).alias("score"))


def competing_blocks(queries: DataFrame, index: Index) -> DataFrame:
    """qid, token, tf, dl, base, zone, w of the blocks that may hold candidates. No posting is read for it.

    All postings of a block weigh the same. A token's heaviest blocks that hold a query's number of candidates show that the
    last candidate scores as much as the last of them at least. A block is skipped if its weight and the most that the query's
    other tokens can add stay below that, and, for a query of one token, if there are enough candidates in blocks before it.
    """
    heads = index.blocks.select("token", "tf", "dl", "base", "zone", "n")
    need = F.col("candidate_limit") + index.slack  # so many, whatever is gone
    rows = weighted(heads.join(asked_tokens(queries, index.terms, index.corpus), "token")).join(queries.select("qid", "candidate_limit"), "qid")
    rows = rows.repartition("qid").withColumn("shown", F.round("w", 6))  # one exchange for all windows; a row a block
    token = Window.partitionBy("qid", "token")
    place = ["shown", "base", "zone"]
    upto = F.sum("n").over(token.orderBy(F.col("shown").desc(), "base", "zone"))  # with those of the same weight and place
    rows = rows.withColumn("upto", upto).withColumn("ahead", F.col("upto") - F.sum("n").over(Window.partitionBy("qid", "token", *place)))
    rows = rows.withColumn("most", F.max("w").over(token)).withColumn("first", F.row_number().over(token.orderBy(F.col("w").desc())) == 1)
    query = Window.partitionBy("qid")
    least = F.coalesce(F.max(F.when(F.col("upto") >= need, F.col("w"))).over(query), F.lit(0.0))
    total = F.sum(F.when(F.col("first"), F.col("most"))).over(query)
    n_own = F.sum(F.col("first").cast("int")).over(query)
    rows = rows.withColumn("bound", F.col("w") + total - F.col("most")).withColumn("least", least).withColumn("n_own", n_own)
    return rows.where((F.col("bound") >= F.col("least") - 1e-5) & ((F.col("n_own") > 1) | (F.col("ahead") < need))).select("qid", "token", "tf", "dl", "base", "zone", "w")


def scored_by_blocks(queries: DataFrame, index: Index) -> DataFrame:
    kept = competing_blocks(queries, index)
    rows = kept.join(index.blocks.select("token", "tf", "dl", "base", "zone", "addrs"), ["token", "tf", "dl", "base", "zone"])
    return rows.select("qid", "w", F.explode("addrs").alias("doc_seq")).groupBy("qid", "doc_seq").agg(F.round(F.sum("w"), 6).alias("score"))


def candidates(queries: DataFrame, index: Index) -> DataFrame:
    """The best-scored documents of each query up to its candidate limit, with their rank r."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_seq"))
    cut = scored(queries, index).withColumn("r", rank).where(F.col("r") <= MOST_CANDIDATES)  # a literal, so that it is pushed below the sort
    return cut.join(queries, "qid").where("r <= candidate_limit")


def matched(queries: DataFrame, index: Index) -> DataFrame:
    """Candidates with their documents, match counts and whether they match all tokens, after min_match and tld."""
    found, docs = candidates(queries, index), index.docs
    if index.docs_of is not None:
        found = found.persist(StorageLevel.DISK_ONLY)  # asked for addresses, then joined; a few thousand rows a query
        index.held.append(found)
        docs = index.docs_of(found)
    found = found.join(docs.withColumnRenamed("tld", "doc_tld"), "doc_seq")
    found = found.withColumn("match_count", F.size(F.filter("qtokens", lambda t: F.array_contains("tokens", t))))
    kept = found.where((F.col("match_count") >= F.col("min_match")) & (F.col("tld").isNull() | (F.col("doc_tld") == F.lower("tld"))))
    return kept.withColumn("perfect", (F.col("match_count") == F.col("n_tokens")).cast("int"))


def stopped(rows: DataFrame) -> DataFrame:
    """Rows up to the one that makes twice the limit of perfect matches."""
    before = F.sum("perfect").over(Window.partitionBy("qid").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("perfect_before", F.coalesce(before, F.lit(0))).where(F.col("perfect_before") < 2 * F.col("lim"))


def grouped(rows: DataFrame) -> DataFrame:
    """g: the place among the query's hyphenated or plain names."""
    order = Window.partitionBy("qid", "has_hyphen").orderBy(F.col("match_count").desc(), "len", F.col("score").desc(), "r")
    return rows.withColumn("g", F.row_number().over(order))


def interleaved(rows: DataFrame) -> DataFrame:
    """pos: hyphenated and plain names in turn, hyphenated first."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("g", F.col("has_hyphen").desc())))


def survivors(queries: DataFrame, index: Index) -> DataFrame:
    return interleaved(grouped(stopped(matched(tokenized(queries), index))))


def search(queries: DataFrame, index: Index) -> DataFrame:
    """Results of queries (qid, q, tld, lim, min_match), a row a hit; total_candidates counts what was left before the limit."""
    rows = survivors(queries, index).withColumn("total_candidates", F.count("*").over(Window.partitionBy("qid")))
    rows = rows.where("pos <= lim")
    return rows.select("qid", F.col("pos").cast("bigint"), F.col("domain_exact").alias("domain"), "label", F.col("doc_tld").alias("tld"), F.col("len").cast("bigint").alias("length"), "has_hyphen", "tokens", F.col("match_count").cast("bigint"), "score", "total_candidates")


def summaries(queries: DataFrame, index: Index) -> DataFrame:
    """qid, total_candidates, returned for every query, those without results or tokens included."""
    counts = survivors(queries, index).groupBy("qid").agg(F.count("*").alias("total"), F.sum((F.col("pos") <= F.col("lim")).cast("int")).alias("hits"))
    return queries.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("total", F.lit(0)).cast("bigint").alias("total_candidates"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("returned"))


def exact(docs: DataFrame, normalized: DataFrame) -> DataFrame:
    """The first document of each normalized name (qid, domain_exact, reject_reason null)."""
    asked = normalized.where("reject_reason is null").select("qid", "domain_exact")
    hit = docs.join(asked, "domain_exact").groupBy("qid").agg(F.min_by(F.struct("domain_exact", "label", "tld", "len", "has_hyphen", "tokens"), "doc_seq").alias("d"))
    return hit.select("qid", F.col("d.domain_exact").alias("domain"), "d.label", "d.tld", F.col("d.len").cast("bigint").alias("length"), "d.has_hyphen", "d.tokens")
