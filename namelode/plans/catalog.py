"""Every query of the domain engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from ..operators import search as S
from ..operators import sync as Y
from ..operators.normalize import normalize, with_status
from ..operators.segment import add_tokens, dictionary_segmenter
from ..session import configure
from ..sources import lines as L
from ..sources.requests import from_json, query_rows
from . import fixtures, snapshot
from . import oracles as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scan(fixtures.raw_domains(spark, sf_dir)).select("seq", "s")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_status(normalize(scanned(spark, sf_dir), "s"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build_docs(scanned(spark, sf_dir), fixtures.segmenter(spark, sf_dir), "seq")


def docs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs as a table in the shared folder, for plans that read them several times."""
    made, path = docs(spark, sf_dir), snapshot.scratch(spark)
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def index(spark: SparkSession, sf_dir: str) -> I.Index:
    return I.index_of(docs_once(configure(spark), sf_dir))


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", T.join_tokens(F.col("tokens")))


# scans and normalizing


@query(O.corpus("SELECT seq, s FROM scanned"))
def scan_parse(spark, sf_dir):
    return scanned(spark, sf_dir)


@query(O.corpus("SELECT count(*) AS n_lines FROM raw_domains WHERE trim(raw) <> '' AND trim(raw) NOT LIKE '#%' AND trim(raw) LIKE '%.%'"))
def scan_count(spark, sf_dir):
    return L.count_lines(fixtures.raw_domains(spark, sf_dir))


#: White space that names may come with.
SPACES = ["", " ", "\t", "\u00a0", "\u3000", " \n ", "\u0085", "\u2028\r"]
_SPACES_SQL = "[" + ", ".join("''" + "".join(f" || chr({ord(c)})" for c in x) for x in SPACES) + "]"


@query(rf"SELECT p_partkey, regexp_replace(raw, '^[\s\p{{Z}}\x{{85}}\x0B]+|[\s\p{{Z}}\x{{85}}\x0B]+$', '', 'g') AS trimmed FROM (SELECT p_partkey, ({_SPACES_SQL})[p_partkey % 8 + 1] || p_name || ({_SPACES_SQL})[p_partkey // 8 % 8 + 1] AS raw FROM part)")
def norm_trim(spark, sf_dir):
    """The parts' names, each between two kinds of white space."""
    pads = F.array(*map(F.lit, SPACES))
    pad = lambda n: F.element_at(pads, (n % len(SPACES) + 1).cast("int"))
    raw = F.concat(pad(F.col("p_partkey")), "p_name", pad(F.floor(F.col("p_partkey") / len(SPACES))))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.trim(raw).alias("trimmed"))


@query(O.corpus("SELECT seq, d AS domain_exact FROM status"))
def norm_domain(spark, sf_dir):
    return normalized(spark, sf_dir).select("seq", "domain_exact")


@query(O.corpus("SELECT seq, label, tld FROM status"))
def norm_split(spark, sf_dir):
    return normalized(spark, sf_dir).select("seq", "label", "tld")


@query(O.corpus("SELECT seq, strlen(label)::INTEGER AS len FROM status"))
def norm_len(spark, sf_dir):
    return normalized(spark, sf_dir).select("seq", "len")


@query(O.corpus("SELECT seq, label LIKE '%-%' AS has_hyphen FROM status"))
def norm_hyphen(spark, sf_dir):
    return normalized(spark, sf_dir).select("seq", "has_hyphen")


@query(O.corpus("SELECT seq, d AS domain_exact, status AS reject_reason FROM status WHERE status IN ('no_dot', 'label_too_long', 'empty_label')"))
def norm_rejects(spark, sf_dir):
    return normalized(spark, sf_dir).where("reject_reason is not null").select("seq", "domain_exact", "reject_reason")


@query()
def norm_idna(spark, sf_dir):
    """Words of the documents that are not ASCII, as names; no SQL knows their ASCII forms."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''").distinct().where(~T.is_ascii(F.col("w")))
    return normalize(words.select(F.concat("w", F.lit(".de")).alias("raw"))).select("raw", "domain_exact", "label", "len", "reject_reason")


@query(O.corpus("SELECT seq, label, status LIKE 'junk%' AS is_junk FROM status WHERE status IN ('ok', 'junk_repeat', 'junk_numeric')"))
def junk_filter(spark, sf_dir):
    return normalized(spark, sf_dir).where("reject_reason is null").select("seq", "label", T.is_junk(F.col("label")).alias("is_junk"))


@query(O.corpus("SELECT seq, cast('0x' || substr(md5(d), 1, 12) AS BIGINT) AS id48 FROM status"))
def domain_id48(spark, sf_dir):
    return normalized(spark, sf_dir).select("seq", T.id48(F.col("domain_exact")).alias("id48"))


@query(O.corpus("SELECT seq, s, ((row_number() OVER (ORDER BY seq) - 1) // 100)::BIGINT AS batch FROM scanned"))
def batch_ids(spark, sf_dir):
    return L.batch_ids(scanned(spark, sf_dir), "seq", 100).select("seq", "s", "batch")


# functions


@query("SELECT p_partkey, array_to_string(string_split(p_name, ' '), ' ') AS joined FROM part")
def tokens_join(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.join_tokens(F.split("p_name", " ")).alias("joined"))


@query(r"SELECT doc_id, md5(array_to_string(tokens, '|')) AS tokens_md5, len(tokens)::INTEGER AS n_tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\p{Z}\x{85}\x0B]+'), lambda x: x <> '') AS tokens FROM documents)")
def tokens_split(spark, sf_dir):
    """The words of whole documents."""
    tokens = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.split_tokens(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.md5(F.array_join("tokens", "|")).alias("tokens_md5"), F.size("tokens").alias("n_tokens"))


@query("SELECT p_partkey, base64(encode(p_name)) AS b64 FROM part")
def base64_fn(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.base64(F.col("p_name").cast("binary")).alias("b64"))


@query(O.corpus("SELECT seq, '/' || tld AS facet FROM status WHERE status = 'ok'"))
def facet_path(spark, sf_dir):
    return normalized(spark, sf_dir).where("status = 'ok'").select("seq", T.facet_path(F.col("tld")).alias("facet"))


@query("SELECT p_partkey, round((p_size % 7) / 10.0::DOUBLE * 100 + (1 - (p_partkey % 63) / 63.0::DOUBLE) * 10 + least(p_retailprice / 50, 20.0) / 20, 6) AS score FROM part")
def combined_score(spark, sf_dir):
    score = T.combined_score(F.col("p_size") % 7, F.col("p_partkey") % 63, F.col("p_retailprice") / 50)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(score, 6).alias("score"))


@query(O.asked("SELECT qid, 'search:' || q || '|' || coalesce(qtld, 'any') || '|' || lim || '|' || min_match AS cache_key FROM queries"))
def cache_key(spark, sf_dir):
    return fixtures.part_queries(spark, sf_dir).select("qid", T.cache_key(F.col("q"), F.col("tld"), F.col("lim"), F.col("min_match")).alias("cache_key"))


# building


@query(O.corpus("SELECT label, array_to_string(tokens, ' ') AS tokens FROM (SELECT DISTINCT label FROM status WHERE status = 'ok') JOIN segments USING (label)"))
def segment_join(spark, sf_dir):
    labels = normalized(spark, sf_dir).where("status = 'ok'").select("label").distinct()
    return shown(fixtures.segmenter(spark, sf_dir).segments(labels)).select("label", "tokens")


@query(O.corpus("SELECT doc_seq, label FROM docs WHERE len(tokens) = 0"))
def segment_missing(spark, sf_dir):
    return docs(spark, sf_dir).where(F.size("tokens") == 0).select("doc_seq", "label")


@query()
def segment_dictionary(spark, sf_dir):
    """Labels split by a dictionary of part names; there is no SQL for the dynamic program."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").count()
    rows = normalized(spark, sf_dir).where("status = 'ok'").select("seq", "label")
    return shown(add_tokens(rows, dictionary_segmenter(names))).select("seq", "label", "tokens")


@query(O.corpus(f"SELECT {O.DOC_COLUMNS} FROM docs"))
def build_docs(spark, sf_dir):
    return shown(docs(spark, sf_dir))


@query(O.corpus("SELECT token, doc_seq, tf, dl FROM postings", O.INDEX))
def build_postings(spark, sf_dir):
    return I.postings_of(docs(spark, sf_dir))


@query(O.corpus("SELECT status, count(*) AS n FROM status GROUP BY status"))
def build_summary(spark, sf_dir):
    return normalized(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(O.corpus("SELECT token, df FROM term_stats", O.INDEX))
def term_stats(spark, sf_dir):
    return index(spark, sf_dir).terms


@query(O.corpus("SELECT n, round(avgdl, 6) AS avgdl FROM corpus_stats", O.INDEX))
def corpus_stats(spark, sf_dir):
    return index(spark, sf_dir).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


# searching


@query(O.asked("SELECT qid, pos::BIGINT AS place, token FROM (SELECT qid, unnest(qtokens) AS token, unnest(range(len(qtokens))) AS pos FROM tokenized)"))
def query_tokens(spark, sf_dir):
    return S.tokenized(fixtures.part_queries(spark, sf_dir)).select("qid", F.posexplode("qtokens").alias("place", "token")).withColumn("place", F.col("place").cast("bigint"))


@query(O.asked("SELECT qid, n_tokens::INTEGER AS n_tokens, candidate_limit::INTEGER AS candidate_limit FROM tokenized"))
def candidate_limit(spark, sf_dir):
    return S.tokenized(fixtures.part_queries(spark, sf_dir)).select("qid", "n_tokens", "candidate_limit")


@query(O.searched("SELECT qid::INTEGER AS qid, doc_seq, score FROM scored"))
def search_bm25(spark, sf_dir):
    return S.scored(S.tokenized(fixtures.queries(spark)), index(spark, sf_dir))


@query(O.searched("SELECT qid::INTEGER AS qid, doc_seq, score, r::INTEGER AS r FROM candidates"))
def topn_candidates(spark, sf_dir):
    return S.candidates(S.tokenized(fixtures.queries(spark)), index(spark, sf_dir)).select("qid", "doc_seq", "score", "r")


@query(O.searched("SELECT qid::INTEGER AS qid, doc_seq, match_count::INTEGER AS match_count, perfect FROM matched"))
def match_count(spark, sf_dir):
    return S.matched(S.tokenized(fixtures.queries(spark)), index(spark, sf_dir)).select("qid", "doc_seq", "match_count", "perfect")


@query(O.searched("SELECT qid::INTEGER AS qid, doc_seq, perfect_before::BIGINT AS perfect_before FROM stopped"))
def early_stop(spark, sf_dir):
    return S.stopped(S.matched(S.tokenized(fixtures.queries(spark)), index(spark, sf_dir))).select("qid", "doc_seq", "perfect_before")


@query(O.searched("SELECT qid::INTEGER AS qid, doc_seq, has_hyphen, g::INTEGER AS g FROM grouped"))
def rank_groups(spark, sf_dir):
    return S.grouped(S.stopped(S.matched(S.tokenized(fixtures.queries(spark)), index(spark, sf_dir)))).select("qid", "doc_seq", "has_hyphen", "g")


@query(O.searched("SELECT qid::INTEGER AS qid, doc_seq, pos::INTEGER AS pos FROM placed"))
def interleave(spark, sf_dir):
    return S.survivors(fixtures.queries(spark), index(spark, sf_dir)).select("qid", "doc_seq", "pos")


def results_of(*qids: int):
    def run(spark, sf_dir):
        return shown(S.search(query_rows(spark, [q for q in fixtures.QUERIES if not qids or q[0] in qids]), index(spark, sf_dir)))

    return run


for _name, _qids in {"search_any": (0, 5, 6), "search_multi": (5, 10), "search_tld": (1, 3, 7), "search_min_match": (2, 4), "search_dup_tokens": (2,), "search_bulk": ()}.items():
    query(O.searched("SELECT * FROM results" + (f" WHERE qid IN ({', '.join(map(str, _qids))})" if _qids else "")), _name)(results_of(*_qids))


@query(O.searched("SELECT * FROM results"))
def search_stored(spark, sf_dir):
    """The same answers from an index on disk, of which only the queries' tokens' postings are read."""
    store = snapshot.Store(spark, snapshot.scratch(spark))
    store.build(docs(configure(spark), sf_dir))
    queries = fixtures.queries(spark)
    tokens = [r["token"] for r in S.query_tokens(S.tokenized(queries)).select("token").distinct().collect()]
    return shown(S.search(queries, store.index(tokens)))


@query(O.searched("SELECT q.qid::INTEGER AS qid, count(pos) AS total_candidates, coalesce(sum((pos <= p.lim)::INTEGER), 0)::BIGINT AS returned FROM queries q LEFT JOIN placed p USING (qid) GROUP BY q.qid"))
def search_summary(spark, sf_dir):
    return S.summaries(fixtures.queries(spark), index(spark, sf_dir))


@query(O.asked("SELECT body, (row_number() OVER (PARTITION BY body ORDER BY qid) - 1)::INTEGER AS qid, q, qtld AS tld, max(lim) OVER (PARTITION BY body)::INTEGER AS lim, min_match FROM (SELECT *, (qid // 10)::INTEGER AS body FROM queries)"))
def bulk_from_json(spark, sf_dir):
    """The queries of ten parts at a time as a request body, and back."""
    rows = fixtures.part_queries(spark, sf_dir).withColumn("body_id", F.floor(F.col("qid") / 10).cast("int"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("qid", "q", "tld", "min_match"))), lambda x: F.struct(x["q"].alias("q"), x["tld"].alias("tld"), x["min_match"].alias("min_match")))
    bodies = rows.groupBy("body_id").agg(F.to_json(F.struct(each.alias("queries"), F.max("lim").alias("limit"))).alias("body"))
    return from_json(bodies, "body", "body_id").withColumnRenamed("body_id", "body")


@query()
def search_json(spark, sf_dir):
    """Each query's answer as JSON; its text depends on the writer, so there is no SQL."""
    hits = S.search(fixtures.queries(spark), index(spark, sf_dir))
    hit = F.struct("domain", "label", "tld", "length", "has_hyphen", "tokens", "match_count", "score")
    return hits.groupBy("qid").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("pos", hit.alias("hit")))), lambda x: x["hit"]).alias("results"), F.max("total_candidates").alias("total_candidates"))).alias("body"))


@query(O.corpus("SELECT qid, domain_exact AS domain, label, tld, len::BIGINT AS length, has_hyphen, array_to_string(tokens, ' ') AS tokens FROM docs JOIN lookups ON domain_exact = name QUALIFY row_number() OVER (PARTITION BY qid ORDER BY doc_seq) = 1", O.LOOKUP))
def exact_lookup(spark, sf_dir):
    asked = normalize(spark.createDataFrame(fixtures.LOOKUPS, "qid int, raw string"))
    return shown(S.exact(docs(spark, sf_dir), asked))


# syncing and upkeep


def changed(spark, sf_dir) -> tuple[DataFrame, Y.Delta]:
    have = docs_once(spark, sf_dir)
    adds, removes = fixtures.sync_lines(spark, have)
    return have, Y.delta(adds, removes, fixtures.segmenter(spark, sf_dir), fixtures.FIRST_ADDED)


@query(O.synced(f"SELECT {O.DOC_COLUMNS} FROM removed_only"))
def sync_remove(spark, sf_dir):
    have, change = changed(spark, sf_dir)
    return shown(have.join(change.removed, "domain_exact", "left_anti").select(*I.DOCS))


@query(O.synced("SELECT d AS domain_exact, line_no FROM winners"))
def sync_dedupe(spark, sf_dir):
    adds, _ = fixtures.sync_lines(spark, docs(spark, sf_dir))
    return Y.last_wins(with_status(normalize(L.scan(adds), "s")).where("status = 'ok'")).select("domain_exact", "line_no")


@query(O.synced(f"SELECT {O.DOC_COLUMNS} FROM upserted"))
def sync_upsert(spark, sf_dir):
    have, change = changed(spark, sf_dir)
    return shown(have.join(change.added, "domain_exact", "left_anti").select(*I.DOCS).unionByName(change.added))


@query(O.synced(f"SELECT {O.DOC_COLUMNS} FROM applied"))
def sync_apply(spark, sf_dir):
    return shown(Y.apply(*changed(spark, sf_dir)))


@query(O.synced("""SELECT *, final - initial AS net_change FROM (SELECT (SELECT count(*) FROM docs) AS initial, (SELECT count(*) FROM requests) AS delete_requests,
  (SELECT count(*) FROM docs WHERE domain_exact IN (SELECT domain_exact FROM requests)) AS rows_removed, (SELECT count(*) FROM added) AS added,
  (SELECT count(*) FROM judged_adds WHERE status LIKE 'junk%') AS filtered, (SELECT count(*) FROM applied) AS final)"""))
def sync_summary(spark, sf_dir):
    return Y.summary(*changed(spark, sf_dir))


def stored(spark, sf_dir) -> snapshot.Store:
    """A stored index after one sync. Its lists are made from the index, so the documents are built once."""
    store = snapshot.Store(spark, snapshot.scratch(spark))
    store.build(docs(spark, sf_dir))
    adds, removes = fixtures.sync_lines(spark, store.docs())
    store.sync(Y.delta(adds, removes, fixtures.segmenter(spark, sf_dir), fixtures.FIRST_ADDED))
    return store


@query(O.synced("SELECT count(*) AS documents, count(DISTINCT domain_exact) AS names, count(DISTINCT tld) AS tlds FROM applied"))
def index_stats(spark, sf_dir):
    """Counts of a snapshot that has been written, synced and read back."""
    return stored(spark, sf_dir).docs().agg(F.count("*").alias("documents"), F.countDistinct("domain_exact").alias("names"), F.countDistinct("tld").alias("tlds"))


@query(O.synced(f"SELECT {O.DOC_COLUMNS} FROM applied"))
def optimize_noop(spark, sf_dir):
    """Compaction changes files, never rows."""
    store = stored(spark, sf_dir)
    store.optimize()
    return shown(store.docs().select(*I.DOCS))


@query(O.searched("SELECT qid::INTEGER AS qid, domain_exact, score, r::INTEGER AS r FROM candidates JOIN docs USING (doc_seq)"))
def topn_stored(spark, sf_dir):
    """Candidates of a stored index, from the blocks whose bounds compete, and their documents by address."""
    store = snapshot.Store(spark, snapshot.scratch(spark))
    store.build(docs(configure(spark), sf_dir))
    own = store.index()
    return S.candidates(S.tokenized(fixtures.queries(spark)), own).join(own.docs, "doc_seq").select("qid", "domain_exact", "score", "r")


@query(O.corpus("SELECT * FROM results", O.SYNC, O.INDEX.replace("FROM docs)", "FROM applied)"), O.SEARCH.replace("JOIN docs USING", "JOIN applied USING")))
def search_synced(spark, sf_dir):
    """The answers of a stored index after a sync."""
    return shown(S.search(fixtures.queries(spark), stored(configure(spark), sf_dir).index()))


@query(O.corpus("SELECT token, df FROM term_stats", O.SYNC, O.INDEX.replace("FROM docs)", "FROM applied)")))
def term_stats_stored(spark, sf_dir):
    """Documents of each token after a sync, from counts of blocks and of what went."""
    return stored(spark, sf_dir).terms()


@query(O.synced("""SELECT domain_exact, label, tld, len, has_hyphen, array_to_string(tokens, ' ') AS tokens FROM (SELECT * FROM docs WHERE domain_exact NOT IN (SELECT domain_exact FROM requests)
  AND domain_exact <> (SELECT arg_max(domain_exact, doc_seq) FROM docs) AND domain_exact NOT IN (SELECT domain_exact FROM added) UNION ALL SELECT * FROM added)"""))
def sync_stored(spark, sf_dir):
    """A stored index after two days: removals, the document of the largest number among them, then additions."""
    store = snapshot.Store(spark, snapshot.scratch(spark))
    store.build(docs(spark, sf_dir))
    adds, removes = fixtures.sync_lines(spark, store.docs())
    last = store.docs().agg(F.max("doc_seq").alias("line_no"), F.max_by("domain_exact", "doc_seq").alias("raw"))
    segments, none = fixtures.segmenter(spark, sf_dir), removes.limit(0)
    with store.staged(adds) as adds:  # taken from the index as it was
        store.sync(Y.delta(none, removes.unionByName(last), segments, store.next_seq()))
        store.sync(Y.delta(adds, none, segments, store.next_seq()))
    return shown(store.docs().select(*I.DOCS[1:]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(S.search(query_rows(spark, [(0, "small gear", None, 5, None)]), index(spark, sf_dir)))
