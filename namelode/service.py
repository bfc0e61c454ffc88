"""The answers of the service: search, bulk search, exact lookup, health and statistics, as plain values."""

from __future__ import annotations

import logging
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .cache import ResultCache
from .operators import search as S
from .operators.normalize import InvalidDomain, normalize
from .plans.snapshot import Store
from .session import configure
from .sources.requests import DEFAULT_LIMIT, query_rows

MAX_BULK = 100
log = logging.getLogger(__name__)


class BadRequest(ValueError):
    pass


class Service:
    """Every call resolves the current snapshot anew, so a sync is seen by the next call."""

    def __init__(self, spark: SparkSession, path: str, cache: ResultCache | None = None):
        self.spark, self.store, self.cache = configure(spark), Store(spark, path), cache

    def _answers(self, rows: list[tuple]) -> dict[int, dict]:
        out = {r[0]: {"results": [], "total_candidates": 0} for r in rows}
        if rows:
            queries = query_rows(self.spark, rows)
            tokens = [r["token"] for r in S.query_tokens(S.tokenized(queries)).select("token").distinct().collect()]  # of MAX_BULK queries at most
            index = self.store.index(tokens)
            try:
                found = S.search(queries, index).orderBy("qid", "pos").collect()  # at most the limit a query
            finally:
                index.release()
            for r in found:
                hit = r.asDict()
                own = out[hit.pop("qid")]
                own["total_candidates"] = hit.pop("total_candidates")
                hit.pop("pos")
                own["results"].append(hit)
        return out

    def _version(self) -> int:
        return max(self.store.versions(), default=0)

    @staticmethod
    def _key(version: int, q: str, tld: str | None, limit: int, min_match: int | None) -> tuple:
        return (version, q, tld, limit, min_match or 1)

    def _each(self, asked: list[tuple]) -> dict[int, dict | None]:
        """The answers of all queries in one plan; if that fails each on its own, none for those that fail again."""
        try:
            return self._answers(asked)
        except Exception:
            if len(asked) == 1:
                log.exception("query %r", asked[0][1])
                return {asked[0][0]: None}
            return {k: v for one in asked for k, v in self._each([one]).items()}

    def search(self, q: str, tld: str | None = None, limit: int = DEFAULT_LIMIT, min_match: int | None = None) -> dict:
        started = time.perf_counter()
        if limit < 1:
            raise BadRequest("limit must be positive")
        if not q.split():
            raise BadRequest("the query is empty")
        key = self._key(self._version() if self.cache else 0, q, tld, limit, min_match)
        found = self.cache.get(key) if self.cache else None
        cached = found is not None
        if not cached:
            found = self._answers([(0, q, tld, limit, min_match)])[0]
            if self.cache:
                self.cache.set(key, found)
        return found | {"query_time_ms": (time.perf_counter() - started) * 1000, "cached": cached}

    def search_bulk(self, queries: list[dict], limit: int = DEFAULT_LIMIT) -> dict:
        """All queries that are not cached in one plan; a blank query, or one that fails, has an empty answer, which is not kept if it failed."""
        started = time.perf_counter()
        if len(queries) > MAX_BULK:
            raise BadRequest(f"more than {MAX_BULK} queries")
        if limit < 1:
            raise BadRequest("limit must be positive")
        version = self._version() if self.cache else 0
        keys = [self._key(version, x["q"], x.get("tld"), limit, x.get("min_match")) for x in queries]
        known = {i: found for i, k in enumerate(keys) if self.cache and (found := self.cache.get(k)) is not None}
        looked = (time.perf_counter() - started) * 1000
        asked = [(i, x["q"], x.get("tld"), limit, x.get("min_match")) for i, x in enumerate(queries) if i not in known]
        fresh = self._each(asked) if asked else {}
        ms = (time.perf_counter() - started) * 1000
        results = []
        for i, k in enumerate(keys):
            if i in known:  # an entry of a single search too; its time is that of looking it up
                results.append(known[i] | {"query_time_ms": looked / len(keys), "cached": True})
            elif (answer := fresh[i]) is None:
                results.append({"results": [], "total_candidates": 0, "query_time_ms": ms / len(asked), "cached": False})
            else:
                if self.cache:
                    self.cache.set(k, answer)
                results.append(answer | {"query_time_ms": ms / len(asked), "cached": False})
        return {"results": results, "total_time_ms": (time.perf_counter() - started) * 1000}

    def search_frame(self, queries: DataFrame) -> DataFrame:
        """Any number of queries (qid, q, tld, lim, min_match) as a plan; many have candidates in all files, so documents are joined."""
        return S.search(queries, replace(self.store.index(), docs_of=None))

    def exact(self, domain: str) -> dict:
        started = time.perf_counter()
        asked = normalize(self.spark.createDataFrame([(0, domain)], "qid int, raw string"))
        reason = asked.select("reject_reason").head()[0]
        if reason:
            raise InvalidDomain(f"{domain!r}: {reason}")
        name = asked.select("domain_exact").head()[0]
        hit = self.store.exact(name).limit(1).collect()
        found = {"domain": {"domain": hit[0]["domain_exact"], "label": hit[0]["label"], "tld": hit[0]["tld"], "length": hit[0]["len"], "has_hyphen": hit[0]["has_hyphen"], "tokens": hit[0]["tokens"]}} if hit else {}
        return {"found": bool(hit), **found, "query_time_ms": (time.perf_counter() - started) * 1000}

    def health(self) -> dict:
        return {"status": "ok", "index_documents": self.store.count(), "index_segments": self.store.segments(), "cache_enabled": self.cache is not None}

    def stats(self) -> dict:
        out = {"index": {"documents": self.store.count(), "segments": self.store.segments(), "size_bytes": self.store.size_bytes()}}
        return out | ({"cache": self.cache.stats()} if self.cache else {})
