"""Each query of the domain engine against its SQL, on the smallest tables."""

import json
import random

import duckdb
import pytest

from namelode.operators.normalize import normalize
from namelode.operators.segment import DictionarySegmenter, TableSegmenter, dictionary_segmenter
from namelode.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("part", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(want.columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, SMALL).count() > 0


def test_entry_without_the_corpus_operators(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("namelode.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "namelode.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)
    sys.modules.pop("__spark_entry__")


def test_dictionaries_of_any_size(spark):
    """Beyond the bound the dictionary stays a table; what comes out is the same."""
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))): rng.randint(1, 900) for _ in range(60)}
    table = spark.createDataFrame(list(words.items()), "w string, count long")
    labels = ["", "-", "a--b", "zzz", "aé-zz.ab", "x" * 63] + ["".join(rng.choice("abéz-.") for _ in range(rng.randint(1, 20))) for _ in range(150)]
    small, large = dictionary_segmenter(table), dictionary_segmenter(table, 100)
    assert isinstance(small, DictionarySegmenter) and isinstance(large, TableSegmenter)
    frame = spark.createDataFrame([(x,) for x in sorted(set(labels))], "label string")
    assert {r["label"]: list(r["tokens"]) for r in large.segments(frame).collect()} == {x: small.split(x) for x in set(labels)}
    many = spark.range(100_500).selectExpr("concat('w', id) as w", "id + 1 as count")
    assert dictionary_segmenter(many, 100).segments(spark.createDataFrame([("w100499w7",)], "label string")).head()["tokens"] == ["w100499", "w7"]
    assert large.segments(frame.limit(0)).count() == 0 and dictionary_segmenter(table.limit(0)).split("ab") == dictionary_segmenter(table.limit(0), -1).segments(spark.createDataFrame([("ab",)], "label string")).head()["tokens"]


def splits(run):
    if not run:
        yield []
    for i in range(1, len(run) + 1):
        for rest in splits(run[i:]):
            yield [run[:i], *rest]


def test_segments_against_all_splits():
    rng = random.Random(3)
    counts = {"cold": 3, "widget": 5, "old": 9, "c": 2, "red": 4, "edge": 4, "re": 7, "d": 1}
    own = DictionarySegmenter(counts)
    cost = lambda words: sum(own.cost.get(w, own.unknown * len(w) + own.unknown) for w in words)
    for label in ["coldwidget", "rededge", *("".join(rng.choice(["c", "old", "red", "edge", "x", "d"]) for _ in range(rng.randint(1, 4))) for _ in range(40))]:
        best = [x for x in splits(label) if max(map(len, x)) <= own.longest]
        assert cost(own.split(label)) == pytest.approx(min(map(cost, best))), label
    assert own.split("coldwidget") == ["cold", "widget"] and own.split("red-edge.x") == ["red", "edge", "x"]


def test_dictionary_query_row_by_row(spark):
    counts = {r["w"]: r["n"] for r in spark.sql(f"SELECT w, count(*) n FROM (SELECT explode(split(p_name, ' ')) w FROM parquet.`{SMALL}/part.parquet`) GROUP BY w").collect()}
    own = DictionarySegmenter(counts)
    rows = catalog.QUERIES["segment_dictionary"](spark, SMALL).collect()
    assert len(rows) == catalog.normalized(spark, SMALL).where("status = 'ok'").count()
    assert all(r["tokens"] == " ".join(own.split(r["label"])) for r in rows)


def test_idna_query_row_by_row(spark):
    """Against the older codec of the standard library, which agrees on lower-case letters but for sharp s and final sigma."""
    rows = [r for r in catalog.QUERIES["norm_idna"](spark, SMALL).collect() if not set("ßς") & set(r["raw"])]
    assert len(rows) > 50 and all(r["domain_exact"] == r["raw"].encode("idna").decode() for r in rows)


def test_json_answers(spark):
    hits = {}
    for r in catalog.QUERIES["search_bulk"](spark, SMALL).orderBy("qid", "pos").collect():
        row = r.asDict()
        own = hits.setdefault(row.pop("qid"), {"results": [], "total_candidates": row["total_candidates"]})
        row.pop("pos"), row.pop("total_candidates")
        own["results"].append(row | {"tokens": row["tokens"].split(" ") if row["tokens"] else []})
    got = {r["qid"]: json.loads(r["body"]) for r in catalog.QUERIES["search_json"](spark, SMALL).collect()}
    assert got == hits and len(got) >= 5


def test_names_in_ascii_take_no_python_tasks(spark):
    names = spark.createDataFrame([("small.com",), ("MÜNCHEN.de",)], "raw string").repartition(16)
    rows = normalize(names)
    assert "RebalancePartitions" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["domain_exact"] for r in rows.collect()) == ["small.com", "xn--mnchen-3ya.de"]


def test_searches_make_documents_once(spark):
    read = catalog.QUERIES["rank_groups"](spark, SMALL).inputFiles()
    assert read and not [f for f in read if "part.parquet" in f or "pages.parquet" in f]
