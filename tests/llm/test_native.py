"""Sharding, top-k and revisits: SQL on the small tables and edge cases."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from namelode.llm import op01_sharding as sharding
from namelode.llm import op05_revisits as revisits
from namelode.llm import op09_topk as topk

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, shard int, slot string"


def sql_rows(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    return con.sql(sql)


def same(df, relation):
    names = relation.columns
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, relation.fetchall()))


def test_sharding(spark):
    same(sharding.op1_query(spark, SMALL), sql_rows(sharding.OP1_SQL, "documents"))


def test_sharding_edges(spark):
    rows = [(1, None, "a", 5, "x"), (1, None, "a", 5, "x"), (None, "", None, 5, "x"), (None, "é" * 50_000, "hot", 5, "x")] + [(i, "t", "hot", 0, "") for i in range(10, 40)]
    got = sharding.stratified_shards(spark.createDataFrame(rows, DOCS), 7).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"rows"}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(r["size"] for r in got)[-1] == 100_016 and min(r["size"] for r in got) == 16
    assert sharding.stratified_shards(spark.createDataFrame([], DOCS)).count() == 0
    assert sharding.stratified_shards(spark.createDataFrame(rows[:2], DOCS)).count() == 2
    with pytest.raises(ValueError):
        sharding.stratified_shards(spark.createDataFrame(rows, DOCS), 0)


def test_topk(spark):
    same(topk.op9_query(spark, SMALL), sql_rows(topk.OP9_SQL, "embeddings"))


def best_by_brute_force(q, own, v, ids, k):
    return sorted((-sum(int(a) * int(b) for a, b in zip(q, v[j])), int(ids[j])) for j in range(len(v)) if ids[j] != own)[:k]


def test_maxscore_is_exact():
    rng = np.random.default_rng(0)
    for n, d, k, fill in ((1, 3, 5, 1), (40, 1, 5, 1), (300, 16, 5, 1), (300, 16, 1, 1), (90, 0, 3, 1), (400, 30, 5, 0.1), (400, 30, 3, 0.02)):
        for size in (4, 1 << 60):  # small numbers in floating point, large ones as whole numbers
            v = rng.integers(1 - size, size, (n, d)).astype(float) * (rng.random((n, d)) < fill)
            ids, asked = rng.permutation(n), np.arange(0, n, 7)
            where = [int(np.flatnonzero(ids == a)[0]) for a in asked]
            best = topk.Best(asked, v[where], k)
            for i in range(0, n, 130):
                best.take(v[i : i + 130], ids[i : i + 130])
            for i, a in enumerate(asked):
                assert best.found[i] == best_by_brute_force(v[where[i]], a, v, ids, k)


def test_only_essential_lists_are_traversed(monkeypatch):
    """Sparse vectors: few lists are read, and few vectors probed."""
    rng = np.random.default_rng(1)
    v = np.round(rng.random((3000, 40)) * 100) * (rng.random((3000, 40)) < 0.05) * 0.9 ** np.arange(40)[None] // 1
    shard, read, probed = topk.Shard(v, np.arange(3000)), [], []
    traverse, probe = shard.traverse, shard.probe
    monkeypatch.setattr(shard, "traverse", lambda q, t: read.append(len(t)) or traverse(q, t))
    monkeypatch.setattr(shard, "probe", lambda q, t, r: probed.append(len(r) * len(t)) or probe(q, t, r))
    for own in range(20):
        query = np.round(rng.random(40) * 50)
        theta = -best_by_brute_force(query, own, v, np.arange(3000), 5)[-1][0]
        rows, scores = topk.maxscore(query, own, shard, 5, float(theta))
        assert sorted(zip((-scores).tolist(), rows.tolist()))[:5] == best_by_brute_force(query, own, v, np.arange(3000), 5)
    assert np.mean(read) < 36 and sum(probed) < 0.2 * 20 * v.size


def test_topk_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 3000)
    same(topk.op9_query(spark, SMALL), sql_rows(topk.OP9_SQL, "embeddings"))


def test_topk_edges(spark):
    schema = "vec_id long, embedding array<float>, rank string"
    rows = [(0, [1.0, 2.0], ""), (1, [1.0], ""), (2, None, ""), (3, [None, 1.0], ""), (4, [float("nan"), 1.0], ""), (5, [float("inf"), 1.0], ""), (6, [], ""), (None, [1.0, 1.0], ""), (7, [1.0, 2.0], ""), (7, [1.0, 2.0], "")]
    vectors = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 65536 * 5), (0, 2, 7, 65536 * 5), (0, 3, 1, 65536), (0, 4, 6, 0)]
    none = spark.createDataFrame([], schema)
    assert topk.top_k(none, none).count() == 0 and topk.top_k(vectors, none).count() == 0


def test_revisits(spark):
    same(revisits.op5_query(spark, SMALL), sql_rows(revisits.OP5_SQL, "pages"))


def test_revisit_edges(spark, monkeypatch):
    monkeypatch.setattr(revisits, "BUCKET_ROWS", 3)  # a frequent URL takes many slices
    schema = "record_id long, kind string, url string, ts long, headers string, digest string, canonical string, slice int"
    row = lambda i, kind, url, ts, head, digest=None: (i, kind, url, ts, head, digest, "clash", 1)
    rows = [row(i, "response", "http://h/a", 10 * i, f"ETag: \"{i}\"\nX-A: 1\nContent-Length: 9", f"d{i}") for i in range(20)]
    rows += [row(100 + i, "revisit", "HTTPS://www.H:443/a/?utm_x=1#f", 10 * i + 5, f"etag: W/\"{i}\"\ncontent-length: 0\ncache-control: no-cache\nx-b: 2") for i in range(20)]
    rows += [row(200, "revisit", "http://h/a", 0, 'ETag: "0"'), row(201, "revisit", "http://h/a", 95, 'ETag: "3"'), row(202, "revisit", "http://h/a", 95, None), row(203, "revisit", None, 5, ""), row(204, "revisit", "http://h/a", None, ""), row(204, "revisit", "http://h/a", None, "")]
    got = revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 26
    by = {r["record_id"]: r for r in got}
    for i in range(20):
        assert (by[100 + i]["outcome"], by[100 + i]["source_id"], by[100 + i]["digest"]) == ("resolved", i, f"d{i}")
        assert by[100 + i]["headers"] == f'cache-control: no-cache\ncontent-length: 9\netag: W/"{i}"\nx-a: 1'
    assert [by[i]["outcome"] for i in range(200, 205)] == ["no_response", "validator_mismatch", "no_validator", "no_response", "no_response"]
    assert revisits.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_canonical_urls(spark):
    """A table made by hand, for the SQL uses the same patterns."""
    urls = {
        "http://h/a": "h/a", "HTTP://H:80/a/": "h/a", "https://www.h:443/a": "h/a", "http://h:8080/a": "h:8080/a", "http://h:443/a": "h:443/a", "https://h:80/a": "h:80/a",
        "http://user:pw@h/a//": "h/a", "http://[2001:DB8::1]/x": "[2001:db8::1]/x", "http://[::1]:8080/x": "[::1]:8080/x", "https://[::1]:443": "[::1]", "http://h": "h", "http://h/": "h",
        "http://h/a?b=2&a=1&utm_x=3#f": "h/a?a=1&b=2", "http://h/a?utm_x=3": "h/a", "http://h?x": "h?x", "http://h:0080/a": "h/a", "http://h:/a": "h/a",
    }
    rows = spark.createDataFrame(list(urls.items()), "url string, want string").withColumn("got", revisits.canonical_url(F.col("url"))).collect()
    assert [(r["url"], r["got"]) for r in rows] == [(r["url"], r["want"]) for r in rows]
    assert spark.createDataFrame([(None,)], "url string").select(revisits.canonical_url(F.col("url"))).head()[0] is None


def test_captures_of_one_time(spark):
    schema = "record_id long, kind string, url string, ts long, headers string, digest string"
    rows = [(i, "response", "http://h/a", 5, f'ETag: "{i}"', f"d{i}") for i in range(50)] + [(100 + i, "revisit", "http://h/a", 9 if i % 2 else 5, 'ETag: "49"', None) for i in range(60)]
    got = {r["record_id"]: (r["outcome"], r["source_id"], r["digest"]) for r in revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert got == {100 + i: ("resolved", 49, "d49") if i % 2 else ("no_response", None, None) for i in range(60)}


def test_rows_of_one_id_are_dealt(spark):
    rows = [(None if i % 2 else 7, f"text {i}", "hot", 0, "") for i in range(3000)]
    got = sharding.stratified_shards(spark.createDataFrame(rows, DOCS), 8).collect()
    assert len({(r["doc_id"], r["text_crc32"]) for r in got}) == 3000 and len({r["shard"] for r in got}) == 8


def record(kind, uri, date, http, body=b"", **more):
    block = http.replace("\n", "\r\n").encode() + b"\r\n\r\n" + body
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{kind}:{uri}:{date}>", "WARC-Target-URI": uri, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", **more, "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def test_warc_files(spark, tmp_path):
    import base64
    import gzip
    import hashlib

    body = b"x" * 3_000_000 + b"\r\nWARC/1.0\r\n"
    info = record("warcinfo", "", "2024-01-01T00:00:00Z", "software: s", **{"Content-Type": "application/warc-fields"})
    full = record("response", "http://H/a", "2024-01-01T00:00:00Z", 'HTTP/1.1 200 OK\nETag: "1"\nContent-Length: 9', body)
    again = record("revisit", "https://www.h:443/a/", "2024-01-02T00:00:00.5Z", 'HTTP/1.1 304 Not Modified\nETag: W/"1"\nCache-Control: no-cache')
    (tmp_path / "a.warc").write_bytes(info + full)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(again))
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc",), (f"file://{tmp_path}/b.warc.gz",)], "path string")
    rows = revisits.warc_records(paths)
    assert sorted((r["kind"], r["url"], r["ts"]) for r in rows.collect()) == [("response", "http://H/a", 1704067200000), ("revisit", "https://www.h:443/a/", 1704153600500)]
    got = revisits.resolve_revisits(rows).collect()
    assert [(r["outcome"], r["digest"]) for r in got] == [("resolved", "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode())]
    assert got[0]["headers"] == 'cache-control: no-cache\ncontent-length: 9\netag: W/"1"'
    assert revisits.warc_records(paths.limit(0)).count() == 0
    for broken in (full[:-100], b"nonsense\r\n"):
        with pytest.raises(ValueError):
            list(revisits.records_of(__import__("io").BytesIO(broken), "f"))
