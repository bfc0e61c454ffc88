"""Snapshots, sync, streaming, cache and service."""

import random
import re

import pytest
from pyspark.sql import functions as F

from namelode import cli
from namelode.cache import ResultCache
from namelode.config import Config
from namelode.operators import search as S
from namelode.operators import sync as Y
from namelode.operators.index import build_docs, index_of
from namelode.operators.normalize import InvalidDomain
from namelode.operators.segment import DictionarySegmenter
from namelode.plans import snapshot
from namelode.plans.commits import Conflict, Files
from namelode.plans.snapshot import Store
from namelode.service import BadRequest, Service
from namelode.sources import lines as L
from namelode.sources.requests import query_rows
from namelode.streaming import daily

WORDS = DictionarySegmenter({"small": 5, "gear": 9, "red": 5, "bolt": 5})


def store_of(spark, path, raw):
    lines = L.scan(L.lines_of(spark, raw)).select(F.col("line_no").alias("doc_seq"), "s")
    store = Store(spark, str(path))
    store.build(build_docs(lines, WORDS))
    return store


def names(store):
    return sorted(r["domain_exact"] for r in store.docs().select("domain_exact").collect())


def test_sync(spark, tmp_path):
    store = store_of(spark, tmp_path / "i", ["small-gear.com", "redbolt.net", "red-gear.com", "red-gear.com", "123456.com"])
    assert names(store) == ["red-gear.com", "red-gear.com", "redbolt.net", "small-gear.com"]
    change = Y.delta(L.lines_of(spark, ["Red-Gear.com", "red-gear.com.", "new.org", "77777.org", "redbolt.net"]), L.lines_of(spark, ["redbolt.net", "small-gear.com", "absent.com", "123456.com", "nodot"]), WORDS, 100)
    summary = Y.summary(store.docs(), change).head()
    assert (summary["initial"], summary["delete_requests"], summary["rows_removed"], summary["added"], summary["filtered"], summary["final"]) == (4, 4, 2, 3, 1, 3)
    store.sync(change)
    assert names(store) == ["new.org", "red-gear.com", "redbolt.net"] and store.segments() == 2
    size = store.size_bytes()
    store.optimize()
    assert names(store) == ["new.org", "red-gear.com", "redbolt.net"] and store.segments() == 1 and size > 0
    with pytest.raises(Conflict):
        store.publish(store.versions()[-1] - 1, store.state())


def test_service(spark, tmp_path):
    store_of(spark, tmp_path / "i", ["small-gear.com", "smallgear.net", "redbolt.net", "gear.com"])
    service = Service(spark, str(tmp_path / "i"), ResultCache())
    first = service.search("Gear", limit=2)
    assert [r["domain"] for r in first["results"]] == ["small-gear.com", "gear.com"] and first["total_candidates"] == 3 and not first["cached"]
    assert service.search("Gear", limit=2)["cached"] and service.stats()["cache"]["hits"] == 1
    frame = service.search_frame(query_rows(spark, [(0, "Gear", None, 2, None)])).orderBy("pos").collect()
    assert [r["domain"] for r in frame] == [r["domain"] for r in first["results"]]
    bulk = service.search_bulk([{"q": "Gear"}, {"q": " "}, {"q": "bolt", "tld": "NET"}], limit=2)
    assert [len(x["results"]) for x in bulk["results"]] == [2, 0, 1] and bulk["results"][0]["cached"]
    assert service.exact("GEAR.com.")["domain"]["label"] == "gear" and service.exact("absent.com")["found"] is False
    with pytest.raises(InvalidDomain):
        service.exact("nodot")
    for bad in (lambda: service.search(" "), lambda: service.search("a", limit=0), lambda: service.search_bulk([{"q": "a"}] * 101)):
        with pytest.raises(BadRequest):
            bad()
    assert service.health()["index_documents"] == 4
    assert bulk["results"][0]["query_time_ms"] >= 0  # an entry of a single search
    answers = service._answers
    service._answers = lambda rows: (_ for _ in ()).throw(RuntimeError()) if any(r[1] == "bad" for r in rows) else answers(rows)
    mixed = service.search_bulk([{"q": "bad"}, {"q": "small"}], limit=2)["results"]
    assert [len(x["results"]) for x in mixed] == [0, 2] and [len(x["results"]) for x in service.search_bulk([{"q": "bad"}, {"q": "small"}], limit=2)["results"]] == [0, 2]
    service._answers = answers
    service.store.sync(Y.delta(L.lines_of(spark, []), L.lines_of(spark, ["gear.com"]), WORDS, 100))
    assert not service.search("Gear", limit=2)["cached"]


def test_stream_sees_each_file_once(spark, tmp_path):
    store = store_of(spark, tmp_path / "i", ["a-gear.com", "b-gear.com"])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.remove.txt").write_text("a-gear.com\nb-gear.com\n")
    (tmp_path / "in" / "1.add.txt").write_text("b-gear.com\nc-gear.com\n")
    run = lambda: daily.run_available(store, WORDS, str(tmp_path / "in"), str(tmp_path / "check"))
    run()
    assert names(store) == ["b-gear.com", "c-gear.com"]
    (tmp_path / "in" / "2.remove.txt").write_text("c-gear.com\n")
    run()
    assert names(store) == ["b-gear.com"] and store.segments() == 2  # a day without additions adds no part


def test_cache():
    now = [0.0]
    cache = ResultCache(2, 10, lambda: now[0])
    cache.set("a", 1), cache.set("b", 2)
    assert cache.get("a") == 1
    cache.set("c", 3)
    assert cache.get("b") is None and cache.get("c") == 3
    now[0] = 11
    assert cache.get("a") is None and cache.stats() == {"connected": True, "hits": 2, "misses": 2} and len(cache._kept) == 1
    assert ResultCache(0).stats()["connected"] is False


def test_lock(tmp_path):
    with cli.lock(str(tmp_path / "l")):
        with pytest.raises(FileExistsError):
            with cli.lock(str(tmp_path / "l")):
                pass
    with cli.lock(str(tmp_path / "l")):
        pass


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "list.txt").write_text("small-gear.com\nredbolt.net\n")
    (tmp_path / "words.txt").write_text("small\ngear\nred\nbolt\n")
    base = ["--index", str(tmp_path / "i")]
    assert cli.main([*base, "full", "--file", str(tmp_path / "list.txt"), "--words", str(tmp_path / "words.txt")]) == 0
    assert cli.main([*base, "daily", "--remove", str(tmp_path / "list.txt"), "--words", str(tmp_path / "words.txt")]) == 0
    assert cli.main([*base, "optimize"]) == 0 and cli.main([*base, "stats"]) == 0
    assert '"documents": 0' in capsys.readouterr().out


def test_stored_search_is_that_of_the_documents(spark, tmp_path):
    """After syncs the stored postings and statistics give what an index of the current documents gives, and no others are read."""
    store = store_of(spark, tmp_path / "i", [f"small-gear{i % 7}.com" for i in range(40)] + [f"redbolt{i}.net" for i in range(30)])
    for day, (adds, removes) in enumerate([(["smallgear.org", "redbolt3.net"], ["small-gear2.com", "redbolt5.net"]), (["small-gear2.com"], ["smallgear.org", "redbolt3.net"])]):
        store.sync(Y.delta(L.lines_of(spark, adds), L.lines_of(spark, removes), WORDS, 1000 * (day + 1)))
    queries = query_rows(spark, [(0, "small gear", None, 5, None), (1, "bolt", "net", 50, None), (2, "zzz", None, 5, None)])
    want = sorted(map(str, S.search(queries, index_of(store.docs())).collect()))
    for index in (store.index(), store.index(["small", "gear", "bolt", "zzz"])):
        assert sorted(map(str, S.search(queries, index).collect())) == want and len(want) > 8
    corpus, own = store.index().corpus.head(), index_of(store.docs()).corpus.head()
    assert (corpus["n"], corpus["avgdl"]) == (own["n"], pytest.approx(own["avgdl"])) and store.count() == store.docs().count()
    terms = lambda index: sorted(map(tuple, index.terms.collect()))
    assert terms(store.index()) == terms(index_of(store.docs())) and terms(store.index(["bolt"])) == [t for t in terms(store.index()) if t[0] == "bolt"]
    plan = store.index(["bolt"]).postings._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(token,bolt\)", plan)
    assert sorted(r["doc_seq"] for r in store.exact("small-gear2.com").collect()) == [2001]


def test_parts_are_merged_and_old_files_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "FAN", 3)
    store = store_of(spark, tmp_path / "i", [f"{x}-gear.com" for x in "abcdefghi"])
    first = store.state()["parts"][0]
    for day in range(4):
        store.sync(Y.delta(L.lines_of(spark, [f"new{day}x.com"]), L.lines_of(spark, []), WORDS, 100 * (day + 1)))
    assert store.segments() <= 3 and store.count() == 13 and store.state()["parts"][0] == first  # what is large is not written again
    before = names(store)
    assert store.vacuum(1) > 0 and names(store) == before and len(store.versions()) == 1
    assert {f.name for f in (tmp_path / "i").iterdir() if f.is_dir()} == set(store._folders(store.state()))
    for orphan in ("staged-1", "docs-2"):
        (tmp_path / "i" / orphan).mkdir()
    (tmp_path / "i" / "pending-3").write_text("{")
    assert store.vacuum(1, age=3600) == 0 and store.vacuum(1) == 2 and not (tmp_path / "i" / "pending-3").exists() and names(store) == before


def test_cli_of_many_files_in_parts(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text("".join(f"small-gear{i}x{j}.com\n" for j in range(5)))
    (tmp_path / "words.txt").write_text("small\ngear\n")
    base = ["--index", f"file://{tmp_path}/i"]
    assert cli.main([*base, "full", "--file", str(tmp_path / "in"), "--words", str(tmp_path / "words.txt"), "--commit-interval", "6"]) == 0
    store = Store(spark, f"file://{tmp_path}/i")
    seqs = [r["doc_seq"] for r in store.docs().orderBy("domain_exact").collect()]
    assert len(set(seqs)) == 15 and seqs == sorted(seqs) and store.segments() == 3
    (tmp_path / "gone.txt").write_text("small-gear0x0.com\n")
    assert cli.main([*base, "daily", "--remove", f"file://{tmp_path}/gone.txt", "--add", f"file://{tmp_path}/absent.txt", "--words", str(tmp_path / "words.txt")]) == 0
    assert store.count() == 14
    with cli.lock(f"file://{tmp_path}/l", spark), pytest.raises(FileExistsError), cli.lock(f"file://{tmp_path}/l", spark):
        pass
    assert cli.main([*base, "vacuum", "--keep", "1"]) == 0
    out = capsys.readouterr()
    assert "full build: done" in out.err and "documents," in out.err


def test_http(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from namelode.http import answer, server

    store_of(spark, tmp_path / "i", ["small-gear.com", "redbolt.net"])
    service = Service(spark, str(tmp_path / "i"), ResultCache())
    assert answer(service, "GET", "/search?q=gear&limit=3")[1]["results"][0]["domain"] == "small-gear.com"
    assert [answer(service, *r)[0] for r in (("GET", "/search?q=%20"), ("GET", "/search"), ("GET", "/exact?domain=nodot"), ("GET", "/none"), ("GET", "/search?q=a&limit=x"), ("POST", "/search/bulk", b"{"))] == [400, 400, 400, 404, 400, 400]
    assert len(answer(service, "POST", "/search/bulk", b'{"queries": [{"q": "gear"}, {"q": "bolt"}], "limit": 2}')[1]["results"]) == 2
    web = server(service, 0, "127.0.0.1")
    threading.Thread(target=web.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}/health", timeout=60) as r:
        assert r.headers["Access-Control-Allow-Origin"] == "*" and b'"index_documents": 2' in r.read()
    web.shutdown()


def test_settings_of_a_file(tmp_path):
    (tmp_path / ".env").write_text("# c\nexport NAMELODE_BATCH_SIZE=7\nNAMELODE_ZONE_URL='http://z #1'\nNAMELODE_ZONE_TOKEN=t # note\nnonsense\n")
    found = Config.from_env(file=str(tmp_path / ".env"))
    assert (found.batch_size, found.zone_url, found.zone_token) == (7, "http://z #1", "t")
    assert Config.from_env({}, file=str(tmp_path / ".env")).batch_size == 50_000


def test_a_number_never_comes_back(spark, tmp_path, capsys):
    """The document of the highest number goes, then another one is added."""
    for name, lines in {"full": "red.com\nblue.com\ngreen.com\n", "gone": "green.com\n", "new": "gold.com\n", "words": "red\n"}.items():
        (tmp_path / name).write_text(lines)
    base, words = ["--index", str(tmp_path / "i")], ["--words", str(tmp_path / "words")]
    assert cli.main([*base, "full", "--file", str(tmp_path / "full"), *words]) == 0
    assert cli.main([*base, "daily", "--remove", str(tmp_path / "gone"), *words]) == 0
    assert cli.main([*base, "daily", "--add", str(tmp_path / "new"), *words]) == 0
    assert '"initial": 2, "rows_removed": 0, "added": 1, "final": 3, "net_change": 1' in capsys.readouterr().out
    store = Store(spark, str(tmp_path / "i"))
    assert names(store) == ["blue.com", "gold.com", "red.com"] and store.count() == 3 and [r["domain_exact"] for r in store.exact("gold.com").collect()] == ["gold.com"]
    with pytest.raises(ValueError):
        store.sync(Y.delta(L.lines_of(spark, ["late.com"]), L.lines_of(spark, []), WORDS, 0))
    assert store.count() == 3


def test_commits(spark, tmp_path, monkeypatch):
    """A writer that dies between its steps publishes nothing, of two writers one wins, and a broken pointer is passed over."""
    store = store_of(spark, tmp_path / "i", ["a-gear.com", "b-gear.com"])
    change = lambda name: Y.delta(L.lines_of(spark, [name]), L.lines_of(spark, ["a-gear.com"]), WORDS, store.next_seq())
    for step in ("_without", "publish"):
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(Store, step, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            store.sync(change("c-gear.com"))
        assert names(store) == ["a-gear.com", "b-gear.com"] and store.versions() == [1]
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Files, "rename", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        store.sync(change("c-gear.com"))
    assert names(store) == ["a-gear.com", "b-gear.com"]
    other, began = Store(spark, store.path), Store._begin
    first = []

    def late(self):
        state = began(self)
        if self is store and not first:
            first.append("begun")
            other.sync(change("other-gear.com"))
        return state

    made = change("c-gear.com")
    with monkeypatch.context() as m, pytest.raises(Conflict):
        m.setattr(Store, "_begin", late)
        store.sync(made)
    assert names(store) == ["b-gear.com", "other-gear.com"] and store.count() == 2
    (tmp_path / "i" / "pointer-99").write_text("")
    assert names(store) == ["b-gear.com", "other-gear.com"] and store.count() == 2 and store.vacuum(1) > 0 and names(store) == ["b-gear.com", "other-gear.com"]
    store.sync(change("c-gear.com"))
    assert names(store) == ["b-gear.com", "c-gear.com", "other-gear.com"] and store.versions()[-1] == 100
    assert store.vacuum(1) == 0 and names(store) == ["b-gear.com", "c-gear.com", "other-gear.com"] and {f.name for f in (tmp_path / "i").iterdir() if f.is_dir()} == set(store._folders(store.state()))


def test_many_syncs(spark, tmp_path, monkeypatch):
    """Random days against a dictionary: names, counts, statistics, lookups; no plan joins what was removed, row by row."""
    monkeypatch.setattr(snapshot, "ZONE", 64)
    monkeypatch.setattr(snapshot, "FAN", 3)
    rng = random.Random(7)
    pool = [f"{a}-{b}{i}.com" for a in ("small", "red") for b in ("gear", "bolt") for i in range(40)]
    have = set(rng.sample(pool, 100))
    store = store_of(spark, tmp_path / "i", sorted(have))
    most = 0
    for day in range(5):
        adds, removes = rng.sample(pool, rng.choice([0, 3, 30])), rng.sample(pool, rng.choice([0, 5, 60]))
        counts = store.sync(Y.delta(L.lines_of(spark, adds), L.lines_of(spark, removes), WORDS, store.next_seq()))
        assert counts["rows_removed"] == len(have & set(removes)) and counts["initial"] == len(have)
        have = (have - set(removes)) | set(adds)
        assert counts["final"] == len(have) == store.count() and names(store) == sorted(have)
        most = max(most, store.segments())
    own, want = store.index(), index_of(store.docs())
    assert sorted(map(tuple, own.terms.collect())) == sorted(map(tuple, want.terms.collect()))
    assert own.corpus.head()["avgdl"] == pytest.approx(want.corpus.head()["avgdl"]) and most <= 7
    assert sorted((r["token"], r["tf"], r["dl"]) for r in own.postings.collect()) == sorted((r["token"], r["tf"], r["dl"]) for r in want.postings.collect())
    for name in rng.sample(pool, 2):
        assert [r["domain_exact"] for r in store.exact(name).collect()] == ([name] if name in have else [])
    queries = query_rows(spark, [(0, "gear", None, 1, None), (1, "small bolt", None, 1, None), (2, "red red gear", "com", 50, None)])
    assert sorted(map(str, S.search(queries, own).collect())) == sorted(map(str, S.search(queries, want).collect()))
    plan = store.docs()._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "words" in plan


def test_blocks_are_skipped_and_files_pruned(spark, tmp_path, monkeypatch):
    """A query reads the blocks that its candidates can be in, and the files of documents that hold candidates."""
    monkeypatch.setattr(snapshot, "ZONE", 32)
    raw = [f"gear{'-small' * (i % 3)}{'-bolt' * (i % 7 == 0)}-x{i}.com" for i in range(640)] + ["bolt.com"]
    store = store_of(spark, tmp_path / "i", raw)
    store.sync(Y.delta(L.lines_of(spark, []), L.lines_of(spark, raw[:5]), WORDS, store.next_seq()))
    want = index_of(store.docs())
    for q, lim, skipped in (("gear", 1, True), ("bolt gear", 2, False), ("gear gear small", 30, False)):
        queries = query_rows(spark, [(0, q, None, lim, None)])
        own, asked = store.index(), S.tokenized(queries)
        kept = S.competing_blocks(asked, own).count()
        every = own.blocks.join(S.query_tokens(asked), "token").count()
        assert kept <= every and (kept < every) >= skipped, (q, kept, every)
        pick = lambda index: sorted((r["r"], r["score"]) for r in S.candidates(asked, index).collect())
        assert pick(own) == pick(want)
    files = lambda rows: len(rows.inputFiles())
    state = store.state()
    assert files(store.docs_at(state, spark.createDataFrame([(70,), (71,)], "at long"))) <= 2 < len(state["parts"][0]["files"])
    assert files(store.docs_at(state, spark.createDataFrame([], "at long"))) == 0
    assert sorted(r["at"] for r in store.docs_at(state, spark.createDataFrame([(0,), (31,), (32,), (640,)], "at long")).collect()) == [0, 31, 32, 640]


def test_stream_batches_that_come_again(spark, tmp_path):
    store = store_of(spark, tmp_path / "i", ["a-gear.com"])
    rows = lambda *x: spark.createDataFrame(list(x), "file string, raw string")
    batch = rows(("1.add.txt", "b-gear.com"), ("2.remove.txt", "b-gear.com"), ("2.add.txt", "c-gear.com"))
    assert daily.apply_batch(store, WORDS, batch, "s", 0) == ["1", "2"] and names(store) == ["a-gear.com", "c-gear.com"]
    before = store.versions()
    assert daily.apply_batch(store, WORDS, batch, "s", 0) == [] and store.versions() == before
    store.publish(before[-1], store.state() | {"applied": {"s": [0, "1"]}})  # as if it had failed between the days
    assert daily.apply_batch(store, WORDS, batch, "s", 0) == ["2"] and daily.apply_batch(store, WORDS, batch, "other", 0) == ["1", "2"]
    with pytest.raises(ValueError):
        daily.apply_batch(store, WORDS, rows(("list.txt", "x.com")), "s", 1)
    assert names(store) == ["a-gear.com", "c-gear.com"]
