"""Zipped lists over the web, and the segmenting service: ranges, broken connections, calls that fail."""

import json
import threading
import zipfile
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from namelode import cli
from namelode.operators.segment import HttpSegmenter
from namelode.plans import catalog, fixtures
from namelode.plans.snapshot import Store
from namelode.sources import lines as L
from namelode.sources import zipped
from namelode.sources.download import DownloadError

SMALL = "/root/testdata/sf0.001"


@contextmanager
def served(**methods):
    handler = type("Handler", (BaseHTTPRequestHandler,), {**methods, "log_message": lambda *a: None})
    web = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{web.server_port}"
    finally:
        web.shutdown()


def ranges_of(data, asked, broken=0, tag=lambda n: "1", ranges=True):
    """A GET that answers ranges of data; every ``broken``-th answer stops half way."""

    def get(self):
        asked.append(self.headers.get("Range"))
        if not ranges:
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)
            return
        start, end = (int(x) for x in self.headers["Range"].removeprefix("bytes=").split("-"))
        part = data[start : end + 1]
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {start}-{start + len(part) - 1}/{len(data)}")
        self.send_header("Content-Length", str(len(part)))
        self.send_header("ETag", tag(len(asked)))
        self.end_headers()
        self.wfile.write(part[: len(part) // 2] if broken and len(asked) % broken == 0 else part)

    return get


def archive(path, lines, member="lists/domains.txt"):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.md", "x")
        z.writestr(member, lines if isinstance(lines, bytes) else "\n".join(lines))
    return path.read_bytes()


def test_zipped_lists_are_scanned_like_text(spark, tmp_path, monkeypatch):
    """The corpus of scan_parse through an archive on a server whose connections break."""
    raw = [r["raw"] for r in fixtures.raw_domains(spark, SMALL).orderBy("seq").collect() if "\n" not in r["raw"]]
    monkeypatch.setattr(zipped, "RANGE", 2048)
    data, asked = archive(tmp_path / "list.zip", raw), []
    want = sorted(r["s"] for r in catalog.QUERIES["scan_parse"](spark, SMALL).collect())
    with served(do_GET=ranges_of(data, asked, broken=3)) as url:
        file = zipped.WebFile(f"{url}/list", pause=0.01)
        assert file.readall() == data and len(asked) >= 2
        monkeypatch.setattr(zipped.WebFile, "__init__", lambda self, url, f=zipped.WebFile.__init__: f(self, url, pause=0.01))
        assert [x for b in zipped.batches_of(f"{url}/list", 7) for x in b["raw"].to_pylist()] == raw
        got = zipped.read_zipped(spark, [f"{url}/list", str(tmp_path / "list.zip"), f"file://{tmp_path}/list.zip"])
        rows = got.orderBy("file", "line_no").collect()
    assert len(rows) == 3 * len(raw) and [r["line_no"] for r in rows[: len(raw)]] == list(range(1, len(raw) + 1))
    assert sorted(r["s"] for r in L.scan(spark.createDataFrame(rows, zipped.SCHEMA)).where(F.col("file").startswith("http")).collect()) == want


def test_zipped_lists_edges(spark, tmp_path):
    archive(tmp_path / "a.zip", b"one.com\r\n\xff\xfe.com\n\n" + b"x" * 300_000 + b".com\nlast.net")
    archive(tmp_path / "b.zip", b"", "domains.txt")
    rows = zipped.read_zipped(spark, [str(tmp_path / "a.zip"), str(tmp_path / "b.zip")]).orderBy("line_no").collect()
    assert [r["raw"][:9] for r in rows] == ["one.com\r", "\ufffd\ufffd.com", "", "x" * 9, "last.net"] and len(rows[3]["raw"]) == 300_004
    archive(tmp_path / "c.zip", "x", "picture.png")
    with pytest.raises(DownloadError):
        list(zipped.batches_of(str(tmp_path / "c.zip")))
    data = archive(tmp_path / "d.zip", ["a.com"] * 5)
    with served(do_GET=ranges_of(data, [], ranges=False)) as url, pytest.raises(DownloadError):
        zipped.WebFile(url)
    with served(do_GET=lambda self: self.send_error(404)) as url, pytest.raises(DownloadError):
        zipped.WebFile(url)
    with served(do_GET=ranges_of(data, [], broken=1)) as url, pytest.raises(DownloadError):
        zipped.WebFile(url, tries=2, pause=0.01).read(50)
    with served(do_GET=ranges_of(data, [], tag=str)) as url, pytest.raises(DownloadError):
        zipped.WebFile(url).read(50)


def test_cli_reads_lists_from_the_web(spark, tmp_path, monkeypatch, capsys):
    lists = {"full": ["small-gear.com", "redbolt.net", "old.org"], "dailyupdate": ["fresh.io", "12345.com"], "dailyremove": ["old.org", "absent.com"]}
    data = {k: archive(tmp_path / f"{k}.zip", v) for k, v in lists.items()}
    (tmp_path / "words.txt").write_text("small\ngear\nred\nbolt\n")

    def get(self):
        ranges_of(data[self.path.split("/")[3]], [])(self)

    with served(do_GET=get) as url:
        monkeypatch.setenv("NAMELODE_ZONE_URL", url), monkeypatch.setenv("NAMELODE_ZONE_TOKEN", "t")
        base, words = ["--index", str(tmp_path / "i")], ["--words", str(tmp_path / "words.txt")]
        assert cli.main([*base, "full", *words]) == 0 and cli.main([*base, "daily", "--download", *words]) == 0
    assert sorted(r["domain_exact"] for r in Store(spark, str(tmp_path / "i")).docs().collect()) == ["fresh.io", "redbolt.net", "small-gear.com"]
    assert '"rows_removed": 1, "added": 1, "final": 3, "net_change": 0, "delete_requests": 2, "filtered": 1' in capsys.readouterr().out
    assert not [f for f in (tmp_path / "i").iterdir() if f.name.startswith("staged")]


def test_calls_of_the_segmenter(spark):
    """Calls of bounded size, several at a time; labels of calls that fail stay without tokens, unless told otherwise."""
    lock, state = threading.Lock(), {"now": 0, "most": 0, "sizes": [], "calls": 0}
    together = threading.Barrier(2)

    def post(self):
        labels = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["labels"]
        with lock:
            state["now"] += 1
            state["calls"] += 1
            state["most"] = max(state["most"], state["now"])
            state["sizes"].append(len(labels))
        try:
            together.wait(0.3)
        except threading.BrokenBarrierError:
            pass
        with lock:
            state["now"] -= 1
        if "l30" in labels:
            self.send_error(503)
            return
        body = b"nonsense" if "l50" in labels else json.dumps({"results": [{"label": x, "segmentation": [x[0], x[1:]]} for x in labels if x != "l7"]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    labels = spark.createDataFrame([(f"l{i}",) for i in range(65)], "label string").coalesce(1)
    with served(do_POST=post) as url:
        own = HttpSegmenter(url, "u", "p", chunk=10, parallel=3, tries=2, pause=0.01)
        rows = {r["label"]: r["tokens"] for r in own.segments(labels).collect()}
        failed = {f"l{i}" for i in [*range(30, 40), *range(50, 60), 7]}
        assert len(rows) == 65 and all(t == ([] if x in failed else ["l", x[1:]]) for x, t in rows.items())
        assert state["most"] <= 3 and state["most"] >= 2 and max(state["sizes"]) == 10 and sum(state["sizes"]) == 65 + 20 and state["calls"] == 9
        assert own.segments(labels.limit(0)).count() == 0
        with pytest.raises(Exception, match="no answer"):
            HttpSegmenter(url, "u", "p", chunk=10, tries=1, strict=True).segments(labels).collect()
    gone = HttpSegmenter(url, "u", "p", tries=1).segments(labels).collect()  # nobody listens any more
    assert len(gone) == 65 and not any(r["tokens"] for r in gone)
