import pytest
from pyspark.sql import functions as F

from namelode.functions import text as T
from namelode.functions.idna import to_ascii
from namelode.operators.normalize import normalize, with_status
from namelode.operators.segment import DictionarySegmenter, LookupSegmenter, add_tokens, segment_single
from namelode.sources import lines as L
from namelode.sources.download import DownloadError, ListKind, download_bytes, list_url, member_of
from namelode.config import Config, ConfigError


def names(spark, *raw):
    rows = with_status(normalize(spark.createDataFrame([(r,) for r in raw], "raw string"))).collect()
    return {r["raw"]: r for r in rows}


def test_normalize(spark):
    got = names(spark, "Example.COM", "example.com.", "my-domain.net", "münchen.de", "nodot", ".com", "com..", "a.b.co.uk", "x" * 64 + ".com", " 　a.de\t", "foo_bar.com", "☃.net", "straße.de")
    assert (got["Example.COM"]["domain_exact"], got["Example.COM"]["label"], got["Example.COM"]["tld"], got["Example.COM"]["len"], got["Example.COM"]["has_hyphen"]) == ("example.com", "example", "com", 7, False)
    assert got["example.com."]["domain_exact"] == "example.com"
    assert got["my-domain.net"]["has_hyphen"] and got["my-domain.net"]["label"] == "my-domain"
    assert got["münchen.de"]["domain_exact"] == "xn--mnchen-3ya.de"
    assert got["straße.de"]["domain_exact"] == "xn--strae-oqa.de" and got["☃.net"]["label"].startswith("xn--")
    assert (got["nodot"]["status"], got[".com"]["status"], got["x" * 64 + ".com"]["status"]) == ("no_dot", "empty_label", "label_too_long")
    assert (got["com.."]["status"], got["com.."]["tld"]) == ("ok", "")
    assert (got["a.b.co.uk"]["label"], got["a.b.co.uk"]["tld"]) == ("a.b.co", "uk")
    assert got[" 　a.de\t"]["domain_exact"] == "a.de" and got["foo_bar.com"]["status"] == "ok"


@pytest.mark.parametrize("label,junk", [("123456", True), ("aaaaa", True), ("xxxxxxx", True), ("1-2-3", True), ("abc123", False), ("ababa", False), ("a-1-2", False), ("12345", True), ("1", True), ("aaaa", False), ("-----", True), ("1.2", False)])
def test_junk(spark, label, junk):
    assert spark.range(1).select(T.is_junk(F.lit(label))).head()[0] is junk


def test_scan_and_batches(spark):
    raw = ["example.com", "test.net", "", "# comment", "invalid", "a." + "b" * 252]
    rows = L.lines_of(spark, raw)
    assert [r["s"] for r in L.scan(rows).orderBy("line_no").collect()] == ["example.com", "test.net"]
    assert L.count_lines(rows).head()[0] == 3
    five = L.scan(L.lines_of(spark, [f"{c}.com" for c in "abcde"]))
    assert sorted((r["s"], r["batch"]) for r in L.batch_ids(five, "line_no", 2).collect()) == [("a.com", 0), ("b.com", 0), ("c.com", 1), ("d.com", 1), ("e.com", 2)]


def test_read_lines(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes("b.com\r\na.com\nü.de\n".encode())
    rows = L.scan(L.read_lines(spark, str(tmp_path / "d.txt"))).orderBy("line_no").collect()
    assert [r["s"] for r in rows] == ["b.com", "a.com", "ü.de"]
    (tmp_path / "bad.txt").write_bytes(b"\xff.com\n")
    with pytest.raises(Exception, match="UTF-8"):
        L.read_lines(spark, str(tmp_path / "bad.txt"), strict=True).collect()


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(T.id48(F.lit("example.com"))) == 99758087617314
    assert one(F.base64(F.lit("user:pass").cast("binary"))) == "dXNlcjpwYXNz"
    assert one(T.split_tokens(F.lit(""))) == [] and one(T.query_tokens(F.lit(" A  b\tA "))) == ["a", "b", "a"]
    assert one(T.cache_key(F.lit("q"), F.lit(None).cast("string"), F.lit(5), F.lit(None).cast("int"))) == "search:q|any|5|1"
    assert one(T.index_terms(F.array(F.lit("Foo-bar"), F.lit("x" * 40), F.lit("foo")))) == ["foo", "bar", "foo"]
    score = lambda m, n, b: one(T.combined_score(F.lit(m), F.lit(n), F.lit(b)))
    assert score(3, 10, 5.0) > score(2, 10, 5.0) and score(2, 5, 5.0) > score(2, 20, 5.0) and score(3, 20, 5.0) > score(2, 5, 5.0)


def test_segmenters(spark):
    d = DictionarySegmenter({"cold": 50, "widget": 50, "old": 40, "c": 1, "middle": 10, "of": 90, "night": 10})
    assert d.split("coldwidget") == ["cold", "widget"] and d.split("middle-ofnight") == ["middle", "of", "night"]
    rows = spark.createDataFrame([("coldwidget",), ("zz",), ("coldwidget",)], "label string")
    table = spark.createDataFrame([("coldwidget", ["cold", "widget"])], "label string, tokens array<string>")
    assert sorted((r["label"], r["tokens"]) for r in add_tokens(rows, LookupSegmenter(table)).collect()) == [("coldwidget", ["cold", "widget"])] * 2 + [("zz", [])]
    assert add_tokens(rows, d).count() == 3


def test_download_names():
    assert [k.value for k in ListKind] == ["full", "dailyupdate", "dailyremove"]
    assert member_of(["a.txt", "x/domains.txt"]) == "x/domains.txt" and member_of(["r.md", "a.txt"]) == "a.txt"
    with pytest.raises(DownloadError):
        member_of(["r.md"])
    assert list_url(Config(zone_url="http://z/", zone_token="t"), ListKind.FULL) == "http://z/t/get/full/list/zip"
    with pytest.raises(ConfigError):
        list_url(Config(), ListKind.FULL)
    assert Config.from_env({"NAMELODE_BATCH_SIZE": "10"}).batch_size == 10
    with pytest.raises(ConfigError):
        Config.from_env({"NAMELODE_BATCH_SIZE": "x"})


def test_idna_falls_back():
    assert to_ascii("\u0378.de") == "\u0378.de" and to_ascii("plain.com") == "plain.com"  # an unassigned character


def test_one_label(spark):
    assert segment_single(spark, DictionarySegmenter({"red": 3, "gear": 2}), "redgear") == ["red", "gear"]
    assert segment_single(spark, LookupSegmenter(spark.createDataFrame([], "label string, tokens array<string>")), "x") == []


def test_download_to_memory(tmp_path):
    (tmp_path / "t" / "get" / "full" / "list").mkdir(parents=True)
    (tmp_path / "t" / "get" / "full" / "list" / "zip").write_bytes(b"PK")
    config = Config(zone_url=f"file://{tmp_path}", zone_token="t")
    assert download_bytes(config, ListKind.FULL) == b"PK"
    with pytest.raises(DownloadError):
        download_bytes(config, ListKind.DAILY_REMOVE)


def test_idna_of_every_character():
    """Each assigned character, and random names, against the library that has the standard's table; Punycode against the codec."""
    import random
    import unicodedata

    from namelode.functions.idna import punycode

    rng = random.Random(4)
    pools = ["abcdef-019", "äöüßéñ", "пример", "例子テスト", "मराठी", "😀🏳"]
    for _ in range(3000):
        label = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 30)))
        assert punycode(label) == label.encode("punycode").decode()
    library = pytest.importorskip("idna")

    def want(name):
        try:
            labels = library.uts46_remap(name, std3_rules=False, transitional=False).split(".")
        except UnicodeError:
            return name
        return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels)

    known = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    assert not [hex(ord(c)) for c in known if to_ascii(f"a{c}b.de") != want(f"a{c}b.de")]
    for _ in range(5000):
        name = "".join(rng.choices(known, k=rng.randint(1, 12)))
        assert to_ascii(name) == want(name)
