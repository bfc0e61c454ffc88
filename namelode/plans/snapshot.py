"""A stored index: parts as Parquet under a commit log, searched and changed without reading it whole.

A document's address is its place: parts in order, and within a part by doc_seq. Parts are never changed; what a sync removes from
one is marked in a bitmap of the part's addresses. A pointer of the log names the parts and bitmaps of a state, so readers that
resolve it once see one state. Files go through Spark's file systems, so a store may be anywhere.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.index import DOCS, Index, postings_of
from ..operators.sync import Delta
from .commits import PENDING, POINTER, CommitLog, Conflict, Files

BUCKETS = 256
#: Addresses of a file, of a block of postings, and of a row of a bitmap, at most.
ZONE = 1 << 15
#: Parts of about one size that are merged.
FAN = 4
BITMAP_BYTES = 32 << 20
DOC_SCHEMA = "doc_seq long, domain_exact string, label string, tld string, len int, has_hyphen boolean, tokens array<string>"
NAME_SCHEMA = "domain_exact string, off long"
BLOCK_SCHEMA = "token string, tf int, dl int, zone long, n int, offs array<long>, bucket int"
BITS_SCHEMA = "zone long, words array<long>"
LOST_SCHEMA = "token string, df long, bucket int"
EMPTY_PART = {"n": 0, "terms": 0, "gone_n": 0, "gone_terms": 0, "bits": None, "lost": None}
EMPTY = {"parts": [], "next_seq": 0, "applied": {}}
_scratch: list[str] = []


def bucket_of(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share, for stores that nobody keeps."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _scratch:
            _scratch.append(tempfile.mkdtemp(prefix="namelode-"))
            atexit.register(shutil.rmtree, _scratch[0], ignore_errors=True)
        shared = f"file://{_scratch[0]}"
    return os.path.join(shared, f"store-{uuid.uuid4().hex}")


def is_gone(off: Column) -> Column:
    """Whether the bitmap row beside an address in its zone (words, null where nothing is gone) has it."""
    at = F.pmod(off, F.lit(ZONE))
    return F.coalesce(F.getbit(F.get("words", (at / 64).cast("int")), (at % 64).cast("int")) == 1, F.lit(False))


def bitmaps(marked: DataFrame) -> DataFrame:
    """p, zone, words of marked addresses (p, off): a row of 64-bit words for each zone that has any."""
    at = F.pmod("off", F.lit(ZONE))
    words = marked.select("p", F.floor(F.col("off") / ZONE).alias("zone"), (at / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(off, {ZONE}) % 64 as int))").alias("bits"))
    words = words.groupBy("p", "zone", "word").agg(F.bit_or("bits").alias("bits"))
    full = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    row = F.transform(F.sequence(F.lit(0), F.lit(ZONE // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return words.groupBy("p", "zone").agg(full.alias("m")).select("p", "zone", row.alias("words"))


def marked_in(rows: DataFrame) -> DataFrame:
    """p, off of the addresses that bitmap rows (p, zone, words) have."""
    words = rows.select("p", "zone", F.posexplode("words").alias("word", "bits")).where("bits <> 0")
    bit = words.select("p", "zone", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).where(F.getbit("bits", F.col("bit")) == 1)
    return bit.select("p", (F.col("zone") * ZONE + F.col("word") * 64 + F.col("bit")).alias("off"))


def tier(n: int) -> int:
    t = 0
    while n >= FAN ** (t + 1):
        t += 1
    return t


class Store:
    """An index that is kept, in parts: the build, then one a sync. A part holds

    - ``docs``, sorted by doc_seq, in files of ZONE rows at most; the pointer has each file's rows, so an address tells its file;
    - ``names`` (domain_exact and address), ranged by name, for exact lookups and syncs;
    - ``postings`` in blocks: the addresses in one zone of the documents that hold a token tf times among dl terms. They are partitioned by
      a hash of the token and sorted by token, so that a search reads its tokens' rows only;
    - ``bits`` and ``lost``, if documents of it are gone: a bitmap of their addresses, and how many of them held each token, so
      that documents of a token are counted from blocks and losses, without a posting;
    - in the pointer ``n`` and ``terms``, documents and their terms, and what is gone of them.

    ``next_seq`` in the pointer only grows: a doc_seq never comes back.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.files = Files(spark, path)
        self.log = CommitLog(self.files)

    def versions(self) -> list[int]:
        return self.log.versions()

    def _latest(self) -> tuple[int, dict]:
        found = self.log.latest()
        if found is None:
            raise FileNotFoundError(f"{self.path} holds no snapshot")
        return found

    def state(self, version: int | None = None) -> dict:
        found = self._latest()[1] if version is None else self.log.read(version)
        if found is None:
            raise FileNotFoundError(f"{self.path} holds no snapshot {version}")
        return EMPTY | found

    def _begin(self) -> tuple[int, dict]:
        """What a writer starts from: the number that it saw, and the state."""
        found = self.log.latest()
        return (found[0], EMPTY | found[1]) if found else ((self.versions() or [0])[-1], EMPTY)

    def _fresh(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def _read(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    # writing

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """rows as a table beside the index while they are worked on, for sources that are slow to read again."""
        folder = self._fresh("staged")
        rows.write.mode("errorifexists").parquet(f"{self.path}/{folder}")
        try:
            yield self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
        finally:
            self.files.delete(folder)

    def _write_part(self, docs: DataFrame) -> tuple[dict, int, int]:
        """A new part, and the smallest and largest doc_seq in it. docs is evaluated once, for it may ask a service; all
        else is made of what was written. A part of one zone is one file of each kind and needs no ranging."""
        part, staged, seen = {k: self._fresh(k) for k in ("docs", "names", "postings")}, self._fresh("staged"), Observation()
        terms = F.coalesce(F.sum(F.size(T.index_terms(F.col("tokens")))), F.lit(0)).alias("terms")
        docs.select(*DOCS).observe(seen, F.count(F.lit(1)).alias("n"), terms, F.min("doc_seq").alias("low"), F.max("doc_seq").alias("high")).write.mode("errorifexists").parquet(f"{self.path}/{staged}")
        found = seen.get
        n = int(found["n"] or 0)
        if not n:
            self.files.delete(staged)
            return EMPTY_PART, 0, 0
        small = n <= ZONE
        put = lambda rows, *by: (rows.coalesce(1) if small else rows.repartitionByRange(*by)).sortWithinPartitions(*by)
        # ties by name, so that a part written again has the same order
        put(self._read(staged, DOC_SCHEMA), "doc_seq", "domain_exact").write.option("maxRecordsPerFile", ZONE).parquet(f"{self.path}/{part['docs']}")
        self.files.delete(staged)
        part = EMPTY_PART | part | {"n": n, "terms": int(found["terms"] or 0)}
        part["files"] = self._files_of(part["docs"], n)
        own = self._addressed(part)
        put(own.select("domain_exact", "off"), "domain_exact", "off").write.parquet(f"{self.path}/{part['names']}")
        each = postings_of(own.withColumn("doc_seq", F.col("off"))).withColumn("zone", F.floor(F.col("doc_seq") / ZONE))
        blocks = each.groupBy("token", "tf", "dl", "zone").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list("doc_seq")).alias("offs")).withColumn("bucket", bucket_of("token"))
        # ranged by zone too, so that a token with a third of all postings is dealt over many tasks
        blocks = put(blocks, "bucket", "token", "dl", "tf", "zone").write
        (blocks if small else blocks.partitionBy("bucket")).parquet(f"{self.path}/{part['postings']}")
        return part, int(found["low"] or 0), int(found["high"] or 0)

    def _files_of(self, folder: str, n: int) -> list[list]:
        """Name, first address and rows of each file of docs, in their order (a row a file)."""
        names = [f for f in Files(self.spark, f"{self.path}/{folder}").names() if f.startswith("part-")]
        if len(names) == 1:
            return [[names[0], 0, n]]
        counts = self._read(folder, DOC_SCHEMA).select(F.col("_metadata.file_name").alias("f")).groupBy("f").count().collect()
        order = lambda name: tuple(map(int, re.match(r"part-(\d+)-.*?-c(\d+)\.", name).groups()))
        out, first = [], 0
        for name, rows in sorted(((r["f"], r["count"]) for r in counts), key=lambda x: order(x[0])):
            out.append([name, first, rows])
            first += rows
        return out

    def publish(self, seen: int, state: dict) -> int:
        """Publish what was made from the state of number ``seen``. If another writer was first, what this one wrote goes again."""
        try:
            return self.log.commit(seen, state)
        except Conflict:
            known = {f for v in self.versions() for f in self._folders(self.log.read(v) or EMPTY)}
            for folder in set(self._folders(state)) - known:
                self.files.delete(folder)
            raise

    def build(self, docs: DataFrame) -> None:
        seen, state = self._begin()
        part, _, high = self._write_part(docs)
        self.publish(seen, EMPTY | {"parts": [part] if part["n"] else [], "next_seq": max(state["next_seq"], high + 1), "applied": state["applied"]})

    def append(self, docs: DataFrame) -> None:
        """Publish one more part of a build, of larger doc_seqs."""
        seen, state = self._begin()
        part = self._added(docs, state)
        self.publish(seen, state | {"parts": [*state["parts"], *([part[0]] if part[0]["n"] else [])], "next_seq": max(state["next_seq"], part[1] + 1)})

    def clear(self) -> None:
        """Publish an index without documents, for a build in parts."""
        seen, state = self._begin()
        self.publish(seen, EMPTY | {"applied": state["applied"]})

    def _added(self, docs: DataFrame, state: dict) -> tuple[dict, int]:
        part, low, high = self._write_part(docs)
        if part["n"] and low < state["next_seq"]:
            for folder in self._folders({"parts": [part]}):
                self.files.delete(folder)
            raise ValueError(f"doc_seq {low} is below {state['next_seq']}, the first that has not been used")
        return part, high

    # reading

    def _zone_bits(self, part: dict) -> DataFrame:
        bits = self._read(part["bits"], BITS_SCHEMA).select(F.col("zone").alias("b_zone"), "words")
        return F.broadcast(bits) if part["n"] // 8 <= BITMAP_BYTES else bits  # all of a part's bitmap is a bit a document at most

    def _alive(self, rows: DataFrame, part: dict) -> DataFrame:
        """rows with an address ``off`` in the part that are not gone."""
        if not part["bits"]:
            return rows
        found = rows.join(self._zone_bits(part), F.floor(F.col("off") / ZONE) == F.col("b_zone"), "left")
        return found.where(~is_gone(F.col("off"))).drop("b_zone", "words")

    def _addressed(self, part: dict, files: list[list] | None = None) -> DataFrame:
        """The part's documents (of some of its files) with ``off``, gone ones included."""
        files = part["files"] if files is None else files
        if not files:
            return self.spark.createDataFrame([], f"{DOC_SCHEMA}, off long")
        rows = self.spark.read.schema(DOC_SCHEMA).parquet(*(f"{self.path}/{part['docs']}/{f[0]}" for f in files)) if files is not part["files"] else self._read(part["docs"], DOC_SCHEMA)
        rows = rows.select(*DOCS, F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
        if len(files) == 1:
            return rows.select(*DOCS, (F.col("i") + files[0][1]).alias("off"))
        firsts = F.broadcast(self.spark.createDataFrame([(f[0], f[1]) for f in files], "f string, first long"))  # a row a file
        return rows.join(firsts, "f").select(*DOCS, (F.col("first") + F.col("i")).alias("off"))

    def _bases(self, state: dict) -> list[int]:
        bases = [0]
        for p in state["parts"]:
            bases.append(bases[-1] + p["n"])
        return bases

    def _union(self, tables: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], schema)

    def docs(self, state: dict | None = None) -> DataFrame:
        state = state or self.state()
        return self._union([(self._alive(self._addressed(p), p) if p["bits"] else self._read(p["docs"], DOC_SCHEMA)).select(*DOCS) for p in state["parts"]], DOC_SCHEMA)

    def docs_at(self, state: dict, addresses: DataFrame) -> DataFrame:
        """The documents at some addresses (``at``), with them; only files that hold any are read. Which zones of addresses
        are asked for comes to the driver, a number each."""
        zones = {r[0] for r in addresses.select(F.floor(F.col("at") / ZONE)).distinct().collect()}
        found = []
        for base, p in zip(self._bases(state), state["parts"]):
            files = [f for f in p["files"] if any(z in zones for z in range((base + f[1]) // ZONE, (base + f[1] + f[2] - 1) // ZONE + 1))]
            if files:
                found.append(self._addressed(p, files).withColumn("at", F.col("off") + base).drop("off"))
        return self._union(found, f"{DOC_SCHEMA}, at long").join(addresses.select("at").distinct(), "at")

    def blocks(self, state: dict, tokens: list[str] | None = None) -> DataFrame:
        """token, tf, dl, base, zone, n, and addrs, the addresses that are not gone. tokens: only theirs are read."""
        found = []
        for base, p in zip(self._bases(state), state["parts"]):
            rows = self._of_tokens(self._read(p["postings"], BLOCK_SCHEMA), tokens)
            if p["bits"]:
                rows = rows.join(self._zone_bits(p), F.col("zone") == F.col("b_zone"), "left").withColumn("offs", F.filter("offs", lambda o: ~is_gone(o)))
            found.append(rows.select("token", "tf", "dl", F.lit(base).alias("base"), "zone", "n", F.transform("offs", lambda o: o + base).alias("addrs")))
        return self._union(found, "token string, tf int, dl int, base int, zone long, n int, addrs array<long>")

    def _of_tokens(self, rows: DataFrame, tokens: list[str] | None) -> DataFrame:
        if tokens is None:
            return rows
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in tokens] or [("",)], "token string").select(bucket_of("token")).distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens or [""]))

    def terms(self, state: dict | None = None, tokens: list[str] | None = None) -> DataFrame:
        """token, df: sums over the parts' blocks and, below zero, over what syncs have removed. No posting is read."""
        state = state or self.state()
        counts = [self._of_tokens(self._read(p["postings"], BLOCK_SCHEMA), tokens).select("token", F.col("n").cast("long").alias("df")) for p in state["parts"]]
        counts += [self._of_tokens(self._read(p["lost"], LOST_SCHEMA), tokens).select("token", (-F.col("df")).alias("df")) for p in state["parts"] if p["lost"]]
        return self._union(counts, "token string, df long").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def corpus(self, state: dict) -> DataFrame:
        n, terms = (sum(p[k] - p[f"gone_{k}"] for p in state["parts"]) for k in ("n", "terms"))
        return self.spark.createDataFrame([(n, terms / n if n else None)], "n long, avgdl double")

    def index(self, tokens: list[str] | None = None) -> Index:
        """The current index; its doc_seqs are addresses, which have the same order. tokens: only their postings are read (names of
        partitions and statistics of row groups tell)."""
        state = self.state()
        blocks = self.blocks(state, tokens)
        postings = blocks.select("token", F.explode("addrs").alias("doc_seq"), "tf", "dl")
        located = [self._alive(self._addressed(p), p).withColumn("doc_seq", F.col("off") + base).select(*DOCS) for base, p in zip(self._bases(state), state["parts"])]
        at = lambda rows: self.docs_at(state, rows.select(F.col("doc_seq").alias("at"))).withColumn("doc_seq", F.col("at")).select(*DOCS)
        slack = sum(p["gone_n"] for p in state["parts"])
        return Index(self._union(located, DOC_SCHEMA), postings, self.corpus(state), self.terms(state, tokens), blocks, slack, at)

    def _names(self, state: dict) -> list[DataFrame]:
        return [self._alive(self._read(p["names"], NAME_SCHEMA), p).select("domain_exact", F.lit(i).alias("p"), "off") for i, p in enumerate(state["parts"])]

    def exact(self, name: str) -> DataFrame:
        """The current document of one normalized name, the first if there are several; the filter reaches the files, and one file
        of documents is read."""
        state = self.state()
        found = [self._alive(self._read(p["names"], NAME_SCHEMA).where(F.col("domain_exact") == F.lit(name)), p).select((F.col("off") + base).alias("at")) for base, p in zip(self._bases(state), state["parts"])]
        first = self._union(found, "at long").agg(F.min("at").alias("at")).where("at is not null")
        return self.docs_at(state, first).select(*DOCS)

    # changing

    def next_seq(self) -> int:
        """The first doc_seq that no document has had."""
        return self._begin()[1]["next_seq"]

    def sync(self, change: Delta, applied: dict | None = None) -> dict:
        """One publication after removals and additions; what goes was there before. Returns initial, rows_removed, added, final,
        net_change. applied: progress of a stream to keep with the commit. Raises Conflict if another writer was first."""
        seen, state = self._begin()
        part, high = self._added(change.added, state)
        names = change.removed.select("domain_exact", F.lit(1).alias("by"))
        if part["n"]:
            names = names.unionByName(self._read(part["names"], NAME_SCHEMA).select("domain_exact", F.lit(0).alias("by")))
        hits, lost, bits = (self._fresh(k) for k in ("staged", "lost", "bits"))
        have = self._union(self._names(state), "domain_exact string, p int, off long")
        have.join(names.groupBy("domain_exact").agg(F.max("by").alias("by")), "domain_exact").select("p", "off", "by").write.parquet(f"{self.path}/{hits}")
        gone = self._read(hits, "p int, off long, by int")
        parts, removed = self._without(state, gone, lost, bits)
        self.files.delete(hits)
        initial = sum(p["n"] - p["gone_n"] for p in state["parts"])
        after = state | {"parts": [*parts, part] if part["n"] else parts, "next_seq": max(state["next_seq"], high + 1), "applied": state["applied"] | (applied or {})}
        self.publish(seen, after)
        self._compact()
        final = sum(p["n"] - p["gone_n"] for p in after["parts"])
        return {"initial": initial, "rows_removed": removed, "added": part["n"], "final": final, "net_change": final - initial}

    def _without(self, state: dict, gone: DataFrame, lost: str, bits: str) -> tuple[list[dict], int]:
        """The parts after some addresses (p, off) are gone, and how many went by a removal. A part that loses documents gets a
        new bitmap and new losses, all others stay as they are."""
        if not gone.head(1):
            return state["parts"], 0
        base = F.element_at(F.array(*[F.lit(b).cast("long") for b in self._bases(state)]), F.col("p") + 1)
        marked = gone.withColumn("at", F.col("off") + base)
        rows = self.docs_at(state, marked).select("at", "tokens").join(marked, "at")
        sums = {r["p"]: r for r in rows.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.size(T.index_terms(F.col("tokens")))).alias("terms"), F.sum("by").alias("removed")).collect()}
        touched = [(i, p) for i, p in enumerate(state["parts"]) if i in sums and p["bits"]]
        before = [marked_in(self._read(p["bits"], BITS_SCHEMA).withColumn("p", F.lit(i))) for i, p in touched]
        bitmaps(reduce(DataFrame.unionByName, [gone.select("p", "off"), *before])).repartition("p").write.partitionBy("p").parquet(f"{self.path}/{bits}")
        terms = rows.select("p", F.explode(F.array_distinct(T.index_terms(F.col("tokens")))).alias("token"), F.lit(1).cast("long").alias("df"))
        before = [self._read(p["lost"], LOST_SCHEMA).select(F.lit(i).alias("p"), "token", "df") for i, p in touched]
        counts = reduce(DataFrame.unionByName, [terms, *before]).groupBy("p", "token").agg(F.sum("df").alias("df")).withColumn("bucket", bucket_of("token"))
        counts.repartition("p", "bucket").sortWithinPartitions("p", "bucket", "token").write.partitionBy("p").parquet(f"{self.path}/{lost}")
        at = lambda i, p: {"bits": f"{bits}/p={i}", "lost": f"{lost}/p={i}", "gone_n": p["gone_n"] + sums[i]["n"], "gone_terms": p["gone_terms"] + sums[i]["terms"]}
        return [p | at(i, p) if i in sums else p for i, p in enumerate(state["parts"])], sum(r["removed"] for r in sums.values())

    def _compact(self) -> None:
        """Merge what is due: the last parts of one tier once there are FAN of them (so a document is written again once a tier),
        and any part that is gone for the most part and has a zone's number of documents to lose. If another writer publishes meanwhile, a later sync does it."""
        while True:
            parts = self.state()["parts"]
            run = len(parts)
            live = [p["n"] - p["gone_n"] for p in parts]
            while run and tier(live[run - 1]) <= tier(live[-1]):
                run -= 1
            stale = [i for i, p in enumerate(parts) if p["gone_n"] * 2 > p["n"] and p["gone_n"] >= ZONE]
            span = (run, len(parts)) if len(parts) - run >= FAN else (stale[0], stale[0] + 1) if stale else None
            if span is None:
                return
            try:
                self.merge(*span)
            except Conflict:
                return

    def merge(self, start: int, end: int) -> None:
        """Parts start to end as one, or none if nothing in them is left."""
        seen, state = self._begin()
        own = state | {"parts": state["parts"][start:end]}
        part, _, _ = self._write_part(self.docs(own))
        parts = [*state["parts"][:start], *([part] if part["n"] else []), *state["parts"][end:]]
        self.publish(seen, state | {"parts": parts})

    def optimize(self) -> None:
        """All parts into one."""
        state = self.state()
        if len(state["parts"]) > 1 or any(p["gone_n"] for p in state["parts"]):
            self.merge(0, len(state["parts"]))

    def vacuum(self, keep: int = 2, age: float = 0) -> int:
        """Delete the pointers before the last ``keep``, and every folder that the others don't name, jobs that failed and
        never published included; how many folders went. Only what is older than ``age`` seconds goes: choose longer than
        any search or sync runs, or stop them before."""
        if keep < 1:
            raise ValueError("keep must be positive")
        now, found = time.time(), self.files.names()  # before the pointers, so that what is published meanwhile is not seen
        states = {v: self.log.read(v) for v in self.versions()}
        kept = [v for v, state in states.items() if state is not None][-keep:]  # one that can't be read shows nothing
        old = {n for n, changed in found.items() if now - changed >= age}
        dropped = {v for v in states if kept and v < kept[0] and f"{POINTER}{v}" in old}
        for v in dropped:
            self.files.delete(f"{POINTER}{v}")
        named = {f for v, state in states.items() if v not in dropped for f in self._folders(state or EMPTY)}
        gone = [n for n in old - named if kept and re.match(r"(docs|names|postings|bits|lost|staged)-", n)]
        for n in sorted(gone):
            self.files.delete(n)
        for n in old:
            if n.startswith(PENDING):
                self.files.delete(n)
        return len(gone)

    @staticmethod
    def _folders(state: dict) -> list[str]:
        parts = state.get("parts", [])
        return [*(p[k] for p in parts if p["n"] for k in ("docs", "names", "postings")), *(p[k].split("/")[0] for p in parts for k in ("bits", "lost") if p[k])]

    # telling

    def count(self) -> int:
        """Current documents, from the pointer alone."""
        return sum(p["n"] - p["gone_n"] for p in self.state()["parts"])

    def segments(self) -> int:
        return len(self.state()["parts"])

    def size_bytes(self) -> int:
        """Of the files in the current snapshot's folders."""
        return sum(self.files.system.getContentSummary(self.files.at(f)).getLength() for f in set(self._folders(self.state())))
