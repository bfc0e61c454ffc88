"""Spelling variants: words one edit apart, found in a dictionary sorted forwards and one sorted backwards.

One edit (an inserted, deleted or replaced code point) leaves a half of a word as it is. Let m be the shorter length of a pair
and p the length of its longest common prefix, which is where the edit is. If p reaches the middle of m, the pair has its first half in
common and meets in a block of the dictionary sorted forwards; if not, it has its second half in common and meets in a block
of the one sorted backwards. So a pair belongs to exactly one block.

A block stands for one m and a range of p: ``low <= p < high``. Its words share the first ``low`` and the last ``m - high`` code
points. A block is subdivided by halving the range of p, so that its words share more on either side; at a range of one place it is
split by the kind of edit, and then the alphabet bounds it. Blocks of more than ``most`` words are subdivided by Spark, as rows of
smaller blocks. All rows are range-sorted by block, so each task scans whole blocks, one after the other, subdivides them further in
memory, and verifies what is left. What leaves a block is a row a word: how many near words it has there and the most
frequent one; pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .op01_sharding import CRC_TABLE_SQL, crc_of

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP = 7, 2, 10, 31
MOST, FEW = 10_000, 8
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = "word string, n_near long, best_n long, best string"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of whole texts, in one of DROP runs (by the CRC of id and run) without one code point.

    Runs below least_length can give no word, so they are not taken out of the text. Counting is combined before the shuffle.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("own"), F.explode(found).alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", CAPITALS, SMALL)).otherwise(F.col("run"))).withColumn("h", F.crc32(F.concat("own", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % DROP == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def keyed(cells: DataFrame) -> DataFrame:
    """cells (word, n, m, low, high, kind) with block, which sorts them forwards by the shared first code points, and backwards by the
    shared last ones.

    kind: '' for any edit, 'r' for replacements only, 'i' for insertions only.
    """
    shared = F.greatest(F.col("m") - F.col("high") + (F.col("kind") == "i").cast("int"), F.lit(0))
    head = F.substring(F.col("word"), F.lit(1), F.col("low"))
    tail = F.substring(F.reverse("word"), F.lit(1), shared)
    return cells.withColumn("block", F.concat_ws(",", "m", "low", "high", "kind", head, tail))


def halves(m: Column, low: Column, high: Column) -> Column:
    """The two ranges of a range of places, each as a cell."""
    middle = F.floor((low + high) / 2).cast("int")
    cell = lambda a, b: F.struct(m.alias("m"), a.alias("low"), b.alias("high"), F.lit("").alias("kind"))
    return F.array(cell(low, middle), cell(middle, high))


def first_cells(words: DataFrame) -> DataFrame:
    """Each word as the shorter or equal one of a pair, and as the longer one: two halves each."""
    length = F.char_length("word")
    ms = F.filter(F.array(length, length - 1), lambda m: m > 0)
    cells = F.flatten(F.transform(ms, lambda m: halves(m, F.lit(0), m + 1)))
    return keyed(words.select("word", "n", F.inline(cells)))


def subdivided(cells: DataFrame) -> DataFrame:
    """The cells of blocks that are too large, as those of smaller blocks that hold the same pairs."""
    m, low, high = F.col("m"), F.col("low"), F.col("high")
    only = lambda kind: F.struct(m.alias("m"), low.alias("low"), high.alias("high"), F.lit(kind).alias("kind"))
    equal = F.char_length("word") == m
    kinds = F.when(equal, F.array(only("r"), only("i"))).otherwise(F.array(only("i")))
    smaller = F.when(high - low > 1, halves(m, low, high)).otherwise(kinds)
    return keyed(cells.select("word", "n", F.inline(smaller)))


def near(a: str, b: str, low: int, high: int) -> bool:
    """Whether one edit makes b of a, at a place (their longest common prefix) from low to below high; len(a) <= len(b)."""
    p, m = low, min(len(a), high)  # the first low code points are shared
    while p < m and a[p] == b[p]:
        p += 1
    if p >= high:
        return False
    return a[p + 1 :] == b[p + 1 :] and p < len(a) if len(a) == len(b) else a[p:] == b[p + 1 :]


class Block:
    """The words of a block with how many near words each has there, and the most frequent of them (ties: the smallest)."""

    def __init__(self, words: list[tuple[str, int]], m: int):
        self.words, self.m = words, m
        self.count = [0] * len(words)
        self.best: list[tuple[int, str] | None] = [None] * len(words)

    def take(self, i: int, n: int, other: tuple[int, str]) -> None:
        self.count[i] += n
        if self.best[i] is None or other < self.best[i]:
            self.best[i] = other

    def value(self, i: int) -> tuple[int, str]:
        word, n = self.words[i]
        return -n, word

    def groups(self, own: list[int], key) -> list[list[int]]:
        found: dict[str, list[int]] = {}
        for i in own:
            found.setdefault(key(self.words[i][0]), []).append(i)
        return [g for g in found.values() if len(g) > 1]

    def search(self, own: list[int], low: int, high: int, kind: str = "") -> None:
        """Subdivide until few words are left, or one place: there all words of length m are near each other, and near their insertions."""
        words, m = self.words, self.m
        if kind == "" and len(own) <= FEW:
            for at, i in enumerate(own):
                for j in own[at + 1 :]:
                    a, b = (i, j) if len(words[i][0]) <= len(words[j][0]) else (j, i)
                    if len(words[a][0]) == m and near(words[a][0], words[b][0], low, high):
                        self.take(a, 1, self.value(b))
                        self.take(b, 1, self.value(a))
        elif kind == "" and high - low > 1:
            middle = (low + high) // 2
            for g in self.groups(own, lambda w: w[len(w) - (m - middle) :]):
                self.search(g, low, middle)
            for g in self.groups(own, lambda w: w[low:middle]):
                self.search(g, middle, high)
        else:
            if kind != "i":
                self.alike([i for i in own if len(words[i][0]) == m])
            if kind != "r":
                for g in self.groups(own, lambda w: w[len(w) - (m - low) :]):
                    self.inserted(g, low)

    def alike(self, own: list[int]) -> None:
        """Words that differ in one and the same place."""
        if len(own) > 1:
            first, second = sorted(map(self.value, own))[:2]
            for i in own:
                self.take(i, len(own) - 1, second if self.value(i) == first else first)

    def inserted(self, own: list[int], low: int) -> None:
        """A word and words with one more code point at ``low``; one that repeats what stands there is near at a later place."""
        for i in (i for i in own if len(self.words[i][0]) == self.m):  # they share all their code points, so there is one at most
            word = self.words[i][0]
            for j in own:
                if j != i and word[low : low + 1] != self.words[j][0][low : low + 1]:
                    self.take(j, 1, self.value(i))
                    self.take(i, 1, self.value(j))

    def rows(self, low: int, high: int, kind: str) -> list[tuple[str, int, int, str]]:
        self.search(list(range(len(self.words))), low, high, kind)
        return [(w, c, -b[0], b[1]) for (w, _), c, b in zip(self.words, self.count, self.best) if c]


def block_rows(words: list[tuple[str, int]], block: str) -> list[tuple[str, int, int, str]]:
    m, low, high, kind, _ = block.split(",", 4)
    return Block(words, int(m)).rows(int(low), int(high), kind)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of sorted rows, one at a time; a block may go over several batches."""
    key, own = None, []
    names = ["word", "n_near", "best_n", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], names)

    for batch in batches:
        out = []
        for block, word, n in zip(*(batch.column(c).to_pylist() for c in ("block", "word", "n"))):
            if block != key:
                if len(own) > 1:
                    out += block_rows(own, key)
                key, own = block, []
            own.append((word, n))
        yield table(out)
    if len(own) > 1:
        yield table(block_rows(own, key))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n_near, best_n, best of the distinct words (word, n) that have near words."""
    found, cells = [], first_cells(words)
    while True:
        large = cells.groupBy("block").agg(F.count("*").alias("size"), F.first("kind").alias("kind")).where((F.col("size") > most) & (F.col("kind") == "")).select("block")
        large = written(large, "large")
        some = bool(large.head(1))
        fine = cells.join(large, "block", "left_anti") if some else cells
        ranged = fine.select("block", "word", "n").repartitionByRange("block").sortWithinPartitions("block")
        found.append(written(ranged.mapInArrow(scan, NEAR), "near"))
        if not some:
            break
        smaller = written(subdivided(cells.join(large, "block", "left_semi")), "cells")
        forget(cells)
        forget(large)
        cells = smaller
    forget(cells)
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    rows = rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return rows.select("word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.w").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root of links (word, form): where following forms ends. Each turn doubles the steps; a form is far more frequent than
    its word, so there are few."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = written(now.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(now)
        if not after.where("moved").head(1):
            return after.select("word", "root")
        now = after


def variants(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n)."""
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    nears = near_words(words, most)
    far = F.col("best_n") >= ratio * F.col("n")
    all_ = written(words.join(nears, "word", "left").select("word", F.when(far, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best_n")).alias("form_n")), "forms")
    forget(words)
    ends = roots(all_.where("form is not null"))
    return all_.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of the texts, the frequent word it is a variant of, and where that leads.

    Null and empty texts have no words; a null id is hashed as 'null'; repeated rows count again. Words are compared by code
    points, whatever their length. Near words of one count: the smallest is the form. A table without words gives an empty
    result. Other columns are not read. ``most`` bounds what is compared with each other at once and changes no result.
    """
    return variants(word_counts(docs, id_col, text_col), ratio, most)


def op11_query(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS MATERIALIZED (SELECT doc_id, translate(r, '{CAPITALS}', '{SMALL}') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{7,}}')) AS r FROM documents)),
hashed AS MATERIALIZED (SELECT doc_id, run, {crc_of("coalesce(doc_id::VARCHAR, 'null') || ':' || run")} AS h FROM (SELECT DISTINCT doc_id, run FROM runs), crc_table),
changed AS (SELECT CASE WHEN h % 31 = 0 THEN left(r.run, (h % length(r.run))::BIGINT) || substr(r.run, (h % length(r.run))::BIGINT + 2) ELSE r.run END AS word
  FROM runs r JOIN hashed k ON r.run = k.run AND r.doc_id IS NOT DISTINCT FROM k.doc_id),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masks AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS mask FROM places),
shorter AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS short FROM places),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
  UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.short = w.word UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.short = w.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(k := -other_n, w := other)) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, CASE WHEN -b.k >= 10 * n THEN b.w END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.k >= 10 * n THEN -b.k END AS form_n FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON s.next = f.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM steps WHERE next IS NULL) USING (word)
"""
