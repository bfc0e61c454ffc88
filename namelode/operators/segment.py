"""Splitting labels into words. A segmenter maps distinct labels to tokens; labels it doesn't know get none."""

from __future__ import annotations

import base64
import json
import math
import re
import time
import urllib.request
import warnings
from collections import deque
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from http.client import HTTPException
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "label string, tokens array<string>"


class Segmenter(Protocol):
    def segments(self, labels: DataFrame) -> DataFrame:
        """label, tokens for distinct labels."""


class LookupSegmenter:
    """Tokens from a table (label, tokens)."""

    def __init__(self, table: DataFrame):
        self.table = table

    def segments(self, labels: DataFrame) -> DataFrame:
        return labels.join(self.table, "label")


def best_split(run: str, cost: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The likeliest words of a run of letters under a unigram model; unknown stretches cost by the character."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for i in range(1, len(run) + 1):
        options = [(best[j][0] + cost.get(run[j:i], unknown * (i - j) + unknown), j) for j in range(max(0, i - longest), i)]
        best.append(min(options))
    out, i = [], len(run)
    while i:
        out.append(run[best[i][1] : i])
        i = best[i][1]
    return out[::-1]


class DictionarySegmenter:
    """Maximum-likelihood words of a dictionary (word -> count), after splitting at hyphens and dots."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.unknown = math.log(total) + 10

    def split(self, label: str) -> list[str]:
        return [w for run in re.split("[-.]+", label) if run for w in best_split(run, self.cost, max(self.longest, 1), self.unknown)]

    def segments(self, labels: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(tokens=frame["label"].map(self.split))

        return labels.mapInPandas(run, SEGMENTS)


class TableSegmenter:
    """What ``DictionarySegmenter`` gives, for a dictionary (w, count) of any size, which stays a table.

    Every stretch of a label that could be a word is looked up by a join; a label then has its own few words with their counts, and
    the best split is found among them. Stretches are distinct before the join, so one that many labels hold is
    looked up once, and what is gathered for a label is bounded by its length.
    """

    def __init__(self, words: DataFrame):
        self.words = words
        found = words.agg(F.sum("count"), F.max(F.char_length("w"))).head()
        self.total, self.longest = int(found[0] or 0) or 1, int(found[1] or 1)
        self.unknown = math.log(self.total) + 10

    def segments(self, labels: DataFrame) -> DataFrame:
        total, longest, unknown = self.total, self.longest, self.unknown
        ends = lambda n: F.sequence(F.lit(1), n)
        runs = labels.select(F.explode(F.split("label", "[-.]+")).alias("run")).where("run <> ''").distinct()
        size = F.char_length("run")
        starts = runs.select("run", F.explode(ends(size)).alias("a")).withColumn("n", F.explode(ends(F.least(F.lit(longest), F.char_length("run") - F.col("a") + 1))))
        pieces = starts.select("run", F.substring(F.col("run"), F.col("a"), F.col("n")).alias("w"))
        known = pieces.select("w").distinct().join(self.words.select("w", "count"), "w")
        hits = pieces.distinct().join(known, "w").groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("w", "count"))).alias("found"))

        def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                costs = [{w: -math.log(n / total) for w, n in (found or {}).items()} for found in frame["found"]]
                yield pd.DataFrame({"run": frame["run"], "words": [best_split(run, cost, longest, unknown) for run, cost in zip(frame["run"], costs)]})

        # a run without any known word is split as well
        words = runs.join(hits, "run", "left").mapInPandas(split, "run string, words array<string>")
        placed = labels.select("label", F.posexplode(F.split("label", "[-.]+")).alias("i", "run")).where("run <> ''").join(words, "run")
        joined = placed.groupBy("label").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "words"))), lambda x: x["words"])).alias("tokens"))
        return labels.select("label").join(joined, "label", "left").select("label", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


class HttpSegmenter:
    """A word-splitting service: POST {"labels": [...]} with basic authentication, answers in the order asked.

    A task keeps ``parallel`` calls of ``chunk`` labels each under way and yields answers in order, so it holds that many chunks
    at most. A call that fails is tried again after a pause; after ``tries`` its labels have no tokens, with a warning, and the
    job goes on. ``strict``: it fails instead.
    """

    def __init__(self, url: str, user: str, password: str, chunk: int = 50_000, timeout: float = 120, parallel: int = 4, tries: int = 2, pause: float = 0.5, strict: bool = False):
        if min(chunk, parallel, tries) < 1:
            raise ValueError("chunk, parallel and tries must be positive")
        self.url, self.auth, self.chunk, self.timeout = url, base64.b64encode(f"{user}:{password}".encode()).decode(), chunk, timeout
        self.parallel, self.tries, self.pause, self.strict = parallel, tries, pause, strict

    def ask(self, labels: list[str]) -> list[list[str]]:
        request = urllib.request.Request(f"{self.url.rstrip('/')}/segment/bulk", json.dumps({"labels": labels}).encode(), {"Content-Type": "application/json", "Authorization": f"Basic {self.auth}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            answers = {r["label"]: r["segmentation"] for r in json.load(response)["results"]}
        return [answers.get(x, []) for x in labels]

    def ask_or_leave(self, labels: list[str]) -> list[list[str]]:
        for turn in range(self.tries):
            try:
                return self.ask(labels)
            except (OSError, HTTPException, ValueError, KeyError, TypeError) as e:  # no answer, or not one that can be read
                failed = e
                if turn + 1 < self.tries:
                    time.sleep(self.pause * 2**turn)
        if self.strict:
            raise RuntimeError(f"the segmenter gave no answer for {len(labels)} labels") from failed
        warnings.warn(f"{len(labels)} labels stay without tokens: {failed}", stacklevel=2)
        return [[] for _ in labels]

    def segments(self, labels: DataFrame) -> DataFrame:
        def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Frames are batches of Arrow's size; a call takes as many of their rows as it may."""
            own: list[pd.DataFrame] = []
            for frame in frames:
                while len(frame):
                    room = self.chunk - sum(map(len, own))
                    own.append(frame.iloc[:room])
                    frame = frame.iloc[room:]
                    if sum(map(len, own)) == self.chunk:
                        yield pd.concat(own)
                        own = []
            if own:
                yield pd.concat(own)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(self.parallel) as pool:
                under_way: deque[tuple[pd.DataFrame, Future]] = deque()
                for part in chunks(frames):
                    if len(under_way) == self.parallel:
                        done, answer = under_way.popleft()
                        yield done.assign(tokens=answer.result())
                    under_way.append((part, pool.submit(self.ask_or_leave, part["label"].tolist())))
                for done, answer in under_way:
                    yield done.assign(tokens=answer.result())

        return labels.mapInPandas(run, SEGMENTS)


DICTIONARY_BYTES = 64 << 20


def dictionary_segmenter(words: DataFrame, most: int = DICTIONARY_BYTES) -> Segmenter:
    """Of words (w, count): in every task while they take no more than ``most`` bytes, as a table beyond that."""
    size = words.agg(F.sum(F.octet_length("w") + 16)).head()[0] or 0
    return DictionarySegmenter({r["w"]: r["count"] for r in words.collect()}) if size <= most else TableSegmenter(words)


def segment_single(spark: SparkSession, segmenter: Segmenter, label: str) -> list[str]:
    """The tokens of one label; none without an answer."""
    found = segmenter.segments(spark.createDataFrame([(label,)], "label string")).head()
    return list(found["tokens"]) if found else []


def add_tokens(rows: DataFrame, segmenter: Segmenter) -> DataFrame:
    """rows with tokens, joined by label; without an answer a row has none and stays."""
    found = segmenter.segments(rows.select("label").distinct()).select("label", F.col("tokens").alias("found"))
    return rows.join(found, "label", "left").withColumn("tokens", F.coalesce("found", F.array().cast("array<string>"))).drop("found")
