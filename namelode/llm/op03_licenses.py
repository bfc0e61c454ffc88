"""Fuzzy search for short licence notices.

A text is lower-cased (A-Z) and reduced to its words, joined by single spaces. A notice of n characters may hold up to k
edits. Split into k+1 pieces, at least one piece stands unchanged in any such occurrence (pigeonhole), so an Aho-Corasick
automaton over all pieces finds every candidate; the regex library's bounded-error matching then verifies the window around
it, by whole words, and tells the edits and the span. Candidates that begin within k characters share a window, so a window
has n + 3k characters at most, holds one occurrence, and the work is in proportion to the candidates. Numbers are never
edited: a version must be the notice's own. The base phrases are found exactly, by whole words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices and their labels.
NOTICES = {
    "under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "under the bsd license": "bsd",
    "dedicated to the public domain": "public-domain",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 10
NUMBER = re.compile("[0-9]+")
SEPARATORS = bytes(b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for b in range(256))
OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,word:long,words:long,edits:long>>"
SPANS = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64())]))


def normal(text: str) -> str:
    return b" ".join(text.encode().translate(SEPARATORS).split()).decode()


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.notices = [(n, label, len(n) // chars_per_edit) for n, label in notices.items()]
        self.letters = [Counter(n) for n in notices]
        self.numbers = [NUMBER.findall(n) for n in notices]
        self.patterns = [regex.compile(f"(?be)(?<![^ ])(?:{regex.escape(n)}){{e<={k}}}(?![^ ])") for n, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            cuts = [round(j * len(n) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(n[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for seed, owners in seeds.items():
            self.automaton.add_word(seed, (len(seed), owners))
        self.automaton.make_automaton()

    def fuzzy(self, words: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in order; where notices overlap, those with the smallest share of edits stay."""
        starts: dict[int, set[int]] = {}
        for last, (size, owners) in self.automaton.iter(words):
            for i, at in owners:
                starts.setdefault(i, set()).add(last + 1 - size - at)
        found = []
        for i, own in starts.items():
            n, k, hits, first, end = len(self.notices[i][0]), self.notices[i][2], set(), None, 0
            for start in [*sorted(own), 1 << 62]:
                if first is not None and start > first + k:
                    a, b = max(0, first - k), end + n + k
                    at = max(0, a - 1)
                    window = words[at : b + 1]
                    # an edit makes up for one missing character at most
                    if (self.letters[i] - Counter(window)).total() <= k and (m := self.patterns[i].search(window, a - at)) is not None and NUMBER.findall(m.group()) == self.numbers[i]:
                        hits.add((sum(m.fuzzy_counts), m.start() + at, m.end() + at))
                    first = None
                first, end = start if first is None else first, start
            taken = np.zeros(len(words) if hits else 0, bool)
            for edits, a, b in sorted(hits):
                if not taken[a:b].any():
                    taken[a:b] = True
                    found.append((edits / n, a, b, i, edits))
        taken, kept = np.full(len(words) if found else 0, np.inf), []
        for share, a, b, i, edits in sorted(found):
            if taken[a:b].min() >= share:
                taken[a:b] = share
                kept.append((i, a, b, edits))
        return sorted(kept, key=lambda x: (x[1], x[0]))

    def scan(self, text: str | None) -> tuple:
        words = normal(text or "")
        n_words = words.count(" ") + 1 if words else 0
        padded, labels, places, n_base = f" {words} ", set(), [], 0
        for phrase, label in BASE.items():
            at, first, last = -1, None, None
            while (at := padded.find(f" {phrase} ", at + 1)) >= 0:
                first, last, n_base = at if first is None else first, at, n_base + 1
            if first is not None:
                labels.add(label)
                places += [first, last]
        first = padded.count(" ", 0, min(places)) if places else None
        last = padded.count(" ", 0, max(places)) if places else None
        spans, before, seen, best = [], 0, 0, 1.0 if labels else 0.0
        for i, a, b, edits in self.fuzzy(words):
            before, seen = before + words.count(" ", seen, a), a
            notice, label, _ = self.notices[i]
            best = max(best, 1 - edits / len(notice))
            spans.append({"label": label, "word": before, "words": words.count(" ", a, b) + 1, "edits": edits})
        every = labels | {s["label"] for s in spans}
        return n_words, n_base, first, last, ",".join(sorted(labels)), ",".join(sorted(every)), best, spans


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is 1 for an exact phrase, else one minus edits over characters of the best notice, 0 without any. spans: each
    notice found, its first word (from 0), how many words it touches and its edits. Null and empty texts have no words, no
    labels (empty strings) and score 0. Every row gives a row, whatever its id; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, chars_per_edit)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                rows = [scanner.scan(t) for t in part.column(1).to_pylist()]
                n, base, first, last, base_labels, labels, score, spans = zip(*rows)
                long = lambda x: pa.array(x, pa.int64())
                yield pa.record_batch([part.column(0), long(n), long(base), long(first), long(last), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(spans, SPANS)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, OUT)


def op3_query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
