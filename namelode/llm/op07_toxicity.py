"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over every text.
2. Words that look obfuscated (digits or signs among letters, letters set apart by spaces or signs, letters three times over)
   become lattices: each character may stand for itself, for letters it imitates, for a repetition or for nothing, at a
   price, and a space between characters set apart for the end of a word or for nothing. Viterbi's algorithm finds the
   letters and ends of words that are likeliest under the trigram model and those prices.
3. The restored words are scored: words and word beginnings that labelled toxic documents have far more often than others
   add their log odds, and a logistic curve fitted on the same rows turns sums into scores. How much evidence a feature needs
   follows from how many features are frequent enough to have so much (Tarone's bound), so small tables get weights too;
   places with the same words around them (copies of a text) count once.

The classifier is fitted on at most TRAIN_ROWS labelled rows, those with the smallest hashes of their ids, all outside the
held-out fold. Everything else is counted over all documents.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, small_batches, tidy, written

TRAIN_ROWS = 10_000
FOLDS = 5
PREFIXES = (3, 4, 5, 6)
LEAST_RATIO = 20.0
MOST_FEATURES = 100_000
CHANCE, WEAK_CHANCE = 0.1, 3  # how many features may seem toxic by chance, and how many if they get a smaller weight
MEMO_WORDS, MEMO_LENGTH = 100_000, 100
#: Letters that digits and signs imitate.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
KEEP, IMITATE, DROP_SIGN, DROP_LIKE, DROP_REPEAT, DROP_DIGIT = 0.0, 1.0, 0.5, 2.0, 1.5, 8.0
DROP_WIDE = 2.0
#: What it costs to drop a space: the narrowest one of a run of characters set apart, one between parts of words, a wider one of a run.
NARROW, BETWEEN, WIDE = " \t\n"
SPACES = {NARROW: KEEP, BETWEEN: DROP_SIGN, WIDE: DROP_WIDE}
CLASSES = 64
OUT = "doc_id long, score double, hits long, restored string"


def char_class(c: str) -> int:
    """0: no letter; 1 to 26: a to z; then other letters."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % (CLASSES - 27) if c.isalpha() else 0


CLASS_OF = np.array([char_class(chr(i).lower()[:1]) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x3000)], np.uint8)


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(points < len(CLASS_OF), CLASS_OF[np.minimum(points, len(CLASS_OF) - 1)], 27 + points % (CLASSES - 27)).astype(np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """gram, n over all texts, runs of non-letters being one word end. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for text in batch.column(1):
                text = text.as_py() or ""
                for i in range(0, len(text), 1 << 20):
                    c = np.concatenate([[0, 0], classes_of(text[i : i + (1 << 20)]), [0]])
                    c = c[np.concatenate([[True, True], (c[2:] > 0) | (c[1:-1] > 0)])]
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["gram", "n"])

    return docs.mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def costs_of(counts: np.ndarray) -> np.ndarray:
    """Minus log probabilities of a class after two others, interpolated with shorter contexts."""
    c = counts.reshape(CLASSES, CLASSES, CLASSES) + 0.0
    one = (c.sum((0, 1)) + 1) / (c.sum() + CLASSES)
    two = (c.sum(0) + 8 * one) / (c.sum((0, 2))[:, None] + 8)
    three = (c + 8 * two[None]) / (c.sum(2)[:, :, None] + 8)
    return -np.log(three).astype(np.float32)


def decode(word: str, costs: np.ndarray) -> str:
    """The likeliest letters of an obfuscated word or, with spaces in it, the likeliest words.

    A state is the last two letters' classes; a path keeps its letters as a linked list, so that the work is in proportion to
    the length. A space is kept as the end of a word or dropped.
    """
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for i, c in enumerate(word):
        repeated = i > 0 and word[i - 1] == c
        if c in SPACES:
            options = [(" ", KEEP), ("", SPACES[c])]
        else:
            options = [(c, KEEP)] if c.isalpha() else []
            options += [(x, IMITATE) for x in LEET.get(c, "")]
            if not c.isalpha():
                options.append(("", DROP_DIGIT if c.isdigit() else DROP_LIKE if c in LEET else DROP_SIGN))
            elif repeated:
                options.append(("", DROP_REPEAT if i < 2 or word[i - 2] != c else 0.0))
        following: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, letters) in paths.items():
            for letter, price in options:
                if letter == " " and b == 0:  # no word to end
                    continue
                k = char_class(letter) if letter else -1
                state = (b, k) if letter else (a, b)
                total = cost + price + (float(costs[a, b, k]) if letter else 0.0)
                if state not in following or total < following[state][0]:
                    following[state] = (total, (letters, letter) if letter else letters)
        paths = following or paths
    return min((cost + (float(costs[a, b, 0]) if b else 0.0), unlinked(letters)) for (a, b), (cost, letters) in paths.items())[1].strip()


def unlinked(letters: tuple) -> str:
    out = []
    while letters:
        letters, letter = letters
        out.append(letter)
    return "".join(reversed(out))


EDGES = re.compile(r"^[^\w@$!|+(€£]+|[\W_]+$")
ODD = re.compile(r"[\W\d_]|(.)\1\1|(\w)\2(\w)\3")  # signs, one letter three times, or two doubled letters side by side
ENDED = re.compile(r"\w[^\w\s]*[,.;:?][^\w\s]*$")
APART = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")


def ended(token: str) -> bool:
    """Whether a sign behind the letters ends a part of a sentence."""
    return not token[-1:].isalnum() and ENDED.search(token) is not None


@dataclass
class Model:
    costs: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    base: float = 0.0
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)
    begun: dict[str, set[str]] = field(default_factory=dict)
    known: tuple[int, tuple[set[str], set[str]]] = (0, (set(), set()))

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "begun": {}}

    def restore(self, token: str) -> str:
        """The letters of a token as split at white space; '' without letters."""
        word = token.lower().rstrip(string.punctuation)
        if not word.isalpha():
            word = EDGES.sub("", token.lower())
        if ODD.search(word) and any(c.isalpha() for c in word):
            word = decode(word, self.costs)
        return word

    def follow(self, begun: set[str], token: str) -> set[str]:
        """Where in the known words (beginnings or whole words) the readings of a token lead from others: characters stand
        for themselves or letters they imitate, signs and repeated letters for nothing too."""
        heads = self.beginnings()[0]
        for before, c in zip(" " + token, token):
            letters = c + LEET.get(c, "")
            going = {w for at in begun for x in letters if (w := at + x) in heads or w in self.weights}
            begun = going | begun if c == before or not c.isalnum() else going
            if not begun:
                break
        return begun

    def starts(self, first: str) -> set[str]:
        """Where in the known words the first letters of a token can be."""
        if len(self.begun) >= MEMO_WORDS:
            self.begun.clear()
        found = self.begun[first] = self.follow({""}, first)
        return found

    def split_words(self, tokens: list[str]) -> Iterator[str]:
        """Known words that spaces cut into parts, where the lattice of the parts, a space ending a word or being nothing,
        drops all of them. Parts are joined only along the beginnings of known words, so a window is no longer than one."""
        heads, _ = self.beginnings()
        for i, token in enumerate(tokens[:-1]):
            first = token[: PREFIXES[0]]
            begun = self.begun[first] if first in self.begun else self.starts(first)
            if not begun or ended(token):
                continue
            begun, j = (begun if first == token else self.follow({""}, token)) & heads, i + 1
            while begun and j < len(tokens):
                begun, j = self.follow(begun, tokens[j]), j + 1
                if not begun:
                    break
                if whole := [w for w in begun if w in self.weights]:
                    window = BETWEEN.join(tokens[i:j])
                    if any(map(str.isalpha, window)) and (word := decode(window, self.costs)) in whole:
                        yield word
                begun = set() if ended(tokens[j - 1]) else begun & heads

    def beginnings(self) -> tuple[set[str], set[str]]:
        """What known words can begin with, and the first letters of whatever has a feature."""
        if self.known[0] != len(self.weights):
            whole = [w for w in self.weights if ":" not in w]
            first = {w[: PREFIXES[0]] for w in self.weights} | {w.partition(":")[2][: PREFIXES[0]] for w in self.weights if ":" in w}
            self.begun.clear()
            self.known = (len(self.weights), ({w[:i] for w in whole for i in range(1, len(w))}, first))
        return self.known[1]

    def words(self, text: str) -> list[str]:
        """What white space separates, known words among them that spaces cut into parts, and for each run of characters set
        apart: them as one token and as the likeliest words."""
        found = text.split()
        if self.weights:
            found += self.split_words(text.lower().split())
        for m in APART.finditer(text) if list(map(len, found)).count(1) >= 3 else ():
            run = m.group().lower()
            found.append("".join(run.split()))
            if any(c.isalpha() for c in run):
                least = min(map(len, re.findall(r"\s+", run)))
                lattice = re.sub(r"\s+", lambda x: WIDE if len(x.group()) > least else NARROW, run)
                found += decode(lattice, self.costs).split()
        return found

    def features(self, word: str) -> list[str]:
        return [word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]

    def of_token(self, token: str) -> tuple[str, ...]:
        """The model's features of a token."""
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            word = self.restore(token)
            found = tuple(f for f in self.features(word) if f in self.weights) if word[: PREFIXES[0]] in self.beginnings()[1] else ()
            if len(token) <= MEMO_LENGTH:  # so that the memo's bytes are bounded too
                self.memo[token] = found
        return found

    def total(self, text: str) -> tuple[float, int]:
        hits: set[str] = set()
        for token in set(self.words(text)):
            if found := self.of_token(token):
                hits.update(found)
        return sum(self.weights[f] for f in sorted(hits)), len(hits)

    def restored(self, text: str) -> str:
        return " ".join(w for t in self.words(text) if (w := self.restore(t)))

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.base + self.slope * total))))


def feature_counts(labelled: DataFrame, model: Model) -> DataFrame:
    """labelled: text, toxic. feature, pos, neg: in how many documents of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                tokens = {model.restore(t) for t in set(model.words(text.as_py() or ""))}
                counts[toxic].update({f for w in tokens if w for f in model.features(w)})
            names = list(counts[0] | counts[1])
            yield pa.record_batch([pa.array(names, pa.string()), *(pa.array([counts[k][f] for f in names], pa.int64()) for k in (1, 0))], ["feature", "pos", "neg"])

    return labelled.mapInArrow(tidy(run), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def contexts(labelled: DataFrame, model: Model, wanted: set[str]) -> DataFrame:
    """feature, places: for each wanted feature the number of places in toxic documents that differ in the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column(0):
                tokens = model.words(text.as_py() or "")
                for before, token, after in zip(["", *tokens], tokens, [*tokens[1:], ""]):
                    own = [f for f in model.features(model.restore(token)) if f in wanted]
                    around = zlib.crc32(f"{before} {after}".encode("utf-8", "replace"))
                    found.update((f, around) for f in own)
            names, around = zip(*found) if found else ((), ())
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(around, pa.int64())], ["feature", "around"])

    return labelled.where("toxic = 1").mapInArrow(tidy(run), "feature string, around long").groupBy("feature").agg(F.countDistinct("around").alias("places"))


def least_evidence(frequencies: dict[int, int], share: float, chance: float = CHANCE) -> float:
    """The log likelihood ratio from which on about so many features are expected by chance.

    frequencies: how many features are in so many documents. A feature in n documents has at most n * -log(share), so only
    those that can reach a bound count against it.
    """
    bound = 0.0
    for n in sorted(frequencies, reverse=True):
        reach, able = n * -math.log(share), sum(k for m, k in frequencies.items() if m >= n)
        wider = math.log(max(1.0, able / chance))
        if reach <= wider:  # with those in so few documents the bound would be out of their reach, so they don't count
            return max(bound, reach)
        bound = wider
    return bound


def fit_curve(totals: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic curve, by Newton's method with a little ridge (no BLAS: see ``op02_packing``)."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * totals + b, -500, 500)))
        q, miss = p * (1 - p), toxic - p
        xx, x1, one = float((totals * totals * q).sum()) + 1e-2, float((totals * q).sum()), float(q.sum()) + 1e-2
        gx, g1 = float((totals * miss).sum()) - 1e-2 * a, float(miss.sum()) - 1e-2 * b
        det = xx * one - x1 * x1
        da, db = (one * gx - x1 * g1) / det, (xx * g1 - x1 * gx) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return a, b


def fold_of(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Rows of the held-out fold (crc32 of the id, mod 5, is 0) teach nothing."""
    small_batches(docs.sparkSession)
    counts = np.zeros(CLASSES**3)
    for row in trigram_counts(docs).collect():  # CLASSES ** 3 rows at most
        counts[row["gram"]] = row["n"]
    model = Model(costs_of(counts))
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and l_id is not null").where(fold_of("l_id") != 0)
    chosen = known.groupBy("l_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(train_rows)
    labelled = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).groupBy("l_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
    labelled = written(labelled.select("text", "toxic"), "labelled")  # train_rows rows at most, whatever ids repeat
    kinds = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    pos, neg = kinds.get(1, 0), kinds.get(0, 0)
    if not pos or not neg:
        model.base = -20.0 if not pos else 20.0
        return model
    counted = written(feature_counts(labelled, model), "features")
    seen, share = F.col("pos") + F.col("neg"), pos / (pos + neg)
    frequencies = {r["n"]: r["count"] for r in counted.groupBy(seen.alias("n")).count().collect()}  # a row for each number of documents
    least, enough = (least_evidence(frequencies, share, c) for c in (WEAK_CHANCE, CHANCE))
    counted = counted.where((F.col("pos") + 0.5) * (neg + 1) >= LEAST_RATIO * (F.col("neg") + 0.5) * (pos + 1)).where(F.col("pos") * -math.log(share) >= least)
    found = {r["feature"]: (r["pos"], r["neg"]) for r in counted.orderBy(F.desc("pos"), "feature").limit(MOST_FEATURES + 1).collect()}
    if len(found) > MOST_FEATURES:  # never cut in silence; the evidence asked for leaves far fewer
        raise ValueError(f"more than {MOST_FEATURES} features seem toxic")
    places = {r["feature"]: r["places"] for r in contexts(labelled, model, set(found)).collect()}
    for name, (p, n) in found.items():
        p = min(p, places.get(name, 0))
        part = sum(k * math.log(k / (p + n) / q) for k, q in ((p, share), (n, 1 - share)) if k)
        ratio = (p + 0.5) / (pos + 1) / ((n + 0.5) / (neg + 1))
        if ratio >= LEAST_RATIO and part >= least:
            model.weights[name] = math.log(ratio) * min(1.0, part / enough) ** 2
    model.memo.clear()

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([model.total(t.as_py() or "")[0] for t in batch.column(0)], pa.float64()), batch.column(1)], ["total", "toxic"])

    rows = labelled.mapInArrow(tidy(totals), "total double, toxic int").toPandas()
    forget(counted)
    forget(labelled)
    model.slope, model.base = fit_curve(rows["total"].to_numpy(), rows["toxic"].to_numpy())
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", restored: bool = False) -> DataFrame:
    """doc_id, score, hits (toxic features found), restored (the decoded words, if asked for; else null).

    Null and empty texts have no words and get the curve's base. Every row gives a row; ids may be null or repeat. Other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand weights and CLASSES ** 3 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            found = [own.total(t) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([own.score(t) for t, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64()), pa.array([own.restored(t) if restored else None for t in texts], pa.string())], ["doc_id", "score", "hits", "restored"])
        own.memo.clear()
        own.begun.clear()

    small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(tidy(run), OUT)


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as bigint) as doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity(docs, model)
    return scored.select("doc_id", (fold_of() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "hits")
