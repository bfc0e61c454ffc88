"""Repeated passages by collinear chaining.

1. Seeds: closed syncmers of SEED words, chosen by their own words alone; a run of nine words that two documents share holds
   one. Seeds go to buckets with some bits of the words around them. There each seed of a document is joined with one source:
   the first document (by id) that shares MIN_PART words around it, else the first that shares nine, else the first that has
   the seed; and, but for the first kind, with a second: the first that also has the words behind the seed, all but one. So a
   passage that a third of all documents share gives at most two matches a document and seed, never pairs, twelve words
   that an earlier document has are always found, and a fuzzy passage is found though its words were first seen elsewhere.
2. The matches of two documents, joined to exact runs where they touch, are chained: in the order of their places in one
   document, each takes the best chain so far that ends before it in the other, found in a Fenwick tree of prefix maxima,
   less the cost of the gaps between them.
3. Chains are aligned word by word: equal diagonals are compared at once, other gaps by edit distance. A gap that costs more
   than it joins cuts the chain, each part is tested on its own, and its ends grow by a banded alignment while that pays.
   A passage is what a document's alignments cover together, MIN_WORDS words or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, small_batches, tidy, written
from .shingles import PLACE, STEP, bucket_bits, mix, planes, runs, unplanes, word_hashes

SEED, SUB = 6, 2
BEFORE, AFTER, FIELD = 3, 6, 5
CONTEXT_BYTES = -(-(BEFORE + AFTER) * FIELD // 8)
CHUNK_SEEDS, HOT = 250_000, 16
SPANS, PART_WORDS = 2000, 100_000
MIN_WORDS, MIN_PART, MIN_IDENTITY = 40, 12, 0.8
GAP_COST, MAX_GAP = 0.05, 60
GROW, BAND, DROP = 48, 8, 12
WEIGHT = 4  # matched words that make up for an edit at MIN_IDENTITY
CHAINS = "doc_id long, source_id long, start long, end long, source_start long, source_end long, anchors array<long>"
WORDED = "own boolean, doc_id long, first long, until long, source_id long, start long, end long, source_start long, source_end long, anchors array<long>, words binary"
PARTS = "doc_id long, source_id long, start_word long, end_word long, source_start long, source_end long, matched long, edits long"


def seeds_of(words: np.ndarray, filler: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes (48 bits) and contexts of a text's seeds.

    A seed is a closed syncmer: a run of SEED words whose smallest run of SUB words is its first or its last. Whether a run is
    one depends on its words alone, and of SEED - SUB runs in a row at least one is. The context holds FIELD bits of each of
    the BEFORE words in front and the AFTER words behind; where the text ends, bits made of filler stand for them.
    """
    n = len(words) - SEED + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    sub = mix(sum(words[j : len(words) - SUB + 1 + j] * PLACE[32 + j] for j in range(SUB)))
    inner = np.minimum.reduce([sub[j : j + n] for j in range(1, SEED - SUB)])
    at = np.flatnonzero(np.minimum(sub[:n], sub[SEED - SUB :]) <= inner)
    seed = mix(sum(words[at + j] * PLACE[j] for j in range(SEED))) >> np.uint64(16)
    edge = mix(np.arange(BEFORE + AFTER, dtype=np.uint64) + np.uint64(filler % (1 << 62)) * np.uint64(16))
    around = np.concatenate([edge[:BEFORE], words, edge[BEFORE:]]) >> np.uint64(64 - FIELD)
    context = np.zeros(len(at), np.uint64)
    for k in range(BEFORE + AFTER):
        context |= around[at + k + (SEED if k >= BEFORE else 0)] << np.uint64(FIELD * k)
    return at, seed, context


def earliest(group: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For rows in the order of doc and place: the row of the first document with the same group and key, the same of its
    places if it has so many; -1 in that document itself."""
    both = mix(group * STEP + key)
    order = np.argsort(both, kind="stable")
    both, own, at = both[order], doc[order], np.arange(len(order))
    new = np.concatenate([[True], both[1:] != both[:-1]])
    run = new | np.concatenate([[True], own[1:] != own[:-1]])
    start, first = (np.maximum.accumulate(np.where(x, at, 0)) for x in (new, run))
    count = np.diff(np.append(np.flatnonzero(run), len(at)))[np.cumsum(run)[start] - 1]
    source = start + np.minimum(at - first, count - 1)
    out = np.empty(len(order), np.int64)
    out[order] = np.where(own[source] == own, -1, order[source])
    return out


def sources_of(seed: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in the order of seed, doc and place: the row of the source, or -1; and that of a second source, or -1.

    The source is the first document that shares MIN_PART words around the seed, which are an alignment by themselves; else
    the first that shares SEED + 3 words; else the first that has the seed. Without MIN_PART words the second is the first document
    that shares all of the AFTER words behind the seed but one: text that goes on alike behind a changed word is that of
    the passage, not of another that only has this seed's words.
    """
    group = np.cumsum(np.concatenate([[0], seed[1:] != seed[:-1]]).astype(np.uint64))
    found = np.full(len(seed), -1, np.int64)
    open_, fuzzy = np.arange(len(seed)), None
    for words in (AFTER, BEFORE, 0):
        mask = np.uint64((1 << FIELD * words) - 1)
        best = np.full(len(seed), len(seed), np.int64)
        for before in range(min(words, BEFORE) + 1):
            key = (context >> np.uint64(FIELD * (BEFORE - before))) & mask
            row = earliest(group, key, doc)
            best = np.minimum(best, np.where(row < 0, len(seed), row))
        hit = open_[best[open_] < len(seed)]
        found[hit] = best[hit]
        open_ = open_[best[open_] == len(seed)]
        fuzzy = open_ if fuzzy is None else fuzzy
        if not len(open_):
            break
    second = np.full(len(seed), -1, np.int64)
    if len(fuzzy):
        own = np.flatnonzero(np.isin(group, group[fuzzy]))  # seeds with no open row need no second source
        after, best = context[own] >> np.uint64(FIELD * BEFORE), np.full(len(own), len(own), np.int64)
        for k in range(AFTER):
            row = earliest(group[own], after & ~np.uint64(((1 << FIELD) - 1) << FIELD * k), doc[own])
            best = np.minimum(best, np.where(row < 0, len(own), row))
        hit = best < len(own)
        second[own[hit]] = own[best[hit]]
        is_fuzzy = np.zeros(len(seed), bool)
        is_fuzzy[fuzzy] = True
        second[~is_fuzzy | (doc[second] == doc[found])] = -1
    return found, second


def packed(*columns: tuple[np.ndarray, int]) -> bytes:
    return len(columns[0][0]).to_bytes(8, "little") + b"".join(planes(c.view("<u8") if c.dtype == np.int64 else c, w) for c, w in columns)


def unpacked(rows: list[bytes], widths: tuple[int, ...]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in widths]
    for data in rows:
        n, at = int.from_bytes(data[:8], "little"), 8
        for own, w in zip(parts, widths):
            own.append(unplanes(data[at : at + n * w], w))
            at += n * w
    return [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]


def dealt(key: np.ndarray, bits: int, columns: tuple[tuple[np.ndarray, int], ...]) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows) for each bucket that has any, by the top bits of 48-bit keys."""
    bucket = (key >> np.uint64(48 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), packed(*((c[part], w) for c, w in columns))


def group_of(doc: np.ndarray) -> np.ndarray:
    return mix(doc.view("<u8")) >> np.uint64(16)


def buckets_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["bucket", "kind", "data"])


def in_order(seed: np.ndarray, context: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows by seed, document and place, each once (a document's row may be there twice)."""
    order = np.lexsort((pos, doc, seed))
    seed, context, doc, pos = (x[order] for x in (seed, context, doc, pos))
    new = np.concatenate([[True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])
    return (seed, context, doc, pos) if new.all() else (seed[new], context[new], doc[new], pos[new])


def seed_rows(docs: DataFrame, bits: int) -> DataFrame:
    """bucket, kind, data: what a task has seen, a chunk of some million words at a time.

    kind 0: seeds with their contexts and places by bucket of seeds. A seed that HOT or more of the chunk's documents have in
    the same context goes there once, with the first of them; the others' matches with that one are rows of kind 1, by group
    of documents. So a passage that a third of all documents share comes to a bucket less than HOT times a chunk.
    """

    def flush(seeds: list, contexts: list, ids: list, places: list) -> Iterator[pa.RecordBatch]:
        seed, context, doc, pos = (np.concatenate(x) for x in (seeds, contexts, ids, places))
        seed, context, doc, pos = in_order(seed, context, doc, pos)
        source = earliest(seed, context, doc)
        _, same, count = np.unique(np.where(source < 0, np.arange(len(seed)), source), return_inverse=True, return_counts=True)
        sent = (source < 0) | (count[same] < HOT)
        copied = np.flatnonzero(~sent)
        rows = [(b, 0, data) for b, data in dealt(seed[sent], bits, ((seed[sent], 6), (context[sent], CONTEXT_BYTES), (doc[sent], 8), (pos[sent], 4)))]
        rows += [(b, 1, data) for b, data in matched(doc, pos, copied, source[copied], bits)]
        yield buckets_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[list] = [[], [], [], []]
        size = 0
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                ids = part.column(0).to_pylist()
                for doc_id, words in zip(ids, word_hashes([(t.as_py() or "").encode() for t in part.column(1)])):
                    at, seed, context = seeds_of(words, hash(doc_id))
                    if len(at):
                        for x, y in zip(own, (seed, context, np.full(len(at), doc_id, np.int64), at)):
                            x.append(y)
                        size += len(at)
                if size >= CHUNK_SEEDS:
                    yield from flush(*own)
                    own, size = [[], [], [], []], 0
        if size:
            yield from flush(*own)

    return docs.mapInArrow(tidy(run), "bucket long, kind int, data binary")


def matched(doc: np.ndarray, pos: np.ndarray, rows: np.ndarray, sources: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    own = doc[rows]
    return dealt(group_of(own), bits, ((own, 8), (doc[sources], 8), (pos[rows], 4), (pos[sources], 4)))


def match_rows(seeds: DataFrame, bits: int) -> DataFrame:
    """bucket, kind, data: matches (doc, source, place, source's place) by group of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "bucket"):
            passed = [(r["bucket"], 1, r["data"]) for r in rows if r["kind"] == 1]
            seed, context, doc, pos = unpacked([r["data"] for r in rows if r["kind"] == 0], (6, CONTEXT_BYTES, 8, 4))
            doc, pos = doc.view(np.int64), pos.view(np.int64)
            order = np.argsort(seed, kind="stable")
            sorted_ = seed[order]
            same = sorted_[1:] == sorted_[:-1]
            order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
            if len(order):
                seed, context, doc, pos = in_order(*(x[order] for x in (seed, context, doc, pos)))
                for source in sources_of(seed, context, doc):
                    found = np.flatnonzero(source >= 0)
                    passed += [(b, 1, data) for b, data in matched(doc, pos, found, source[found], bits)]
            if passed:
                yield buckets_batch(passed)

    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seeds.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "bucket long, kind int, data binary")


def exact_runs(pos: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and lengths of the runs of words that overlapping and touching matches of one diagonal make up."""
    order = np.lexsort((pos, pos - other))
    pos, other = pos[order], other[order]
    cut = np.flatnonzero((np.diff(pos - other) != 0) | (np.diff(pos) > SEED)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(pos)]]) - 1
    return pos[first], other[first], pos[last] - pos[first] + SEED


def best_chains(pos: np.ndarray, other: np.ndarray, length: np.ndarray | None = None) -> list[list[int]]:
    """Chains of matches (places ascending in both documents) by falling score; each match is in one chain at most."""
    order = np.lexsort((-other, pos))  # of matches at one place, those further on come first and so never chain
    x, y = pos[order].tolist(), other[order].tolist()
    rank = (np.unique(other, return_inverse=True)[1][order] + 1).tolist()
    n, top = len(x), int(max(rank))
    size = [SEED] * n if length is None else length[order].tolist()
    tree, whose = [-1e18] * (top + 1), [-1] * (top + 1)
    score, before = [0.0] * n, [-1] * n
    for j in range(n):
        best, who, r = -1e18, -1, rank[j] - 1
        while r:
            if tree[r] > best:
                best, who = tree[r], whose[r]
            r &= r - 1
        place = GAP_COST * (x[j] + y[j])
        if who >= 0 and best - place > 0 and x[who] < x[j]:
            score[j], before[j] = size[j] + best - place, who
        else:
            score[j] = size[j]
        value, r = score[j] + place + 2 * GAP_COST * (size[j] - SEED), rank[j]
        while r <= top:
            if value > tree[r]:
                tree[r], whose[r] = value, j
            r += r & -r
    used, chains = [False] * n, []
    for j in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(int(order[j]))
            j = before[j]
        if chain:
            chains.append(chain[::-1])
    return chains


def split_chain(chain: list[int], pos: np.ndarray, other: np.ndarray, length: np.ndarray) -> Iterator[list[int]]:
    """A chain's parts between gaps of more than MAX_GAP words, and between runs that overlap by a seed or more."""
    part = [chain[0]]
    for a, b in zip(chain, chain[1:]):
        far, near = max(pos[b] - pos[a], other[b] - other[a]), min(pos[b] - pos[a], other[b] - other[a])
        if far > MAX_GAP + length[a] or near <= length[a] - SEED:
            yield part
            part = []
        part.append(b)
    yield part


def chain_rows(matches: DataFrame) -> DataFrame:
    """The chains of each document with each of its sources. A group of documents is one bounded part of all matches."""

    def flush(key: tuple[int, int], pos: np.ndarray, other: np.ndarray) -> Iterator[tuple]:
        pos, other, length = exact_runs(pos, other)
        for chain in best_chains(pos, other, length) if len(pos) > 1 else [[0]]:
            for part in split_chain(chain, pos, other, length):
                p, o, n = pos[part], other[part], length[part]
                yield *key, int(p[0]), int((p + n).max()), int(o[0]), int((o + n).max()), np.stack([p - p[0], o - o[0], n], 1).ravel().tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [x.split()[0] for x in CHAINS.split(", ")], [*[pa.int64()] * 6, pa.list_(pa.int64())]
        rows = []
        for own in runs(batches, "bucket"):
            doc, source, pos, other = (x.view(np.int64) for x in unpacked([r["data"] for r in own], (8, 8, 4, 4)))
            order = np.lexsort((other, pos, source, doc))
            doc, source, pos, other = (x[order] for x in (doc, source, pos, other))
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (source[1:] != source[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(doc)]):
                rows += flush((int(doc[a]), int(source[a])), pos[a:b], other[a:b])
                if len(rows) >= 5000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return matches.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), CHAINS)


def gap_edits(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two short runs of words."""
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != x))])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def best_stretches(blocks: list[tuple], weight: int) -> list[tuple[int, int]]:
    """The maximal stretches (Ruzzo and Tompa) of blocks that gain: matched words less weight times edits."""
    found: list[tuple[int, int, int, int]] = []  # first, end, sum before, sum after
    total = 0
    for i, block in enumerate(blocks):
        before, total = total, total + block[4] - weight * block[5]
        if total <= before:
            continue
        first = i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= total:
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
        found.append((first, i + 1, before, total))
    return [x[:2] for x in found]


def alike(matched: int, own: int, source: int) -> bool:
    return matched >= MIN_IDENTITY * max(own, source)


def stretches(blocks: list[tuple], weight: int = 2) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(start, end, source start, source end, matched, edits) of the parts of a chain that are alike.

    A gap that costs more than either side of it gains cuts; a part that is still not alike is cut at a higher price. At
    WEIGHT, what gains is alike, so that no exact match is ever lost.
    """
    for i, j in best_stretches(blocks, weight):
        own, first, last = blocks[i:j], blocks[i], blocks[j - 1]
        matched, edits = sum(x[4] for x in own), sum(x[5] for x in own)
        if weight >= WEIGHT or alike(matched, last[1] - first[0], last[3] - first[2]):
            yield first[0], last[1], first[2], last[3], matched, edits
        else:
            yield from stretches(own, weight + 1)


def chain_blocks(words: np.ndarray, other: np.ndarray, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, source start, source end, matched, edits) of a chain's exact runs and the gaps between them, in turn."""
    out, x, y = [], None, None
    for p, o, n in anchors:
        if x is not None:
            skip = max(x - p, y - o, 0)
            p, o, n = p + skip, o + skip, n - skip
            if n <= 0:
                continue
            if p > x or o > y:
                a, b = words[x:p], other[y:o]
                edits = longest = max(len(a), len(b))
                if len(a) == len(b):
                    edits = int((a != b).sum())
                if edits > 2 and len(a) and len(b) and not set(a.tolist()).isdisjoint(b.tolist()):
                    edits = min(edits, gap_edits(a, b))
                out.append((x, p, y, o, longest - edits, edits))
        x, y = p + n, o + n
        out.append((p, x, o, y, n, 0))
    return out


def grown(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How far pairs of runs of words go on alike from their starts, substitutions, insertions and deletions counted.

    For each pair (own words, source words, matched, edits) where matched less 2 times edits is greatest, and the same for
    WEIGHT times edits. All pairs go through the rows of a banded alignment together; a pair rests once it has lost DROP.
    """
    one, edit = 256, -(2 * 256 + 1)  # a cell is gain * 256 - edits
    best = np.zeros((len(pairs), 2, 4), np.int64)
    a = np.full((len(pairs), GROW), -1, np.int32)
    b = np.full((len(pairs), GROW + 3 * BAND + 1), -2, np.int32)
    for i, (x, y) in enumerate(pairs):
        a[i, : min(len(x), GROW)] = x[:GROW]
        b[i, BAND : BAND + min(len(y), GROW + BAND)] = y[: GROW + BAND]
    at, slope = np.arange(len(pairs)), np.arange(2 * BAND + 1) * -edit
    cells = np.where(np.arange(-BAND, BAND + 1) < 0, -(1 << 28), np.arange(-BAND, BAND + 1) * edit)[None].repeat(len(pairs), 0).astype(np.int64)
    top = np.zeros((len(pairs), 2), np.int64)
    for i in range(GROW):
        new = cells + np.where(a[:, i, None] == b[:, i : i + 2 * BAND + 1], one, edit)
        np.maximum(new[:, :-1], cells[:, 1:] + edit, out=new[:, :-1])
        cells = np.maximum.accumulate(new + slope, 1) - slope
        for k in (0, 1):
            worth = cells if k == 0 else cells - (WEIGHT - 2) * one * (-cells & 255)
            j = worth.argmax(1)
            value = worth[np.arange(len(j)), j]
            more = np.flatnonzero(value > top[:, k])
            if len(more):
                top[more, k] = value[more]
                cell = cells[more, j[more]]
                edits = -cell & 255
                best[at[more], k] = np.stack([np.full(len(more), i + 1), i + 1 + j[more] - BAND, (cell + edits) // one + 2 * edits, edits], 1)
        going = cells.max(1) > top[:, 0] - DROP * one
        if not going.all():
            at, a, b, cells, top = at[going], a[going], b[going], cells[going], top[going]
            if not len(at):
                break
    return best


def align(chains: list[tuple[np.ndarray, int, np.ndarray, int, int, int, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(number, start, end, source start, source end, matched, edits) of what is alike in each chain.

    A chain: words from word ``first`` of the document, the same of the source, start, source start, anchors.
    """
    found, pairs = [], []
    for k, (words, first, other, other_first, start, source_start, anchors) in enumerate(chains):
        runs = anchors.reshape(-1, 3) + [start - first, source_start - other_first, 0]
        for a, b, c, d, matched, edits in stretches(chain_blocks(words, other, runs.tolist())):
            found.append((k, a + first, b + first, c + other_first, d + other_first, matched, edits))
            pairs += [(words[max(0, a - GROW) : a][::-1], other[max(0, c - GROW - BAND) : c][::-1]), (words[b : b + GROW], other[d : d + GROW + BAND])]
    ends = grown(pairs).tolist() if pairs else []
    for (k, a, b, c, d, matched, edits), left, right in zip(found, ends[::2], ends[1::2]):
        for (w, x, m, e), (y, z, n, f) in zip(left, right):
            own = (a - w, b + y, c - x, d + z, matched + m + n, edits + e + f)
            if alike(own[4], own[1] - own[0], own[3] - own[2]):
                yield (k, *own)
                break


def short_words(docs: DataFrame) -> DataFrame:
    """doc_id, all_words: 16 bits of each word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                words = word_hashes([(t.as_py() or "").encode() for t in part.column(1)])
                yield pa.record_batch([part.column(0), pa.array([(w >> np.uint64(48)).astype("<u2").tobytes() for w in words], pa.binary())], ["doc_id", "all_words"])

    return docs.mapInArrow(tidy(run), "doc_id long, all_words binary")


def worded(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """Two kinds of rows. own: the chains with first and words, the document's words around them from the first on. Not own:
    doc_id, first, until, words for each stretch of a source that chains ask for; a source's stretches come SPANS at a time,
    so that a document that is the source of many costs no long row."""
    from pyspark.sql import Window

    spans = chains.select(F.col("source_id").alias("l_id"), F.greatest(F.col("source_start") - GROW, F.lit(0)).alias("first"), (F.col("source_end") + GROW).alias("until")).distinct()
    part = F.floor(F.row_number().over(Window.partitionBy("l_id").orderBy("first", "until")) / SPANS).alias("part")
    spans = spans.select("l_id", "first", "until", part).groupBy("l_id", "part").agg(F.collect_list(F.struct("first", "until")).alias("spans"))
    columns = [x.split()[0] for x in CHAINS.split(", ")][1:]
    own = chains.select(F.col("doc_id").alias("l_id"), F.floor(F.col("start") / PART_WORDS).alias("part"), F.struct(*columns).alias("chain")).groupBy("l_id", "part").agg(F.collect_list("chain").alias("chains"))
    lists = spans.select("l_id", "spans").unionByName(own.select("l_id", "chains"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [x.split()[0] for x in WORDED.split(", ")], [pa.bool_(), *[pa.int64()] * 8, pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            for i in range(0, len(batch), 200):
                rows = []
                for row in batch.slice(i, 200).to_pylist():
                    words, doc_id = row["all_words"], row["doc_id"]
                    cut = lambda a, b: words[2 * a : 2 * b]  # noqa: E731, B023
                    for c in row["chains"] or ():
                        first, until = max(c["start"] - GROW, 0), c["end"] + GROW
                        rows.append((True, doc_id, first, until, *(c[k] for k in columns), cut(first, until)))
                    rows += [(False, doc_id, s["first"], s["until"], *[None] * len(columns), cut(s["first"], s["until"])) for s in row["spans"] or ()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    joined = short_words(docs).join(lists, F.col("doc_id") == F.col("l_id")).select("doc_id", "all_words", "spans", "chains")
    return joined.mapInArrow(tidy(run), WORDED)


def aligned(chains: DataFrame) -> DataFrame:
    """chains with first, words, source_first, source_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.to_pylist()
            chained = [(np.frombuffer(r["words"], "<u2"), r["first"], np.frombuffer(r["source_words"], "<u2"), r["source_first"], r["start"], r["source_start"], np.array(r["anchors"])) for r in own]
            rows = [(own[k]["doc_id"], own[k]["source_id"], *part) for k, *part in align(chained) if part[1] - part[0] >= MIN_PART]
            if rows:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], [x.split()[0] for x in PARTS.split(", ")])

    return chains.mapInArrow(tidy(run), PARTS)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source_id, start_word, end_word, source_start, source_end, matched, edits, passage_start, passage_end.

    One row for each alignment of a document with an earlier one (smaller id) within a passage; words are what white space
    (ASCII) separates, counted from 0, ends are exclusive. passage_start and passage_end: the run of words, min_words or
    more, that overlapping and touching alignments cover together. A passage's first document has no row of its own; it is
    the source. Null and empty texts and null ids have no passages; rows with equal ids and equal texts are one document.
    Repetition inside one document is left alone. Other columns are not read.
    """
    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").where("doc_id is not null")
    bits = bucket_bits(picked)
    chains = written(chain_rows(match_rows(seed_rows(picked, bits), bits)), "chains")
    words = written(worded(picked, chains), "chain-words")
    forget(chains)
    source = words.where("not own").select(F.col("doc_id").alias("s_id"), F.col("first").alias("source_first"), F.col("until").alias("source_until"), F.col("words").alias("source_words"))
    asked = (F.col("source_id") == F.col("s_id")) & (F.greatest(F.col("source_start") - GROW, F.lit(0)) == F.col("source_first")) & (F.col("source_end") + GROW == F.col("source_until"))
    with_words = words.where("own").drop("own", "until").join(source, asked)
    return passages(aligned(with_words).repartition("doc_id").distinct(), min_words)  # a document's row may be there twice


def passages(parts: DataFrame, min_words: int) -> DataFrame:
    """Alignments in the passage (touching alignments of one document) that they belong to, if that is long enough."""
    from pyspark.sql import Window

    by_place = Window.partitionBy("doc_id").orderBy("start_word", "end_word", "source_id", "source_start")
    reach = F.max("end_word").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    numbered = parts.withColumn("new", (reach.isNull() | (F.col("start_word") > reach)).cast("int")).withColumn("run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id", "run")
    out = numbered.withColumn("passage_start", F.min("start_word").over(whole)).withColumn("passage_end", F.max("end_word").over(whole))
    return out.where(F.col("passage_end") - F.col("passage_start") >= min_words).drop("new", "run")


def without_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words of their passages cut out of the text; documents of which nothing is left go.

    Rows without passages stay as they are, those with null ids, null and empty texts too; rows that repeat an id are cut
    alike as far as their texts reach. All columns stay, whatever their names.
    """
    own_id, cuts = (free_name(x, docs.columns) for x in ("cut_id", "cuts"))
    spans = found.select("doc_id", "passage_start", "passage_end").distinct().groupBy(F.col("doc_id").alias(own_id)).agg(F.sort_array(F.collect_list(F.struct("passage_start", "passage_end"))).alias(cuts))

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, own in zip(texts, spans):
            at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
            kept, last = [], 0
            for s in own:
                a, b = s["passage_start"], min(s["passage_end"], len(at))
                if a < b:
                    kept.append(text[last : at[a][0]])
                    last = at[b - 1][1]
            out.append("".join([*kept, (text or "")[last:]]).strip())
        return pd.Series(out)

    joined = docs.join(spans, F.col(id_col) == F.col(own_id), "left")
    changed = joined.where(F.col(cuts).isNotNull()).withColumn(text_col, cut(F.col(text_col), F.col(cuts))).where(F.col(text_col) != "")
    return joined.where(F.col(cuts).isNull()).unionByName(changed).drop(own_id, cuts)


def free_name(name: str, columns: list[str]) -> str:
    """The name, or the first with underscores in front that is none of the columns."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def op6_query(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
