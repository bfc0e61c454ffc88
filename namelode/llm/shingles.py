"""Hashes of words and shingles over whole Arrow batches, and the exchange that finds shingles of more than one document.

Word hashes come from one running sum over the bytes of a block (a polynomial with odd multiplier modulo 2^64, over random
values of the bytes); a shingle's hash mixes its words' hashes. Long texts are cut at white space into blocks, so memory is
bounded by the block and by 8 bytes a word of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

BLOCK = 1 << 18
CHUNK_TOKENS = 400_000
CHUNK_DOCS = 60_000
BUCKET_BYTES = 64 << 20
MIN_BUCKETS = 128
#: White space to spaces, A-Z to a-z.
SPACES = bytes(32 if b in range(9, 14) else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b for b in range(256))
_random = np.random.default_rng(20240607)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x))]) for x in (STEP, UNSTEP)]
    return _powers[0], _powers[1]


def block_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of the words between spaces: where each starts, and its hash."""
    data = np.frombuffer(block, np.uint8)
    word = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[data] * up[: len(data)])])
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * PLACE[63])


def word_hashes(texts: list[bytes], table: bytes = SPACES) -> list[np.ndarray]:
    """The hashes of each text's words in order; words are what lies between the bytes that table makes spaces."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    waiting: list[tuple[int, bytes]] = []

    def flush() -> None:
        if not waiting:
            return
        starts, hashes = block_hashes(b" ".join(b for _, b in waiting))
        ends = np.cumsum([len(b) + 1 for _, b in waiting])
        cuts = np.searchsorted(starts, ends)
        for (i, _), part in zip(waiting, np.split(hashes, cuts[:-1])):
            parts[i].append(part)
        waiting.clear()

    size = 0
    for i, text in enumerate(texts):
        text, at = text.translate(table), 0
        while at < len(text):
            end = len(text)
            if end - at > BLOCK:
                end = text.rfind(b" ", at, at + BLOCK)
                if end <= at and (end := text.find(b" ", at + BLOCK)) < 0:
                    end = len(text)
            waiting.append((i, text[at:end]))
            size, at = size + end - at + 1, end
            if size >= BLOCK:
                flush()
                size = 0
    flush()
    empty = np.zeros(0, np.uint64)
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else empty for p in parts]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of width words, in order; fewer words make one shingle of all; no words make none."""
    if not len(words):
        return words
    if len(words) < width:
        return mix((words * PLACE[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += words[j : j + n] * PLACE[j]
    return mix(total)


def planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers as width planes of bytes, lowest first; sorted values then compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


# The exchange. A chunk is some millions of (shingle, document) pairs that one task has seen. A shingle that it saw once goes
# to the shingle's bucket with its document's number; one seen more often goes there once, as a marker with its count, while
# its documents wait in the chunk's own row. Each bucket sums the counts and answers every chunk with what is not unique.

CHUNK_ROWS = "bucket int, chunk long, single binary, doc binary, marker binary, times binary, header binary"
NAMES = [x.split()[0] for x in CHUNK_ROWS.split(", ")]
TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
ANSWERS = "chunk long, token binary, doc binary, df binary, marker binary, times binary, header binary"
ANSWER_NAMES = [x.split()[0] for x in ANSWERS.split(", ")]
SETS = "doc_id long, n long, fp binary, tokens binary"


def batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def chunk_rows(chunk: int, docs: list[tuple[int | None, int, bytes, np.ndarray]], bits: int) -> list[tuple]:
    """docs: id, set size, fingerprint, sorted 48-bit tokens."""
    lengths = [len(d[3]) for d in docs]
    tokens = np.concatenate([d[3] for d in docs]) if docs else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(docs), dtype=np.uint64), lengths)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(tokens)))
    once = np.repeat(count == 1, count)
    single, single_doc, known, known_doc = tokens[once], owner[once], tokens[~once], owner[~once]
    marker, times = tokens[first][count > 1], count[count > 1].astype(np.uint64)
    header = pack_header(docs, known, known_doc)
    home = int(mix(np.array([chunk], np.uint64))[0]) % (1 << bits)  # the header only passes through
    rows = [(home, chunk, b"", b"", b"", b"", header)]
    shift = np.uint64(48 - bits)
    used = np.unique(np.concatenate([single, marker]) >> shift)  # buckets without tokens cost nothing
    s, m = (np.searchsorted(x >> shift, used) for x in (single, marker))
    s, m = np.append(s, len(single)), np.append(m, len(marker))
    for i, b in enumerate(used.tolist()):
        rows.append((b, chunk, planes(single[s[i] : s[i + 1]], 6), planes(single_doc[s[i] : s[i + 1]], 2), planes(marker[m[i] : m[i + 1]], 6), planes(times[m[i] : m[i + 1]], 4), None))
    return rows


def pack_header(docs: list[tuple], known: np.ndarray, known_doc: np.ndarray) -> bytes:
    table = pa.record_batch([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.int64()), pa.array([d[2] for d in docs], pa.binary())], ["doc_id", "n", "fp"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    first = sink.getvalue().to_pybytes()
    return len(first).to_bytes(8, "little") + len(known).to_bytes(8, "little") + first + planes(known, 6) + planes(known_doc, 2)


def unpack_header(data: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    size, n = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    at = 16 + size
    return pa.ipc.open_stream(data[16:at]).read_all(), unplanes(data[at : at + 6 * n], 6), unplanes(data[at + 6 * n :], 2)


def chunked(sets: Iterator[tuple[int | None, int, bytes, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    waiting, size, serial, task = [], 0, 0, TaskContext.get().partitionId()
    for row in sets:
        waiting.append(row)
        size += len(row[3])
        if size >= CHUNK_TOKENS or len(waiting) >= CHUNK_DOCS:
            yield batch_of(chunk_rows((task << 24) + serial, waiting, bits), NAMES, TYPES)
            waiting, size, serial = [], 0, serial + 1
    if waiting:
        yield batch_of(chunk_rows((task << 24) + serial, waiting, bits), NAMES, TYPES)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of sorted batches that have the same key, together."""
    own: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if own and own[-1][key] != row[key]:
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), *[pa.binary()] * 6]
    for rows in runs(batches, "bucket"):
        heads = [(r["chunk"], b"", b"", b"", b"", b"", r["header"]) for r in rows if r["header"] is not None]
        for head in heads:
            yield batch_of([head], ANSWER_NAMES, types)
        rows = [r for r in rows if r["header"] is None]
        if not rows:
            continue
        singles, markers = [unplanes(r["single"], 6) for r in rows], [unplanes(r["marker"], 6) for r in rows]
        every, back = np.unique(np.concatenate(singles + markers), return_inverse=True)
        times = np.concatenate([np.ones(sum(map(len, singles)), np.uint64), *[unplanes(r["times"], 4) for r in rows]])
        df = np.minimum(np.bincount(back, weights=times, minlength=len(every)), 2**32 - 1).astype(np.uint64)[back]
        cuts = np.cumsum([len(x) for x in singles + markers])[:-1]
        dfs = np.split(df, cuts)
        for r, tokens, own, marks, marked in zip(rows, singles, dfs, markers, dfs[len(rows) :]):
            keep = own > 1
            if keep.any() or len(marks):
                yield batch_of([(r["chunk"], planes(tokens[keep], 6), planes(unplanes(r["doc"], 2)[keep], 2), planes(own[keep], 4), planes(marks, 6), planes(marked, 4), None)], ANSWER_NAMES, types)


def gathered(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for rows in runs(batches, "chunk"):
        table, known, known_doc = next(unpack_header(r["header"]) for r in rows if r["header"] is not None)
        rows = [r for r in rows if r["header"] is None]
        join = lambda c, w: np.concatenate([np.zeros(0, np.uint64), *[unplanes(r[c], w) for r in rows]])
        marker, marked = join("marker", 6), join("times", 4)
        order = np.argsort(marker)
        known_df = marked[order][np.searchsorted(marker[order], known)] if len(known) else known
        token, doc, df = np.concatenate([join("token", 6), known]), np.concatenate([join("doc", 2), known_doc]).astype(np.int64), np.concatenate([join("df", 4), known_df])
        n = table["n"].to_numpy()
        enough = (np.bincount(doc, minlength=len(n)) * den >= n * num) & (n > 0)
        keep = enough[doc]
        token, doc, df = token[keep], doc[keep], df[keep]
        order = np.lexsort((token, df, doc))
        token, cuts = token[order], np.searchsorted(doc[order], np.arange(len(n) + 1))
        out = [(i, k, fp, planes(token[a:b], 6) if ok else None) for i, k, fp, ok, a, b in zip(table["doc_id"].to_pylist(), n.tolist(), table["fp"].to_pylist(), enough, cuts[:-1], cuts[1:])]
        for i in range(0, len(out), 2000):
            yield batch_of(out[i : i + 2000], [x.split()[0] for x in SETS.split(", ")], types)


def exchange(rows: DataFrame, bits: int, num: int, den: int) -> DataFrame:
    """From chunk rows: every document with its set's size and fingerprint and, where num/den or more of the set is in
    other documents too, those tokens, rarest first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_bucket = rows.repartition(min(parts, 1 << bits), "bucket").sortWithinPartitions("bucket")
    answers = by_bucket.mapInArrow(tidy(answered), ANSWERS)
    return answers.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(tidy(lambda b: gathered(b, num, den)), SETS)


def text_rows(docs: DataFrame, width: int, bits: int, table: bytes = SPACES) -> DataFrame:
    """docs: doc_id, text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                texts = [(t.as_py() or "").encode() for t in part.column(1)]
                for doc_id, words in zip(part.column(0).to_pylist(), word_hashes(texts, table)):
                    tokens = np.unique(shingle_hashes(words, width))
                    fp = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None
                    # 48 bits a token from here on: two tokens of a document that fall together would still count as two
                    yield doc_id, len(tokens), fp, np.unique(tokens >> np.uint64(16))

    return docs.mapInArrow(tidy(lambda b: chunked(sets(b), bits)), CHUNK_ROWS)


def set_rows(sets: DataFrame, bits: int) -> DataFrame:
    """sets: doc_id, n, fp, tokens (planes of 6 bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, n, fp, tokens in zip(*(batch.column(i).to_pylist() for i in range(4))):
                yield doc_id, n, fp, np.sort(unplanes(tokens, 6))

    return sets.mapInArrow(tidy(lambda b: chunked(read(b), bits)), CHUNK_ROWS)


def bucket_bits(docs: DataFrame) -> int:
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return (max(MIN_BUCKETS, size // BUCKET_BYTES) - 1).bit_length()
