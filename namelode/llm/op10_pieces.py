"""Encoding and decoding with a merge-type (BPE) sentencepiece vocabulary.

A chunk is encoded by an agenda of adjacent symbol pairs: the pair whose joined piece has the best score is merged first,
the leftmost among equals, and the merged symbol offers its two new neighbour pairs. Symbols that are no piece become bytes.
The agenda is a heap; for short chunks it is a plain list of the pairs' costs beside the symbols, which is faster there.

Pieces hold the space mark only at their start (the vocabulary is asked), so no merge crosses from a word into the next
space mark, and a text's ids are the ids of its chunks, each a run of space marks and the word behind it, in turn. Chunks
are kept in a bounded memo. Every chunk that enters it is encoded by the library as well, once an Arrow batch; where the two
differ, the library's ids are taken and counted in ``repaired``. A text's whole ids are decoded by the library; ``decode_ids``
says the same without it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
MEMO_CHUNKS, MEMO_BYTES = 400_000, 32 << 20
SHORT = 40
NEVER = float("inf")
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, repaired long"
_loaded: dict[str, Codec] = {}


class Codec(dict):
    """The memo itself: a chunk without its first space mark -> its ids, written in decimal and joined by spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(lib.get_piece_size())
        plain = [i for i in every if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.cost = {lib.id_to_piece(i): -lib.get_score(i) for i in plain if not lib.is_unused(i)}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in every if lib.is_byte(i)}
        self.text = {i: lib.id_to_piece(i) for i in plain}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.old: dict[str, str] = {}
        self.size = 0  # of the chunks that have entered and their ids, in characters
        self.new: list[str] = []
        self.repaired: set[str] = set()

    def merged_short(self, symbols: list[str]) -> list[str]:
        cost = self.cost
        agenda = [cost.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost.get(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost.get(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def merged(self, symbols: list[str]) -> list[str]:
        cost = self.cost
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(cost[p], i, i + 1, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in cost]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := piece + symbols[k]) in cost:
                    heapq.heappush(agenda, (cost[p], i, k, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + piece) in cost:
                heapq.heappush(agenda, (cost[p], h, i, p))
        return [s for s in symbols if s]

    def encode_chunk(self, chunk: str) -> list[int]:
        symbols = self.merged_short(list(chunk)) if len(chunk) <= SHORT else self.merged(list(chunk))
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            bytes_of = lambda s: [self.bytes[b] for b in s.encode()] if self.bytes else [self.unknown]
            return [i for s in symbols for i in ([self.ids[s]] if s in self.ids else bytes_of(s))]

    def decode_ids(self, ids: list[int]) -> str:
        """The text of ids: pieces, runs of bytes as UTF-8, marks as spaces, without the space put before the text."""
        try:
            return "".join([self.text[i] for i in ids]).replace(MARK, " ").removeprefix(" ")
        except KeyError:
            out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i in self.text:
                out.append(self.text[i].replace(MARK, " "))
            elif i == self.unknown:
                out.append(" ⁇ ")
        return "".join(out).removeprefix(" ")

    def __missing__(self, key: str) -> str:
        if (kept := self.old.pop(key, None)) is not None:
            self[key] = kept
            return kept
        value = " ".join(map(str, self.encode_chunk(MARK + key)))
        self[key] = value
        self.size += len(key) + len(value)
        self.new.append(key)
        return value

    def chunks(self, text: str) -> list[str]:
        marked = text.replace(" ", MARK)
        if not self.splits:
            return [marked]
        if marked[:1] != MARK and MARK + MARK not in marked:
            return marked.split(MARK)
        return [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + marked)]

    def check_new(self) -> bool:
        """Compare the chunks that are new in the memo with the library; whether any was repaired."""
        new, self.new = self.new, []
        wrong = False
        texts = [k.replace(MARK, " ") for k in new]
        for key, text, ids in zip(new, texts, self.library.encode(texts, num_threads=1)):
            value = " ".join(map(str, ids))
            if text and self[key] != value:  # the library gives nothing for an empty text, whose mark is a chunk all the same
                self[key] = value
                self.repaired.add(key)
                wrong = True
        return wrong

    def encode(self, text: str) -> str:
        return " ".join([*map(self.__getitem__, self.chunks(text)), str(self.end)]) if text else str(self.end)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        if len(self) > MEMO_CHUNKS or self.size > MEMO_BYTES:  # what is not used again before the next time goes
            self.old = dict(self) if self.size <= MEMO_BYTES else {}
            self.clear()
            self.size = 0
        ids = [self.encode(t) for t in texts]
        if self.check_new():
            ids = [self.encode(t) for t in texts]
        out = []
        for text, joined in zip(texts, ids):
            bad = bool(self.repaired) and not self.repaired.isdisjoint(self.chunks(text))
            back = self.library.decode(list(map(int, joined.split())))
            out.append((joined.count(" ") + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), int(bad)))
        return out


def codec(path: str) -> Codec:
    """One codec a Python worker, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, repaired: encode whole texts with an end id, decode, and digest both.

    Null and empty texts have the end id alone. Ids may be null or repeat; every row gives a row. An empty table gives an
    empty result. Other columns are not read. model: a file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                found = own.digests([t or "" for t in part.column(1).to_pylist()])
                n, ids, back, bad = zip(*found)
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back), pa.array(bad, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "repaired"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, OUT)


def op10_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
