"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A document costs linear * n + quadratic * n**2, as attention over n tokens does. Within a block of documents,
descending costs are assigned to the lowest-cost sequence with room for them. As many sequences are opened as the
block's tokens need, so that less than one sequence of padding remains; documents are cut into pieces where they are
longer than a sequence, or where no sequence has room for them whole.

Blocks are consecutive rows of an input partition, of about `block_tokens` tokens: no shuffle, bounded memory, and a
task that is run again gives the same pieces.

Defined results: a null or empty text is one piece, the end id alone. Repeated rows are packed as often as they come.
A null doc_id stays null. No rows give no pieces. Ties of cost go by input order, ties of sequences by number.
Other columns are left out. Every id, of texts of any length, lies in exactly one piece.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

SEQUENCE_TOKENS = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
BLOCK_TOKENS = 4 << 20
#: Chunks of text whose ids a worker keeps; beyond that it starts afresh.
CACHE_CHUNKS = 400_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


#: Of word_bpe files: the bytes that byte-level vocabularies write as themselves; the other bytes follow from U+0100 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_CHARACTER = {b: chr(b) for b in _SELF} | {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(256)} - {*_SELF}))}
#: Below this code point, text is normal (NFC) as it is and lower case goes letter by letter.
_PLAIN = "\u0180"


class ChunkTokenizer:
    """Ids of texts by a `tokenizers` file without special tokens, kept for each white-space separated chunk.

    Valid for tokenizers that drop white space before any merge, so that a text's ids are those of its chunks end to
    end; `whole` checks a text against the library itself. Chunks of plain letters skip the library's slow normaliser
    and splitter where the file's are the known ones, and meet its merges directly.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.merges = self.plain.model
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = [x["type"] for x in parts["normalizer"]["normalizers"]] + [x["type"] for x in parts["pre_tokenizer"]["pretokenizers"]]
        self.known = steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
        self.pieces = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall if self.known else None
        self.reset()

    def reset(self) -> None:
        self.number = _Numbers()
        self.piece_ids: dict[str, list[int]] = {}
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.plain.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        found = self.piece_ids.get(piece)
        if found is None:
            written = piece if piece.isascii() and piece.isprintable() else "".join(map(_AS_CHARACTER.__getitem__, piece.encode()))
            found = self.piece_ids[piece] = [t.id for t in self.merges.tokenize(written)]
        return found

    def _learn(self, chunks: list[bytes]) -> None:
        sizes, ids = [], []
        piece_ids = self._piece
        for c in chunks:
            text = c.decode("utf-8", "replace")
            before = len(ids)
            if not self.known or not (text.isascii() or max(text) < _PLAIN):
                ids += self.whole(text)
            elif (low := text.lower()).isalpha():
                ids += piece_ids(low)
            elif low[-1] in ",." and low[:-1].isalpha():
                ids += piece_ids(low[:-1])
                ids += piece_ids(low[-1])
            else:
                for piece in self.pieces(low):
                    ids += piece_ids(piece)
            sizes.append(len(ids) - before)
        new = np.array(sizes, np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(new) - new])
        self.sizes = np.concatenate([self.sizes, new])
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.number) > CACHE_CHUNKS:
            self.reset()
        known = len(self.number)
        split = [t.split() for t in texts]
        counts = [len(c) for c in split]
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        if len(self.number) > known:
            self._learn(list(islice(self.number, known, None)))
        sizes = self.sizes[at]
        ids = self.ids[common.run_index(self.starts[at], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *counts])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class _Numbers(dict):
    """Numbers what it is asked for, in the order of the first question."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


_loaded: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]


def assign(sizes: list[int], capacity: int = SEQUENCE_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pieces (document, start, length, sequence, offset) of documents of these sizes, and the sequences' costs."""
    count = -(-sum(sizes) // capacity)
    costs, room = np.zeros(count), np.full(count, capacity, np.int64)
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    opened = 0
    for d, n in enumerate(sizes):
        full = n // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, opened, 0))
            costs[opened], room[opened] = linear * capacity + quadratic * capacity**2, 0
            opened += 1
        if n % capacity:
            rest.append((n % capacity, d, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    heap = [(0.0, s) for s in range(opened, count)]
    aside: list[tuple[float, int]] = []

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, s, int(capacity - room[s])))
        room[s] -= n
        costs[s] += linear * n + quadratic * n * n

    for n, d, start in rest:
        aside.clear()
        while heap and room[heap[0][1]] < n:
            aside.append(heapq.heappop(heap))
            if len(aside) > 64:
                break
        if heap and room[heap[0][1]] >= n:
            put(d, start, n, s := heap[0][1])
            heapq.heapreplace(heap, (costs[s], s)) if room[s] else heapq.heappop(heap)
        else:
            fits = room >= n
            if fits.any():
                put(d, start, n, int(np.argmin(np.where(fits, costs, np.inf))))
            else:
                while n:
                    s = int(np.argmin(np.where(room > 0, costs, np.inf)))
                    take = int(min(n, room[s]))
                    put(d, start, take, s)
                    start, n = start + take, n - take
            heap[:] = [(costs[s], s) for s in np.flatnonzero(room > 0).tolist()]
            heapq.heapify(heap)
            continue
        for _, s in aside:
            heapq.heappush(heap, (costs[s], s))
    return pieces, costs


def pack(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: its document, place in it, length, the crc32 of its ids, sequence, offset and the sequence's cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = tokenizer(path), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held, done = 0, 0
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal held, done
            sizes = [len(x) for x in ids]
            pieces, costs = assign(sizes, capacity, linear, quadratic)
            doc, start, length, seq, offset = (list(x) for x in zip(*pieces, strict=True))
            crc = [zlib.crc32(ids[d][a : a + n].astype("<u4").tobytes()) for d, a, n, _, _ in pieces]
            base = (task << 36) + done
            out = pa.RecordBatch.from_pydict({
                "doc_id": pa.array([names[d] for d in doc], pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array([sizes[d] for d in doc], pa.int64()),
                "sequence_id": pa.array([base + s for s in seq], pa.int64()), "offset": pa.array(offset, pa.int64()), "cost": pa.array(costs[seq], pa.float64()),
            })
            done += len(costs)
            ids.clear()
            names.clear()
            held = 0
            return out

        for batch, data, at in common.blocks(batches, limit=1 << 20):
            raw, edges = data.tobytes(), at.tolist()
            for name, found in zip(batch.column("doc_id").to_pylist(), own.encode([raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]), strict=True):
                ids.append(np.concatenate([found, end]))
                names.append(name)
                held += len(found) + 1
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    return common.documents(docs).mapInArrow(run, PIECES)
