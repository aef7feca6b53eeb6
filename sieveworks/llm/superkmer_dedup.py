"""Exact removal of repeated word windows, by super-k-mer partitioning.

A window is `WINDOW` consecutive words of one document. Its minimiser is the least hash among its runs of `MINIMISER`
words, so equal windows have equal minimisers. Consecutive windows that share a minimiser travel together, as one packed
string, to the bucket of that minimiser; there all windows of a bucket are sorted, and those with equal words stand side
by side. Every window but the first (least doc_id, then least start) is repeated, and the words it covers go.

Before they travel, the windows of each block of input text are sorted in the same way: what repeats within a block is
known to be repeated at once and stays behind. So a window travels at most once from a block, however many copies there
are, and no bucket gets more of a hot passage than there are blocks. Hashes only bring candidates together: the words
are compared byte by byte. Strings are shuffled compressed, texts once, for the removal.

A bucket is never held whole. Its task deals it to parts by other bits of the minimiser, on the task's own scratch file
once they outgrow HELD bytes, and sorts part by part. A part of more than SORTED bytes (a hot minimiser) is dealt on by
bits of the windows' hashes, which equal windows share, level by level; what no bits can part is one window, met many
times, and read twice as a stream: for its first place, then for the others. So a task's memory is bounded, whatever the
input and its skew.

Defined results: a null or empty text has no words; documents of fewer than `WINDOW` words keep all. A null doc_id comes
after all others. Rows with equal doc_id and text are one document, and each of them gets its result; rows with equal
doc_id and different texts are different documents, in the order of a hash of the text. No rows give no rows; other
columns are left out (`deduplicate` keeps those of documents).
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, MINIMISER = 20, 3
#: Text bytes packed at a time.
BLOCK_BYTES = 2 << 20
#: Parts of a bucket, and of a part that is still too large; the latter LEVELS times.
PARTS, LEVELS = 64, 4
#: Bytes of strings that a task holds before they go to its scratch file, and that it sorts at once.
HELD, SORTED = 32 << 20, 4 << 20
#: Of zstd, for what is shuffled, and for scratch files.
LEVEL, SCRATCH_LEVEL = 6, 3
#: Bytes of two windows compared at a time.
_COMPARED = 4 << 20
_FACTOR = 0x9E3779B97F4A7C15
_KEY = np.dtype([("part", "u1"), ("known", "?"), ("doc", "<i8"), ("hash", "<i4"), ("start", "<i4"), ("windows", "<i4"), ("bytes", "<i4")])


def _joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for every i with n values from there on, by doubling."""
    have, size = h, 1
    out, taken = None, 0
    left = n
    while left:
        if left & 1:
            if out is None:
                out = have
            else:
                m = min(len(out), len(have) - taken)
                out = out[:m] * np.uint64(pow(_FACTOR, size, 1 << 64)) + have[taken : taken + m]
            taken += size
        left >>= 1
        if left:
            m = len(have) - size
            have = have[: max(m, 0)] * np.uint64(pow(_FACTOR, size, 1 << 64)) + have[size:] if m > 0 else have[:0]
            size *= 2
    return common.mix(out[: max(0, len(h) - n + 1)])


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """Least of g[i:i+n] for every i."""
    size, have = 1, g
    while size * 2 <= n:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return np.minimum(have[: len(g) - n + 1], have[n - size :][: len(g) - n + 1]) if len(g) >= n else g[:0]


def _pack(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words end to end with a space after each, and their starts (one more than words)."""
    at = np.concatenate([[0], np.cumsum(e - s + 1)])
    out = np.append(data, np.uint8(32))[common.run_index(s, e - s + 1)]
    out[at[1:] - 1] = 32
    return out, at


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] equals data[b:b+size]."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _COMPARED, side="right")))
        differ = data[common.run_index(a[i:j], sizes[i:j])] != data[common.run_index(b[i:j], sizes[i:j])]
        out[i:j] = ~np.logical_or.reduceat(np.append(differ, False), np.cumsum(sizes[i:j]) - sizes[i:j])
        i = j
    return out


def _firsts(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """For each valid window (a word index, ascending), the first valid window with the same words; hashes are of all windows."""
    order = np.argsort(hashes[valid], kind="stable")
    value = hashes[valid][order]
    head = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    first = np.arange(len(hashes))
    runs = np.cumsum(head) - 1
    first[valid[order]] = valid[order][np.flatnonzero(head)][runs] if len(value) else []
    later = valid[first[valid] != valid]
    if not len(later):
        return first[valid]
    of = first[later]
    # Where the window before repeats the one before the first, all but the last word has been compared there.
    chained = np.zeros(len(later), bool)
    chained[1:] = (later[1:] == later[:-1] + 1) & (of[1:] == of[:-1] + 1)
    skip = np.where(chained, WINDOW - 1, 0)
    sizes = at[later + WINDOW] - at[later + skip]
    fine = (sizes == at[of + WINDOW] - at[of + skip]) & (at[later + WINDOW] - at[later] == at[of + WINDOW] - at[of])
    fine[fine] = _same(data, at[later + skip][fine], at[of + skip][fine], sizes[fine])
    if not fine.all():  # unlike words under one hash: group such runs by the words themselves
        odd = np.isin(first[valid], of[~fine])
        seen: dict[bytes, int] = {}
        for w in valid[odd].tolist():
            first[w] = seen.setdefault(data[at[w] : at[w + WINDOW]].tobytes(), w)
    return first[valid]


def _intervals(windows: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one row: first windows and sizes."""
    if not len(windows):
        return windows, windows
    new = np.concatenate([[True], (windows[1:] != windows[:-1] + 1) | (row[windows[1:]] != row[windows[:-1]])])
    begin = np.flatnonzero(new)
    return windows[begin], np.diff(np.append(begin, len(windows)))


def _sorted_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """By document, each document once."""
    t = pa.table(batch).sort_by([("doc_id", "ascending"), ("hash", "ascending")]).combine_chunks()
    ids, hashes = t.column("doc_id").to_pylist(), t.column("hash").to_pylist()
    keep = [i for i in range(len(ids)) if not i or (ids[i], hashes[i]) != (ids[i - 1], hashes[i - 1])]
    return t.take(keep).combine_chunks().to_batches()[0] if keep else batch.slice(0, 0)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column("doc_id")
    return ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy().astype(np.int64), batch.column("hash").to_numpy(zero_copy_only=False).astype(np.int32)


def superkmers(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, count of keys, pack): for each block and bucket, super-k-mers; repeats within the block are packed without strings."""
    for raw, _, _ in common.blocks(batches, limit=BLOCK_BYTES):
        batch = _sorted_rows(raw)
        data, at = common.flat(batch.column("text"))
        data, at = data[at[0] : at[-1]], at - at[0]
        s, e, row = common.words(data, at)
        if len(s) < WINDOW:
            continue
        packed, place = _pack(data, s, e)
        known, doc, text_hash = _keys(batch)
        h = common.word_hashes(data, s, e)
        valid = np.flatnonzero(row[WINDOW - 1 :] == row[: len(row) - WINDOW + 1])
        if not len(valid):
            continue
        first = _firsts(packed, place, _joined(h, WINDOW), valid)
        least = _least(_joined(h, MINIMISER), WINDOW - MINIMISER + 1)
        begin_of_row = np.searchsorted(row, np.arange(len(doc)))

        def keyed(window: np.ndarray, sizes: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
            out = np.zeros(len(window), _KEY)
            r = row[window]
            out["known"], out["doc"], out["hash"], out["start"], out["windows"], out["bytes"] = known[r], doc[r], text_hash[r], window - begin_of_row[r], sizes, lengths
            return out

        repeated, sizes = _intervals(valid[first != valid], row)
        local = keyed(repeated, sizes, 0)
        fresh = valid[first == valid]
        new = np.concatenate([[True], (fresh[1:] != fresh[:-1] + 1) | (row[fresh[1:]] != row[fresh[:-1]]) | (least[fresh[1:]] != least[fresh[:-1]])])
        begin = np.flatnonzero(new)
        window, sizes = fresh[begin], np.diff(np.append(begin, len(fresh)))
        lengths = place[window + sizes - 1 + WINDOW] - place[window]
        kmers = keyed(window, sizes, lengths)
        scattered = common.mix(least[window])
        bucket, kmers["part"] = (scattered % np.uint64(buckets)).astype(np.int64), (scattered >> np.uint64(40)) % np.uint64(PARTS)
        order = np.lexsort((kmers["part"], bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        engine = zstandard.ZstdCompressor(level=LEVEL)
        where, counts, blobs = [], [], []
        for b in np.unique(bucket).tolist():
            own = order[edges[b] : edges[b + 1]]
            strings = packed[common.run_index(place[window[own]], lengths[own])]
            where.append(b)
            counts.append(len(own))
            blobs.append(engine.compress(_by_field(kmers[own]) + strings.tobytes()))
        for i in range(0, len(local), 4096):
            where.append(int(doc[row[repeated[i]]]) % buckets)
            counts.append(len(local[i : i + 4096]))
            blobs.append(engine.compress(_by_field(local[i : i + 4096])))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(where, pa.int32()), "count": pa.array(counts, pa.int32()), "pack": pa.array(blobs, pa.binary())})


def _by_field(keys: np.ndarray) -> bytes:
    """Field by field, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(keys[f]).tobytes() for f in _KEY.names)


def _unpacked(count: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a pack and its strings."""
    raw, at = zstandard.ZstdDecompressor().decompress(blob), 0
    keys = np.zeros(count, _KEY)
    for f in _KEY.names:
        keys[f] = np.frombuffer(raw, _KEY[f], count, at)
        at += count * _KEY[f].itemsize
    return keys, np.frombuffer(raw, np.uint8, offset=at)


class _Parts:
    """Super-k-mers of one bucket (or part) by part: in memory up to HELD bytes, beyond in a scratch file of the task."""

    def __init__(self):
        self.raw = [0] * PARTS
        self._held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(PARTS)]
        self._filed: list[list[tuple[int, int, int]]] = [[] for _ in range(PARTS)]
        self._bytes, self._file = 0, None

    def add(self, keys: np.ndarray, strings: np.ndarray) -> None:
        """keys come sorted by part, their strings in the same order."""
        edges = np.searchsorted(keys["part"], np.arange(PARTS + 1))
        ends = np.concatenate([[0], np.cumsum(keys["bytes"].astype(np.int64))])
        for p in np.unique(keys["part"]).tolist():
            own = keys[edges[p] : edges[p + 1]], strings[ends[edges[p]] : ends[edges[p + 1]]]
            self._held[p].append(own)
            self.raw[p] += len(own[1])
        self._bytes += len(strings) + keys.nbytes
        if self._bytes > HELD:
            self._flush()

    def _flush(self) -> None:
        self._file = self._file or tempfile.TemporaryFile()
        engine, at = zstandard.ZstdCompressor(level=SCRATCH_LEVEL), self._file.seek(0, 2)
        for held, filed in zip(self._held, self._filed, strict=True):
            if held:
                keys, strings = (np.concatenate(x) for x in zip(*held, strict=True))
                blob = engine.compress(_by_field(keys) + strings.tobytes())
                self._file.write(blob)
                filed.append((at, len(blob), len(keys)))
                at += len(blob)
                held.clear()
        self._bytes = 0

    def chunks(self, parts: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p in parts:
            for at, size, count in self._filed[p]:
                self._file.seek(at)
                yield _unpacked(count, self._file.read(size))
            yield from self._held[p]

    def close(self) -> None:
        if self._file:
            self._file.close()


def _windows_of(keys: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed super-k-mers: starts of the words (one more than words), their rows, the windows, their places in the document, hashes of all windows."""
    at = np.concatenate([[0], np.cumsum(keys["bytes"].astype(np.int64))])
    s, e, row = common.words(data, at)
    first_word = np.searchsorted(row, np.arange(len(keys)))
    valid = common.run_index(first_word, keys["windows"].astype(np.int64))
    return np.append(s, len(data)), row, valid, valid - first_word[row[valid]] + keys["start"][row[valid]], _joined(common.word_hashes(data, s, e), WINDOW)


def _found(keys: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(keys["doc"], pa.int64(), mask=~keys["known"]), "hash": pa.array(keys["hash"], pa.int32()),
        "start": pa.array(start.astype(np.int32), pa.int32()), "windows": pa.array(sizes.astype(np.int32), pa.int32()),
    })


def _judged(chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The repeated windows among all of the chunks, sorted in memory."""
    keys, data = (np.concatenate(x) for x in zip(*chunks, strict=True))
    begin = np.cumsum(keys["bytes"].astype(np.int64)) - keys["bytes"]
    order = np.lexsort((keys["start"], keys["hash"], keys["doc"], ~keys["known"]))
    keys = keys[order]
    data = data[common.run_index(begin[order], keys["bytes"].astype(np.int64))]
    place, row, valid, offset, hashes = _windows_of(keys, data)
    first = _firsts(data, place, hashes, valid)
    position = np.zeros(len(place), np.int64)
    position[valid] = offset
    a, b = row[valid], row[first]
    # The same place of the same document may come twice, from rows that repeat: it isn't repeated by itself.
    itself = (keys["doc"][a] == keys["doc"][b]) & (keys["hash"][a] == keys["hash"][b]) & (keys["known"][a] == keys["known"][b]) & (offset == position[first])
    windows, sizes = _intervals(valid[~itself], row)
    return _found(keys[row[windows]], position[windows], sizes)


def _streamed(chunks: Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """The repeated windows among single windows of few different texts, read twice."""

    def rows() -> Iterator[tuple[np.ndarray, list[bytes], list[tuple]]]:
        for keys, data in chunks():
            ends = np.cumsum(keys["bytes"].astype(np.int64)).tolist()
            raw = data.tobytes()
            yield keys, [raw[b - n : b] for b, n in zip(ends, keys["bytes"].tolist(), strict=True)], list(zip(*(keys[f].tolist() for f in ("known", "doc", "hash", "start")), strict=True))

    least: dict[bytes, tuple] = {}
    order = lambda x: (not x[0], *x[1:])
    for _, texts, places in rows():
        for t, x in zip(texts, places, strict=True):
            if t not in least or order(x) < order(least[t]):
                least[t] = x
    for keys, texts, places in rows():
        again = keys[np.array([least[t] != x for t, x in zip(texts, places, strict=True)], bool)]
        yield _found(again, again["start"], again["windows"])


def _sorted_parts(parts: _Parts, level: int = 0) -> Iterator[pa.RecordBatch]:
    """The repeated windows of all parts, a few bytes at a time; large parts are dealt on by the windows' hashes."""
    p = 0
    while p < PARTS:
        q, total = p + 1, parts.raw[p]
        while q < PARTS and total + parts.raw[q] <= SORTED:
            q, total = q + 1, total + parts.raw[q]
        if total > SORTED and level == LEVELS:
            yield from _streamed(lambda own=range(p, q): parts.chunks(own))
        elif total > SORTED:
            finer = _Parts()
            for keys, data in parts.chunks(range(p, q)):
                place, row, valid, offset, hashes = _windows_of(keys, data)
                out = keys[row[valid]]
                out["part"] = (hashes[valid] >> np.uint64(6 * level)) % np.uint64(PARTS)
                out["start"], out["windows"], out["bytes"] = offset, 1, place[valid + WINDOW] - place[valid]
                order = np.argsort(out["part"], kind="stable")
                out, at = out[order], place[valid][order]
                for i in range(0, len(out), 8192):  # a window's string is longer than its share of a super-k-mer
                    few = out[i : i + 8192]
                    finer.add(few, data[common.run_index(at[i : i + 8192], few["bytes"].astype(np.int64))])
            yield from _sorted_parts(finer, level + 1)
            finer.close()
        elif total:
            yield _judged(parts.chunks(range(p, q)))
        p = q


def repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of repeated windows out of all packs of some buckets."""
    parts = _Parts()
    for batch in batches:
        counts, packs = batch.column("count"), batch.column("pack")
        for i in range(batch.num_rows):
            keys, strings = _unpacked(counts[i].as_py(), packs[i].as_py())
            local = keys["bytes"] == 0
            if local.any():
                yield _found(keys[local], keys["start"][local], keys["windows"][local])
            if not local.all():
                parts.add(keys[~local], strings)
    yield from _sorted_parts(parts)
    parts.close()


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("hash", F.hash(F.coalesce("text", F.lit(""))))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), start and windows: runs of windows that start earlier, too."""
    buckets = common.partitions(docs)
    packs = _hashed(common.documents(docs)).mapInArrow(lambda it: superkmers(it, buckets), "bucket int, count int, pack binary")
    return packs.repartitionById(buckets, F.col("bucket")).mapInArrow(repeated_windows, "doc_id long, hash int, start int, windows int")


def _cover(start: list[int], windows: list[int], words: int) -> np.ndarray:
    """Which words the windows cover."""
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, np.array(start) + np.array(windows) - 1 + WINDOW, -1)
    return np.cumsum(change)[:words] > 0


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Documents with the list of their repeated runs (null without any)."""
    found = repeats(docs).groupBy(F.col("doc_id").alias("key"), F.col("hash").alias("key_hash")).agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    docs = _hashed(docs)
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("hash") == F.col("key_hash")), "left").drop("key", "key_hash", "hash")


def _parted(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row the text's bytes, the words' starts and ends, and which words go."""
    data, at = common.flat(batch.column("text"))
    data, at = data[at[0] : at[-1]], at - at[0]
    s, e, row = common.words(data, at)
    edges, raw = np.searchsorted(row, np.arange(len(at))), data.tobytes()
    for i, runs in enumerate(batch.column("runs").to_pylist()):
        a, b = edges[i], edges[i + 1]
        gone = _cover([r["start"] for r in runs], [r["windows"] for r in runs], b - a) if runs else np.zeros(b - a, bool)
        yield raw[at[i] : at[i + 1]], s[a:b] - at[i], e[a:b] - at[i], gone


def kept_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the kept words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in common.blocks(batches):
            rows = []
            for raw, s, e, gone in _parted(batch):
                s, e = s[~gone], e[~gone]
                words = _pack(np.frombuffer(raw, np.uint8), s, e)[0].tobytes()[:-1] if len(s) else b""
                rows.append((len(gone), int(gone.sum()), hashlib.sha256(words).hexdigest()))
            n, removed, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return _with_repeats(common.documents(docs)).select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Documents without the words of repeated windows; a run of removed words goes with the white space after it."""
    docs = common.only(docs, **common.DOCUMENT_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in common.blocks(batches):
            texts = []
            for raw, s, e, gone in _parted(batch):
                if gone.any():
                    begin = np.where(gone, s, 0)
                    follow = np.append(s[1:], len(raw))
                    keep = np.ones(len(raw), bool)
                    keep[common.run_index(begin[gone], follow[gone] - begin[gone])] = False
                    raw = np.frombuffer(raw, np.uint8)[keep].tobytes().rstrip(b" ")
                texts.append(raw.decode("utf-8", "replace"))
            valid = batch.column("text").is_valid().to_pylist()
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "lang", "source")} | {"text": pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], pa.string())})

    done = _with_repeats(docs).select("doc_id", "text", "lang", "source", "runs").mapInArrow(run, "doc_id long, lang string, source string, text string")
    return done.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
