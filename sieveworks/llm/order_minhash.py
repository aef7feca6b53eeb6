"""Order MinHash: fingerprints whose likeness follows edit distance, since they keep the order of what they select.

Each of `entries` random permutations selects the `picks` smallest k-mers of a text, a k-mer that occurs again counting
as another one (numbered by occurrence). The selected ones are put back in text order and hashed as a tuple. Likeness
is the share of equal entries.

Defined results: a null or empty text has no k-mers and gets the fingerprint of the empty tuple; a text shorter than k
is one k-mer; one with fewer than `picks` k-mers is the tuple of all. Equal texts have equal fingerprints. The document
after a null doc_id is the next row with a null doc_id or, at the end, the first row; null ids come last; rows with
equal ids go by text. A lone document is its own next one. No rows give no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, PICKS, ENTRIES = 6, 2, 64
#: Numbers of a permutation matrix held at a time, and where.
_CELLS = 1 << 17
_VALUES, _SMALL = np.empty(_CELLS, np.uint32), np.empty(_CELLS, bool)
_POSITION_BITS = np.uint64(24)


def _permutations(entries: int) -> np.ndarray:
    """Odd factors: each permutes the 32-bit hashes."""
    draws = common.mix(np.arange(1, entries + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return (draws >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


_FACTORS = _permutations(ENTRIES)


def kmer_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of the occurrence-numbered k-mers of a text given as code points, in text order."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint32)
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h *= np.uint64(0x100000001B3)
        h += codes[j : n - k + 1 + j]
    h = common.mix(h + np.uint64(k))
    if n < 1 << 24:  # hash and position in one word sort much faster than an index sort
        key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        key.sort()
        at, value = (key & np.uint64((1 << 24) - 1)).astype(np.int64), key >> _POSITION_BITS
    else:
        at = np.argsort(h & ~np.uint64((1 << 24) - 1), kind="stable")
        value = h[at] >> _POSITION_BITS
    again = np.flatnonzero(value[1:] == value[:-1]) + 1
    if len(again):
        fresh = np.ones(len(value), bool)
        fresh[again] = False
        since = np.arange(len(value)) - np.maximum.accumulate(np.where(fresh, np.arange(len(value)), 0))
        h[at[again]] = common.mix((h[at[again]] & ~np.uint64((1 << 24) - 1)) + since[again].astype(np.uint64))
    return (h >> np.uint64(32)).astype(np.uint32)


def _few(marks: np.ndarray) -> np.ndarray:
    """The places of the few that are true, looked for eight at a time."""
    n = len(marks) & ~7
    at = (np.flatnonzero(marks[:n].view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[marks[at]], n + np.flatnonzero(marks[n:])])


def fingerprint(codes: np.ndarray, k: int = K, picks: int = PICKS, a: np.ndarray = _FACTORS) -> np.ndarray:
    """The entries (32 bits each) of a text given as code points."""
    h = kmer_hashes(codes, k)
    n, entries = len(h), len(a)
    out = np.full(entries, np.uint64(n if n < picks else picks), np.uint64)
    if n <= picks:
        for x in h:
            out = common.mix(out ^ common.mix(np.full(entries, x, np.uint64)))
        return (common.mix(out + np.arange(entries, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    # Rows: permutations. A value beyond the bound is hardly ever among the smallest; rows with too few below it are done in full.
    bound = np.uint32(min(0xFFFFFFFF, ((picks + 9) << 32) // n))
    rows, cols, values = [], [], []
    width = _CELLS // entries
    for i in range(0, n, width):
        part = h[i : i + width]
        cells = entries * len(part)
        x, small = _VALUES[:cells], _SMALL[:cells]
        np.multiply(part[None, :], a[:, None], out=x.reshape(entries, -1))
        np.less_equal(x, bound, out=small)
        at = _few(small)
        r, c = np.divmod(at, len(part))
        rows.append(r)
        cols.append(c + i)
        values.append(x[at])
    r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
    for row in np.flatnonzero(np.bincount(r, minlength=entries) < picks):
        x = h * a[row]
        least = np.argpartition(x, picks - 1)[:picks]
        least = np.flatnonzero(x <= x[least].max())
        keep = r != row
        r, c, v = np.concatenate([r[keep], np.full(len(least), row)]), np.concatenate([c[keep], least]), np.concatenate([v[keep], x[least]])
    order = np.lexsort((c, v, r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(entries))
    chosen = np.sort(c[first[:, None] + np.arange(picks)], axis=1)
    for j in range(picks):
        out = common.mix(out ^ common.mix(h[chosen[:, j]].astype(np.uint64) + np.uint64(j)))
    return (common.mix(out + np.arange(entries, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(x == y))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex of 32-bit entries) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(codes_of(t or "")).astype(">u4").tobytes().hex() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fingerprint": pa.array(found, pa.string())})

    return common.documents(docs).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, context, doc_id, text) in partitions sorted so that each row's next document follows it.

    Buckets are ranges of doc_id that begin at ids that occur; the row that begins a bucket is also dealt, as context,
    to the end of the bucket before (the first to the last). Texts are shuffled once.
    """
    docs = common.documents(docs)
    count = partitions = common.partitions(docs)
    count *= 4
    points = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", [i / count for i in range(1, count)], 20 * count).alias("points")).first()
    starts = np.array(sorted({points["least"], *points["points"]}) if points["least"] is not None else [0], np.int64)

    @F.pandas_udf("array<int>")
    def buckets(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        values = ids.fillna(0).astype("int64").to_numpy()
        at = np.maximum(np.searchsorted(starts, values, side="right") - 1, 0)
        begins = known & (starts[at] == values)
        last = len(starts) - 1
        return pd.Series([[int(x), int(x) - 1 if x else last] if b else [int(x) if k else last] for x, b, k in zip(at, begins, known, strict=True)])

    dealt = docs.select("doc_id", "text", F.posexplode(buckets("doc_id")).alias("context", "bucket"))
    return dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket", "context", F.col("doc_id").asc_nulls_last(), "text")


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the beginning of the one after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_next(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likenesses to the edited text and the next document."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        rows: list[tuple] = []
        held: tuple | None = None  # the row whose next one hasn't come yet
        begun: tuple | None = None  # the bucket's first row

        def judged(row: tuple, after: tuple) -> None:
            name, text, own = row
            changed = edited(text, after[1])
            other = fingerprint(codes_of(changed))
            rows.append((name, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(own, other), likeness(own, after[2])))

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return found

        bucket = None
        for batch in batches:
            for where, context, name, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "context", "doc_id", "text")), strict=True):
                if where != bucket:
                    if held is not None:
                        judged(held, begun)
                    bucket, held, begun = where, None, None
                if context and held is None:
                    continue
                row = (name, text or "", fingerprint(codes_of(text or "")))
                if held is not None:
                    judged(held, row)
                held = None if context else row
                begun = begun or row
                if len(rows) >= 512:
                    yield out()
        if held is not None:
            judged(held, begun)
        if rows:
            yield out()

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
