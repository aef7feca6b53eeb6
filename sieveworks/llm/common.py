"""Helpers shared by the training-data operators: input selection, shared folders, flat Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: The columns that a documents table has; pipeline stages hand on exactly these.
DOCUMENT_COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
#: Text bytes that a Python worker turns into flat arrays at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of a batch that goes to a Python worker: rows alone would not bound it, as texts may be long.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Has the session cut batches for Python workers by bytes; a smaller bound of the user's own stays."""
    if int(spark.conf.get(_BATCH_CONF, str(64 << 20)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns, cast; other columns (whatever their names) go. A missing column is null."""
    there = set(df.columns)
    bound_batches(df.sparkSession)
    return df.select(*[(F.col(f"`{c}`") if c in there else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def documents(df: DataFrame) -> DataFrame:
    return only(df, doc_id="long", text="string")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that new_path named, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle in proportion to the input should have."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end and the rows' offsets (one more than rows). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most limit text bytes (or one row) with their flat text; offsets start at 0."""
    for batch in batches:
        data, at = flat(batch.column(text))
        i, n = 0, len(at) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word [^\\x20\\x09-\\x0D]+ of flat text. Words end where rows end."""
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(at, s, side="right") - 1


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e]: sums of scattered 8-byte pieces, each bound to its place in the word."""
    out = np.zeros(len(s), np.uint64)
    if not len(s):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at64 = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    size = e - s
    out = mix(size.astype(np.uint64) * _ODD + np.uint64(1))
    keep = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.arange(1, 9, dtype=np.uint64)))
    live, k = np.arange(len(s)), 0
    while len(live):
        left = size[live] - 8 * k
        piece = np.ascontiguousarray(at64[s[live] + 8 * k]).view(np.uint64).ravel() & keep[np.minimum(left, 8) - 1]
        out[live] = mix(out[live] ^ mix(piece + np.uint64((k + 1) * int(_ODD) & 0xFFFFFFFFFFFFFFFF)))
        live, k = live[left > 8], k + 1
    return out


def run_index(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] of them), starts[1], ...: indices of ranges, end to end."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, sizes)
