"""WARC archives of pages, with revisit records for repeated payloads, and a globally ordered capture index.

`write` archives one record per page, each a gzip member of its own, in files of about FILE_BYTES. Of records with equal
payloads of at least `least_bytes` bytes, the one with the smallest page_id is a response and the others are revisits of
it. Files are written by Spark's own committer, so that a lost executor leaves no half file; each ends with an empty
member. `read` parses files back, record by record, checks every digest, and gives each file's captures as a run sorted
by url key and time, in packs, with the file and offset at which `fetch` finds the record.
`merge` deals the packs out by key range to scratch files of the tasks, and merges the runs of a range with a loser tree
that holds one pack of each; more than FAN_IN runs are merged in turns. No range is sorted again or held whole, and
ranges in order are the index in order: by url key, time, page_id (null first), digest and type.

Pages have no time of their own: a capture is dated one microsecond after FIRST_CAPTURE for each page_id (null: none).
Ids beyond the years 100 to 9999 get the first or last moment; their order is then by id.

Defined results: a null html is an empty payload, a null url an empty one; records with a null page_id are responses and
nothing refers to them; rows that repeat the smallest page_id of a payload are responses, too. No rows give no rows;
other columns are left out. Line breaks in urls are percent-encoded in the archive. A record is held whole by a task.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import tempfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_BYTES = 100
#: Compressed bytes at which a file ends, and zlib's level.
FILE_BYTES, LEVEL = 16 << 20, 4
FIRST_CAPTURE = "2024-01-01 00:00:00"
_FIRST_ID, _LAST_ID = -60_000_000_000_000_000, 250_000_000_000_000_000
#: Keys from which the bounds of key ranges are taken, for each range.
KEYS_PER_RANGE = 32
#: Captures of a pack, and runs merged at a time.
PACK, FAN_IN = 1024, 64
#: A gzip member of no bytes, which ends a file.
_END = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "urlkey": "string", "captured": "string", "file": "string", "offset": "long"}


def url_key(url: Column) -> Column:
    """The host's labels in reverse, then path and query: com,example,www)/a?b. Urls without :// stay as they are."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    tail = F.regexp_replace(rest, r"^[^/?]*", "")
    return F.when(F.instr(url, "://") > 0, F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail)))).otherwise(url)


def _selected(pages: DataFrame) -> DataFrame:
    """page_id, url as archived, its key, and time, with the html."""
    rows = common.only(pages, page_id="long", url="string", html="string")
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    after = F.greatest(F.least(F.coalesce("page_id", F.lit(0)), F.lit(_LAST_ID)), F.lit(_FIRST_ID)).cast("decimal(24,0)")
    at = (F.lit(FIRST_CAPTURE).cast("timestamp_ntz") + F.make_dt_interval(secs=(after / 1_000_000).cast("decimal(18,6)"))).cast("string")
    captured = F.concat(F.translate(F.substring(at, 1, 19), " ", "T"), F.lit("."), F.rpad(F.substring(at, 21, 6), 6, "0"), F.lit("Z"))
    rows = rows.select("page_id", url.alias("url"), "html", captured.alias("captured"))
    return rows.select("*", url_key(F.col("url")).alias("urlkey"))


def captures(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages with payload, digest, time and, for revisits, the page_id of the response."""
    rows = _selected(pages).withColumn("payload", F.coalesce("html", F.lit(""))).drop("html")
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest"))
    own = rows.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = own.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("last > refers_to").drop("last")
    again = own.join(first, "payload_digest").filter("page_id > refers_to").select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), "refers_to").distinct()
    # Only ids travel to find the revisits; payloads are dealt by page_id and digest, which no hot payload or host can skew.
    return rows.join(again, (F.col("page_id") == F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest")), "left").drop("again_id", "again_digest")


def _member(page_id: int | None, url: str, captured: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    kind = "response" if refers_to is None else f"revisit\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: {name(refers_to)}"
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name(page_id)}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {captured}\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return engine.compress(head.encode() + block + b"\r\n\r\n") + engine.flush()


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Archives the pages as WARC files under the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        full = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "captured", "payload", "payload_digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, captured, payload, digest, refers_to = (c[i] for c in columns)
                held.append(_member(page_id.as_py(), url.as_py(), captured.as_py(), payload.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py()))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield full()
                    held, size = [], 0
        if held:
            yield full()

    files = captures(pages, least_bytes).mapInArrow(run, "content binary")
    # A row is a file: its bytes, then the line separator, which is the empty member.
    files.select(F.col("content").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", _END.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def _record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
    fields = {k.lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields.get("content-length", -1))
    if not mark or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return fields, rest[:size]


def records(archive: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record of a WARC file."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        engine, parts, begin, step = zlib.decompressobj(31), [], at, 1 << 13
        try:
            while not engine.eof and at < len(view):
                piece = view[at : at + step]
                parts.append(engine.decompress(piece))
                at, step = at + len(piece) - len(engine.unused_data), min(2 * step, 1 << 20)
        except zlib.error as e:
            raise ValueError(f"no gzip member at {begin}: {e}") from e
        if not engine.eof:
            raise ValueError("a WARC file ends within a record")
        if raw := b"".join(parts):
            yield begin, *_record(raw)


def fetch(archive: bytes, offset: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record at the offset."""
    return next(records(archive[offset:]))[1:]


def _capture(fields: dict[str, str], block: bytes, file: str, offset: int) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't match its digest")
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    return number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to")), python_url_key(fields["warc-target-uri"]), fields["warc-date"], file, offset


def python_url_key(url: str) -> str:
    """url_key of one url."""
    _, found, rest = url.partition("://")
    if not found:
        return url
    rest = rest.partition("#")[0]
    cut = next((i for i, x in enumerate(rest) if x in "/?"), len(rest))
    tail = rest[cut:]
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (tail if tail.startswith("/") else "/" + tail)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner moves up; a step replays one path."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None if x is not None and y is None else x is not None and (x, a) < (y, b)

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            self._replay(w)


def _key(row: tuple | list) -> tuple:
    """Url key, time, page_id (null first); digest and type part what is equal till there."""
    return row[5], row[6], row[0] is not None, row[0] or 0, row[2], row[3]


def _bounds(pages: DataFrame, ranges: int) -> list[tuple]:
    """Keys that part the captures into about equal ranges, from about KEYS_PER_RANGE for each, drawn by a hash."""
    rows = _selected(pages).select("page_id", "urlkey", "captured")
    share = min(1.0, KEYS_PER_RANGE * ranges / max(1, rows.count()))
    sample = rows.filter(F.shiftrightunsigned(F.xxhash64("page_id", "urlkey"), 33) < int(share * (1 << 31))).collect()
    keys = sorted((r["urlkey"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in sample)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _packed(rows: list) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(json.dumps(rows, separators=(",", ":")).encode())


def _unpacked(pack: bytes) -> list[list]:
    return json.loads(zstandard.ZstdDecompressor().decompress(pack))


def read(spark: SparkSession, path: str, bounds: list[tuple]) -> DataFrame:
    """Rows (range, file, chunk, n, pack): for each file and key range, the file's captures in that range in order, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column("path")[i].as_py().rpartition("/")[2]
                found = [_capture(fields, block, file, offset) for offset, fields, block in records(batch.column("content")[i].as_buffer())]
                found.sort(key=_key)
                cuts = [0, *(bisect.bisect_left(found, b, key=lambda x: _key(x)[:4]) for b in bounds), len(found)]
                rows = [(r, file, k, len(x), _packed(x)) for r, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) for k, j in enumerate(range(a, z, PACK)) if (x := found[j : min(j + PACK, z)])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["range", "file", "chunk", "n", "pack"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "range int, file string, chunk int, n long, pack binary")


class _Scratch:
    """Runs of packs on a scratch file of the task."""

    def __init__(self):
        self._file = tempfile.TemporaryFile()

    def put(self, pack: bytes) -> tuple[int, int]:
        at = self._file.seek(0, 2)
        self._file.write(pack)
        return at, len(pack)

    def rows(self, places: list[tuple[int, int]]) -> Iterator[list]:
        for at, size in places:
            self._file.seek(at)
            yield from _unpacked(self._file.read(size))

    def merged(self, runs: list[list[tuple[int, int]]]) -> Iterator[list]:
        """All rows of the runs in order."""
        while len(runs) > FAN_IN:
            places, held = [], []
            for row in LoserTree([self.rows(r) for r in runs[:FAN_IN]], _key):
                held.append(row)
                if len(held) == PACK:
                    places.append(self.put(_packed(held)))
                    held = []
            runs = [*runs[FAN_IN:], [*places, self.put(_packed(held))]]
        return iter(LoserTree([self.rows(r) for r in runs], _key))


def merge(runs: DataFrame, ranges: int) -> DataFrame:
    """Captures with their position in the index."""
    # One row for each range, of which there are as many as partitions.
    sizes = {r["range"]: r["n"] for r in runs.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    start, total = {}, 0
    for where in sorted(sizes):
        start[where], total = total, total + sizes[where]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch, of = _Scratch(), {}
        for b in batches:
            for where, file, chunk, pack in zip(*(b.column(c).to_pylist() for c in ("range", "file", "chunk", "pack")), strict=True):
                of.setdefault(where, {}).setdefault(file, []).append((chunk, scratch.put(pack)))
        for where, files in sorted(of.items()):
            out = []
            for i, row in enumerate(scratch.merged([[place for _, place in sorted(x)] for _, x in sorted(files.items())]), start[where]):
                out.append((*row, i))
                if len(out) == PACK:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return runs.select("range", "file", "chunk", "pack").repartitionById(ranges, F.col("range")).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _FIELDS.items()) + ", position long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*(pa.int64() if t == "long" else pa.string() for t in _FIELDS.values()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*_FIELDS, "position"])


def archive_and_index(pages: DataFrame, least_bytes: int = LEAST_BYTES, path: str | None = None) -> DataFrame:
    """Archives the pages, reads the archives back and merges their captures. Without a path of one's own the archives are removed once read."""
    spark, ranges = pages.sparkSession, common.partitions(pages)
    where = path or common.new_path(spark, "warc")
    write(pages, where, least_bytes)
    runs = common.cut(read(spark, where, _bounds(pages, ranges)))
    if path is None:
        common.remove(spark, where)
    return merge(runs, ranges)
