"""Near duplicates of word-shingle multisets: BagMinHash signatures, bands, and exact verification.

Signature. Every shingle owns Poisson processes over weight and time. Weights (its occurrences in a document) are
discretised to whole numbers and grouped in dyadic ranges [0,1), [1,2), [2,4), [4,8) ...; a range has one process whose
rate is its width, and each of its points falls on a place in the range (so that the process splits, level by level,
into those of its halves) and on one of the registers. A document takes the points below its weight; a register keeps
the earliest. Two documents agree in a register with probability equal to their weighted Jaccard similarity, exactly.
Points are drawn only up to a time by which all registers are very likely filled; documents with an empty one go on.

Candidates. Documents that agree in all registers of a band share its bucket; exact copies are one node. Every pair of
nodes that shares a bucket is decided, whatever the bucket's size. In each bucket members are first compared with one
leader, not with each other. Where classes still differ in a bucket of three or more, its nodes are dealt out in blocks:
a task gets two blocks and compares all their nodes at once, by a product of matrices, and returns classes, not pairs.
Blocks whose nodes are in the bucket's largest class already are not compared with each other, and of buckets with the
same nodes one is enough. Every comparison is of the multisets themselves, so the classes are those of comparing all
candidates. Linked nodes form classes (connected components by large and small stars).

Defined results: a document without words is alone in its class, also if its text is null. One of fewer than `SHINGLE`
words has one shingle, all its words. Rows with equal texts are in one class, whatever their ids. The class id is the
least doc_id of its documents (null if none has one). No rows give no rows; other columns are left out
(`deduplicate` keeps those of documents).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .superkmer_dedup import _hashed, _joined, _pack

SHINGLE, SIMILARITY = 5, 0.8
#: Two documents at similarity 0.8 share a band with probability 0.99993, at 0.85 with 0.999998, at 0.3 with 0.06.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Registers are all filled by the first horizon but in e**-PATIENCE of documents.
PATIENCE = 6.0
#: Nodes of a block.
BLOCK = 256
#: Shingles of a matrix at a time.
_COLUMNS = 4096
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each shingle of flat text, and starts, ends and rows of the words."""
    s, e, row = common.words(data, at)
    h = common.word_hashes(data, s, e)
    whole = np.flatnonzero(row[SHINGLE - 1 :] == row[: max(0, len(row) - SHINGLE + 1)]) if len(row) >= SHINGLE else np.zeros(0, np.int64)
    found, rows = (_joined(h, SHINGLE)[whole], row[whole]) if len(whole) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    counts = np.bincount(row, minlength=len(at) - 1) if len(row) else np.zeros(len(at) - 1, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        edge = np.searchsorted(row, short)
        extra = np.array([_joined(h[a : a + n], n)[0] + np.uint64(n) for a, n in zip(edge.tolist(), counts[short].tolist(), strict=True)], np.uint64)
        found, rows = np.concatenate([found, common.mix(extra)]), np.concatenate([rows, short])
    return found, rows, s, e, row


def multiset(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of each different shingle of each row, by row and hash."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    h, r = hashes[order], rows[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
    return r[new], h[new], np.diff(np.append(new, len(h)))


def signatures(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, count: int, registers: int = REGISTERS) -> np.ndarray:
    """(count, registers) signatures (64 bits a register) of weighted sets; rows without elements are all ones."""
    out = np.full(count * registers, np.inf)
    total = np.bincount(rows, weights, count)
    waiting = total > 0
    horizon = np.where(waiting, (np.log(registers) + PATIENCE) / np.maximum(total, 1), 0.0)
    while waiting.any():
        live = waiting[rows]
        r, h, w = rows[live], hashes[live], weights[live]
        low, width, level = 0, 1, 0
        while len(r):  # one dyadic range of weights after the other
            seed = common.mix(h + np.uint64((level + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            _points(out, r, seed, w, low, width, horizon, registers)
            low, width, level = low + width, width if not level else 2 * width, level + 1
            over = w > low
            r, h, w = r[over], h[over], w[over]
        waiting &= np.isinf(out.reshape(count, registers)).any(axis=1)
        horizon *= 4
        out[np.repeat(waiting, registers)] = np.inf
    return common.mix(out.view(np.uint64)).reshape(count, registers)


def _points(out: np.ndarray, r: np.ndarray, seed: np.ndarray, w: np.ndarray, low: int, width: int, horizon: np.ndarray, registers: int) -> None:
    """Lowers the registers to the points, up to the horizon, of a range of weights of the elements."""
    t, k = np.zeros(len(r)), 0
    while len(r):
        with np.errstate(over="ignore"):
            u = common.mix(seed + np.uint64((2 * k + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * width)
        near = t < horizon[r]
        if not near.all():
            r, seed, w, t, u = r[near], seed[near], w[near], t[near], u[near]
            if not len(r):
                return
        v = common.mix(u ^ _GOLD)
        register = (v >> np.uint64(40)) % np.uint64(registers)
        place = low + width * ((v & np.uint64(0xFFFFFFFFFF)).astype(np.float64) * 2.0**-40)
        inside = place < w
        np.minimum.at(out, r[inside] * registers + register[inside].astype(np.int64), t[inside])
        k += 1


def band_hashes(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(rows, bands) hashes of the bands of signatures."""
    parts = found.reshape(len(found), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        out = common.mix(out * _GOLD + parts[:, :, j])
    return out


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, given as different hashes in order and their numbers."""
    _, a, b = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(x[1][a], y[1][b]).sum())
    return both / max(1, int(x[1].sum()) + int(y[1].sum()) - both)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, hash of the text, node (128-bit hash of the words), bands and compressed words; a node's later rows in a block leave those out."""
    engine = zstandard.ZstdCompressor(level=3)
    for batch, data, at in common.blocks(batches):
        found, rows, s, e, row = shingles(data, at)
        edges = np.searchsorted(row, np.arange(len(at)))
        packed, place = _pack(data, s, e)
        raw = packed.tobytes()
        words = [raw[place[a] : place[b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        nodes = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in words]
        seen: dict[bytes, int] = {}
        fresh = np.array([x is not None and seen.setdefault(x, i) == i for i, x in enumerate(nodes)], bool)
        keep = fresh[rows]
        r, h, w = multiset(found[keep], rows[keep])
        number = np.cumsum(fresh) - 1
        bands = band_hashes(signatures(number[r], h, w, int(fresh.sum()))).view(np.int64) if fresh.any() else np.zeros((0, BANDS), np.int64)
        own = iter(bands.tolist())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "hash": batch.column("hash"), "node": pa.array(nodes, pa.binary()), "bands": pa.array([next(own) if f else None for f in fresh], pa.list_(pa.int64())),
            "words": pa.array([engine.compress(x) if f else None for f, x in zip(fresh, words, strict=True)], pa.binary()),
        })


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose words_a and words_b are similar enough."""
    engine = zstandard.ZstdDecompressor()
    kept: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def of(node: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray]:
        if node not in kept:
            if len(kept) > 64:
                kept.clear()
            data = np.frombuffer(engine.decompress(words), np.uint8)
            found, rows, *_ = shingles(data, np.array([0, len(data)]))
            kept[node] = multiset(found, rows)[1:]
        return kept[node]

    for batch in batches:
        a, b, x, y = (batch.column(c) for c in ("a", "b", "words_a", "words_b"))
        linked = []
        for i in range(batch.num_rows):
            p, q = of(a[i].as_py(), x[i].as_py()), of(b[i].as_py(), y[i].as_py())
            n, m = int(p[1].sum()), int(q[1].sum())
            linked.append(min(n, m) >= SIMILARITY * max(n, m) and similarity(p, q) >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(linked)), b.filter(pa.array(linked))], names=["a", "b"])


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser one, or edges to greater ones only: then the lesser ones are the labels."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) of the linked nodes: the label is the least node of the connected component."""
    edges = common.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = common.cut(small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _overlaps(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Shared shingles, with multiplicity, of all pairs of multisets: those that two or more have, as a matrix times itself."""
    features, rows = [], []
    for i, (h, n) in enumerate(sets):
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        features.append(np.where(nth > 0, common.mix(np.repeat(h, n) + nth.astype(np.uint64) * _GOLD), np.repeat(h, n)))
        rows.append(np.full(len(nth), i))
    value, row = np.concatenate(features), np.concatenate(rows)
    _, which, counts = np.unique(value, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    keep = counts[which] > 1
    column, row = number[which[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    edges = np.searchsorted(column, np.arange(0, int(number[-1]) + 1 + _COLUMNS, _COLUMNS)) if len(column) else []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        dense = np.zeros((len(sets), _COLUMNS), np.float32)
        dense[row[a:b], column[a:b] - k * _COLUMNS] = 1
        out += dense @ dense.T
    return out


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the nodes which are connected within a tile of two blocks; rows come sorted by tile."""
    engine = zstandard.ZstdDecompressor()

    def linked(nodes: list[bytes], words: list[bytes]) -> Iterator[pa.RecordBatch]:
        sets = []
        for w in words:
            data = np.frombuffer(engine.decompress(w), np.uint8)
            found, rows, *_ = shingles(data, np.array([0, len(data)]))
            sets.append(multiset(found, rows)[1:])
        size = np.array([int(n.sum()) for _, n in sets], np.float64)
        both = _overlaps(sets)
        near = both >= SIMILARITY * (size[:, None] + size[None, :] - both)
        free, a, b = np.ones(len(nodes), bool), [], []
        for i in range(len(nodes)):
            if not free[i]:
                continue
            free[i], front = False, np.array([i])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & free)
                free[front] = False
                a += [nodes[i]] * len(front)
                b += [nodes[j] for j in front]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    tile, nodes, words = None, [], []
    for batch in batches:
        for *where, node, text in zip(*(batch.column(c).to_pylist() for c in ("g", "p", "q", "node", "words")), strict=True):
            if where != tile:
                if len(nodes) > 1:
                    yield from linked(nodes, words)
                tile, nodes, words = where, [], []
            nodes.append(node)
            words.append(text)
    if len(nodes) > 1:
        yield from linked(nodes, words)


def _tiles(members: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """Rows (g, p, q, node): nodes of buckets with several classes, dealt to pairs of blocks; None if there are none."""
    rows = _labelled(members.select("band", "node"), labels)
    same = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"h{i}") for i in (0, 1)]
    mixed = rows.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"), *same).filter("x <> y and n > 2")
    once = mixed.groupBy("n", "h0", "h1").agg(F.min("band").alias("band")).select("band")
    rows = common.cut(rows.join(once, "band").select(F.col("band").alias("g"), "node", F.col("label").alias("own")))
    if rows.isEmpty():
        return None
    counts = rows.groupBy("g", "own").agg(F.count("*").alias("n"))
    main = counts.groupBy("g").agg(F.max_by("own", F.struct("n", "own")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("all"))
    rows = rows.join(main, "g")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    out, inside = F.greatest(blocks(F.col("all") - F.col("inside")), F.lit(1)), blocks(F.col("inside"))
    rows = rows.withColumns({"n_out": out, "n_in": inside, "is_main": F.col("own") == F.col("main")})
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("n_in")).otherwise(F.col("n_out"))).cast("int")
    rows = rows.withColumn("mine", F.when(F.col("is_main"), F.col("n_out") + mine).otherwise(mine))
    # A block outside the main class meets all blocks; one inside meets those outside.
    others = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("n_out") - 1).otherwise(F.col("n_out") + F.col("n_in") - 1))
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("g", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "node")


def near_classes(sketches: DataFrame) -> DataFrame | None:
    """Rows (node, label) of nodes linked to others; None without any. sketches: node, bands, words."""
    rows = sketches.filter("bands is not null").select(F.explode("bands").alias("band"), "node")
    shared = rows.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader <> last").drop("last")
    members = common.cut(rows.join(shared, "band").select("band", "leader", "node").distinct())
    if members.isEmpty():
        return None
    words = common.cut(sketches.filter("words is not null").join(members.select("node").distinct(), "node").groupBy("node").agg(F.first("words").alias("words")))
    pairs = members.filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    both = pairs.join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b").join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a")
    links = common.cut(both.mapInArrow(_verify, "a binary, b binary"))
    labels = None if links.isEmpty() else components(links)
    tiles = _tiles(members, labels)
    if tiles is not None:
        dealt = tiles.join(words, "node").repartition(common.partitions(sketches), "g", "p", "q").sortWithinPartitions("g", "p", "q", "node")
        more = common.cut(dealt.mapInArrow(_compare_blocks, "a binary, b binary"))
        if not more.isEmpty():
            labels = components(more if labels is None else more.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    return labels


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text and class_id of every document, with its node."""
    spark, path = docs.sparkSession, common.new_path(docs.sparkSession, "sketches")
    _hashed(common.documents(docs)).mapInArrow(_sketch, "doc_id long, hash int, node binary, bands array<long>, words binary").write.parquet(path)
    sketches = spark.read.parquet(path)
    labels = near_classes(sketches)
    own = sketches.select("doc_id", "hash", "node")
    labelled = own.withColumn("label", F.col("node")) if labels is None else own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = labelled.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    with_words = labelled.filter("label is not null").join(heads, "label").select("doc_id", "hash", "class_id", "node")
    found = common.cut(with_words.union(labelled.filter("label is null").select("doc_id", "hash", F.col("doc_id").alias("class_id"), "node")))
    common.remove(spark, path)
    return found


def deduplicate(docs: DataFrame) -> DataFrame:
    """Documents, of each class those with the least doc_id. Rows that repeat it all stay; rows without doc_id go if their class has one with it, else they stay."""
    docs = common.only(docs, **common.DOCUMENT_COLUMNS)
    gone = classes(docs).filter("class_id is not null and not (doc_id <=> class_id)").select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash")).distinct()
    rows = _hashed(docs)
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti").select(*common.DOCUMENT_COLUMNS)
