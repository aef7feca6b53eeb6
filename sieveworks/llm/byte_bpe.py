"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, and decoding.

Texts are split by the vocabulary's pattern, in the JVM. A word that is a token is that token; any other one starts as
the ids of its bytes, and the pair of neighbouring pieces that makes the token of least rank (the leftmost one on ties)
is merged until no pair makes a token. Decoding puts the pieces of ids end to end.

There are two forms with equal results. `encode_native` is higher-order functions alone: distinct words of all documents
are folded once, over a literal rank map, and joined back. It shuffles every word of every text and interprets each
step, so it suits small inputs. `encode`, which the query runs, folds the distinct words of a block of text at once, a
merge of every word a step, in numpy: no shuffle, memory bounded by the block.

Defined results: a null or empty text has no tokens and decodes to no bytes. Rows that repeat get equal results, a null
doc_id stays null, no rows give no rows, and other columns are left out. Words of any length are encoded whole; long
ones by a queue of merges, so that time stays in proportion to their length (but for a logarithm).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Buckets of the literal map (a power of two); they hold a few keys each.
PAIR_BUCKETS = 1 << 15
#: Bytes from which a word is folded on its own.
LONG_WORD = 256
_NONE, _EDGE, _REST = 2**31 - 1, 0xFFFF, 2**30


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file (base64 token, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    """The pattern with Unicode white space, as the vocabulary means it."""
    return "(?U)" + pattern


def words_of(text: Column, pattern: str) -> Column:
    """The texts that the pattern matches, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), 0)


def _pairs(ranks: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """Pairs of tokens, and the token that they make."""
    if len(ranks) >= _EDGE or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a rank file needs all single bytes and fewer than 65,535 tokens")
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                yield a, b, rank


# Blocks of distinct words


class Merges:
    """The rank map of one rank file in arrays; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = np.array(sorted((a << 16 | b, r) for a, b, r in _pairs(ranks)), np.int64)
        self.keys, self.values = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)
        self.own = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.of_bytes = self.made(np.repeat(self.own, 256), np.tile(self.own, 256))
        self.tokens = pa.array(list(ranks), pa.binary())
        self.token_ids = np.array(list(ranks.values()), np.int32)

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that two tokens make; a number above all ranks if they make none."""
        key = a.astype(np.int64) << 16 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE).astype(np.int32)

    def fold(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[at[i]:at[i+1]] (none empty) end to end, and their numbers: in each step every word merges its pair of least rank."""
        n, size = len(at) - 1, np.diff(at)
        word = np.repeat(np.arange(n), size)
        x, r = self.own[data], np.full(len(data), _NONE, np.int32)
        r[:-1] = self.of_bytes[data[:-1].astype(np.int64) << 8 | data[1:]]
        r[at[1:] - 1] = _NONE
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(x):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(r, start)
            live = least < _NONE
            if not live.all():
                over = np.repeat(~live, size)
                ended.append((word[over], x[over]))
                word, x, r, size, least = word[~over], x[~over], r[~over], size[live], least[live]
                if not len(x):
                    break
                start = np.cumsum(size) - size
            hits = np.flatnonzero(r == np.repeat(least, size))
            p = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]
            x[p] = least
            left, last = p > start, start + size - 1
            r[p[left] - 1] = self.made(x[p[left] - 1], least[left])
            right = p + 1 < last
            r[p] = _NONE
            r[p[right]] = self.made(least[right], x[p[right] + 2])
            keep = np.ones(len(x), bool)
            keep[p + 1] = False
            word, x, r, size = word[keep], x[keep], r[keep], size - 1
        word, x = (np.concatenate(c) for c in zip(*ended, strict=True)) if ended else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        return x[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)

    def fold_long(self, word: bytes) -> np.ndarray:
        """Ids of one word, by a queue of the pairs."""
        made = dict(zip(self.keys.tolist(), self.values.tolist(), strict=True))
        x = self.own[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(x) + 1)), list(range(-1, len(x) - 1))
        queue = [(made[k], i, x[i], x[i + 1]) for i in range(len(x) - 1) if (k := x[i] << 16 | x[i + 1]) in made]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if x[i] != a or j >= len(x) or x[j] != b:  # one of the two has merged since
                continue
            x[i], x[j], after[i] = rank, -1, after[j]
            if after[j] < len(x):
                before[after[j]] = i
                if (k := rank << 16 | x[after[j]]) in made:
                    heapq.heappush(queue, (made[k], i, rank, x[after[j]]))
            if before[i] >= 0 and (k := x[before[i]] << 16 | rank) in made:
                heapq.heappush(queue, (made[k], before[i], x[before[i]], rank))
        return np.array([i for i in x if i >= 0], np.int32)

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and their numbers."""
        words = words.cast(pa.binary())
        whole = pc.index_in(words, value_set=self.tokens)
        token = whole.fill_null(-1).to_numpy()
        size = pc.binary_length(words).to_numpy()
        numbers = (token >= 0).astype(np.int64)
        short, long = np.flatnonzero((token < 0) & (size < LONG_WORD) & (size > 0)), np.flatnonzero((token < 0) & (size >= LONG_WORD))
        data, at = common.flat(words.take(pa.array(short)))
        ids, numbers[short] = self.fold(data[at[0] : at[-1]], at - at[0])
        single = [self.fold_long(words[i].as_py()) for i in long.tolist()]
        numbers[long] = [len(x) for x in single]
        out = np.empty(int(numbers.sum()), np.int32)
        begin = np.cumsum(numbers) - numbers
        out[begin[token >= 0]] = self.token_ids[token[token >= 0]]
        out[common.run_index(begin[short], numbers[short])] = ids
        for i, x in zip(long.tolist(), single, strict=True):
            out[begin[i] : begin[i] + len(x)] = x
        return out, numbers


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and ids of every document."""
    merges: list[Merges] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not merges:
            merges.append(Merges(ranks))
        for batch in batches:
            lists = batch.column("words")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            words = lists.flatten().dictionary_encode()
            ids, numbers = merges[0].encoded(words.dictionary)
            which = words.indices.to_numpy()
            own, begin = numbers[which], np.cumsum(numbers) - numbers
            at = np.concatenate([[0], np.cumsum(own)])[ends]
            found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids[common.run_index(begin[which], own)], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "ids"])

    return common.documents(docs).select("doc_id", words_of(F.col("text"), pattern).alias("words")).mapInArrow(run, "doc_id long, ids array<int>")


def digests(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, the number of ids, and the sha256 of the ids and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        names, pieces = pa.array([str(i) for i in range(len(pieces))], pa.binary()), pa.array(pieces, pa.binary())

        def joined(lists: pa.ListArray, of: pa.Array, mark: bytes) -> list[str]:
            whole = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, of.take(lists.values)), mark)
            return [hashlib.sha256(x.as_buffer()).hexdigest() for x in whole]

        for batch in batches:
            lists = batch.column("ids")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.list_value_length(lists).cast(pa.int64()), pa.array(joined(lists, names, b" "), pa.string()), pa.array(joined(lists, pieces, b""), pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


# Higher-order functions


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _literal(value: list, kind: str) -> Column:
    """A literal made by constant folding, which is much faster than one made of literals."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _looked_up(keys: Column, values: Column, bucket: Column, key: Column) -> Column:
    """The key's value in its bucket; null if it isn't there."""
    return F.get(F.get(values, bucket), F.array_position(F.get(keys, bucket), key).cast("int") - 1)


class Vocabulary:
    """Literal maps for one rank file of at most 65,535 tokens with all single bytes among them; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        keys: list[list[int]] = [[] for _ in range(PAIR_BUCKETS)]
        values: list[list[int]] = [[] for _ in range(PAIR_BUCKETS)]
        for a, b, rank in _pairs(ranks):
            at = (a * 31 + b) & (PAIR_BUCKETS - 1)
            packed = (a << 16 | b) & 0xFFFFFFFF
            keys[at].append(packed - (1 << 32) if packed >= 1 << 31 else packed)
            values[at].append(rank)
        sums = [zlib.crc32(bytes([b])) for b in range(256)]
        self.modulus = next(m for m in range(256, 1 << 17) if len({x % m for x in sums}) == 256)
        own = [0] * self.modulus
        for b, x in enumerate(sums):
            own[x % self.modulus] = ranks[bytes([b])]
        #: Bound once by `let`, since each use of a literal of its own would be a copy.
        self.maps = F.struct(_literal(keys, "array<array<int>>").alias("keys"), _literal(values, "array<array<int>>").alias("values"), _literal(own, "array<int>").alias("bytes"))
        by_rank = {r: t for t, r in ranks.items()}
        self.pieces = F.split(F.lit(" ".join(by_rank.get(i, b"").hex() for i in range(max(by_rank) + 1))), " ")

    def pair(self, maps: Column, a: Column, b: Column) -> Column:
        """The rank of the token that two tokens make; a number above all ranks if they make none."""
        bucket = (a * 31 + b).bitwiseAND(PAIR_BUCKETS - 1)
        return F.coalesce(_looked_up(maps["keys"], maps["values"], bucket, F.shiftleft(a, 16).bitwiseOR(b)), F.lit(_NONE))

    def merged(self, maps: Column, word: Column) -> Column:
        """The ids of a word (binary, not empty), by the bound maps. Both ends are held by an edge, which makes no token with anything."""
        one, edge = F.lit(1), F.lit(_EDGE)

        def step(state: Column, _: Column) -> Column:
            """One merge of the neighbours with the least rank; nothing changes once no neighbours make a token."""
            x, r = state["x"], state["r"]

            def merge(rank: Column, at: Column) -> Column:  # x[at] and x[at + 1], counted from 1, become the token of this rank
                ids = F.concat(F.slice(x, one, at - 1), F.array(rank), F.slice(x, at + 2, F.lit(_REST)))
                near = F.array(self.pair(maps, F.get(x, at - 2), rank), self.pair(maps, rank, F.get(x, at + 1)))
                return F.struct(ids.alias("x"), F.concat(F.slice(r, one, at - 2), near, F.slice(r, at + 2, F.lit(_REST))).alias("r"))

            return let(F.array_min(r), lambda m: F.when(m < _NONE, let(F.array_position(r, m).cast("int"), lambda at: merge(m, at))).otherwise(state))

        def whole(w: Column, size: Column) -> Column:
            own = F.transform(F.sequence(one, size), lambda i: F.get(maps["bytes"], (F.crc32(F.substring(w, i, one)) % self.modulus).cast("int")))
            start = let(F.concat(F.array(edge), own, F.array(edge)), lambda x: F.struct(x.alias("x"), F.transform(F.sequence(F.lit(0), size), lambda i: self.pair(maps, F.get(x, i), F.get(x, i + 1))).alias("r")))
            return F.aggregate(F.sequence(one, size), start, step, lambda s: F.slice(s["x"], F.lit(2), F.size(s["x"]) - 2))

        return let(word, lambda w: whole(w, F.octet_length(w)))

    def decoded(self, ids: Column) -> Column:
        """The bytes of ids: their pieces end to end."""
        return let(self.pieces, lambda p: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")))


def encode_native(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """encode by higher-order functions alone: every distinct word is folded once."""
    vocabulary = Vocabulary(ranks)
    rows = common.documents(docs).withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = rows.dropDuplicates(["doc_id", "hash"]).select("doc_id", "hash", F.posexplode(words_of(F.col("text"), pattern)).alias("place", "word"))
    listed = _literal([{"t": t.hex(), "r": r} for t, r in ranks.items()], "array<struct<t:string,r:int>>")
    tokens = docs.sparkSession.range(1).select(F.inline(listed)).select(F.unhex("t").alias("token"), F.col("r").alias("rank"))
    folded = let(vocabulary.maps, lambda m: vocabulary.merged(m, F.col("word").cast("binary")))
    words = found.select("word").distinct().join(tokens, F.col("word").cast("binary") == F.col("token"), "left")
    words = words.select("word", F.when(F.col("rank").isNotNull(), F.array("rank")).otherwise(folded).alias("ids"))
    each = found.join(words, "word").groupBy("doc_id", "hash").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("parts"))
    each = each.select(F.col("doc_id").alias("key"), F.col("hash").alias("key_hash"), F.flatten("parts.ids").alias("ids"))
    joined = rows.join(each, F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("hash") == F.col("key_hash")), "left")
    return joined.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decoded_native(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and the decoded bytes, by higher-order functions alone."""
    return encoded.select("doc_id", Vocabulary(ranks).decoded(F.col("ids")).alias("decoded"))
