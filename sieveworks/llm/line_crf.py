"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features, and those of the lines before and after it, give the emission scores; a matrix
gives the transitions. Forward-backward marginals, weighted by the lines' lengths, aggregate into the share of a
document that is good, and a logistic curve turns that share into the probability that the document's label is 1.

Labels are of documents, lines have none: training is by expectation-maximisation. Lines of documents labelled 1 are
good; those of documents labelled 0 start as bad and then get the marginals of the model, but for the least good line,
which stays bad. The sample is bounded:
`SAMPLE` labelled documents of each label, chosen by a hash of doc_id, whatever their length, and of each its first
`SAMPLE_LINES` lines; documents whose crc32(doc_id as text) mod 4 is 2 are never among them. Scores are of all lines. Ids, languages and sources are no features.

Defined results: a null or empty text, or one of white space only, has no lines that count and gets the share of label 1
in all training labels. Rows that repeat get equal scores, a null doc_id is not held out, lines of any length count whole.
No rows give no rows; other columns are left out (`keep_good` keeps those of documents). Without labels of both kinds
every document scores that share (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, SAMPLE_LINES = 1500, 2000
THRESHOLD = 0.7
ROUNDS, STEPS, RATE, RIDGE = 3, 60, 0.15, 1e-3
FEATURES = ("length", "words", "mean_word", "upper", "digits", "exclaimed", "symbols", "bars", "same_as_last", "line_again", "ends_sentence", "begins_upper")


def _marks(codes: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(x) for x in codes]] = True
    return out


_UPPER, _DIGIT, _BANG, _BAR = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marks("0123456789"), _marks("!"), _marks("|")
_SYMBOL, _END = _marks("*$%&#@^~<>{}[]=+\\_`"), _marks(".!?:;\"')")


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, length in bytes and features of each line that has a word, of flat text."""
    s, e, row = common.words(data, at)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(FEATURES)))
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line_of = breaks[s]
    new = np.concatenate([[True], (line_of[1:] != line_of[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(s)) - 1
    lines, count = np.cumsum(new) - 1, last - begin + 1
    a, b = s[begin], e[last]
    size = b - a

    def share(marks: np.ndarray, by: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks)])
        return (sums[b] - sums[a]) / by

    accented = np.zeros(len(data), bool)  # capital letters of Latin-1 in UTF-8
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    h = common.word_hashes(data, s, e)
    same = np.zeros(len(s), bool)
    same[1:] = (h[1:] == h[:-1]) & ~new[1:]
    place = np.arange(len(s)) - begin[lines]
    whole = np.add.reduceat(common.mix(h + place.astype(np.uint64)), begin) + count.astype(np.uint64)
    key = common.mix(whole ^ common.mix(row[begin].astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(begin), bool)
    again[first] = False
    letters = np.add.reduceat(e - s, begin)
    columns = (
        np.log1p(size) / 6, np.log1p(count) / 4, np.minimum(letters / count, 30) / 10, 3 * share(_UPPER[data] | accented, size), 5 * share(_DIGIT[data], size),
        np.minimum(share(_BANG[data], count), 2), np.minimum(share(_SYMBOL[data], count), 2), np.minimum(share(_BAR[data], count), 2), 3 * np.add.reduceat(same, begin) / count,
        again, _END[data[b - 1]], _UPPER[data[a]] | ((data[a] == 0xC3) & (np.append(data, 0)[a + 1] <= 0x9E)),
    )
    return row[begin], size, np.column_stack([np.asarray(c, np.float64) for c in columns])


def with_neighbours(rows: np.ndarray, features: np.ndarray) -> np.ndarray:
    """A constant, a line's features, and those of the lines before and after it in its document, with marks where there is none."""
    n, d = features.shape
    before, after = np.zeros((n, d + 1)), np.zeros((n, d + 1))
    before[:, d] = after[:, d] = 1
    if n > 1:
        near = rows[1:] == rows[:-1]
        before[1:][near] = np.column_stack([features[:-1][near], np.zeros(near.sum())])
        after[:-1][near] = np.column_stack([features[1:][near], np.zeros(near.sum())])
    return np.column_stack([np.ones(n), features, before, after])


@dataclass
class Chains:
    """Lines of documents laid out step by step: at[t] are the t-th lines of the documents that have one, longest first."""

    at: list[np.ndarray]

    @classmethod
    def of(cls, rows: np.ndarray) -> Chains:
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(rows)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        return cls([begin[: np.searchsorted(-size, -t, side="left")] + t for t in range(int(size[0]) if len(size) else 0)])


def marginals(emission: np.ndarray, transition: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: probability of each state (bad, good) of each line, and expected transitions."""
    potential = np.exp(emission - emission.max(axis=1, keepdims=True))
    move = np.exp(transition - transition.max())
    forward, backward = np.zeros_like(potential), np.ones_like(potential)
    for t, at in enumerate(chains.at):
        x = potential[at] if not t else (forward[chains.at[t - 1][: len(at)]] @ move) * potential[at]
        forward[at] = x / x.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(len(chains.at) - 1, 0, -1):
        at = chains.at[t]
        up = chains.at[t - 1][: len(at)]
        right = potential[at] * backward[at]
        joint = forward[up][:, :, None] * move[None] * right[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        expected += joint.sum(axis=0)
        x = right @ move.T
        backward[up] = x / x.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), expected


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 0.001, 0.999)
    return np.log(share / (1 - share))


@dataclass
class Model:
    """Emission weights of the good state (the bad one's are zero), transition scores, and the curve from share to score."""

    weights: np.ndarray
    transition: np.ndarray
    slope: float
    offset: float
    prior: float

    def good(self, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Marginal probability of each line to be good."""
        emission = np.zeros((len(rows), 2))
        emission[:, 1] = with_neighbours(rows, features) @ self.weights
        return marginals(emission, self.transition, Chains.of(rows))[0][:, 1]

    def shares(self, rows: np.ndarray, sizes: np.ndarray, features: np.ndarray, count: int) -> np.ndarray:
        """Length-weighted share of each document that is good; nan without lines."""
        total = np.bincount(rows, sizes, count)
        with np.errstate(invalid="ignore"):
            return np.bincount(rows, sizes * self.good(rows, features), count) / total if len(rows) else np.full(count, np.nan)

    def scores(self, shares: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(shares), self.prior, 1 / (1 + np.exp(-(self.slope * _logit(np.nan_to_num(shares)) + self.offset))))


def _adam(value: np.ndarray, state: list, gradient: np.ndarray, step: int) -> np.ndarray:
    state[0] = 0.9 * state[0] + 0.1 * gradient
    state[1] = 0.99 * state[1] + 0.01 * gradient**2
    return value + RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)


def fit(rows: np.ndarray, sizes: np.ndarray, features: np.ndarray, labels: np.ndarray, prior: float) -> Model:
    """Maximum conditional likelihood within expectation-maximisation over the lines of documents labelled 0."""
    x, chains = with_neighbours(rows, features), Chains.of(rows)
    wanted = labels[rows].astype(np.float64)
    moves = rows[1:] == rows[:-1]
    model = Model(np.zeros(x.shape[1]), np.zeros((2, 2)), 1.0, 0.0, prior)
    weight = 1.0 / np.sqrt(np.bincount(rows, minlength=len(labels))[rows])  # long documents do not drown the others
    weight *= len(rows) / weight.sum()
    for turn in range(ROUNDS):
        pairs = np.column_stack([1 - wanted, wanted])
        seen = (pairs[:-1][moves][:, :, None] * pairs[1:][moves][:, None, :]).sum(axis=0) if moves.any() else np.zeros((2, 2))
        first, second = [0.0, 0.0], [0.0, 0.0]
        for step in range(1, STEPS + 1):
            emission = np.zeros((len(rows), 2))
            emission[:, 1] = x @ model.weights
            found, expected = marginals(emission, model.transition, chains)
            model.weights = _adam(model.weights, first, ((wanted - found[:, 1]) * weight) @ x / len(rows) - RIDGE * model.weights, step)
            model.transition = _adam(model.transition, second, (seen - expected) / len(rows) - RIDGE * model.transition, step)
        bad, good = labels[rows] == 0, model.good(rows, features)
        least = np.full(len(labels), np.inf)
        np.minimum.at(least, rows, good)
        wanted[bad] = np.where(good <= least[rows], 0.0, np.minimum(good, 0.95))[bad]
    share = model.shares(rows, sizes, features, len(labels))
    known = ~np.isnan(share)
    z, y = _logit(share[known]), labels[known]
    each = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    curve, state = np.zeros(2), [0.0, 0.0]
    for step in range(1, 6 * STEPS + 1):
        p = 1 / (1 + np.exp(-(curve[0] * z + curve[1])))
        curve = _adam(curve, state, np.array([(each * (y - p) * z).sum(), (each * (y - p)).sum()]) - 1e-4 * curve, step)
    model.slope, model.offset = float(curve[0]), float(curve[1])
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from a bounded sample of labelled documents; see the module's text."""
    own = common.only(labels, doc_id="long", quality="int").filter("doc_id is not null and quality in (0, 1)").filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = own.agg(F.avg("quality")).first()[0]
    prior = 0.5 if seen is None else float(seen)
    chosen = {r["doc_id"]: r["quality"] for q in (0, 1) for r in own.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    flat_model = Model(np.zeros(1 + 3 * len(FEATURES) + 2), np.zeros((2, 2)), 0.0, float(np.log((prior + 1e-6) / (1 - prior + 1e-6))), prior)
    if len(set(chosen.values())) < 2:
        return flat_model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in common.blocks(batches):
            rows, sizes, features = line_features(data, at)
            edges = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            pack = [np.column_stack([sizes[a:b], features[a:b]]).astype("<f4").tobytes() for a, b in zip(edges[:-1], np.minimum(edges[1:], edges[:-1] + SAMPLE_LINES), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lines": pa.array(pack, pa.binary())})

    texts = common.documents(docs).filter(F.col("doc_id").isin(list(chosen)))
    found = texts.mapInArrow(run, "doc_id long, lines binary").dropDuplicates(["doc_id"]).collect()
    found = sorted((r["doc_id"], bytes(r["lines"])) for r in found if len(r["lines"]))
    parts = [np.frombuffer(x, "<f4").reshape(-1, 1 + len(FEATURES)) for _, x in found]
    y = np.array([chosen[d] for d, _ in found])
    if len(set(y.tolist())) < 2:
        return flat_model
    lines = np.concatenate(parts).astype(np.float64)
    return fit(np.repeat(np.arange(len(parts)), [len(p) for p in parts]), lines[:, 0], lines[:, 1:], y, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, lines and the expected number of bad ones of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in common.blocks(batches):
            rows, sizes, features = line_features(data, at)
            count = batch.num_rows
            good = model.good(rows, features) if len(rows) else np.zeros(0)
            with np.errstate(invalid="ignore"):
                shares = np.bincount(rows, sizes * good, count) / np.bincount(rows, sizes, count)
            found = model.scores(shares)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": pa.array(found, pa.float64()), "predicted": pa.array((found >= THRESHOLD).astype(np.int32), pa.int32()),
                "n_lines": pa.array(np.bincount(rows, minlength=count), pa.int64()), "bad_lines": pa.array(np.bincount(rows, 1 - good, count), pa.float64()),
            })

    done = common.documents(docs).mapInArrow(run, "doc_id long, score double, predicted int, n_lines long, bad_lines double")
    return done.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_lines", "bad_lines")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    docs = common.only(docs, **common.DOCUMENT_COLUMNS)
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in common.blocks(batches):
            rows, sizes, features = line_features(data, at)
            yield batch.filter(pa.array(model.scores(model.shares(rows, sizes, features, batch.num_rows)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
