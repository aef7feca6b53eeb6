"""The pipeline against plain versions of its stages, and odd input to each stage."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sieveworks.llm import common, line_crf, packing, pii_surrogates
from test_judges import plain_attempts, plain_marginals
from test_sketches import WORD, plain_classes, plain_removal

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def corpus():
    """Clean documents, some with line noise, near copies, a passage that repeats, personal data, and odd rows."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage, rows, labels = sentence(40), [], []
    for i in range(60):
        good = i % 3 != 0
        lines = [sentence(rng.randint(8, 14)) for _ in range(rng.randint(2, 4))] if good else ["$$$ BUY!!! *** 9999 #### | | |"] * rng.randint(2, 4)
        text = "\n".join(lines)
        if good and i % 5 == 0:
            text += "\n" + passage
        if good and i % 4 == 0:
            text += f"\nMail {word()}@{word()}.org or call +1 (524) 555-{1000 + i}, Mr. {word().capitalize()}."
        rows.append((i, text))
        labels.append((i, int(good)))
        if good and i % 6 == 1:
            longer = "\n".join([text, *(sentence(30) for _ in range(4))])
            rows += [(1000 + i, longer), (2000 + i, longer + " more"), (3000 + i, longer)]
    return [*rows, (7000, None), (7001, ""), (7002, " \n ")], labels


def plain_score(model, text):
    """The score of one document by enumerating the states of all its lines."""
    data, at = common.flat(pa.array([text or ""]))
    rows, sizes, features = line_crf.line_features(data, at)
    if not len(rows):
        return model.prior
    emission = np.zeros((len(rows), 2))
    emission[:, 1] = line_crf.with_neighbours(rows, features) @ model.weights
    good = np.array(plain_marginals(emission, model.transition)[0])[:, 1]
    share = np.clip((sizes * good).sum() / sizes.sum(), 0.001, 0.999)
    return 1 / (1 + np.exp(-(model.slope * np.log(share / (1 - share)) + model.offset)))


def test_stages_are_the_plain_ones(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = common.read_table(spark, str(tmp_path), "documents")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    model = line_crf.train(docs, common.read_table(spark, str(tmp_path), "labels"))
    want = {i: t for i, t in rows if plain_score(model, t) >= line_crf.THRESHOLD}
    docs = stages["quality classifier"](spark, docs, str(tmp_path)).cache()
    assert texts(docs) == want and 0 < len(want) < len(rows)

    heads = {min(g) for g in plain_classes(sorted(want.items()))[0]}
    docs = stages["near-dedup"](spark, docs, str(tmp_path)).cache()
    assert texts(docs) == {i: want[i] for i in heads} and len(heads) < len(want)

    plain = plain_removal(sorted((i, want[i]) for i in heads))
    docs = stages["substring dedup"](spark, docs, str(tmp_path)).cache()
    kept = texts(docs)
    assert sum(n for _, n, _ in plain.values()) > 0
    for i, t in kept.items():
        assert hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest() == plain[i][2]

    attempts = plain_attempts(kept.values())
    docs = stages["pii"](spark, docs, str(tmp_path)).cache()
    clean = texts(docs)
    assert clean == {i: None if t is None else pii_surrogates.rewritten(t, attempts)[0] for i, t in kept.items()} and clean != kept

    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in stages["packing"](spark, docs, str(tmp_path)).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    tokens = packing.ChunkTokenizer(PATH)
    for i, t in clean.items():
        ends = [0, *(s + n for s, n in sorted(pieces[i]))]
        assert [s for s, _ in sorted(pieces[i])] == ends[:-1] and ends[-1] == len(tokens.whole(t or "")) + 1
    for own in sequences.values():
        ends = [0, *(s + n for s, n in sorted(own))]
        assert [s for s, _ in sorted(own)] == ends[:-1] and ends[-1] <= packing.SEQUENCE_TOKENS

    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert {r["doc_id"] for r in whole} == set(clean)


def test_stages_take_clashing_columns_and_odd_rows(spark):
    rows = [(None, None), (None, "text without id " * 9), (1, ""), (1, ""), (2, "some text " * 12), (2, "another text " * 12), (3, "x" * 5000)]
    names = ("score", "hash", "runs", "attempts", "start", "length", "offset", "cost", "node", "label", "class_id", "key", "predicted")
    odd = spark.createDataFrame([(d, t, *("clash" for _ in names)) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.columns == list(common.DOCUMENT_COLUMNS), name
        assert 1 <= out.count() <= len(rows)
        assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, "")
    assert packed.count() >= len(rows) and "cost" in packed.columns and packed.schema["cost"].dataType.simpleString() == "double"


def plain_assign(sizes, capacity):
    """The rule itself: whole sequences first, then what is left by falling size, each into the cheapest sequence that has room."""
    cost = lambda n: packing.LINEAR * n + packing.QUADRATIC * n * n
    count = -(-sum(sizes) // capacity)
    pieces, rest, opened = [], [], 0
    for d, n in enumerate(sizes):
        for k in range(n // capacity):
            pieces.append((d, k * capacity, capacity, opened, 0))
            opened += 1
        if n % capacity:
            rest.append((n % capacity, d, n // capacity * capacity))
    costs, room = [cost(capacity)] * opened + [0.0] * (count - opened), [0] * opened + [capacity] * (count - opened)
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        fits = [s for s in range(count) if room[s] >= n]
        while n:
            s = min(fits or [s for s in range(count) if room[s]], key=lambda s: (costs[s], s))
            take = min(n, room[s])
            pieces.append((d, start, take, s, capacity - room[s]))
            costs[s], room[s] = costs[s] + cost(take), room[s] - take
            start, n = start + take, n - take
    return pieces


@pytest.mark.parametrize("seed", range(12))
def test_assignment_is_the_plain_rule(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 7, 40, 60, 99, 100, 101, 250]) for _ in range(rng.randint(1, 150))]
    assert sorted(packing.assign(sizes, 100)[0]) == sorted(plain_assign(sizes, 100))
