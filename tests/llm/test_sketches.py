"""Order MinHash, BagMinHash and the window removal, against brute force on small inputs."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sieveworks.llm import bagminhash, common, order_minhash, superkmer_dedup

DOC = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with other columns, some of whose names clash with what operators make."""
    return spark.createDataFrame([(d, t, "en", None, 1, "x", 7, "y") for d, t in rows], DOC + ", lang string, source string, n_chars long, fingerprint string, hash int, label string").repartition(3)


def words_of(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, vocabulary)}" for _ in range(n)]


def test_words_match_the_pattern():
    texts = ["", " a  b\tc\n", None, "x", "ä ö \x0b\x0cz", "  ", "a\x1cb", "end "]
    data, at = common.flat(pa.array(texts))
    s, e, row = common.words(data, at)
    raw = data.tobytes()
    got = collections.defaultdict(list)
    for a, b, r in zip(s, e, row, strict=True):
        got[int(r)].append(raw[a:b].decode())
    assert [got[i] for i in range(len(texts))] == [WORD.findall(t or "") for t in texts]


def test_word_hashes_tell_words_apart():
    ws = ["a", "b", "ab", "ba", "abcdefgh", "abcdefghi", "abcdefghä", "x" * 40, "x" * 41]
    data, at = common.flat(pa.array(ws + ws))
    h = common.word_hashes(data, *common.words(data, at)[:2])
    assert len(set(h.tolist())) == len(ws) and h[: len(ws)].tolist() == h[len(ws) :].tolist()


# Order MinHash


def plain_fingerprint(text, k=order_minhash.K):
    h = order_minhash.kmer_hashes(order_minhash.codes_of(text))
    assert len(h) == max(1, len(text) - min(k, len(text)) + 1)
    out = np.zeros(order_minhash.ENTRIES, np.uint32)
    for e, a in enumerate(order_minhash._FACTORS):
        least = sorted(np.lexsort((np.arange(len(h)), h * a))[:2].tolist())
        z = np.array([2], np.uint64)
        for j, i in enumerate(least):
            z = common.mix(z ^ common.mix(h[i : i + 1].astype(np.uint64) + np.uint64(j)))
        out[e] = (common.mix(z + np.uint64(e)) >> np.uint64(32))[0]
    return out


@pytest.mark.parametrize("text", ["abcdefgh" * 3, "the cat sat on the mat, the cat sat", "ä😀" * 50, " ".join(words_of(3000, 1))])
def test_fingerprint_is_the_plain_one(text):
    assert (order_minhash.fingerprint(order_minhash.codes_of(text)) == plain_fingerprint(text)).all()


def test_occurrences_are_numbered_and_order_counts():
    h = order_minhash.kmer_hashes(order_minhash.codes_of("abcdefabcdefabcdef"))
    assert len(set(h.tolist())) == len(h)
    x, y = " ".join(words_of(300, 1)), " ".join(words_of(300, 2))
    f = lambda t: order_minhash.fingerprint(order_minhash.codes_of(t))
    swapped = order_minhash.likeness(f(x + " " + y), f(y + " " + x))
    assert 0.3 < swapped < 0.8, "the same k-mers in another order are less alike"
    assert order_minhash.likeness(f(x), f(x)) == 1.0 and order_minhash.likeness(f(x), f(y)) < 0.1


def test_compare_next(spark):
    rows = [(5, "abc def ghi jkl mno"), (1, "x" * 5000), (9, None), (7, ""), (3, "short"), (11, " ".join(words_of(800, 4))), (12, "z"), (2, "ä😀ö")]
    got = {r["doc_id"]: r for r in order_minhash.compare_next(table(spark, rows)).collect()}
    ordered = sorted(rows)
    for i, (d, t) in enumerate(ordered):
        t, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        f = [order_minhash.fingerprint(order_minhash.codes_of(x)) for x in (t, changed, after)]
        assert r["fingerprint"] == f[0].astype(">u4").tobytes().hex() and r["edited_fingerprint"] == f[1].astype(">u4").tobytes().hex()
        assert (r["near_edited"], r["near_next"]) == (order_minhash.likeness(f[0], f[1]), order_minhash.likeness(f[0], f[2]))
    assert got[9]["fingerprint"] == got[7]["fingerprint"]


def test_compare_next_edges(spark):
    assert order_minhash.compare_next(table(spark, [])).count() == 0
    assert order_minhash.compare_next(table(spark, [(None, "a b"), (None, None)])).count() == 2
    lone = order_minhash.compare_next(table(spark, [(4, "abcdef" * 9)])).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0
    many = [(1, "same text here")] * 4 + [(i, f"text {i}") for i in range(2, 60)] + [(None, "tail")]
    assert order_minhash.compare_next(table(spark, many)).count() == len(many)
    assert order_minhash.fingerprints(table(spark, [(1, "a"), (2, "a")])).select("fingerprint").distinct().count() == 1


# Windows


def plain_removal(rows, w=superkmer_dedup.WINDOW):
    docs = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, {}
    for d, t in docs:
        ws = WORD.findall(t or "")
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            key = tuple(ws[i : i + w])
            if key in first:
                gone[i : i + w] = [True] * w
            else:
                first[key] = (d, i)
        kept = " ".join(x for x, g in zip(ws, gone, strict=True) if not g)
        out[d] = (len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def windows_fixture():
    passage, line = " ".join(words_of(60, 7)), " ".join(["again"] * 45)
    rows = [(i, " ".join(words_of(50, 100 + i)) + " " + passage + "\n" + " ".join(words_of(30, 200 + i))) for i in range(40)]
    rows += [(100 + i, passage) for i in range(30)] + [(200, line), (201, line + " " + passage + " " + line), (202, None), (203, ""), (204, " ".join(words_of(19, 5))), (205, "  ".join(words_of(20, 5))), (206, "\t".join(words_of(20, 5)))]
    rows += [(300 + i, " ".join(words_of(80, 300, vocabulary=3))) for i in range(3)] + [(None, passage)]
    return rows


@pytest.mark.parametrize(("block", "sorted_bytes", "levels"), [(1, 4 << 20, 4), (1 << 12, 4 << 20, 4), (1 << 22, 4 << 20, 4), (1, 3000, 4), (1 << 12, 500, 2), (1, 100, 1)])
def test_removal_is_the_plain_one(spark, monkeypatch, block, sorted_bytes, levels):
    """Also where buckets go to scratch files, hot parts are dealt on, and single windows are read as a stream."""
    rows = windows_fixture()
    blocks = common.blocks
    monkeypatch.setattr(common, "blocks", lambda it, text="text", limit=block: blocks(it, text, block))
    if sorted_bytes < 4 << 20:
        monkeypatch.setattr(superkmer_dedup, "SORTED", sorted_bytes)
        monkeypatch.setattr(superkmer_dedup, "HELD", 2000)
        monkeypatch.setattr(superkmer_dedup, "LEVELS", max(1, levels))
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in part], pa.int64()), "text": pa.array([r[1] for r in part]), "hash": pa.array([hash(r[1]) & 0xFFFF for r in part], pa.int32())}) for part in (rows[::2], rows[1::2])]
    packs = sorted((p for b in superkmer_dedup.superkmers(iter(batches), 7) for p in zip(*(b.column(c).to_pylist() for c in ("bucket", "count", "pack")), strict=True)), key=lambda x: x[0])
    one = pa.RecordBatch.from_pydict({"bucket": pa.array([p[0] for p in packs], pa.int32()), "count": pa.array([p[1] for p in packs], pa.int32()), "pack": pa.array([p[2] for p in packs], pa.binary())})
    gone = collections.defaultdict(set)
    for b in superkmer_dedup.repeated_windows(iter([one])):
        for r in b.to_pylist():
            gone[r["doc_id"]].update(range(r["start"], r["start"] + r["windows"] - 1 + superkmer_dedup.WINDOW))
    assert {d: len(x) for d, x in gone.items() if x} == {d: n for d, (_, n, _) in plain_removal(rows).items() if n}


def test_kept_words(spark):
    rows = windows_fixture()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in superkmer_dedup.kept_words(table(spark, rows)).collect()}
    assert got == plain_removal(rows)
    assert superkmer_dedup.kept_words(table(spark, [])).count() == 0


def test_rows_that_repeat_are_one_document(spark):
    text = " ".join(words_of(40, 9))
    got = superkmer_dedup.kept_words(table(spark, [(1, text)] * 5 + [(2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0)] * 5 + [(2, 40)]


def test_unlike_words_under_one_hash_stay_apart():
    data, at = common.flat(pa.array([" ".join(words_of(30, 1)) + " " + " ".join(words_of(30, 2))]))
    packed, place = superkmer_dedup._pack(data, *common.words(data, at)[:2])
    valid = np.arange(41)
    first = superkmer_dedup._firsts(packed, place, np.zeros(41, np.uint64), valid)
    assert (first == valid).all()


def test_removal_keeps_lines_and_columns(spark):
    passage = " ".join(words_of(30, 3))
    got = {r["doc_id"]: r for r in superkmer_dedup.deduplicate(table(spark, [(1, passage), (2, "first line\n" + passage + "\nlast line"), (3, None)])).collect()}
    assert list(got[1].asDict()) == list(common.DOCUMENT_COLUMNS)
    assert got[2]["text"] == "first line\nlast line" and got[2]["n_chars"] == 20 and got[1]["text"] == passage and got[3]["text"] is None


# BagMinHash


def test_signatures_are_unbiased():
    rng, est, true = np.random.default_rng(5), [], []
    for trial in range(60):
        base = np.sort(common.mix(np.arange(50, dtype=np.uint64) + np.uint64(1000 * trial)))
        a, b = rng.integers(1, 40, 50), rng.integers(0, 40, 50)
        keep = b > 0
        sig = bagminhash.signatures(np.repeat([0, 1], [50, keep.sum()]), np.concatenate([base, base[keep]]), np.concatenate([a, b[keep]]), 2)
        est.append((sig[0] == sig[1]).mean())
        true.append(bagminhash.similarity((base, a), (base[keep], b[keep])))
    assert abs(np.mean(est) - np.mean(true)) < 0.02


def test_signature_does_not_depend_on_company():
    h = common.mix(np.arange(30, dtype=np.uint64))
    alone = bagminhash.signatures(np.zeros(30, int), h, np.full(30, 3), 1)
    both = bagminhash.signatures(np.repeat([0, 1], 30), np.concatenate([h, h]), np.repeat([3, 5], 30), 3)
    assert (alone[0] == both[0]).all() and (both[2] == both[2][0]).all()


def plain_classes(rows):
    sets = {}
    for i, (_, t) in enumerate(rows):
        ws = WORD.findall(t or "")
        sets[i] = collections.Counter(tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))) if ws else None
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sims = []
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (both := sum((sets[i] & sets[j]).values())):
                sims.append(s := both / (sum(sets[i].values()) + sum(sets[j].values()) - both))
                if s >= 0.8:
                    parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(sorted(g) for g in groups.values()), sims


def near_fixture():
    rng, rows = random.Random(2), []
    for g in range(12):
        base = words_of(rng.randint(30, 300), 500 + g, 5000)
        for _ in range(rng.choice([1, 2, 9])):
            other = list(base)
            for _ in range(max(1, len(base) // 150)):
                other[rng.randrange(len(other))] = f"n{rng.random()}"
            rows.append(" ".join(other))
        rows += [" ".join(base)] * rng.choice([0, 3])
    hot = words_of(200, 1, 5000)
    for i in range(60):  # many alike, most pairs just too far from each other
        other = list(hot)
        for k in range(3):
            other[(37 * i + 61 * k) % 200] = f"h{i}.{k}"
        rows.append(" ".join(other))
    rows += ["one two", "one two", "one", "rep " * 300, "rep " * 290]
    return list(enumerate(rows))


def test_classes_are_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", 16)
    rows = near_fixture() + [(900, None), (901, ""), (902, " ")]
    got = collections.defaultdict(list)
    for r in bagminhash.classes(table(spark, rows)).collect():
        got[r["class_id"]].append(r["doc_id"])
    assert sorted(sorted(g) for g in got.values()) == plain_classes(rows)[0]
    assert all(k == min(v) for k, v in got.items())


def test_recall_on_documents(spark):
    """Of all pairs at the similarity or above, of ids divisible by 50 and all rows, those in one class; and no class joins documents that no chain links."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = {d: collections.Counter(tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))) for d, t in rows if (ws := WORD.findall(t or ""))}
    holders = collections.defaultdict(set)
    for d, s in sets.items():
        for x in s:
            holders[x].add(d)
    of = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs).collect()}
    pairs = found = 0
    for d in (d for d in sets if d % 50 == 0):
        for o in set().union(*(holders[x] for x in sets[d])) - {d}:
            both = sum((sets[d] & sets[o]).values())
            if both >= 0.8 * (sum(sets[d].values()) + sum(sets[o].values()) - both):
                pairs, found = pairs + 1, found + (of[d] == of[o])
    assert pairs and found >= 0.9 * pairs
    groups = collections.defaultdict(list)
    for d, c in of.items():
        groups[c].append((d, dict(rows)[d]))
    for members in groups.values():
        if len(members) > 1:
            assert len(plain_classes(members)[0]) == 1


def test_overlap_matrix():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(9):
        h = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        sets.append((h, rng.integers(1, 4, len(h))))
    got = bagminhash._overlaps(sets)
    for i in range(9):
        for j in range(9):
            if i != j:
                a, b = dict(zip(*map(np.ndarray.tolist, sets[i]), strict=True)), dict(zip(*map(np.ndarray.tolist, sets[j]), strict=True))
                assert got[i, j] == sum(min(n, b.get(x, 0)) for x, n in a.items())


def test_class_edges(spark):
    assert bagminhash.classes(table(spark, [])).count() == 0
    same = " ".join(words_of(50, 3))
    got = bagminhash.classes(table(spark, [(None, same), (4, same), (4, same), (2, "other text")])).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"]) for r in got) == [(-1, 4), (2, 2), (4, 4), (4, 4)]
    kept = bagminhash.deduplicate(table(spark, [(1, same), (2, same + " more"), (2, "another text"), (3, "else"), (3, "else"), (5, None), (6, None), (None, same), (None, "alone")])).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:7]) for r in kept) == [(0, "alone"), (1, same[:7]), (2, "another"), (3, "else"), (3, "else"), (5, ""), (6, "")] and list(kept[0].asDict()) == list(common.DOCUMENT_COLUMNS)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200)]
    df = spark.createDataFrame([(str(1000 + a).encode(), str(1000 + b).encode()) for a, b in edges], "a binary, b binary")
    got = {r["node"].decode(): r["label"].decode() for r in bagminhash.components(df).collect()}
    assert got == {str(1000 + i): "1000" for i in range(1, 31)} | {"1101": "1100", "1102": "1100"}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    """Against union-find: chains, stars, cycles and repeated edges, in any order and direction."""
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(200, 200 + i) for i in range(1, 30)] + [(300 + i, 300 + (i + 1) % 7) for i in range(7)]
    edges += rng.sample(edges, 10)
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    df = spark.createDataFrame([(f"{a:03}".encode(), f"{b:03}".encode()) for a, b in edges], "a binary, b binary")
    got = [(r["node"].decode(), r["label"].decode()) for r in bagminhash.components(df).collect()]
    assert sorted(got) == [(f"{x:03}", f"{find(x):03}") for x in range(400) if find(x) != x]
