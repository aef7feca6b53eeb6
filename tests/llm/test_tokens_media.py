"""Transport streams, byte-level BPE and packing: round trips, and the libraries' own results."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sieveworks.llm import byte_bpe, common, mpegts, packing

P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, media string, lang string, ids string"
ODD = [
    "", None, " ", "a", "Hello world, it's 2024!", "don't WE'LL  x²½ ªº", "tab\tnew\nline \r\n  end  ", "ä ö ü ß — „Zitat“ 😀👨‍👩‍👧 ́x", "a\x00b\x1cc\x85d\xa0e　f", "<|endoftext|> <|startoftext|>x",
    "x" * 700, "ab" * 300 + " " + "é" * 200, "İstanbul ΣΑΣ ŉ Ǆ", " 　" * 5, "1234567890" * 9, "token = \"9f99bb99f99999a99999ae99d9cc999f999b9b9d\"!!!",
]


def table(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i, t, "m", "en", "z") for i, t in enumerate(texts)], DOC).repartition(2)


# Transport streams


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 6143, 6144, 6145, 100_000])
def test_streams_round_trip(size):
    payload = mpegts.padded(random.Random(size).randbytes(size))
    assert len(payload) % 192 == 0 and payload
    media = mpegts.mux(payload)
    s = mpegts.demux(media)
    assert len(media) % 188 == 0 and b"".join(u.payload for u in s.units) == payload
    assert (s.errors, s.repeated, s.bad_sections, s.skipped_bytes) == (0, 0, 0, 0)
    assert s.programs == {1: 0x1000} and s.kinds == {0x100: 6} and all(u.whole for u in s.units)
    assert [u.pts for u in s.units] == [k * 3600 for k in range(len(s.units))] and [u.random_access for u in s.units] == [k % 4 == 0 for k in range(len(s.units))]


def test_damaged_streams():
    payload = mpegts.padded(random.Random(1).randbytes(50_000))
    packets = [mpegts.mux(payload)[i : i + 188] for i in range(0, len(mpegts.mux(payload)), 188)]
    read = lambda x: mpegts.demux(b"".join(x))
    lost = read(packets[:20] + packets[21:])
    assert lost.errors == 1 and [u.whole for u in lost.units].count(False) == 1
    twice = read(packets[:20] + [packets[19]] + packets[20:])
    assert twice.repeated == 1 and twice.errors == 0 and b"".join(u.payload for u in twice.units) == payload
    noise = mpegts.demux(b"\x00\x47\x01" + b"".join(packets[:9]) + b"junk" + b"".join(packets[9:]))
    assert noise.skipped_bytes == 7 and b"".join(u.payload for u in noise.units) == payload
    broken = bytearray(packets[1])
    broken[20] ^= 1
    assert read([packets[0], bytes(broken), *packets[2:9]]).bad_sections == 1
    filler = b"\x47\x1f\xff\x10" + b"\xff" * 184
    assert b"".join(u.payload for u in read([x for p in packets for x in (p, filler)]).units) == payload
    assert mpegts.demux(b"").units == [] and mpegts.demux(b"nothing here").units == []


def test_time_stamps_wrap():
    assert mpegts._pts_bytes(0) == mpegts._pts_bytes(1 << 33) and mpegts._pts_bytes((1 << 33) - 1) == b"\x2f\xff\xff\xff\xff"


def test_section_checksum():
    assert mpegts.section_crc(b"123456789") == 0x0376E6E7


def test_media_query(spark):
    got = {r["n_bytes"]: r for r in mpegts.digests(mpegts.read(mpegts.store(table(spark, ODD)))).collect()}
    for t in ODD:
        raw = (t or "").encode()
        full = mpegts.padded(raw)
        r = got[len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])) or len([x for x in ODD if len((x or "").encode()) == len(raw)]) > 1
    assert mpegts.digests(mpegts.read(mpegts.store(table(spark, [])))).count() == 0


# Byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    made = [" ".join("".join(rng.choice("abcdeéñß'1 ") for _ in range(rng.randint(1, 14))) for _ in range(60)) for _ in range(12)]
    return ODD + made + ["same words again"] * 3 + ["ab" * 700 + " " + "é" * 400, "x" * 255 + " " + "x" * 256 + " " + "ab" * 128]


def test_bpe_is_the_library_s(spark, ranks):
    own, texts = library(ranks), odd_texts()
    df = spark.createDataFrame([(i, t, "m", "en", "z") for i, t in enumerate(texts)] + [(None, "no id", "m", "en", "z")], DOC)
    encoded = byte_bpe.encode(df, ranks, P.PATTERN)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    digests = {r["doc_id"]: r for r in byte_bpe.digests(encoded, ranks).collect()}
    for i, t in [*enumerate(texts), (None, "no id")]:
        want = own.encode_ordinary(t or "")
        assert ids[i] == want, t
        d = digests[i]
        assert (d["n_tokens"], d["ids_sha256"], d["decoded_sha256"]) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_merges_of_random_words(ranks):
    rng, own, merges = random.Random(5), library(ranks), byte_bpe.Merges(ranks)
    words = sorted({"".join(rng.choice(x) for _ in range(rng.randint(1, 40))) for x in ("ab", "aeiounrst", "abcéßñ語", "THEthe ") for _ in range(400)})
    found, numbers = merges.encoded(pa.array(words))
    at = np.concatenate([[0], np.cumsum(numbers)])
    for i, w in enumerate(words):
        want = own._core_bpe.encode_single_piece(w.encode())
        assert found[at[i] : at[i + 1]].tolist() == want
        assert w.encode() in ranks or merges.fold_long(w.encode()).tolist() == want


def test_native_bpe_is_the_same(spark, ranks):
    texts = [t for t in odd_texts() if len(t or "") < 400]
    df = spark.createDataFrame([(i, t, "m", "en", "z") for i, t in enumerate(texts)] + [(None, "no id", "m", "en", "z")], DOC)
    both = [{r["doc_id"]: r["ids"] for r in f(df, ranks, P.PATTERN).collect()} for f in (byte_bpe.encode, byte_bpe.encode_native)]
    assert both[0] == both[1]
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decoded_native(byte_bpe.encode(df, ranks, P.PATTERN), ranks).collect()}
    assert decoded == {i: (t or "").encode() for i, t in enumerate(texts)} | {None: b"no id"}


def test_native_bpe_runs_no_python(spark, ranks):
    docs = common.read_table(spark, "/root/testdata/sf0.001", "documents").limit(5)
    plan = byte_bpe.decoded_native(byte_bpe.encode_native(docs, ranks, P.PATTERN), ranks)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|MapInArrow|MapInPandas|PythonUDF|Scan ExistingRDD", plan)


def test_bpe_of_nothing(spark, ranks):
    assert byte_bpe.encode(table(spark, []), ranks, P.PATTERN).count() == 0
    assert byte_bpe.digests(byte_bpe.encode(table(spark, []), ranks, P.PATTERN), ranks).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.Merges({b"a": 0})


# Packing

PATH = P.path("word_bpe_49k.json")


def test_chunks_have_the_library_s_ids():
    t = packing.ChunkTokenizer(PATH)
    texts = [x for x in ODD if x is not None]
    for _ in range(2):
        for text, found in zip(texts, t.encode([x.encode() for x in texts]), strict=True):
            assert found.tolist() == t.whole(text), text


@pytest.mark.parametrize("seed", range(8))
def test_assignment(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 40, 100, 130, 300]) for _ in range(rng.randint(1, 200))]
    pieces, costs = packing.assign(sizes, 100)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for d, start, n, s, offset in pieces:
        assert n > 0
        by_doc[d].append((start, n))
        by_seq[s].append((offset, n))
    for groups, ends in ((by_doc, sizes), (by_seq, None)):
        for k, parts in groups.items():
            at = 0
            for a, n in sorted(parts):
                assert a == at
                at += n
            assert at <= 100 if ends is None else at == ends[k]
    assert len(by_doc) == len(sizes) and len(by_seq) == len(costs) == -(-sum(sizes) // 100)
    assert all(costs[s] == pytest.approx(sum(n * packing.LINEAR + packing.QUADRATIC * n * n for _, n in p)) for s, p in by_seq.items())


def test_descending_documents_meet_the_cheapest_sequence():
    pieces, costs = packing.assign([50, 40, 30, 30, 20, 20, 10], 100)
    assert costs.max() - costs.min() < 0.35 * costs.max() and len(costs) == 2
    assert [p[0] for p in pieces][:2] == [0, 1] and pieces[0][3] != pieces[1][3]


def test_pack(spark):
    texts = ODD + [" ".join(f"word{i}" for i in range(6000)), "tail"]
    tok = packing.ChunkTokenizer(PATH)
    got = packing.pack(table(spark, texts), PATH, block_tokens=3000).collect()
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 4096
    docs = collections.defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*tok.whole(t or ""), packing.END_ID]
        parts = sorted(docs[None if i == 3 else i], key=lambda r: r["start"])
        assert sum(r["length"] for r in parts) == len(ids) and all(r["doc_tokens"] == len(ids) for r in parts)
        for r in parts:
            import numpy as np

            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    assert packing.pack(table(spark, []), PATH).count() == 0


def test_missing_columns_are_null(spark):
    df = common.only(spark.createDataFrame([(1,)], "doc_id int"), **common.DOCUMENT_COLUMNS)
    assert df.first().asDict() == {"doc_id": 1, "text": None, "lang": None, "source": None, "n_chars": None}
