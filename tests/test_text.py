import pytest
from pyspark.sql import functions as F

from sieveworks.functions import negation as N
from sieveworks.functions import text as X
from sieveworks.schema import SPANS

SOURCE = "I feel a bit drowsy & have a little blurred vision, so far no gastric problems."


def reason(spark, spans, text, kind="reaction", source=SOURCE):
    df = spark.createDataFrame([(kind, spans, text, source)], f"k string, spans {SPANS}, t string, s string")
    return df.select(X.span_reason(F.col("k"), F.col("spans"), F.col("t"), F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("spans", "text", "kind", "expected"),
    [
        ([(9, 19)], "bit drowsy", "reaction", None),
        ([(11, 21)], "bit drowsy", "reaction", "span_ungrounded"),
        ([(900, 910)], "bit drowsy", "reaction", "span_out_of_range"),
        ([(2, 6), (13, 19)], "feel drowsy", "reaction", None),
        ([(2, 6), (13, 19)], "drowsy feel", "drug", None),
        ([(9, 19)], "  Bit   Drowsy ", "reaction", None),
        ([], "bit", "reaction", "schema_invalid"),
        (None, "bit", "reaction", "schema_invalid"),
        ([(9, 19)], "  ", "reaction", "schema_invalid"),
        ([(9, 19)], None, "reaction", "schema_invalid"),
        ([(19, 9)], "bit", "reaction", "schema_invalid"),
        ([(-1, 5)], "bit", "reaction", "schema_invalid"),
        ([(9, 19)], "bit drowsy", "ADR", "schema_invalid"),
        ([(9, 19)], "bit drowsy", None, "schema_invalid"),
        ([(900, 910), (5, 1)], "bit", "reaction", "span_out_of_range"),
    ],
)
def test_grounding(spark, spans, text, kind, expected):
    assert reason(spark, spans, text, kind) == expected


def test_offsets_count_code_points(spark):
    assert reason(spark, [(2, 5)], "déj", source="😀 déjà") is None


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("term", "norm"),
    [("Pain (finding)", "pain"), ("Café au lait spot (disorder)", "café au lait spot"), ("A (b) (c)", "a b"), ("x_y-z", "x_y z"), ("(only)", ""), ("  Two   words ", "two words")],
)
def test_normalise_term(spark, term, norm):
    assert one(spark, X.normalise_term(F.col("t")), t=term) == norm


@pytest.mark.parametrize(
    ("span", "source", "claim", "expected"),
    [
        ("no", "no, no, no", 4, (4, 6, "search_nearest_of_3")),
        ("no", "no, no, no", 2, (0, 2, "search_nearest_of_3")),
        ("far", SOURCE, 0, (55, 58, "search_unique")),
        ("FEEL", SOURCE, 0, (2, 6, "search_case_insensitive")),
        ("zebra", SOURCE, 0, (-1, -1, "not_in_source")),
        ("", SOURCE, 0, (-1, -1, "empty")),
        ("aa", "aaa", 1, (1, 3, "search_nearest_of_2")),
    ],
)
def test_recover_offsets(spark, span, source, claim, expected):
    assert tuple(one(spark, X.recover_offsets(F.col("a"), F.col("b"), F.col("c")), a=span, b=source, c=claim)) == expected


@pytest.mark.parametrize(("a", "b", "expected"), [([(0, 10)], [(5, 15)], 5 / 15), ([(0, 5), (3, 8)], [(0, 8)], 1.0), ([(5, 5)], [(5, 6)], 0.0), ([], [(1, 2)], 0.0)])
def test_iou(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], f"a {SPANS}, b {SPANS}")
    assert df.select(X.iou(F.col("a"), F.col("b"))).first()[0] == pytest.approx(expected)


def cue(spark, source, mention, window=6):
    a = source.index(mention)
    df = spark.createDataFrame([(source, [(a, a + len(mention))])], f"s string, p {SPANS}")
    return df.select(N.negation_cue(F.col("s"), F.col("p"), window)).first()[0]


@pytest.mark.parametrize(
    ("source", "mention", "expected"),
    [
        (SOURCE, "gastric problems", "no"),
        (SOURCE, "bit drowsy", None),
        (SOURCE, "little blurred vision", None),
        ("Since starting it I have no energy at all.", "no energy", None),
        ("I had no rash, but the muscle pain was unbearable.", "muscle pain", None),
        ("I had no rash. The muscle pain was unbearable.", "muscle pain", None),
        ("There is no doubt that the muscle pain came from this drug.", "muscle pain", None),
        ("I did not get any rash and I don't have nausea now.", "nausea", "n't"),
        ("Denied rash but had pain", "pain", "denied"),
        ("gastric problems? none at all", "gastric problems", None),
        ("gastric problems, none at all", "gastric problems", "none"),
        ("He was ruled out for pain", "pain", None),
        ("no a b c d e f pain", "pain", None),
        ("no a b c d e pain", "pain", "no"),
        ("no, a, b, c pain", "pain", None),
    ],
)
def test_negation(spark, source, mention, expected):
    assert cue(spark, source, mention) == expected


def test_negation_against_plain_python(spark):
    import random
    import re

    rng = random.Random(3)
    words = ["no", "not", "but", "denies", "never", "don't", "pain", ",", ".", "rash", "none", "without", "no doubt", "still", "x", ":"]

    def plain(source, a, b):
        low = source.lower()
        for p in N.PSEUDO:
            if (i := low.rfind(p, max(0, a - 60), a)) >= 0 and a - i <= 40:
                return None
        tokens = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[\w']+|[.;:!?,]", source)]
        left = [t for t, _, e in tokens if e <= a][::-1]
        right = [t for t, s, _ in tokens if s >= b]
        for n, t in enumerate(left):
            if t in N.SENTENCE_END or t in N.TERMINATORS or n >= 6:
                break
            if t in N.CUES and t not in N.FORWARD_ONLY:
                return t
            if t.endswith("n't"):
                return "n't"
        for n, t in enumerate(left):
            if t in N.SENTENCE_END or n >= 18:
                break
            if t in N.FORWARD_ONLY:
                return t
        for n, t in enumerate(right):
            if t in N.SENTENCE_END or n >= 3:
                break
            if t in N.TRAILING:
                return t
        return None

    rows = []
    for _ in range(300):
        source = " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))
        a = rng.randint(0, len(source) - 2)
        b = rng.randint(a + 1, len(source))
        rows.append((source, [(a, b)], plain(source, a, b)))
    df = spark.createDataFrame(rows, f"s string, p {SPANS}, want string")
    bad = df.withColumn("got", N.negation_cue(F.col("s"), F.col("p"))).filter("not (got <=> want)").collect()
    assert not bad, bad[:3]


def test_cues_are_found_at_any_distance_in_characters_and_texts_split_few_times(spark):
    """Gaps and words longer than what is split first; against the same texts with short ones."""
    gap, word = " " * 5000, "w" * 5000
    near = ["He denied any rash today.", "No www rash today.", "It was a rash www never.", "He denied. A rash www. None", "wrash no"]
    rows = [(i, t, x) for i, t in enumerate(near) for x in (t, t.replace(" ", gap), t.replace("www", word), "No, but. " * 900 + t)]
    at = F.instr("text", "rash") - 1
    cue = N.negation_cue(F.col("text"), F.array(F.struct(at.alias("s"), (at + 4).alias("e"))))
    found = {}
    for i, c in spark.createDataFrame(rows, "i int, near string, text string").select("i", cue.alias("cue")).collect():
        found.setdefault(i, set()).add(c)
    assert found == {0: {"denied"}, 1: {"no"}, 2: {"never"}, 3: {None}, 4: {None}}
    plan = spark.createDataFrame([("a", 0)], "text string, at int").select(N.negation_cue(F.col("text"), F.array(F.struct(F.col("at").alias("s"), F.col("at").alias("e")))).alias("cue"))
    assert plan._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") <= 4
