"""A golden gate: labelled records over one made-up text, judged end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as X
from ..operators import ledger, stages, vocabulary

SOURCE = "After two weeks my head hurt and I felt sick. No swelling so far, but the blue tablets made me sleepy, and my knee pain came back."
CONCEPTS = [("100001", True, True, True), ("100002", True, True, True), ("100003", False, False, True), ("100004", True, False, False), ("100005", True, False, False), ("100006", False, False, False)]
TERMS = [("100001", "Sleepy (finding)", True), ("100001", "Drowsy", False), ("100002", "Swelling", False), ("100003", "Knee pain", False), ("100004", "Operation on head", False), ("100005", "Blue tablets", False), ("100006", "Sick", False)]


def _case(phrase: str, sct: str | None, verdict: str, reason: str | None = None, kind: str = "reaction", shift: int = 0, text: str | None = None, spans: list | None = None) -> tuple:
    at = SOURCE.index(phrase) + shift
    return phrase if text is None else text, [(at, at + len(phrase))] if spans is None else spans, sct, kind, verdict, reason


CASES = [
    _case("sleepy", "100001", "ACCEPT"), _case("sleepy", "100001", "ACCEPT", text=" SLEEPY "), _case("swelling", "100002", "ACCEPT"), _case("blue tablets", "100005", "ACCEPT", kind="drug"),
    _case("felt sick", "100006", "BAND"), _case("head hurt", "100002", "BAND"), _case("head hurt", schema.CONCEPT_LESS, "BAND"), _case("head hurt", None, "BAND"), _case("my knee pain", "100003", "BAND"),
    _case("sleepy", "100001", "REJECT", "span_ungrounded", shift=2), _case("sleepy", "100001", "REJECT", "span_out_of_range", spans=[(900, 906)]), _case("head hurt", "999999", "REJECT", "code_unknown"), _case("head hurt", "100004", "REJECT", "wrong_semantic_type"),
]


def records(spark: SparkSession) -> DataFrame:
    rows = [("GATE.1", kind, text, spans, sct, None, 0.9, schema.NEW, None, f"GATE.1#{i}", None) for i, (text, spans, sct, kind, *_) in enumerate(CASES)]
    return spark.createDataFrame(rows, schema.RECORD)


def backend(spark: SparkSession) -> vocabulary.Vocabulary:
    d = spark.createDataFrame([(c, t, f, i) for i, (c, t, f) in enumerate(TERMS)], "concept_id string, term string, fsn boolean, rowid long").withColumn("norm", X.normalise_term(F.col("term")))
    return vocabulary.Vocabulary(spark.createDataFrame(CONCEPTS, schema.CONCEPT), vocabulary.term_arrays(d), "gate")


def gate(spark: SparkSession) -> list[str]:
    """What went wrong: nothing, if every record gets its verdict, judging routes nothing, and the ledger is complete."""
    docs = spark.createDataFrame([("GATE.1", "GATE", SOURCE)], schema.DOC)
    done = stages.run(stages.enrich(records(spark), docs, backend(spark)), [1, 2], [1, 2])
    expected = {f"GATE.1#{i}": (c[4], c[5]) for i, c in enumerate(CASES)}
    first = done.snapshots[1].select("record_id", "r1_verdict", "r1_reason", "zone").collect()
    faults = [f"{r['record_id']}: {r['r1_verdict']}/{r['r1_reason']} instead of {'/'.join(map(str, expected[r['record_id']]))}" for r in first if (r["r1_verdict"], r["r1_reason"]) != expected[r["record_id"]]]
    faults += [f"{r['record_id']}: judged and routed at once" for r in first if r["zone"] != schema.NEW]
    last = done.snapshots[2].select("record_id", "zone", "sct", "withheld_sct").collect()
    faults += [f"{r['record_id']}: withheld but still answered" for r in last if r["zone"] == schema.ABSTAIN and r["sct"] is not None]
    rows = ledger.entries(done.snapshots[1], "gate", 1).unionByName(ledger.entries(done.snapshots[2], "gate", 2))
    n, silent = rows.agg(F.count("*"), F.count_if((F.col("rung") == 1) & F.col("verdict").isNull())).first()
    faults += ([f"{n} ledger rows for {len(CASES)} records"] if n != 2 * len(CASES) else []) + ([f"{silent} judgements without a verdict"] if silent else [])
    return faults


def resolves(v: vocabulary.Vocabulary, real: str, fake: str) -> bool:
    """Whether a backend knows a real code and not a made-up one."""
    found = {r["id"] for r in v.concept.filter(F.col("id").isin(real, fake)).select("id").collect()}
    return found == {real}
