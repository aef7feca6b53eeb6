"""The stages that judge records: deterministic checks, then abstention; and the driver that runs them in order.

Enrichment joins every lookup once; verdicts and audits are expressions over the joined columns, so that all variants
of the parameters share one enrichment.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import negation as N
from ..functions import text as X
from .vocabulary import Vocabulary, finding_status, lexical_match


def enrich(records: DataFrame, sources: DataFrame | None, vocabulary: Vocabulary | None, meddra: DataFrame | None = None, window: int = 6, cue: bool = True, contained: bool = True) -> DataFrame:
    """Records with source, grounding, negation cue, concept flags, both lexical matches, and the other code's term.

    Without sources the records carry theirs, as `source`, and no text is shuffled to meet them. All joins are left and on equality. The vocabulary is shuffled, never broadcast: its size is only guessed, from
    compressed files, and the driver would have to hold it. Spark broadcasts the other code list if its size is below
    the session's threshold. Whoever needs neither the cue nor the contained match leaves them out: Spark drops unused
    columns only after the driver has analysed them, and these two take about a third of what building the plan allocates.
    """
    if sources is not None:
        records = records.join(sources.select("doc_id", F.col("text").alias("source")), "doc_id", "left")
    rows = records.withColumn("source", F.coalesce("source", F.lit("")))
    rows = rows.withColumn("span_reason", X.span_reason(F.col("entity_type"), F.col("spans"), F.col("text"), F.col("source")))
    if cue:
        rows = rows.withColumn("cue", F.when(F.col("span_reason").isNull(), N.negation_cue(F.col("source"), F.col("spans"), window)))
    if vocabulary is None:
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("present", "boolean"), ("active", "boolean"), ("status", "string"), ("exact", "boolean"), ("contained", "boolean"), ("preferred", "string")) if contained or c != "contained"})
    else:
        c = vocabulary.concept.select(F.col("id").alias("sct"), "active", "is_finding", "is_finding_hist", F.lit(True).alias("found"))
        t = vocabulary.terms.select(F.col("concept_id").alias("sct"), "norms", "preferred")
        # Records without a code meet nothing; each gets a key of its own, or one task would get them all.
        coded = (F.coalesce("sct", F.lit("")) != "") & (F.col("sct") != schema.CONCEPT_LESS)
        rows = rows.withColumn("code_key", F.when(coded, F.col("sct")).otherwise(F.concat(F.lit("#"), F.xxhash64("doc_id", "text").cast("string"))))
        both = c.withColumnRenamed("sct", "code_key").hint("merge"), t.withColumnRenamed("sct", "code_key").hint("merge")
        rows = rows.join(both[0], "code_key", "left").join(both[1], "code_key", "left").drop("code_key")
        rows = rows.withColumns({
            "present": F.coalesce("found", F.lit(False)), "status": finding_status(F.col("found"), F.col("active"), F.col("is_finding"), F.col("is_finding_hist")),
            "exact": lexical_match(F.col("norms"), F.col("text")), **({"contained": lexical_match(F.col("norms"), F.col("text"), "contained")} if contained else {}),
        }).drop("found", "norms", "is_finding", "is_finding_hist")
    if meddra is None:
        return rows.withColumns({"meddra_present": F.lit(None).cast("boolean"), "meddra_term": F.lit(None).cast("string")})
    m = meddra.select(F.col("code").alias("meddra"), F.col("term").alias("meddra_term"), F.lit(True).alias("in_list"))
    rows = rows.join(m, "meddra", "left")
    return rows.withColumn("meddra_present", F.when(F.coalesce("meddra", F.lit("")) != "", F.coalesce("in_list", F.lit(False)))).drop("in_list")


def _no_code(sct: Column) -> Column:
    return F.coalesce(sct, F.lit("")) == ""


def _checks(cfg: dict[str, Any]) -> list[tuple[Column, str]]:
    """Conditions of rejections with their reasons, in order, for records that have a code in the vocabulary's scope."""
    c = F.col
    scope = F.lit(cfg["finding_scope"] == "all") | (c("entity_type") == "reaction")
    checks = [(~c("present"), "code_unknown")]
    if cfg["reject_inactive"]:
        checks.append((~c("active"), "code_inactive"))
    if cfg["finding_check"]:
        checks.append((scope & (c("status") == "not_finding"), "wrong_semantic_type"))
    return checks


def verdict(cfg: dict[str, Any] | None = None, allow_no_vocabulary: bool = False, vocabulary: bool = True) -> Column:
    """struct(verdict, reason, band): the first check that fails decides."""
    cfg, c = schema.merge(schema.CHECK_DEFAULTS, cfg), F.col
    says = lambda v, r=None, b=None: F.struct(F.lit(v).alias("verdict"), (r if isinstance(r, Column) else F.lit(r).cast("string")).alias("reason"), F.lit(b).cast("string").alias("band"))
    out = F.when(c("span_reason").isNotNull(), says(schema.REJECT, c("span_reason")))
    if cfg["check_negation"] and cfg["negation_action"] == "reject":
        out = out.when(c("cue").isNotNull(), says(schema.REJECT, "negated"))
    out = out.when(c("sct") == schema.CONCEPT_LESS, says(schema.BAND, b="concept_less")).when(_no_code(c("sct")), says(schema.BAND, b="no_code"))
    if not vocabulary:
        if allow_no_vocabulary:
            return out.otherwise(says(schema.BAND, b="no_vocabulary"))
        return out.otherwise(F.struct(F.raise_error(F.lit("a record with a code needs a vocabulary")).cast("string").alias("verdict"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("band")))
    for fails, reason in _checks(cfg):
        out = out.when(fails, says(schema.REJECT, reason))
    if cfg["meddra_check"] == "reject":
        out = out.when(~c("meddra_present"), says(schema.REJECT, "meddra_unknown"))
    return out.when(c("contained" if cfg["lexical_mode"] == "contained" else "exact"), says(schema.ACCEPT)).otherwise(says(schema.BAND, b="colloquial_no_lexical_match"))


def audit(cfg: dict[str, Any] | None = None, vocabulary: bool = True) -> Column:
    """struct(reasons, unevaluable): every check, whatever the others say; it decides nothing."""
    cfg, c = schema.merge(schema.CHECK_DEFAULTS, cfg), F.col
    coded = (c("sct") != schema.CONCEPT_LESS) & ~_no_code(c("sct"))
    found = [c("span_reason")]
    if cfg["check_negation"] and cfg["negation_action"] == "reject":
        found.append(F.when(c("cue").isNotNull(), F.lit("negated")))
    if vocabulary:
        for i, (fails, reason) in enumerate(_checks(cfg)):
            found.append(F.when(coded & (fails if not i else c("present") & fails), F.lit(reason)))
    if cfg["meddra_check"] == "reject":
        found.append(F.when(~c("meddra_present"), F.lit("meddra_unknown")))
    blocked = F.map_filter(
        F.create_map(F.lit("negation"), F.when(c("span_reason").isNotNull() & F.lit(cfg["check_negation"]), F.lit("span not grounded")), F.lit("code"), F.when(coded & F.lit(not vocabulary), F.lit("vocab unavailable"))),
        lambda _, v: v.isNotNull(),
    )
    return F.struct(F.array_compact(F.array(*found)).alias("reasons"), blocked.alias("unevaluable"))


def apply_checks(enriched: DataFrame, cfg: dict[str, Any] | None = None) -> DataFrame:
    """Records with verdict, reason, band and audit; zone and reason change only in mode gate."""
    cfg = schema.merge(schema.CHECK_DEFAULTS, cfg)
    gate = F.lit(cfg["mode"] == "gate")
    rows = enriched.withColumn("v", verdict(cfg)).withColumn("a", audit(cfg))
    return rows.withColumns({
        "r1_verdict": F.col("v.verdict"), "r1_reason": F.col("v.reason"), "reason_band": F.col("v.band"), "r1_reasons": F.col("a.reasons"), "unevaluable": F.col("a.unevaluable"),
        "zone": F.when(gate, F.col("v.verdict")).otherwise(F.col("zone")), "reason": F.when(gate, F.col("v.reason")).otherwise(F.col("reason")),
    }).drop("v", "a")


def decide(cfg: dict[str, Any] | None = None, tau: Column | None = None) -> Column:
    """struct(zone, reason) of the abstention stage."""
    cfg, c = schema.merge(schema.ABSTAIN_DEFAULTS, cfg), F.col
    tau = F.lit(float(cfg["tau"])) if tau is None else tau
    says = lambda z, r: F.struct((z if isinstance(z, Column) else F.lit(z)).alias("zone"), (r if isinstance(r, Column) else F.lit(r).cast("string")).alias("reason"))
    judged = F.when(c("zone").isin(*schema.VERDICTS), c("zone")).otherwise(c("r1_verdict"))
    why = F.coalesce(F.nullif("reason", F.lit("")), F.col("r1_reason"))
    rejected = says(schema.ABSTAIN, why) if cfg["abstain_on_reject"] else says(c("zone"), c("reason"))
    low = (tau > 0) & F.coalesce(c("confidence") < tau, F.lit(False))
    return F.when(judged == schema.REJECT, rejected).when(low, says(schema.ABSTAIN, "low_confidence")).when(judged.isin(*cfg["abstain_zones"]), says(schema.ABSTAIN, "unresolved")).when(judged == schema.ACCEPT, says(schema.VERIFIED, None)).otherwise(says(c("zone"), c("reason")))


def apply_abstention(records: DataFrame, cfg: dict[str, Any] | None = None) -> DataFrame:
    """Records with their new zone; one that enters ABSTAIN loses its code and confidence to withheld_*."""
    rows = records.withColumn("d", decide(cfg))
    enters = (F.col("d.zone") == schema.ABSTAIN) & (F.col("zone") != schema.ABSTAIN)
    rows = rows.withColumns({"withheld_sct": F.when(enters, F.col("sct")), "withheld_confidence": F.when(enters, F.col("confidence")), "sct": F.when(~enters, F.col("sct"))})
    return rows.withColumns({"zone": F.col("d.zone"), "reason": F.col("d.reason")}).drop("d")


def _entered(rung: int, was: Column) -> Column:
    entry = F.struct(F.lit(rung).alias("rung"), was.alias("from"), F.col("zone").alias("to"), F.col("reason").alias("reason"))
    return F.when(was != F.col("zone"), F.array_append(F.coalesce("provenance", F.array().cast(_HISTORY)), entry)).otherwise(F.col("provenance"))


def marked(rung: int, before: DataFrame, after: DataFrame) -> DataFrame:
    """after with an entry of (stage, from, to, reason) in its provenance where the zone changed."""
    was = before.select("record_id", F.col("zone").alias("was"))
    return after.join(was, "record_id", "left").withColumn("provenance", _entered(rung, F.col("was"))).drop("was")


_HISTORY = "array<struct<rung:int,from:string,to:string,reason:string>>"
Stage = Callable[[DataFrame, dict[str, Any]], DataFrame]
#: Stages by number; numbers without one are reported as missing, never made up.
STAGES: dict[int, Stage] = {1: lambda df, ctx: apply_checks(df, ctx.get(1)), 2: lambda df, ctx: apply_abstention(df, ctx.get(2))}
NAMES = {0: "extraction", 1: "deterministic", 2: "abstention", 3: "retrieval", 4: "model", 5: "ensemble", 6: "human"}


def load(n: int, package: str = "sieveworks_stages") -> Stage | None:
    """Stage n: one of this package, else `apply` of the module r<n> of another one. None only if that very module is missing; what fails inside it fails here."""
    if n in STAGES:
        return STAGES[n]
    try:
        return importlib.import_module(f"{package}.r{n}").apply
    except ModuleNotFoundError as e:
        if e.name in (package, f"{package}.r{n}"):
            return None
        raise


def _with_history(rung: int, before: DataFrame, stage: Stage, settings: dict[int, dict[str, Any]]) -> DataFrame:
    """What the stage leaves, with an entry in the provenance of records whose zone changed."""
    if "provenance" not in before.columns:
        return stage(before, settings)
    after = stage(before.withColumn("zone_before", F.col("zone")), settings)
    if "zone_before" not in after.columns:
        return marked(rung, before, after)
    return after.withColumn("provenance", _entered(rung, F.col("zone_before"))).drop("zone_before")


@dataclass
class Run:
    """Lazy frames after each stage that ran, in order, and the stages that were asked for but don't exist."""

    order: list[int] = field(default_factory=list)
    snapshots: dict[Any, DataFrame] = field(default_factory=dict)
    missing: list[int] = field(default_factory=list)


def run(enriched: DataFrame, order: list[int], asked: list[int], settings: dict[int, dict[str, Any]] | None = None) -> Run:
    """The asked stages in the settings' order, each on what the one before left; provenance grows where zones change."""
    out, frame = Run(), enriched
    for n in (n for n in order if n in asked):
        stage = load(n)
        if stage is None:
            out.missing.append(n)
            continue
        frame = _with_history(n, frame, stage, settings or {})
        out.order.append(n)
        out.snapshots[n] = frame
    return out


def ablate(enriched: DataFrame, asked: list[int], settings: dict[int, dict[str, Any]] | None = None) -> Run:
    """Each stage alone on the same input (stage 0, which makes the input, is left out), beside the input itself."""
    out = Run(["input"], {"input": enriched.withColumns({"r1_verdict": F.lit(None).cast("string"), "r1_reason": F.lit(None).cast("string")})})
    for n in asked:
        if n and (stage := load(n)):
            frame = enriched if n == 1 else out.snapshots["input"]
            out.order.append(n)
            out.snapshots[n] = _with_history(n, frame, stage, settings or {})
        elif n:
            out.missing.append(n)
    return out
