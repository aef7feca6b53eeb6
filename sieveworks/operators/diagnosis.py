"""Replays on the answer key: variants of the parameters, planted faults, backends against each other, A against B."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from .stages import audit, verdict

#: Named variants of the checks' parameters, and the kinds of planted faults.
VARIANTS: dict[str, dict[str, Any]] = {
    "default": {}, "contained": {"lexical_mode": "contained"}, "finding_all": {"finding_scope": "all"}, "no_finding": {"finding_check": False}, "reject_inactive": {"reject_inactive": True},
    "negation_reject": {"negation_action": "reject"}, "meddra_reject": {"meddra_check": "reject"},
}
FAULTS = ("hallucinated_code", "wrong_type_code", "span_shift", "span_fabricate", "plausible_wrong", "sibling_wrong", "meddra_hallucinated")


def calibrate(enriched: DataFrame, variants: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """variant, verdict, reason and entity_type with counts: one pass over one enrichment for all variants."""
    variants = VARIANTS if variants is None else variants
    judged = F.array(*(F.struct(F.lit(name).alias("variant"), verdict(cfg).alias("v")) for name, cfg in variants.items()))
    rows = enriched.select("entity_type", F.explode(judged).alias("x"))
    return rows.groupBy("x.variant", "x.v.verdict", "x.v.reason", "entity_type").agg(F.count("*").alias("n"))


def examples(rows: DataFrame, by: list[str], order: list[str], k: int = 6) -> DataFrame:
    """The first k rows of each group (Spark keeps k a task before it shuffles)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def draw(seed: int, kind: str, n: int | Column, key: str = "record_id") -> Column:
    """A number below n that depends on seed, kind and record only."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{kind}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return number % n


def pool(concepts: DataFrame, name: str, limit: int = 4000) -> DataFrame:
    """Up to `limit` ids, in order, as rows (place, id); a pool for planted faults is small by design."""
    top = concepts.select("id").distinct().orderBy("id").limit(limit)
    return top.select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("place"), F.col("id").alias(name))


def siblings(descriptions: DataFrame, concepts: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """code and up to k findings whose normalised term ends with the last word (of four letters or more) of the code's preferred term.

    Such a word is a suffix of the term's own last word, so terms meet the different words by equality on all of these
    suffixes. The first k + 1 findings of each word are kept, as no code loses more than itself, and only they meet the
    codes of that word. gold: code, preferred.
    """
    head = gold.select("code", F.lower(F.regexp_extract("preferred", r"(\S+)\s*$", 1)).alias("head")).filter(F.length("head") >= 4).distinct()
    finding = concepts.filter("is_finding and active").select(F.col("id").alias("concept_id"))
    last = F.regexp_extract("norm", r"(\S+)$", 1)
    own = descriptions.join(finding.hint("merge"), "concept_id", "left_semi").select("concept_id", last.alias("last")).filter(F.length("last") >= 4).distinct()
    ends = own.select("concept_id", F.explode(F.transform(F.sequence(F.lit(4), F.length("last")), lambda n: F.right("last", n))).alias("head"))
    first = ends.join(head.select("head").distinct().hint("merge"), "head", "left_semi").distinct()
    first = first.withColumn("at", F.row_number().over(Window.partitionBy("head").orderBy("concept_id"))).filter(F.col("at") <= k + 1).drop("at")
    pairs = head.join(first.hint("merge"), "head").filter(F.col("concept_id") != F.col("code"))
    place = F.dense_rank().over(Window.partitionBy("code").orderBy("concept_id")) - 1
    return pairs.select("code", place.cast("long").alias("place"), F.col("concept_id").alias("sibling")).filter(F.col("place") < k).distinct()


def plant(records: DataFrame, kind: str, non_findings: DataFrame, findings: DataFrame, near: DataFrame, seed: int = 42) -> DataFrame:
    """Coded records with a fault of this kind; `skipped` marks those that can't have one. Pools have places 0, 1, 2 ..."""
    rows = records.filter((F.coalesce("sct", F.lit("")) != "") & (F.col("sct") != schema.CONCEPT_LESS)).withColumn("gold_sct", F.col("sct"))
    keep = rows.withColumn("skipped", F.lit(False))
    if kind == "hallucinated_code":
        return keep.withColumn("sct", (F.lit(100_000_000) + draw(seed, kind, 900_000_000)).cast("string"))
    if kind == "span_shift":
        return keep.withColumn("spans", F.transform("spans", lambda p: F.struct((p["s"] + 2).alias("s"), (p["e"] + 2).alias("e"))))
    if kind == "span_fabricate":
        return keep.withColumn("text", F.concat("text", F.lit(" zenoprofen")))
    if kind == "meddra_hallucinated":
        has = F.coalesce("meddra", F.lit("")) != ""
        return rows.withColumn("skipped", ~has).withColumn("meddra", F.when(has, (F.lit(10_000_000) + draw(seed, kind, 90_000_000)).cast("string")))
    if kind == "sibling_wrong":
        sizes = near.groupBy("code").agg(F.count("*").alias("n_near"))
        rows = rows.join(sizes, rows["sct"] == sizes["code"], "left").drop("code").withColumn("place", F.when(F.col("n_near") > 0, draw(seed, kind, F.greatest("n_near", F.lit(1)))))
        other = near.select(F.col("code").alias("near_code"), "place", "sibling")
        rows = rows.join(other, (F.col("sct") == F.col("near_code")) & (rows["place"] == other["place"]), "left").drop("near_code", "place", "n_near")
        return rows.withColumn("skipped", F.col("sibling").isNull()).withColumn("sct", F.coalesce("sibling", "sct")).drop("sibling")
    from_pool = (non_findings if kind == "wrong_type_code" else findings).toDF("place", "drawn")
    n = from_pool.count()  # at most the pool's limit
    rows = rows.withColumn("place", draw(seed, kind, max(1, n))).join(from_pool, "place", "left").drop("place")
    return rows.withColumn("skipped", F.col("drawn").isNull() | ((F.lit(kind) == "plausible_wrong") & (F.col("drawn") == F.col("sct")))).withColumn("sct", F.coalesce("drawn", "sct")).drop("drawn")


def detection(judged: DataFrame, by: list[str]) -> DataFrame:
    """Counts of planted faults that were rejected, banded and accepted. judged has verdict and skipped."""
    live = lambda v: F.count_if(~F.col("skipped") & (F.col("verdict") == v))
    return judged.groupBy(*by).agg(F.count_if(~F.col("skipped")).alias("n"), F.count_if("skipped").alias("skipped"), live(schema.REJECT).alias("rejected"), live(schema.BAND).alias("banded"), live(schema.ACCEPT).alias("accepted")).withColumns({
        "detection_rate": F.coalesce(F.try_divide("rejected", "n"), F.lit(0.0)), "wrongly_accepted_rate": F.coalesce(F.try_divide("accepted", "n"), F.lit(0.0)),
    })


def backend_class(present: Column, active: Column, international: Column) -> Column:
    """Whether a code is in both backends, retired, in an extension only, or nowhere."""
    return F.when(~F.coalesce(present, F.lit(False)), F.lit("absent")).when(~active, F.lit("retired")).when(international, F.lit("both")).otherwise(F.lit("extension"))


def counted(enriched: DataFrame) -> DataFrame:
    """One row of what a replay of the answer key saw besides verdicts: inactive codes, mentions under a denial, and concept-less ones by verdict."""
    coded = (F.coalesce("sct", F.lit("")) != "") & (F.col("sct") != schema.CONCEPT_LESS)
    rows = enriched.select("sct", "cue", (coded & F.col("present") & ~F.col("active")).alias("retired"), verdict()["verdict"].alias("v"))
    none = lambda v: F.count_if((F.col("sct") == schema.CONCEPT_LESS) & (F.col("v") == v)).alias(f"concept_less_{v.lower()}")
    return rows.agg(F.count("*").alias("n"), F.count_if("retired").alias("inactive_seen"), F.count("cue").alias("negated_flagged"), *map(none, schema.VERDICTS))


def invisible(classes: DataFrame) -> DataFrame:
    """entity_type, n, how many the other backend can't see, and their percentage; a row of `all` comes first. classes: class, entity_type, n."""
    seen = F.coalesce(F.sum(F.when(F.col("class") == "both", F.col("n"))), F.lit(0))
    rows = classes.withColumn("entity_type", F.explode(F.array(F.lit("all"), F.col("entity_type")))).groupBy("entity_type").agg(F.sum("n").alias("n"), (F.sum("n") - seen).alias("invisible"))
    return rows.withColumn("pct", F.bround(100 * F.col("invisible") / F.col("n"), 2))


def sample_codes(codes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n of the different codes, drawn by a keyed hash, with their places."""
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), F.col("code")))
    top = codes.select("code").distinct().withColumn("draw", drawn).orderBy("draw", "code").limit(n)
    return top.select("code", F.row_number().over(Window.orderBy("draw", "code")).alias("place"))


def cross_checked(codes: DataFrame) -> DataFrame:
    """How often two backends agree, how often the class of a code predicts the other one, and what they disagree on. codes: code, here, there, class."""
    both = codes.withColumn("same", F.col("here") == F.col("there"))
    odd = F.array_sort(F.collect_list(F.when(~F.col("same"), F.col("code"))))  # of a sample
    return both.agg(F.count("*").alias("sampled"), F.count_if("same").alias("agreed"), F.count_if(F.col("there") == (F.col("class") == "both")).alias("predicted_correct"), odd.alias("disagreements"))


def masked(enriched: DataFrame, cfg: dict[str, Any] | None = None) -> DataFrame:
    """reason, how often it decided, how often it holds, and how many times the order of checks hid it."""
    rows = enriched.select(verdict(cfg)["reason"].alias("first"), audit(cfg)["reasons"].alias("all"))
    first = rows.filter("first is not null").groupBy(F.col("first").alias("reason")).agg(F.count("*").alias("n_verdict"))
    every = rows.select(F.explode("all").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_all"))
    both = every.join(first, "reason", "full").select("reason", F.coalesce("n_verdict", F.lit(0)).alias("n_verdict"), F.coalesce("n_all", F.lit(0)).alias("n_all"))
    return both.withColumn("masked", F.greatest(F.col("n_all") - F.col("n_verdict"), F.lit(0)))


def side_by_side(metrics: DataFrame) -> DataFrame:
    """metric, a and b of rows (mode, metric, value)."""
    return metrics.groupBy("metric").pivot("mode", ["A", "B"]).agg(F.sum("value")).select("metric", F.coalesce("A", F.lit(0)).alias("a"), F.coalesce("B", F.lit(0)).alias("b"))
