"""The ledger of stage decisions, and what is counted from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema

#: Slices into which the range of a group's values is cut.
LEVELS = 4096


def entries(snapshot: DataFrame, run_id: str, rung: int, outcome: str = "judged") -> DataFrame:
    """One row for each record that a stage handled."""
    has = set(snapshot.columns)
    verdict = F.col("r1_verdict") if rung == 1 and "r1_verdict" in has else F.lit(None).cast("string")
    return snapshot.select(
        F.lit(run_id).alias("run_id"), F.lit(rung).alias("rung"), "doc_id", "record_id", "zone", F.lit(outcome).alias("outcome"), F.col("r1_reason" if rung == 1 and "r1_reason" in has else "reason").alias("reason"),
        *(F.lit(0).cast("long").alias(c) for c in ("tokens_in", "tokens_out", "api_calls")), *(F.lit(0.0).alias(c) for c in ("latency_ms", "usd", "human_minutes")),
        F.unix_timestamp().cast("double").alias("ts"), F.lit(None).cast("map<string,string>").alias("extra"), verdict.alias("verdict"),
    )


def p95(rows: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """The nearest-rank 95th percentile of the non-zero values of each group, ranks rounded half to even.

    Ranks come from counts: of values, then twice of LEVELS slices of the range in which the rank lies, and only the
    last slice is ranked value by value. Rows are combined before they are shuffled, and no group is sorted in one task.
    """
    counts = rows.filter(F.coalesce(F.col(value), F.lit(0.0)) != 0).groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").alias("total")
    place = F.least(F.col("total") - 1, F.bround(F.lit(0.95) * (F.col("total") - 1)).cast("long"))
    rest = counts.join(counts.groupBy(*by).agg(total).select(*by, place.alias("place")), by)
    for _ in range(2):
        rest = _slice(rest, by)
    up = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rest.withColumn("upto", F.sum("n").over(up))
    return ranked.filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place"))).select(*by, F.col("value").alias("p95"))


def _slice(counts: DataFrame, by: list[str]) -> DataFrame:
    """Of (by, value, n, place) the values in the slice of the range that holds the place, which then counts from there."""
    ends = counts.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    # Differences and quotients of doubles are rounded, but never out of order, so slices are.
    at = F.when(F.col("high") > F.col("low"), F.floor((F.col("value") - F.col("low")) / ((F.col("high") - F.col("low")) / LEVELS))).otherwise(F.lit(0)).cast("long")
    rows = counts.join(ends, by).withColumn("at", at)
    sums = rows.groupBy(*by, "at").agg(F.sum("n").alias("size"), F.first("place").alias("goal"))
    upto = F.sum("size").over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))  # LEVELS + 1 rows at most
    held = sums.withColumn("upto", upto).filter((F.col("upto") > F.col("goal")) & (F.col("upto") - F.col("size") <= F.col("goal")))
    held = held.select(*by, "at", (F.col("goal") - F.col("upto") + F.col("size")).alias("place"))
    return rows.drop("place", "low", "high").join(held, [*by, "at"]).select(*by, "value", "n", "place")


def ranked(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts with their places, most frequent first, ties by what is counted."""
    rest = [c for c in counts.columns if c not in (*by, "n")]
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), *rest)))


def cost_by_stage(rows: DataFrame, n_records: int | None = None) -> DataFrame:
    """For each stage the sums of the measures, rows, tokens a record, p95 seconds and reviews a hundred records."""
    n = F.lit(n_records) if n_records else F.col("records")
    sums = rows.groupBy("rung").agg(*(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "api_calls", "latency_ms", "usd", "human_minutes")), F.count("*").alias("records"), F.count_if(F.col("human_minutes") != 0).alias("reviewed"))
    out = sums.join(p95(rows, ["rung"]), "rung", "left")
    return out.select("*", ((F.col("tokens_in") + F.col("tokens_out")) / n).alias("tokens_per_record"), (F.coalesce("p95", F.lit(0.0)) / 1000).alias("p95_latency_s"), (100.0 * F.col("reviewed") / n).alias("reviews_per_100")).drop("p95")


def histogram(rows: DataFrame, column: str, rung: Column | int | None = None) -> DataFrame:
    """Counts of reasons or verdicts (without empty ones) or zones, of one stage or of each."""
    if rung is not None:
        rows = rows.filter(F.col("rung") == rung)
    if column != "zone":
        rows = rows.filter(F.coalesce(F.col(column), F.lit("")) != "")
    return rows.groupBy("rung", column).agg(F.count("*").alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.sum("api_calls").alias("api_calls"), (F.sum("latency_ms") / 1000).alias("wall_clock_s"), F.sum("usd").alias("usd"),
        F.sum("human_minutes").alias("human_minutes"), F.count_if(F.col("human_minutes") != 0).alias("reviewed"), F.count("*").alias("rows"),
    )


def snapshot_counts(snapshot: DataFrame, correct: Column | None = None, judged: str = "zone") -> DataFrame:
    """One row: zones (or verdicts), settled and answered records, and with a scorer the correct ones and the errors."""
    answered = ~F.col("zone").isin(schema.ABSTAIN, schema.REJECT) & (F.coalesce("sct", F.lit("")) != "")
    zone = lambda *z: F.count_if(F.col(judged).isin(*z))
    cells = [
        F.count("*").alias("n_records"), zone(schema.ACCEPT).alias("accept"), zone(schema.BAND).alias("band"), zone(schema.REJECT).alias("reject"), zone(schema.ABSTAIN).alias("abstained"),
        zone(schema.ESCALATE).alias("escalated"), zone(schema.VERIFIED, schema.RESOLVED).alias("verified"), F.count_if(~F.col("zone").isin(*schema.OPEN_ZONES)).alias("settled"), F.count_if(answered).alias("answered"),
    ]
    if correct is not None:
        cells.append(F.count_if(answered & correct).alias("correct"))
    out = snapshot.agg(*cells)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumn("coverage", ratio(F.col("answered"), F.col("n_records")))
    if correct is None:
        return out
    return out.withColumns({"corrupted": F.col("answered") - F.col("correct"), "f1_sct_strict": ratio(F.col("correct"), F.col("answered")), "yield": ratio(F.col("correct"), F.col("n_records")), "err_per_100": ratio(100 * (F.col("answered") - F.col("correct")), F.col("n_records"))})


def results(counted: DataFrame, costs: DataFrame) -> DataFrame:
    """Rows of snapshot counts (with rung and place) with costs, and the exchange rate to the row before: spend per error prevented.

    The table has one row a stage, so its window over all rows is of a handful of rows.
    """
    before = F.lag("corrupted").over(Window.orderBy("place"))
    rows = counted.join(costs.select("rung", "tokens_in", "tokens_out", "human_minutes", "tokens_per_record", "p95_latency_s", "reviews_per_100"), "rung", "left").withColumn("prevented", before - F.col("corrupted"))
    return rows.withColumns({
        "marginal_tokens_per_error": F.when(F.col("prevented") > 0, (F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))) / F.col("prevented")),
        "marginal_reviews_per_error": F.when(F.col("prevented") > 0, F.coalesce("human_minutes", F.lit(0.0)) / F.col("prevented")),
        "r1_reject_pct": F.when(F.col("rung") == 1, F.coalesce(F.try_divide(100.0 * F.col("reject"), F.col("n_records")), F.lit(0.0))),
    })
