"""Threshold sweeps: risk against coverage."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from .stages import decide


def sweep(records: DataFrame, correct: Column, cfg: dict[str, Any] | None = None, taus: list[float] | None = None) -> DataFrame:
    """One row for each threshold: answered, correct, and correct answers that were withheld.

    Each record is exploded into the few thresholds, which are a literal; counts combine before the shuffle.
    """
    taus = [i / 20 for i in range(21)] if taus is None else taus
    rows = records.withColumn("right", F.coalesce(correct, F.lit(False))).withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    held = decide(cfg, F.col("tau"))["zone"] == schema.ABSTAIN
    counts = rows.withColumn("held", held).groupBy("tau").agg(F.count("*").alias("n"), F.count_if(~F.col("held")).alias("answered"), F.count_if(~F.col("held") & F.col("right")).alias("correct"), F.count_if(F.col("held") & F.col("right")).alias("over_abstention"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return counts.withColumns({"coverage": ratio("answered", "n"), "selective_precision": ratio("correct", "answered"), "risk": F.coalesce(1 - F.try_divide(F.col("correct"), F.col("answered")), F.lit(0.0)), "yield": ratio("correct", "n")})


def area(curve: DataFrame) -> DataFrame:
    """The area under risk over coverage by trapezoids, over the span of coverage; 0 without a span. A curve has a row a threshold."""
    w = Window.orderBy("coverage", "risk")
    steps = curve.select("coverage", "risk", F.lag("coverage").over(w).alias("c0"), F.lag("risk").over(w).alias("r0"))
    total = steps.agg(F.sum((F.col("coverage") - F.col("c0")) * (F.col("risk") + F.col("r0")) / 2).alias("a"), (F.max("coverage") - F.min("coverage")).alias("span"))
    return total.select(F.when(F.col("span") > 0, F.col("a") / F.col("span")).otherwise(F.lit(0.0)).alias("aurc"))


def free_lunch(curve: DataFrame) -> DataFrame:
    """The strictest threshold that withholds something and nothing correct; no row without one."""
    return curve.filter("over_abstention = 0 and coverage < 1").orderBy(F.desc("tau")).limit(1)
