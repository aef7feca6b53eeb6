"""Scorers: functions (records, gold) -> records with a boolean column `right`, named module:function and loaded when asked for."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from . import alignment

Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def load(spec: str | None) -> Scorer | None:
    """The scorer of "module:function" (`strict` without a function); None without a spec, so that accuracy stays blank."""
    if not spec:
        return None
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name or "strict")


def strict(records: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Right are records that match a gradable gold mention by their spans and give one of its codes."""
    mine = records.select("doc_id", F.col("record_id").alias("i_id"), F.col("spans").alias("fragments"), F.coalesce("sct", F.lit("")).alias("code"))
    mine = mine.withColumn("i", F.row_number().over(alignment.Window.partitionBy("doc_id").orderBy("i_id")))
    answers = gold.select("doc_id", F.col("idx").alias("j"), F.col("spans").alias("fragments"), "sct", "gold_kind").filter(F.col("gold_kind").isin(*schema.GRADABLE_KINDS))
    matched = alignment.align(mine, answers, threshold).select("doc_id", "i", "j")
    hit = matched.join(mine.select("doc_id", "i", "i_id", "code"), ["doc_id", "i"]).join(answers.select("doc_id", "j", "sct"), ["doc_id", "j"])
    hit = hit.filter(F.array_contains("sct", F.col("code"))).select(F.col("i_id").alias("record_id"), F.lit(True).alias("right")).distinct()
    return records.join(hit, "record_id", "left").withColumn("right", F.coalesce("right", F.lit(False)))
