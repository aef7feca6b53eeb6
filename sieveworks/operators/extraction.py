"""The extraction harness: a model callable for each document, then plain columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import readers

#: A model: (prompt, text, mode) -> (raw output, tokens in, tokens out).
Model = Callable[[str, str, str], tuple[str, int, int]]


def prompt(mode: Column) -> Column:
    """The prompts of A and B differ in the tool block only."""
    base = 'List every adverse reaction and drug mention as JSON: {"mentions":[{"span_text","start","end","code","confidence"}]}.'
    return F.concat(F.lit(base), F.when(mode == "B", F.lit(" Use the search tool to look codes up.")).otherwise(F.lit("")))


def call(docs: DataFrame, model: Model, mode: str) -> DataFrame:
    """doc_id, raw, tokens_in and tokens_out of a model; batches stream through, one document at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [model(p, t, mode) for p, t in zip(f["prompt"], f["text"], strict=True)]
            yield pd.DataFrame({"doc_id": f["doc_id"], "raw": [x[0] for x in out], "tokens_in": [x[1] for x in out], "tokens_out": [x[2] for x in out]})

    asked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), prompt(F.lit(mode)).alias("prompt"))
    return asked.mapInPandas(run, "doc_id string, raw string, tokens_in long, tokens_out long")


def records(raw: DataFrame, docs: DataFrame) -> DataFrame:
    """Records of model output, with offsets found by search rather than believed."""
    rows = readers.mentions_of(raw).join(docs.select("doc_id", "text"), "doc_id")
    at = X.recover_offsets(F.col("span_text"), F.col("text"), F.col("start"))
    rows = rows.withColumn("at", at)
    return rows.select("doc_id", F.lit("reaction").alias("entity_type"), F.col("span_text").alias("text"), F.array(F.struct(F.col("at.s").alias("s"), F.col("at.e").alias("e"))).alias("spans"), F.col("code").alias("sct"), F.lit(None).cast("string").alias("meddra"), "confidence", F.lit("NEW").alias("zone"), F.lit(None).cast("string").alias("reason"), F.concat("doc_id", F.lit("#p"), F.col("pos").cast("string")).alias("record_id"), F.col("at.how").alias("offsets"))


def totals(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count("*").alias("documents"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if(readers.parse_failed(F.col("raw"))).alias("parse_failures"))
