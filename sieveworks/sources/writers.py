"""Writers; Spark's committers publish whole outputs only."""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import readers

#: The columns of the results table.
RESULT_COLUMNS = (
    "rung layer n_records accept band reject abstained escalated verified settled coverage yield f1_sct_strict corrupted err_per_100 tokens_per_record p95_s reviews_per_100 "
    "marginal_tokens_per_error marginal_reviews_per_error r1_reject_pct r1_mode ci_low ci_high"
).split()
#: The digits after the point that the results table shows.
ROUNDED = {"coverage": 5, "yield": 5, "f1_sct_strict": 5, "err_per_100": 3, "tokens_per_record": 2, "p95_s": 4, "reviews_per_100": 2}


def vocabulary(concept: DataFrame, terms: DataFrame, path: str, force: bool = False, release: str = "") -> bool:
    """The vocabulary's tables and meta rows (key, value), published by one rename once all are written; False if one was there and stays.

    Terms are sorted by concept, for row-group pruning.
    """
    spark = concept.sparkSession
    if readers.there(spark, f"{path}/meta") and not force:
        return False
    building = f"{path}.building-{uuid.uuid4().hex}"
    concept.write.parquet(f"{building}/concept")
    terms.repartitionByRange("concept_id").sortWithinPartitions("concept_id").write.parquet(f"{building}/description")
    made, said = spark.read.parquet(f"{building}/concept"), spark.read.parquet(f"{building}/description")
    counts = made.agg(F.count("*").alias("concepts"), F.count_if("active").alias("active"), F.count_if("is_finding").alias("findings")).first().asDict() | {"descriptions": said.count()}
    meta = {"release": release, "built": time.strftime("%Y-%m-%dT%H:%M:%S")} | counts
    spark.createDataFrame([(k, str(v)) for k, v in meta.items()], "key string, value string").coalesce(1).write.json(f"{building}/meta")
    to, where = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, building))
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(to, True)
    if not files.rename(where, to):
        raise OSError(f"{building} can't become {path}")
    return True


def ledger(rows: DataFrame, path: str, append: bool = True) -> None:
    rows.write.mode("append" if append else "overwrite").partitionBy("run_id", "rung").json(path)


def records(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def results(rows: DataFrame, path: str) -> None:
    """A results table: a few rows, so one file, with blanks for what is unknown; rounded here only."""
    if "p95_latency_s" in rows.columns:
        rows = rows.withColumnRenamed("p95_latency_s", "p95_s")
    there = set(rows.columns)
    shown = lambda c: F.bround(F.col(f"`{c}`").cast("double"), ROUNDED[c]) if c in ROUNDED else F.col(f"`{c}`")
    cells = [(shown(c) if c in there else F.lit(None)).cast("string").alias(c) for c in RESULT_COLUMNS]
    rows.select(*cells).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="")


def split(name: str, ids: list[str], path: str, **meta: Any) -> None:
    Path(path).write_text(json.dumps({"split": name, "n_docs": len(ids), "doc_ids": ids} | meta, indent=1), encoding="utf-8")


def report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def manifest(settings: dict[str, Any], path: str) -> None:
    """The settings of a run, beside its results."""
    Path(path).write_text(json.dumps(settings, indent=1, sort_keys=True), encoding="utf-8")
