"""The ledger as a stream: costs and histograms kept up to date while runs append to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema


def entries(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema.LEDGER).option("maxFilesPerTrigger", files_per_trigger).json(path)


def running_costs(rows: DataFrame) -> DataFrame:
    """Sums by run and stage; the state has a row for each of them."""
    return rows.groupBy("run_id", "rung").agg(*(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "api_calls", "latency_ms", "usd", "human_minutes")), F.count("*").alias("records"))


def windowed_counts(rows: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Zones by stage and time window; windows close once the watermark has passed."""
    timed = rows.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("window"), "rung", "zone").agg(F.count("*").alias("n"))


def start(rows: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return rows.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
