"""Deterministic stratified splits of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allocation(sizes: dict[str, int], n: int) -> dict[str, int]:
    """n places dealt to strata in proportion, what is left to the largest remainders (ties by stratum). Strata are few."""
    total = sum(sizes.values()) or 1
    want = {k: n * v / total for k, v in sizes.items()}
    take = {k: int(w) for k, w in want.items()}
    for k in sorted(sizes, key=lambda k: (-(want[k] - take[k]), k)):
        if sum(take.values()) >= n:
            break
        take[k] += 1
    return take


def allocations(sizes: DataFrame, n: int) -> DataFrame:
    """allocation() as a plan: sizes has stratum and n_docs, one row a stratum."""
    total = Window.partitionBy(F.lit(1))
    want = F.lit(n) * F.col("n_docs") / F.sum("n_docs").over(total)
    rows = sizes.withColumn("want", want).withColumn("base", F.floor("want").cast("long"))
    rows = rows.withColumn("left", F.lit(n) - F.sum("base").over(total)).withColumn("place", F.row_number().over(total.orderBy(F.desc(F.col("want") - F.col("base")), "stratum")))
    return rows.select("stratum", "n_docs", (F.col("base") + (F.col("place") <= F.col("left")).cast("long")).alias("take"))


def assign(docs: DataFrame, seed: int = 42, n_dev: int = 40, n_test: int = 60) -> DataFrame:
    """doc_id, stratum and split: dev, then test, by the order of a keyed hash within the stratum; the rest is the pool.

    Only strata sizes come to the driver. Within a stratum no global sort is needed: documents are ranked only up to the
    places that dev and test take, by a top-k over the hash; everything else is pool by an anti join.
    """
    docs = docs.select("doc_id", "stratum", F.md5(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string"))).alias("draw"))
    sizes = {r["stratum"]: r["n"] for r in docs.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    dev, test = allocation(sizes, n_dev), None
    test = allocation({k: v - dev[k] for k, v in sizes.items()}, n_test) if sizes else {}
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("draw", "doc_id"))
    top = docs.withColumn("place", place).filter(F.col("place") <= max([1, *(dev[k] + test.get(k, 0) for k in sizes)]))
    name = F.lit("pool")
    for k in sizes:
        mine = F.col("stratum") == k
        name = F.when(mine & (F.col("place") <= dev[k]), F.lit("dev")).when(mine & (F.col("place") <= dev[k] + test.get(k, 0)), F.lit("test")).otherwise(name)
    chosen = top.withColumn("split", name).filter("split <> 'pool'").select("doc_id", "split")
    return docs.join(chosen, "doc_id", "left").select("doc_id", "stratum", F.coalesce("split", F.lit("pool")).alias("split"))
