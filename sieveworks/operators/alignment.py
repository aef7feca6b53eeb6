"""Alignment of predicted and gold mentions by the overlap of their characters, and its scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as X


def candidates(pred: DataFrame, gold: DataFrame, threshold: float, hull: bool = False) -> DataFrame:
    """doc_id, i, j and iou of pairs in one document that overlap enough; with hull also lo and hi, which hold both. Both sides: doc_id, i (or j), fragments.

    Spans that can't meet are left out before their characters are compared.
    """
    edge = lambda df, n: df.withColumns({f"{n}0": F.array_min(F.transform("fragments", lambda p: p["s"])), f"{n}1": F.array_max(F.transform("fragments", lambda p: p["e"]))}).withColumnRenamed("fragments", f"f{n}")
    p, g = edge(pred.select("doc_id", "i", "fragments"), "p"), edge(gold.select("doc_id", "j", "fragments"), "g")
    near = p.join(g, (p["doc_id"] == g["doc_id"]) & (F.col("p0") < F.col("g1")) & (F.col("g0") < F.col("p1"))).select(p["doc_id"], "i", "j", X.iou(F.col("fp"), F.col("fg")).alias("iou"), F.least("p0", "g0").alias("lo"), F.greatest("p1", "g1").alias("hi"))
    near = near if hull else near.drop("lo", "hi")
    return near.filter((F.col("iou") >= threshold) & (F.col("iou") > 0))


def parted(pairs: DataFrame) -> DataFrame:
    """Pairs with `part` instead of lo and hi: pairs whose hulls don't touch share no mention, so they are matched apart."""
    order = Window.partitionBy("doc_id").orderBy("lo", "hi", "i", "j")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = pairs.withColumn("new", F.when(F.col("lo") < before, 0).otherwise(1))
    return rows.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new", "lo", "hi")


def _groups(pairs: DataFrame) -> list[str]:
    return ["doc_id", "part"] if "part" in pairs.columns else ["doc_id"]


def greedy(pairs: DataFrame) -> DataFrame:
    """Pairs chosen by falling overlap, then by i and j, each mention once: a fold over the sorted candidates of a document, or of each of its parts."""
    listed = pairs.groupBy(*_groups(pairs)).agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("cost"), "i", "j"))).alias("c"))
    start = F.array().cast("array<struct<cost:double,i:int,j:int>>")
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["i"] == x["i"]) | (y["j"] == x["j"]))
    chosen = F.aggregate("c", start, lambda acc, x: F.when(free(acc, x), F.array_append(acc, F.struct(x["cost"].alias("cost"), x["i"].cast("int").alias("i"), x["j"].cast("int").alias("j")))).otherwise(acc))
    return listed.select("doc_id", F.explode(chosen).alias("x")).select("doc_id", "x.i", "x.j", (-F.col("x.cost")).alias("iou"), F.lit("greedy").alias("matcher"))


def assignment(weights: list[list[float]]) -> list[tuple[int, int]]:
    """The matching of greatest total weight: shortest augmenting paths with potentials, for any shape."""
    n = max(len(weights), len(weights[0]) if weights else 0)
    if not n:
        return []
    cost = [[-weights[r][c] if r < len(weights) and c < len(weights[0]) else 0.0 for c in range(n)] for r in range(n)]
    row_pot, col_pot, match = [0.0] * n, [0.0] * n, [-1] * n  # match: the row of each column
    for r in range(n):
        slack, via, done = [float("inf")] * n, [-1] * n, [False] * n
        row, col = r, -1
        while True:
            for c in range(n):
                if not done[c] and (x := cost[row][c] - row_pot[row] - col_pot[c]) < slack[c]:
                    slack[c], via[c] = x, col
            nxt = min((c for c in range(n) if not done[c]), key=slack.__getitem__)
            step = slack[nxt]
            row_pot[r] += step
            for c in range(n):
                if done[c]:
                    row_pot[match[c]] += step
                    col_pot[c] -= step
                else:
                    slack[c] -= step
            done[nxt], col = True, nxt
            if match[col] < 0:
                break
            row = match[col]
        while col >= 0:
            match[col] = match[via[col]] if via[col] >= 0 else r
            col = via[col]
    return [(match[c], c) for c in range(n) if match[c] < len(weights) and c < len(weights[0])]


def optimal(pairs: DataFrame) -> DataFrame:
    """The pairs of a document with the greatest total overlap, found part by part."""

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(df["i"].unique()), sorted(df["j"].unique())
        known = {(a, b): w for a, b, w in zip(df["i"], df["j"], df["iou"], strict=True)}
        found = [(rows[a], cols[b]) for a, b in assignment([[known.get((r, c), 0.0) for c in cols] for r in rows])]
        kept = [(a, b, known[a, b]) for a, b in found if (a, b) in known]
        return pd.DataFrame({"doc_id": [df["doc_id"].iloc[0]] * len(kept), "i": [a for a, _, _ in kept], "j": [b for _, b, _ in kept], "iou": [w for *_, w in kept], "matcher": "optimal"})

    return pairs.groupBy(*_groups(pairs)).applyInPandas(solve, "doc_id string, i int, j int, iou double, matcher string")


def align(pred: DataFrame, gold: DataFrame, threshold: float = 0.5, matcher: str = "greedy") -> DataFrame:
    """Matched pairs. Those below the threshold never steer the matching."""
    pairs = candidates(pred, gold, threshold, True).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "iou", "lo", "hi")
    pairs = parted(pairs)
    return greedy(pairs) if matcher == "greedy" else optimal(pairs)


def spurious(pred: DataFrame, matched: DataFrame) -> DataFrame:
    return pred.join(matched, ["doc_id", "i"], "left_anti")


def missed(gold: DataFrame, matched: DataFrame) -> DataFrame:
    return gold.join(matched, ["doc_id", "j"], "left_anti")


def score(pred: DataFrame, gold: DataFrame, matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Span counts over all gold mentions, and code counts over the gradable ones, never fused; of the whole or by columns of matched."""
    by = by or []
    code = pred.select("doc_id", "i", F.coalesce("code", F.lit("")).alias("code"))
    answer = gold.select("doc_id", "j", "sct", F.coalesce("gold_kind", F.lit("single")).alias("gold_kind"))
    gradable = F.col("gold_kind").isin(*schema.GRADABLE_KINDS) & (F.coalesce(F.size("sct"), F.lit(0)) > 0)
    rows = matched.join(code, ["doc_id", "i"]).join(answer, ["doc_id", "j"]).withColumn("gradable", gradable).withColumn("right", F.array_contains("sct", F.col("code")))
    counts = rows.groupBy(*by).agg(F.count("*").alias("span_matched"), F.count_if(F.col("gradable") & F.col("right")).alias("code_correct"), F.count_if(F.col("gradable") & ~F.col("right")).alias("code_wrong"), F.count_if(~F.col("gradable")).alias("matched_ungradable"))
    totals = answer.agg(F.count("*").alias("n_gold"), F.count_if(gradable).alias("gold_gradable")).join(F.broadcast(pred.agg(F.count("*").alias("n_pred"))))
    c = F.col
    out = counts.join(F.broadcast(totals)).withColumns({"spurious": c("n_pred") - c("span_matched"), "missed": c("n_gold") - c("span_matched"), "span_precision": F.coalesce(F.try_divide(c("span_matched"), c("n_pred")), F.lit(0.0)), "span_recall": F.coalesce(F.try_divide(c("span_matched"), c("n_gold")), F.lit(0.0))})
    return out.withColumns({
        "span_f1": F.coalesce(F.try_divide(2 * c("span_precision") * c("span_recall"), c("span_precision") + c("span_recall")), F.lit(0.0)),
        "code_accuracy": F.try_divide(c("code_correct"), c("code_correct") + c("code_wrong")), "code_recall": F.try_divide(c("code_correct"), c("gold_gradable")),
    })


def sweep(pred: DataFrame, gold: DataFrame, thresholds: list[float]) -> Iterator[tuple[float, DataFrame]]:
    """Scores at each threshold."""
    for t in thresholds:
        yield t, score(pred, gold, align(pred, gold, t))


def sweep_table(pred: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """The scores of `sweep` with a column threshold, in one plan: pairs are found once, and each threshold matches its own."""
    levels = pred.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    pairs = candidates(pred, gold, min(thresholds), True).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter("iou >= threshold")
    # A document at a threshold is matched like a document of its own.
    own = pairs.select(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "threshold").alias("doc_id"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "iou", "lo", "hi")
    matched = greedy(parted(own)).select("doc_id.doc_id", "doc_id.threshold", "i", "j", "iou")
    some = score(pred, gold, matched, ["threshold"])
    names = [c for c in some.columns if c != "threshold"]
    none = score(pred, gold, matched.limit(0)).select(*(F.col(c).alias(f"none_{c}") for c in names))  # for thresholds that match nothing
    return levels.join(F.broadcast(none)).join(some, "threshold", "left").select("threshold", *(F.coalesce(c, f"none_{c}").alias(c) for c in names))
