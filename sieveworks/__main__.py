"""Commands: build a vocabulary, freeze the splits, run the stages, run each alone, replay variants and faults, compare backends, check the gate.

    python -m sieveworks build --release DIR --out DIR
    python -m sieveworks init --corpus DIR --vocabulary DIR --out DIR
    python -m sieveworks run --corpus DIR --vocabulary DIR --out DIR [--predictions FILE] [--stages 1-2] [--manifest FILE] [--scorer MODULE:FUNCTION]
    python -m sieveworks ablate ... | calibrate --corpus DIR --vocabulary DIR --out DIR | probe ... | crosscheck ... --release DIR | gate
"""

from __future__ import annotations

import argparse
import sys
import time
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import diagnosis, ledger, scoring, splits, stages, vocabulary
from .plans import gate
from .session import session, shared_folder
from .sources import readers, writers

#: A code that a released vocabulary has, and one that none has.
PROBE_CODES = "162031009,999999999"


def build(spark: SparkSession, release: str, out: str, force: bool = False) -> None:
    at = lambda kind: readers.snapshot_file(release, f"sct2_{kind}_Snapshot", spark)
    concepts = readers.rf2_concepts(spark, at("Concept"))
    flagged = vocabulary.with_findings(concepts, readers.rf2_edges(spark, at("Relationship")))
    writers.vocabulary(flagged, readers.rf2_descriptions(spark, at("Description")), out, force, release)


def load(spark: SparkSession, path: str) -> vocabulary.Vocabulary:
    return vocabulary.Vocabulary(spark.read.parquet(f"{path}/concept"), vocabulary.term_arrays(spark.read.parquet(f"{path}/description")), "local", path)


def init(spark: SparkSession, a: argparse.Namespace) -> int:
    """The vocabulary knows a real code and not a made-up one; the splits are made once and then stay."""
    if not readers.there(spark, f"{a.vocabulary}/concept"):
        print(f"no vocabulary at {a.vocabulary}: build it first", file=sys.stderr)
        return 2
    real, fake = a.probe_codes.split(",")
    if not gate.resolves(load(spark, a.vocabulary), real, fake):
        print(f"the vocabulary should know {real} and not {fake}", file=sys.stderr)
        return 1
    docs, gold = readers.load_corpus(spark, a.corpus)
    if a.force or not readers.there(spark, f"{a.out}/test.json"):
        Path(a.out).mkdir(parents=True, exist_ok=True)
        split = splits.assign(docs.select("doc_id", X.family(F.col("grp")).alias("stratum"))).checkpoint()
        for name in ("dev", "test"):  # of fixed sizes
            writers.split(name, [r[0] for r in split.filter(F.col("split") == name).select("doc_id").orderBy("doc_id").collect()], f"{a.out}/{name}.json", seed=42)
        writers.records(split.filter("split = 'pool'").select("doc_id"), f"{a.out}/pool")
    for name in ("dev", "test"):
        ids = readers.split_ids(spark, f"{a.out}/{name}.json")
        print(f"split {name}: {ids.count()} documents, {gold.join(ids, 'doc_id', 'left_semi').count()} mentions")
    return 0


def _probe(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Every kind of fault planted into the answer key, and what the checks made of it."""
    docs, gold = readers.load_corpus(spark, a.corpus)
    v, codes = load(spark, a.vocabulary), readers.optional_code_list(spark, a.codes, quiet=True)
    records, terms = readers.gold_as_records(gold), spark.read.parquet(f"{a.vocabulary}/description")
    own = records.select(F.col("sct").alias("concept_id")).distinct().join(v.terms, "concept_id").select(F.col("concept_id").alias("code"), "preferred")
    near = diagnosis.siblings(terms, v.concept, own)
    pools = [diagnosis.pool(v.concept.filter(x), "id") for x in ("active and not is_finding", "active and is_finding")]

    def one(kind: str) -> DataFrame:
        cfg = {"meddra_check": "reject"} if kind == "meddra_hallucinated" else None
        bad = stages.enrich(diagnosis.plant(records, kind, *pools, near), docs, v, codes)
        return diagnosis.detection(bad.withColumn("verdict", stages.verdict(cfg)["verdict"]).withColumn("kind", F.lit(kind)), ["kind", "entity_type"])

    return reduce(DataFrame.unionByName, map(one, diagnosis.FAULTS))


def _crosscheck(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """How much of the answer key a backend of active international concepts can't see."""
    _, gold = readers.load_corpus(spark, a.corpus)
    c = readers.rf2_concepts(spark, readers.snapshot_file(a.release, "sct2_Concept_Snapshot", spark))
    c = c.select(F.col("id").alias("code"), "active", (F.col("module_id") == vocabulary.INTERNATIONAL).alias("international"), F.lit(True).alias("present"))
    rows = gold.filter(F.size("sct") > 0).select(F.get("sct", F.lit(0)).alias("code"), "entity_type").join(c, "code", "left")
    kind = diagnosis.backend_class(F.col("present"), F.col("active"), F.col("international"))
    return diagnosis.invisible(rows.groupBy(kind.alias("class"), "entity_type").agg(F.count("*").alias("n")))


def _input(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Records with all lookups, and the answer key."""
    docs, gold = readers.load_corpus(spark, a.corpus)
    if a.predictions:
        given = readers.records(spark, a.predictions).withColumn("position", F.monotonically_increasing_id())
        records = readers.backfilled(readers.guarded(given, docs.select("doc_id")))
    else:
        records = readers.gold_as_records(gold)
    rows = stages.enrich(records, docs, load(spark, a.vocabulary), readers.optional_code_list(spark, a.codes))
    return rows.drop("source"), gold  # grounding and denial are told; the texts need not travel on with every mention


def _write(done: stages.Run, out: str, right: Column | None = None, run_id: str = "run") -> None:
    counted, entries = [], []
    for place, n in enumerate(done.order):
        snap = done.snapshots[n]
        number = n if isinstance(n, int) else -1
        one = ledger.snapshot_counts(snap, right, "r1_verdict" if n == 1 else "zone").withColumns({"rung": F.lit(number), "layer": F.lit(stages.NAMES.get(n, str(n))), "place": F.lit(place)})
        counted.append(one if right is not None else one.withColumn("corrupted", F.lit(None).cast("long")))
        entries.append(ledger.entries(snap, run_id, number))
    rows = reduce(DataFrame.unionByName, entries)
    writers.ledger(rows, f"{out}/ledger", append=False)
    writers.results(ledger.results(reduce(DataFrame.unionByName, counted), ledger.cost_by_stage(rows)), f"{out}/results")
    for n in done.missing:
        print(f"stage {n} ({stages.NAMES.get(n, '?')}) doesn't exist here", file=sys.stderr)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("sieveworks", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["build", "init", "run", "ablate", "calibrate", "probe", "crosscheck", "gate"])
    for name in ("--release", "--out", "--corpus", "--vocabulary", "--predictions", "--codes", "--manifest", "--scorer"):
        p.add_argument(name)
    p.add_argument("--stages", default="1-2")
    p.add_argument("--probe-codes", default=PROBE_CODES)
    p.add_argument("--force", action="store_true")
    a = p.parse_args(args)
    spark = session()
    shared_folder(spark)
    try:
        scorer = scoring.load(a.scorer)
        if a.command == "init":
            return init(spark, a)
        if a.command == "gate":
            faults = gate.gate(spark)
            print("\n".join(faults) or "all records judged as expected")
            return int(bool(faults))
        if a.command == "build":
            build(spark, a.release, a.out, a.force)
            return 0
        settings = readers.manifest(a.manifest) if a.manifest else {"rungs": {}}
        cfg = {int(k): v for k, v in settings["rungs"].items()}
        if a.command == "calibrate":
            rows = _input(spark, a)[0].checkpoint()
            writers.report(diagnosis.calibrate(rows), f"{a.out}/calibration")
            writers.report(diagnosis.counted(rows), f"{a.out}/calibration-counts")
            writers.report(diagnosis.examples(rows.select("doc_id", "record_id", "text", "sct", "preferred", stages.verdict()["reason"].alias("reason")).filter("reason is not null"), ["reason"], ["record_id"]), f"{a.out}/calibration-examples")
            return 0
        if a.command in ("probe", "crosscheck"):
            writers.report((_probe if a.command == "probe" else _crosscheck)(spark, a), f"{a.out}/{a.command}")
            return 0
        asked = readers.stages_of(a.stages)
        rows, gold = _input(spark, a)
        rows = (scorer(rows, gold) if scorer else rows).checkpoint()  # all stages and counts read this
        done = stages.run(rows, list(settings.get("rung_order", asked)), asked, cfg) if a.command == "run" else stages.ablate(rows, asked, cfg)
        _write(done, a.out, F.col("right") if scorer else None, time.strftime(f"{a.command}-%Y%m%d-%H%M%S"))
        if a.manifest:
            writers.manifest(settings, f"{a.out}/manifest.json")
        return 0
    except FileNotFoundError as missing:
        print(f"not found: {missing}", file=sys.stderr)
        return 2
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"not found: {e.getMessage()}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
