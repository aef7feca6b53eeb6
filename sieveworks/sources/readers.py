"""Readers: annotated corpora, vocabulary releases, code lists, records, ledgers, run settings."""

from __future__ import annotations

import json
import warnings
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as X

#: Fixed values of the release format: the is-a relation and the type of fully specified names.
IS_A, FSN_TYPE = "116680003", "900000000000003001"


def there(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder meets the pattern, in whatever store it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return len(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or ()) > 0


def documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, grp and text of every text/*.txt under the root; a missing folder is an error, one without files gives no rows."""
    if not there(spark, f"{root}/text"):
        raise FileNotFoundError(f"{root}/text")
    if not there(spark, f"{root}/text/*.txt"):
        return spark.createDataFrame([], schema.DOC)
    raw = spark.read.text(f"{root}/text/*.txt", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))
    return raw.select("doc_id", F.split_part("doc_id", F.lit("."), F.lit(1)).alias("grp"), "text")


def annotation_lines(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """doc_id and line of a layer's *.ann files; a layer that is missing, or has none, is empty."""
    if not there(spark, f"{root}/{layer}/*.ann"):
        return spark.createDataFrame([], "doc_id string, line string")
    return spark.read.text(f"{root}/{layer}/*.ann").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.ann$", 1).alias("doc_id"), F.col("value").alias("line"))


def type_layer(lines: DataFrame) -> DataFrame:
    """doc_id, tag and src_type of the T rows."""
    parts = F.split("line", "\t")
    rows = lines.filter(F.col("line").startswith("T")).select("doc_id", F.get(parts, 0).alias("tag"), F.regexp_extract(F.get(parts, 1), r"^(\w+)\s+[\d ;]+$", 1).alias("src_type"))
    return rows.filter("src_type <> ''")


def code_layer(lines: DataFrame) -> DataFrame:
    """doc_id, tag, codes, gold_kind, spans and quoted text; rows without offsets, or with neither a code nor CONCEPT_LESS, are left out."""
    rows = lines.filter(F.trim("line") != "").select("doc_id", X.split_row(F.col("line")).alias("r"))
    head = F.regexp_replace("r.body", r"(\d+ \d+(?:\s*;\s*\d+ \d+)*)\s*$", "")
    rows = rows.select("doc_id", "r.tag", X.span_list(F.col("r.body")).alias("spans"), head.alias("head"), F.col("r.quoted").alias("quoted"))
    kind = X.gold_kind(F.col("head"))
    return rows.select("doc_id", "tag", F.when(kind == "concept_less", F.array().cast("array<string>")).otherwise(X.codes(F.col("head"))).alias("codes"), kind.alias("gold_kind"), "spans", "quoted").filter(
        "gold_kind is not null and size(spans) > 0"
    )


def entity_type(src_type: Column) -> Column:
    """Corpus types folded into record types; unknown ones are reactions."""
    return F.when(src_type == "Drug", F.lit("drug")).otherwise(F.lit("reaction"))


def gold(codes: DataFrame, types: DataFrame, meddra: DataFrame) -> DataFrame:
    """Gold mentions: code rows with the type of their tag (ADR without one) and the codes of the second layer, numbered within a document."""
    typed = types.select("doc_id", F.col("tag").alias("type_tag"), "src_type")
    other = meddra.select("doc_id", "tag", F.col("codes").alias("meddra"))
    rows = codes.withColumn("type_tag", F.concat(F.lit("T"), F.expr("substring(tag, 3)"))).join(typed, ["doc_id", "type_tag"], "left").join(other, ["doc_id", "tag"], "left")
    order = Window.partitionBy("doc_id").orderBy(X.tag_number(F.col("tag")), "tag")
    rows = rows.withColumn("idx", F.row_number().over(order) - 1).withColumn("src_type", F.coalesce("src_type", F.lit("ADR")))
    return rows.select(
        "doc_id", "idx", F.concat("doc_id", F.lit("#"), F.col("idx").cast("string")).alias("record_id"), entity_type(F.col("src_type")).alias("entity_type"), "src_type",
        F.col("quoted").alias("text"), "spans", F.col("codes").alias("sct"), "gold_kind", F.coalesce("meddra", F.array().cast("array<string>")).alias("meddra"),
    )


def load_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Documents and gold mentions of a corpus folder."""
    read = lambda layer: annotation_lines(spark, root, layer)
    return documents(spark, root), gold(code_layer(read("sct")), type_layer(read("original")), code_layer(read("meddra")))


def gold_as_records(mentions: DataFrame) -> DataFrame:
    """Gold as predictions: the first code or CONCEPT_LESS, the first other code, full confidence."""
    return mentions.select(
        "doc_id", "entity_type", "text", "spans", F.coalesce(F.get("sct", F.lit(0)), F.lit(schema.CONCEPT_LESS)).alias("sct"), F.get("meddra", F.lit(0)).alias("meddra"), F.lit(1.0).alias("confidence"),
        F.lit(schema.NEW).alias("zone"), F.lit(None).cast("string").alias("reason"), "record_id",
    )


def snapshot_file(release: str, prefix: str, spark: SparkSession | None = None) -> str:
    """The first file, by path, with the prefix anywhere under the release; given a session, in any store that Spark reads."""
    found = sorted(str(p) for p in Path(release).rglob(f"{prefix}*.txt")) if spark is None else []
    if spark is not None and there(spark, release):
        where = spark._jvm.org.apache.hadoop.fs.Path(release)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().startswith(prefix) and path.getName().endswith(".txt"):
                found.append(path.toString())
        found.sort()
    if not found:
        raise FileNotFoundError(f"{prefix}*.txt is nowhere under {release}")
    return found[0]


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="", escape="")


def rf2_concepts(spark: SparkSession, path: str) -> DataFrame:
    c = _tsv(spark, path)
    return c.select(F.col("id"), (F.col("active") == "1").alias("active"), F.col("moduleId").alias("module_id"))


def rf2_edges(spark: SparkSession, path: str) -> DataFrame:
    r = _tsv(spark, path).filter(F.col("typeId") == IS_A)
    return r.select(F.col("destinationId").alias("parent"), F.col("sourceId").alias("child"), (F.col("active") == "1").alias("active"))


def rf2_descriptions(spark: SparkSession, path: str) -> DataFrame:
    d = _tsv(spark, path).filter(F.col("active") == "1")
    return d.select(F.col("conceptId").alias("concept_id"), "term", X.normalise_term(F.col("term")).alias("norm"), (F.col("typeId") == FSN_TYPE).alias("fsn"), F.col("id").try_cast("long").alias("rowid"))


def code_list(spark: SparkSession, path: str) -> DataFrame:
    """code and term of a CSV with meddra_code and meddra_term; blank codes go, of equal codes the last row stays."""
    raw = spark.read.csv(path, header=True).select(F.trim("meddra_code").alias("code"), F.trim("meddra_term").alias("term"), F.monotonically_increasing_id().alias("row"))
    return raw.filter("code <> ''").groupBy("code").agg(F.max_by("term", "row").alias("term"))


def optional_code_list(spark: SparkSession, path: str | None, quiet: bool = False) -> DataFrame | None:
    """None where no path is given, or (with a warning) where nothing is there: the checks that need it are then off."""
    if not path:
        return None
    if there(spark, path):
        return code_list(spark, path)
    if not quiet:
        warnings.warn(f"no code list at {path}: its checks are off", stacklevel=2)
    return None


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records as JSON lines; unknown fields are dropped, missing ones null."""
    return spark.read.schema(schema.RECORD).json(path)


def backfilled(predictions: DataFrame) -> DataFrame:
    """Records with ids; a blank one becomes doc_id#p and the column `position`."""
    return predictions.withColumn("record_id", F.coalesce(F.nullif("record_id", F.lit("")), F.concat("doc_id", F.lit("#p"), F.col("position").cast("string"))))


def outside(predictions: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of predictions that are not in the split."""
    return predictions.join(ids.select("doc_id"), "doc_id", "left_anti").select("doc_id").distinct()


def guarded(predictions: DataFrame, ids: DataFrame) -> DataFrame:
    """Predictions, or an error that names three documents outside the split."""
    found = outside(predictions, ids)
    some = [r[0] for r in found.orderBy("doc_id").limit(3).collect()]
    if some:
        raise ValueError(f"predictions for {found.count()} documents outside the split, such as {', '.join(map(str, some))}")
    return predictions


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.LEDGER).json(path)


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True).select(F.explode("doc_ids").alias("doc_id"))


def items(docs: DataFrame, ids: DataFrame, split: str = "dev", first: int = 0) -> DataFrame:
    """Documents of a split for a model run: never of the test split; the first n by id, all for n <= 0."""
    if split == "test":
        raise ValueError("the test split is not for model runs")
    chosen = docs.join(ids, "doc_id", "left_semi")
    return chosen.orderBy("doc_id").limit(first) if first > 0 else chosen


def manifest(path: str) -> dict[str, Any]:
    """Run settings, with paths made absolute beside the file."""
    own = json.loads(Path(path).read_text(encoding="utf-8"))
    own.setdefault("rungs", {})
    for key, value in own.get("paths", {}).items():
        if value and not Path(value).is_absolute():
            own["paths"][key] = str(Path(path).resolve().parent / value)
    return own


def stages_of(spec: str) -> list[int]:
    """Numbers of "0-6" or "1,2"."""
    found: list[int] = []
    for part in spec.split(","):
        a, _, b = part.strip().partition("-")
        found += range(int(a), int(b or a) + 1)
    return found


def mentions_of(raw: DataFrame) -> DataFrame:
    """Model output (doc_id, raw) as mentions; what doesn't parse as an object with mentions is counted by `parse_failures`, never repaired."""
    kind = "struct<mentions:array<struct<span_text:string,start:int,end:int,code:string,confidence:double>>>"
    parsed = raw.select("doc_id", F.from_json("raw", kind).alias("x")).select("doc_id", F.posexplode("x.mentions").alias("pos", "m"))
    return parsed.select("doc_id", "pos", F.coalesce("m.span_text", F.lit("")).alias("span_text"), F.coalesce("m.start", F.lit(-1)).alias("start"), F.coalesce("m.end", F.lit(-1)).alias("end"), "m.code", F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"))


def parse_failed(raw: Column) -> Column:
    """Whether model output is no JSON object."""
    return F.try_parse_json(raw).isNull() | ~F.trim(raw).startswith("{")


def prices(path: str, overrides: dict[str, dict[str, float]] | None = None) -> dict[str, dict[str, float]]:
    """Prices for a million tokens in and out by model, of a JSON (or, where the library is there, YAML) file, with overrides."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        own = yaml.safe_load(text)
    else:
        own = json.loads(text)
    return {m: {"in": 0.0, "out": 0.0} | own.get("models", own).get(m, {}) | (overrides or {}).get(m, {}) for m in {*own.get("models", own), *(overrides or {})}}
