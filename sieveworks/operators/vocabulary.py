"""Vocabularies: the closure of the is-a graph, concept flags, terms, lookup and retrieval."""

from __future__ import annotations

import contextlib
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed value: the root of findings in released vocabularies.
FINDING_ROOT = "404684003"
#: Fixed value: the module of the international edition.
INTERNATIONAL = "900000000000207008"
#: Fixed value: what is said of a code list that is the answer key's own.
CAVEAT = "every code in this table appears in the gold annotations and none do not: it is the answer key's code inventory, not a vocabulary"
STATUSES = ("finding", "not_finding", "unknown")


#: Hops that a round of the closure follows at most: more make fewer jobs of larger plans.
HOPS = 6


def swept(frame: DataFrame) -> DataFrame:
    """The frame, after a full collection in the driver, which gives back heap that planning and running it had filled and that nothing would return otherwise."""
    frame.sparkSession.sparkContext._jvm.System.gc()
    return frame


@contextlib.contextmanager
def _interpreted(spark: SparkSession) -> Iterator[None]:
    """No code of whole stages meanwhile: each hop's differs, and the driver would generate and compile it for a short run."""
    key = "spark.sql.codegen.wholeStage"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def closures(edges: DataFrame, root: str) -> DataFrame:
    """Rows (kind, id): for each kind of edge the root and all below it. edges: kind, parent, child.

    A search by breadth, of all kinds at once, until a round's last hop finds nothing new. A node carries the hop that
    found it in this round (-1: before it), and only nodes of the hop before are followed, each once; so cycles and
    diamonds end. A round follows several hops in one plan, twice as many as the round before up to HOPS, which shuffles
    the edges once, and is materialised with checkpoint(): it reads the round before and no earlier one. A round for each hop, over all the rounds before it, filled
    the driver with their plans and tasks; what a round leaves is swept after it. Nothing is broadcast: sizes are only guessed, from compressed files, and the
    driver would have to hold it.
    """
    with _interpreted(edges.sparkSession):
        edges = edges.select("kind", F.col("parent").alias("id"), "child").distinct().checkpoint()
        seen = edges.select("kind").distinct().select("kind", F.lit(root).alias("id"), F.lit(0).alias("hop")).checkpoint()
        follow = edges.withColumnsRenamed({"kind": "of", "id": "parent"}).hint("merge")
        hops = 1
        while not seen.filter("hop >= 0").isEmpty():
            for n in range(hops):
                below = (F.col("kind") == F.col("of")) & (F.col("id") == F.col("parent")) & (F.col("hop") == n)
                found = F.array(F.struct("id", "hop"), F.struct(F.col("child").alias("id"), F.lit(n + 1).alias("hop")))
                rows = seen.join(follow, below, "left").select("kind", F.explode(found).alias("x")).filter("x.id is not null")
                seen = rows.groupBy("kind", F.col("x.id").alias("id")).agg(F.min("x.hop").alias("hop"))
            seen = swept(seen.withColumn("hop", F.when(F.col("hop") == hops, 0).otherwise(-1)).checkpoint())
            hops = min(2 * hops, HOPS)
    return seen.select("kind", "id")


def closure(edges: DataFrame, root: str) -> DataFrame:
    """The root and all below it, over parent, child."""
    rows = closures(edges.select(F.lit("all").alias("kind"), "parent", "child"), root).select("id")
    return rows.union(edges.sparkSession.createDataFrame([(root,)], "id string")).distinct()


def with_findings(concepts: DataFrame, edges: DataFrame, root: str = FINDING_ROOT) -> DataFrame:
    """Concepts with is_finding (over active edges) and is_finding_hist (over all edges ever published)."""
    kinds = F.when(F.col("active"), F.array(F.lit("now"), F.lit("ever"))).otherwise(F.array(F.lit("ever")))
    found = closures(edges.select(F.explode(kinds).alias("kind"), "parent", "child"), root)
    flags = found.groupBy("id").agg(F.max(F.col("kind") == "now").alias("now"), F.max(F.col("kind") == "ever").alias("ever"))
    mine = lambda c: F.coalesce(c, F.lit(False)) | (F.col("id") == root)
    return concepts.join(flags.hint("merge"), "id", "left").withColumns({"is_finding": mine("now"), "is_finding_hist": mine("ever")}).drop("now", "ever")


def finding_status(present: Column, active: Column, now: Column, ever: Column) -> Column:
    """finding, not_finding or unknown: only an active concept outside the findings is surely none."""
    return F.when(~F.coalesce(present, F.lit(False)), F.lit("unknown")).when(now, F.lit("finding")).when(active, F.lit("not_finding")).when(ever, F.lit("finding")).otherwise(F.lit("unknown"))


def term_arrays(descriptions: DataFrame) -> DataFrame:
    """One row for each concept: its different normalised terms, and the preferred one.

    Preferred is the fully specified name without its tag, else the first other term as it is.
    """
    best = F.min_by("term", F.struct(~F.col("fsn"), "rowid"))
    made = descriptions.groupBy("concept_id").agg(F.array_sort(F.collect_set("norm")).alias("norms"), best.alias("best"), F.max("fsn").alias("has_fsn"))
    tag = r"(?U)\s*\([^()]*\)\s*$"
    return made.select("concept_id", "norms", F.when(F.col("has_fsn"), F.regexp_replace("best", tag, "")).otherwise(F.col("best")).alias("preferred"))


@dataclass
class Vocabulary:
    """A backend: concepts (id, active, is_finding, is_finding_hist) and terms (concept_id, norms, preferred)."""

    concept: DataFrame
    terms: DataFrame
    name: str = "local"
    release: str = ""
    lossy: bool = False
    meta: dict[str, int] = field(default_factory=dict)


REQUIRED = {"concept": ("id", "active", "is_finding", "is_finding_hist"), "terms": ("concept_id", "norms", "preferred")}


def conforms(v: object) -> list[str]:
    """What a backend lacks."""
    return [f"{part}.{c}" for part, columns in REQUIRED.items() for c in columns if c not in getattr(getattr(v, part, None), "columns", ())]


def restricted(v: Vocabulary, concepts_with_module: DataFrame, international: str = INTERNATIONAL) -> Vocabulary:
    """The view that a remote service has: active international concepts only."""
    seen = concepts_with_module.filter(F.col("active") & (F.col("module_id") == international)).select("id").hint("merge")
    return Vocabulary(v.concept.join(seen, "id", "left_semi"), v.terms.join(seen, v.terms["concept_id"] == seen["id"], "left_semi"), "remote", v.release, True)


_selected: dict[tuple, Vocabulary] = {}


def select(local: Callable[[], Vocabulary | None], remote: Callable[[], Vocabulary], prefer: str = "local") -> Vocabulary:
    """The preferred backend if it is there, else the other one, with a warning; an incomplete one fails here, not in a plan.

    With the default preference the choice is remembered for the process, by what would load it.
    """
    if prefer == "local" and (local, remote) in _selected:
        return _selected[local, remote]
    chosen = local() if prefer == "local" else None
    if chosen is None:
        chosen = remote()
        if chosen.lossy:
            warnings.warn(f"vocabulary {chosen.name}: active international concepts only, so codes of extensions and retired ones count as unknown", stacklevel=2)
    if missing := conforms(chosen):
        raise TypeError(f"the vocabulary {chosen.name} lacks {', '.join(missing)}")
    if prefer == "local":
        _selected[local, remote] = chosen
    return chosen


def stats(concepts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Counts of concepts, active ones, findings and descriptions."""
    c = concepts.agg(F.count("*").alias("concepts"), F.count_if("active").alias("active"), F.count_if("is_finding").alias("findings"), F.count_if("is_finding_hist").alias("findings_hist"))
    return c.join(F.broadcast(descriptions.agg(F.count("*").alias("descriptions"))))


def lexical_match(norms: Column, text: Column, mode: str = "exact") -> Column:
    """Whether a term of the concept equals the text or, if contained, has all its words or all of its words in it."""
    want = X.normalise_term(text)
    if mode == "exact":
        return F.coalesce((want != "") & F.array_contains(norms, want), F.lit(False))
    words = X.norm_words(want)
    inside = lambda t: (F.size(F.array_except(words, X.norm_words(t))) == 0) | (F.size(F.array_except(X.norm_words(t), words)) == 0)
    return F.coalesce((want != "") & F.exists(norms, lambda t: (t == want) | ((F.size(X.norm_words(t)) > 0) & inside(t))), F.lit(False))


def term_match(term: Column, text: Column, mode: str = "exact") -> Column:
    """lexical_match against the one term of another code list; false without a term."""
    norm = X.normalise_term(F.coalesce(term, F.lit("")))
    return lexical_match(F.when(norm != "", F.array(norm)), text, mode)


def plain_lexical_match(terms: Column, text: Column) -> Column:
    """Equality up to case and spacing only, as the remote service compares."""
    same = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    return F.coalesce(F.exists(terms, lambda t: same(t) == same(text)), F.lit(False))


def code_shape(code: Column) -> Column:
    return F.coalesce(code.rlike("^[0-9]{6,18}$"), F.lit(False))


def codes_for_terms(descriptions: DataFrame, queries: DataFrame) -> DataFrame:
    """query and code: concepts that have the query's normalised term."""
    wanted = queries.select("query", X.normalise_term(F.col("query")).alias("norm")).filter("norm <> ''")
    return wanted.join(descriptions.hint("merge"), "norm").select("query", F.col("concept_id").alias("code")).distinct()


def exact_search(descriptions: DataFrame, queries: DataFrame, rows: int = 5) -> DataFrame:
    """The first concepts, in row order, with the query's normalised term."""
    wanted = queries.select("query", X.normalise_term(F.col("query")).alias("norm")).filter("norm <> ''")
    found = wanted.join(descriptions, "norm").groupBy("query", F.col("concept_id").alias("code")).agg(F.min("rowid").alias("rowid"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rowid", "code"))
    return found.withColumn("place", place).filter(F.col("place") <= rows).select("query", "code", "place")


def jaccard_search(codes: DataFrame, queries: DataFrame, k: int = 5, mode: str = "answer_space") -> DataFrame:
    """The k codes whose terms share most words with the query, ties by code. A reference list must not be searched.

    Candidates come from an equi join on shared words, so no pair without a common word is ever made.
    """
    if mode != "answer_space":
        raise RuntimeError("only an answer space may be searched: a reference list would hand back the answer key")
    split = lambda df, key, text: df.select(F.col(key), X.norm_words(X.normalise_term(F.col(text))).alias("words"))
    c, q = split(codes, "code", "term").filter("size(words) > 0"), split(queries, "query", "query").filter("size(words) > 0").distinct()
    shared = q.select("query", F.size("words").alias("nq"), F.explode("words").alias("word")).join(c.select("code", F.size("words").alias("nc"), F.explode("words").alias("word")), "word")
    scored = shared.groupBy("query", "code").agg((F.count("*") / (F.first("nq") + F.first("nc") - F.count("*"))).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "code"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).withColumn("score", F.bround("score", 3))


def agreement(m: Column, s: Column) -> Column:
    """Whether two terms share a word; null if either is missing."""
    words = lambda c: X.norm_words(X.normalise_term(c))
    missing = m.isNull() | s.isNull() | (m == "") | (s == "")
    return F.when(missing, F.lit(None).cast("boolean")).otherwise(F.size(F.array_intersect(words(m), words(s))) > 0)


def leakage(table: DataFrame, gold_codes: DataFrame) -> DataFrame:
    """How much of a code list is the answer key's own inventory."""
    own, gold = table.select("code").distinct(), gold_codes.select("code").distinct().withColumn("hit", F.lit(1))
    counted = own.join(gold, "code", "left").agg(F.count("*").alias("n_codes"), F.count("hit").alias("n_also_in_gold"))
    return counted.select("n_codes", "n_also_in_gold", (F.col("n_codes") - F.col("n_also_in_gold")).alias("n_independent_of_gold"), (F.col("n_codes") == F.col("n_also_in_gold")).alias("derived_from_gold")).withColumn("caveat", F.when(F.col("derived_from_gold"), F.lit(CAVEAT)))
