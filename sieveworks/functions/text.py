"""Text, span and set functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ENTITY_TYPES

#: Words that don't count for lexical overlap.
STOP_WORDS = "the a an of my and or in on to was is were had have so very bit little some no not".split()

#: Fixed value: the group of documents that is a stratum of its own.
LARGE_GROUP = "LIPITOR"


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def token_bag(text: Column) -> Column:
    """The words, sorted: equal for texts that differ in case, spacing and order only."""
    return F.array_sort(words(text))


def normalise_term(term: Column) -> Column:
    """Without one trailing (tag), lower case, everything but letters, digits and _ as single spaces."""
    bare = F.regexp_replace(term, r"(?U)\s*\([^()]*\)\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def norm_words(norm: Column) -> Column:
    return F.filter(F.array_distinct(F.split(norm, " ")), lambda w: w != "")


def quoted(source: Column, spans: Column) -> Column:
    """The text of the spans, joined by spaces; offsets are code points, ends exclusive."""
    return F.array_join(F.transform(spans, lambda p: F.substring(source, p["s"] + 1, p["e"] - p["s"])), " ")


def span_reason(entity_type: Column, spans: Column, text: Column, source: Column) -> Column:
    """Why a mention isn't grounded in its source; null if it is."""
    per_span = F.transform(
        spans,
        lambda p: F.when(p["s"].isNull() | p["e"].isNull() | (p["s"] < 0) | (p["e"] <= p["s"]), F.lit("schema_invalid")).when(p["e"] > F.length(source), F.lit("span_out_of_range")),
    )
    first = F.get(F.filter(per_span, lambda r: r.isNotNull()), 0)
    malformed = ~F.coalesce(entity_type.isin(*ENTITY_TYPES), F.lit(False)) | (F.coalesce(F.size(spans), F.lit(0)) <= 0) | (F.coalesce(F.size(token_bag(text)), F.lit(0)) <= 0)
    return F.when(malformed, F.lit("schema_invalid")).when(first.isNotNull(), first).when(token_bag(quoted(source, spans)) != token_bag(text), F.lit("span_ungrounded"))


def is_grounded(entity_type: Column, spans: Column, text: Column, source: Column) -> Column:
    return span_reason(entity_type, spans, text, source).isNull()


def codes(body: Column) -> Column:
    """All runs of 6 to 18 digits that stand alone."""
    return F.regexp_extract_all(body, F.lit(r"\b\d{6,18}\b"), 0)


def span_list(body: Column) -> Column:
    """The offsets at the end of an annotation's body: `1 4;7 9`."""
    tail = F.regexp_extract(body, r"(\d+ \d+(?:\s*;\s*\d+ \d+)*)\s*$", 1)
    pairs = F.filter(F.split(tail, r"\s*;\s*"), lambda x: x != "")
    return F.transform(pairs, lambda x: F.struct(F.split_part(x, F.lit(" "), F.lit(1)).cast("int").alias("s"), F.split_part(x, F.lit(" "), F.lit(2)).cast("int").alias("e")))


def gold_kind(body: Column) -> Column:
    """How many codes an annotation names, and how they are joined; null without any."""
    n = F.size(codes(body))
    bare = F.trim(F.regexp_replace(F.upper(body), r"[|]", " "))
    return F.when(bare.startswith("CONCEPT_LESS"), F.lit("concept_less")).when(n == 1, F.lit("single")).when((n > 1) & body.rlike(r"(?i)\bor\b"), F.lit("any_of")).when(n > 1, F.lit("all_of"))


def split_row(line: Column) -> Column:
    """An annotation line as struct(tag, body, quoted): by tabs, else by runs of two or more white spaces, else tag and body."""
    tabs, wide = F.split(line, "\t"), F.split(F.rtrim(line), r"\s{2,}")
    rest = lambda parts, glue: F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), glue)
    made = lambda tag, body, text: F.struct(F.trim(tag).alias("tag"), F.trim(body).alias("body"), text.alias("quoted"))
    loose = F.split(F.trim(line), r"\s+", 2)
    return F.when(F.size(tabs) >= 3, made(F.get(tabs, 0), F.get(tabs, 1), rest(tabs, "\t"))).when(F.size(wide) >= 3, made(F.get(wide, 0), F.get(wide, 1), rest(wide, " "))).otherwise(
        made(F.get(loose, 0), F.coalesce(F.get(loose, 1), F.lit("")), F.lit(""))
    )


def tag_number(tag: Column) -> Column:
    """The digits of a tag as a number; 0 without any."""
    return F.coalesce(F.regexp_replace(tag, r"\D", "").try_cast("long"), F.lit(0).cast("long"))


def context(source: Column, spans: Column, pad: int = 45) -> Column:
    """The surroundings of a mention with white space squashed."""
    a = F.greatest(F.array_min(F.transform(spans, lambda p: p["s"])) - pad, F.lit(0))
    b = F.array_max(F.transform(spans, lambda p: p["e"])) + pad
    return F.trim(F.regexp_replace(F.substring(source, a + 1, b - a), r"(?U)\s+", " "))


def overlap_words(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), 0))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 if either side is empty or missing."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def lexical_overlap(text: Column, label: Column) -> Column:
    return jaccard(overlap_words(text), overlap_words(label))


def positions(fragments: Column) -> Column:
    """The character positions of fragments, each once."""
    full = F.filter(fragments, lambda p: p["e"] > p["s"])
    return F.array_distinct(F.flatten(F.transform(full, lambda p: F.sequence(p["s"], p["e"] - 1))))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two fragment lists' positions."""
    return jaccard(positions(a), positions(b))


def _nearest(span: Column, source: Column, anchor: Column) -> Column:
    """struct(at, n, d, h): how many places the span stands at, overlapping ones too, and the one nearest to the anchor (the first of two)."""
    # The pieces between places: a split before every place, so their lengths add up to the places.
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(span, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), none.alias("d"), none.alias("h"))

    def step(acc: Column, size: Column) -> Column:
        hit = (acc["at"] > 0) | source.startswith(span)
        far = F.abs(acc["at"] - anchor).cast("int")
        better = hit & (acc["d"].isNull() | (far < acc["d"]))
        return F.struct((acc["at"] + size).alias("at"), (acc["n"] + hit.cast("int")).alias("n"), F.when(better, far).otherwise(acc["d"]).alias("d"), F.when(better, acc["at"]).otherwise(acc["h"]).alias("h"))

    return F.aggregate(F.transform(F.split(source, quoted), F.length), start, step)


def recover_offsets(span: Column, source: Column, claimed: Column) -> Column:
    """struct(s, e, how): where a quoted span stands; of several places the one nearest to the claim. One pass over the source."""
    n = F.length(span)
    anchor = F.when(claimed >= 0, claimed).otherwise(F.lit(0))
    low = F.instr(F.lower(source), F.lower(span)) - 1
    at = lambda s, how: F.struct(s.cast("int").alias("s"), (s + n).cast("int").alias("e"), how.alias("how"))
    none = lambda how: F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(how).alias("how"))
    said = lambda k: F.when(k == 1, F.lit("search_unique")).otherwise(F.concat(F.lit("search_nearest_of_"), k.cast("string")))
    exact = F.get(F.transform(F.array(_nearest(span, source, anchor)), lambda x: at(x["h"], said(x["n"]))), 0)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, none("empty"))
        .when((F.instr(source, span) == 0) & (low < 0), none("not_in_source"))
        .when(F.instr(source, span) == 0, at(low, F.lit("search_case_insensitive")))
        .otherwise(exact)
    )


def honoured_tool(code: Column, results: Column) -> Column:
    """Whether the emitted code is among the tool's results; null without results."""
    return F.when(F.coalesce(F.size(results), F.lit(0)) <= 0, F.lit(None).cast("boolean")).otherwise(F.coalesce(F.exists(results, lambda r: r["code"] == F.coalesce(code, F.lit("None"))), F.lit(False)))


def family(group: Column) -> Column:
    """The two strata of documents, by group."""
    return F.when(group == LARGE_GROUP, F.lit("lipitor")).otherwise(F.lit("diclofenac"))


def dollars(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost at prices for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def cache_key(*fields: Column) -> Column:
    """sha256 of the canonical JSON of the fields, which are aliased columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def iri_key(code: Column) -> Column:
    """A code's IRI, encoded twice for use in a path, as ontology services want it."""
    return F.url_encode(F.url_encode(F.concat(F.lit("http://snomed.info/id/"), code)))


def response_key(key: Column) -> Column:
    """A cache key as a file name: unusual characters as _, at most 180 characters."""
    return F.substring(F.regexp_replace(key, r"[^A-Za-z0-9_.-]", "_"), 1, 180)
