"""URL filters: explicit rules, and for the rest a naive Bayes score of segmented host and path words.

Names are split at everything but letters and digits, then into words by a unigram Viterbi search (`cheappills` is
cheap + pills). Word counts come from the visible text of all pages. Every distinct run of letters meets the lexicon by
a join on its own substrings, so the lexicon may have any size and is never sent whole to a task.

Multinomial naive Bayes scores the words. No list of good or bad names is built in: it learns from the urls that the
rules decide (and from labelled urls of one's own, `examples`), all of them, and judges those that no rule fits. Words
that it never saw count for neither side. Counts, weights and scores are aggregates over distinct runs and words.

Rules are `host/path` texts; a rule fits its host and all subdomains if the url's path starts with the rule's, and the
longest one that fits decides. The rules are meant to be few (they become one CASE expression).

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and the verdict of no words
(the prior's). Without any labelled url every score is the prior's. Rows that repeat repeat and count each, ties between
rules of equal length go to the one given first, no rows give no rows, and other columns are left out. Urls and pages of
any length are judged whole; capital letters other than A-Z and all else but a-z and 0-9 part words.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Cost of an unknown run of letters: a word that occurs less than once, and as much for each letter.
UNKNOWN, LETTER = 1.0, 2.5
SMOOTHING, BLOCK_PRIOR = 0.5, 0.2
_RUNS = r"[a-z]+|[0-9]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; then up to ?, # or the end."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(reversed(list(rules)), key=lambda x: len(x[0])):
        own, _, begin = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """Rows (word, n): the a-z words in the pages' visible text."""
    text = F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return common.only(pages, html="string").select(F.explode(F.regexp_extract_all(text, F.lit(r"[a-z]+"), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def split(run: str, edges: Iterable[tuple[int, int, int]], total: int) -> list[str]:
    """The likeliest words of a run of letters. edges: begin, end and count of the known words in it; what no word covers stays together."""
    n = len(run)
    unknown = math.log(max(total, 1)) + UNKNOWN
    into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for begin, end, count in edges:
        into[end].append((begin, math.log(total / count)))
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    least, at = 0.0, 0  # of best[i] - LETTER * i, so that unknown runs of all lengths take one step
    for end in range(1, n + 1):
        best[end], back[end] = least + unknown + LETTER * end, at
        for begin, cost in into[end]:
            if best[begin] + cost < best[end]:
                best[end], back[end] = best[begin] + cost, begin
        if best[end] - LETTER * end < least:
            least, at = best[end] - LETTER * end, end
    words, end = [], n
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (run, words) of the distinct runs: letters in words, digits as they are. counts: word, n."""
    runs = runs.select("run").distinct()
    letters = runs.filter(F.col("run").rlike("^[a-z]"))
    known = counts.agg(F.sum("n").alias("total"), F.collect_set(F.length("word")).alias("sizes"))  # as many lengths as words have, no more
    sized = letters.crossJoin(F.broadcast(known)).select("run", "total", F.explode(F.filter("sizes", lambda x: x <= F.length("run"))).alias("size"))
    parts = sized.select("run", "total", "size", F.explode(F.sequence(F.lit(1), F.length("run") - F.col("size") + 1)).alias("at"))
    parts = parts.select("run", "total", "size", "at", F.substring(F.col("run"), F.col("at"), F.col("size")).alias("word"))
    met = parts.join(counts, "word").groupBy("run", "total").agg(F.collect_list(F.struct((F.col("at") - 1).alias("begin"), (F.col("at") - 1 + F.col("size")).alias("end"), "n")).alias("edges"))

    def run_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("run", "total", "edges")), strict=True)
            found = [split(r, [(e["begin"], e["end"], e["n"]) for e in edges], total) for r, total, edges in rows]
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(found, pa.list_(pa.string()))], names=["run", "words"])

    done = met.mapInArrow(run_of, "run string, words array<string>")
    return runs.join(done, "run", "left").select("run", F.coalesce("words", F.array("run")).alias("words"))


def weights(labelled: DataFrame, segments: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """Rows (word, weight) of multinomial naive Bayes. labelled: run, blocked (boolean), times."""
    pairs = labelled.join(segments, "run").select(F.explode("words").alias("word"), "blocked", "times")
    n = lambda which: F.coalesce(F.sum(F.when(which, F.col("times"))), F.lit(0)).cast("double")
    words = pairs.groupBy("word").agg(n(F.col("blocked")).alias("b"), n(~F.col("blocked")).alias("a"))
    sums = words.agg(F.sum("b").alias("all_b"), F.sum("a").alias("all_a"), F.count("*").alias("size"))
    share = lambda x, y: F.log((F.col(x) + smoothing) / (F.col(y) + smoothing * F.col("size")))
    return words.crossJoin(F.broadcast(sums)).select("word", (share("b", "all_b") - share("a", "all_a")).alias("weight"))


def _runs(host: Column, path: Column) -> Column:
    """The runs of a url, in order."""
    found = lambda c: F.regexp_extract_all(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_RUNS), 0)
    return F.concat(found(host), found(path))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, counts: DataFrame | None = None, examples: DataFrame | None = None, prior: float = BLOCK_PRIOR) -> DataFrame:
    """page_id, host, path, rule, verdict, and the words and score of the classifier. counts: word, n, instead of the pages' own; examples: url, blocked (boolean), besides the urls that rules decide."""
    host, path = host_and_path(F.col("url"))
    parts = common.only(pages, page_id="long", url="string").select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.select("*", rule.alias("rule"), says.alias("says"))
    # Equal urls have equal results: the words travel once for each distinct host and path, by run, and come back by a hash of both.
    key = F.xxhash64("host", "path")
    urls = judged.groupBy("host", "path", "says").agg(F.count("*").alias("times")).select("*", _runs(F.col("host"), F.col("path")).alias("runs"))
    labelled = urls.filter("says is not null").select(F.explode("runs").alias("run"), (F.col("says") == "block").alias("blocked"), "times")
    runs = urls.select(F.explode("runs").alias("run"))
    if examples is not None:
        own_host, own_path = host_and_path(F.col("url"))
        own = common.only(examples, url="string", blocked="boolean").filter("blocked is not null").select(F.explode(_runs(own_host, own_path)).alias("run"), "blocked", F.lit(1).cast("long").alias("times"))
        labelled, runs = labelled.unionByName(own), runs.unionByName(own.select("run"))
    segments = common.cut(segmented(runs, common.cut(word_counts(pages)) if counts is None else counts))
    known = weights(labelled.groupBy("run", "blocked").agg(F.sum("times").alias("times")), segments)
    scored = segments.select("run", "words", F.explode("words").alias("word")).join(known, "word", "left").groupBy("run").agg(F.first("words").alias("words"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    scored = common.cut(scored)
    each = urls.select("host", "path", F.posexplode("runs").alias("place", "run")).join(scored, "run")
    whole = each.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("found"), F.sum("weight").alias("weight"))
    whole = whole.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), F.array_join(F.flatten("found.words"), " ").alias("words"), "weight")
    start = math.log(prior / (1 - prior))
    done = judged.join(whole, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    score = 1 / (1 + F.exp(-(F.coalesce("weight", F.lit(0.0)) + start)))
    done = done.select("page_id", "host", "path", "rule", "says", F.coalesce("words", F.lit("")).alias("words"), F.round(score, 9).alias("score"))
    return done.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "words", "score")
