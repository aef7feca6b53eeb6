"""Whether a mention is denied by the words around it, as Column expressions over token arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cues of denial, cues that govern what follows at a distance, words that end a scope, and phrases that only look like a denial.
CUES = ["no", "not", "none", "never", "nor", "without", "denies", "denied", "deny", "negative for", "free of", "free from", "ruled out", "no sign of", "no signs of", "no evidence of", "no more", "n't"]
FORWARD_ONLY = ["denies", "denied", "deny", "negative for", "ruled out", "without"]
TERMINATORS = ["but", "however", "although", "though", "except", "yet", "still", "unless", "aside", "besides"]
PSEUDO = ["no doubt", "not only", "not just", "no wonder", "not sure", "no idea", "not to mention"]
TRAILING = ["none", "never"]
SENTENCE_END = [".", ";", "!", "?"]
_TOKEN = r"(?U)[\w']+|[.;:!?,]"
_INSIDE = r"(?U)^[\w']$"
#: Characters beside a mention that are split first; the whole side is split only where they hold too few tokens.
_BESIDE = 400


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), 0)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once: inside a lambda each mention of an expression would compute it anew."""
    return F.get(F.transform(F.array(value), body), 0)


def _beside(near: Column, whole: Column, least: int) -> Column:
    """The tokens of near if there are so many, one of which its far edge may cut in two; else those of the whole side."""
    return _with(_tokens(near), lambda t: F.when(F.size(t) >= least, t).otherwise(_tokens(whole)))


def _until(tokens: Column, stops: list[str], most: int) -> Column:
    """The tokens before the first stop, at most so many."""
    places = F.filter(F.transform(F.array(*map(F.lit, stops)), lambda s: F.array_position(tokens, s)), lambda p: p > 0)
    end = F.coalesce(F.array_min(places).cast("int") - 1, F.size(tokens))
    return F.slice(tokens, F.lit(1), F.least(end, F.lit(most)))


def negation_cue(source: Column, spans: Column, window: int = 6) -> Column:
    """The cue that denies the mention; null if none does.

    A pseudo-denial that ends before the mention and begins within 40 characters of it rules a denial out. Cues are
    looked for backwards in `window` tokens of the sentence, not beyond a terminator; those that act at a distance
    in three times as many, terminators or not; trailing ones in three tokens after the mention. Commas and colons count.
    """
    start, end = F.array_min(F.transform(spans, lambda p: p["s"])), F.array_max(F.transform(spans, lambda p: p["e"]))
    # A phrase of n characters that begins at start-40 or later and ends by start.
    near = F.substring(F.lower(source), F.greatest(start - 40, F.lit(0)) + 1, F.least(start, F.lit(40)))
    pseudo = _with(near, lambda x: F.exists(F.array(*map(F.lit, PSEUDO)), lambda p: F.contains(x, p)))
    # A token that the mention's edge cuts in two belongs to neither side.
    cut = lambda at: F.substring(source, at, F.lit(1)).rlike(_INSIDE) & F.substring(source, at + 1, F.lit(1)).rlike(_INSIDE) & (at > 0)
    left = _beside(F.substring(source, F.greatest(start - _BESIDE, F.lit(0)) + 1, F.least(start, F.lit(_BESIDE))), F.substring(source, F.lit(1), start), 3 * window + 2)
    left = _with(left, lambda t: F.reverse(F.when(cut(start), F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t)))
    right = _beside(F.substring(source, end + 1, F.lit(_BESIDE)), F.substring(source, end + 1, F.length(source)), 5)
    right = _with(right, lambda t: F.when(cut(end), F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(1)))).otherwise(t))
    direct = [c for c in CUES if c not in FORWARD_ONLY]
    hit = lambda t: t.isin(direct) | t.endswith("n't")
    back = lambda x: F.get(F.transform(F.filter(_until(x, SENTENCE_END + TERMINATORS, window), hit), lambda t: F.when(t.isin(direct), t).otherwise(F.lit("n't"))), 0)
    far = lambda x: F.get(F.filter(_until(x, SENTENCE_END, 3 * window), lambda t: t.isin(FORWARD_ONLY)), 0)
    trail = _with(right, lambda x: F.get(F.filter(_until(x, SENTENCE_END, 3), lambda t: t.isin(TRAILING)), 0))
    before = _with(left, lambda x: F.coalesce(back(x), far(x)))
    return F.when((F.coalesce(F.size(spans), F.lit(0)) <= 0) | pseudo, F.lit(None).cast("string")).otherwise(F.coalesce(before, trail))


def window_in_tokens(characters: int) -> int:
    """A window given in characters."""
    return max(1, characters // 7)
