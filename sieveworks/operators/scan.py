"""Scans of texts and file lists for what must not be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of credentials, and phrases that tell of licensed patient texts.
SECRETS = {
    "service key": r"sk-[A-Za-z0-9_-]{20,}",
    "cloud key": r"AIza[0-9A-Za-z_-]{30,}",
    "model key": r"sk-ant-[A-Za-z0-9_-]{20,}",
    "repository token": r"ghp_[A-Za-z0-9]{30,}",
    "hardcoded credential": r"(?i)(api[_-]?key|secret|password|token)\s*[=:]\s*['\"][^'\"]{12,}['\"]",
}
TELLS = (
    r"(?i)askapatient",
    r"(?i)\bI've been on \w+ \d+ for (over |about )?\d+ (years|months)",
    r"(?i)\b(gp|doctor) (started|put) me on\b",
    r"(?i)\bstopped taking (it|them) after \d+ days\b",
)


def issues(text: Column, notebook: Column | None = None) -> Column:
    """Array of struct(level, what), of whole texts."""
    found = [F.when(text.rlike(p), F.struct(F.lit("BLOCK").alias("level"), F.lit(f"possible {what}").alias("what"))) for what, p in SECRETS.items()]
    hits = sum((text.rlike(p).cast("int") for p in TELLS), F.lit(0))
    found.append(F.when(hits >= 2, F.struct(F.lit("BLOCK").alias("level"), F.lit("reads like licensed text").alias("what"))).when(hits == 1, F.struct(F.lit("WARN").alias("level"), F.lit("one phrase of licensed text").alias("what"))))
    if notebook is not None:
        found.append(F.when(notebook & text.contains('"output_type"'), F.struct(F.lit("WARN").alias("level"), F.lit("notebook has outputs").alias("what"))))
    return F.array_compact(F.array(*found))


def scan(files: DataFrame) -> DataFrame:
    """name, level and what of each issue. files: name, text."""
    rows = files.select("name", F.explode(issues(F.col("text"), F.col("name").endswith(".ipynb"))).alias("x"))
    return rows.select("name", "x.level", "x.what")


def forbidden(paths: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """path and why, for paths under a forbidden prefix."""
    why = F.coalesce(*(F.when(F.col("path").startswith(p), F.lit(w)) for p, w in prefixes)) if prefixes else F.lit(None).cast("string")
    return paths.select("path", why.alias("why")).filter("why is not null")


def unpinned(requirements: DataFrame) -> DataFrame:
    """Requirement lines without ==."""
    line = F.trim(F.regexp_replace("line", "#.*", ""))
    return requirements.select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").contains("=="))


def absent(paths: DataFrame, required: DataFrame) -> DataFrame:
    return required.join(paths, "path", "left_anti")
