"""Per-repository ignore files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspack.functions.globs import glob_regex, walk_globs

_LINE_BREAK = r"\r\n|\r|\n"
_EDGE_SPACE = r"\A\p{javaWhitespace}+|\p{javaWhitespace}+\z"


def ignore_patterns(files: DataFrame, ignore_name: str) -> DataFrame:
    """Patterns of each repository's root ignore file, one row per line that is one.

    Blank lines and lines starting with ``#`` are not patterns. The path is compared as it is, so that the filter
    reaches the scan: a name at the root has no slash to normalise.
    """
    lines = files.where(F.col("path") == ignore_name).select(
        "repo", F.posexplode(F.split("content", _LINE_BREAK)).alias("line_no", "line")
    )
    stripped = lines.select("repo", "line_no", F.regexp_replace("line", _EDGE_SPACE, "").alias("pattern"))
    return stripped.where((F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#")))


@F.pandas_udf(
    T.StructType([T.StructField("ignore_regex", T.StringType()), T.StructField("walk_regex", T.StringType())])
)
def _globs_as_regexes(globs: pd.Series) -> pd.DataFrame:
    walking = globs.map(walk_globs)
    return pd.DataFrame(
        {"ignore_regex": globs.map(glob_regex), "walk_regex": [glob_regex(g) if g else None for g in walking]}
    )


def ignore_regexes(files: DataFrame, ignore_name: str) -> DataFrame:
    """One row per ignore file: ``repo`` and single expressions for its patterns.

    ``walk_regex`` covers the patterns that can hide whole directories (see
    ``walk_globs``), null if there is none. Only ignore files pass through Python, one row each.
    """
    lines = F.transform(F.split("content", _LINE_BREAK), lambda line: F.regexp_replace(line, _EDGE_SPACE, ""))
    globs = F.filter(lines, lambda line: (line != "") & ~F.startswith(line, F.lit("#")))
    rules = files.where(F.col("path") == ignore_name).select("repo", globs.alias("globs")).where(F.size("globs") > 0)
    regexes = rules.select("repo", _globs_as_regexes("globs").alias("regexes"))
    return regexes.select("repo", "regexes.*")


def without_ignored(files: DataFrame, regexes: DataFrame) -> DataFrame:
    """Files that no pattern of their repository matches: an anti-join on ``repo``."""
    rules = regexes.select("repo", "ignore_regex")
    hit = (files["repo"] == rules["repo"]) & (
        F.regexp_instr(files["path"], rules["ignore_regex"]) > 0
    )
    return files.join(rules, hit, "left_anti")
