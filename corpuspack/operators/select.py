"""Which files are packed, and why the others are not.

All rules are row predicates over ``(repo, path, size_bytes)``, so selection itself
shuffles nothing. Only per-repository ignore rules need a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.config import PackConfig
from corpuspack.functions.globs import (
    DEFAULT_EXCLUDES,
    glob_regex,
    matches_globs,
    matches_regex_column,
    walk_globs,
)
from corpuspack.functions.text import parent_dir

INCLUDE = "include"
SKIP_DIR = "skip_dir"
EXCLUDE = "exclude"
SKIP_SIZE = "skip_size"
SKIP_UNREADABLE = "skip_unreadable"


def exclude_globs(config: PackConfig) -> tuple[str, ...]:
    """Built-in excludes first, then the configured ones; duplicates stay."""
    return DEFAULT_EXCLUDES + config.exclude


def exclude_sources(config: PackConfig, files: DataFrame, ignore_patterns: DataFrame) -> DataFrame:
    """Every exclude pattern in force per repository, with where it comes from."""
    fixed = F.array(
        *[
            F.struct(F.lit(source).alias("source"), F.lit(i).alias("position"), F.lit(glob).alias("pattern"))
            for source, globs in (("default", DEFAULT_EXCLUDES), ("config", config.exclude))
            for i, glob in enumerate(globs)
        ]
    )
    repos = files.select("repo").distinct()
    per_repo = repos.select("repo", F.inline(fixed))
    ignored = ignore_patterns.select(
        "repo", F.lit("ignore_file").alias("source"), F.col("line_no").alias("position"), "pattern"
    )
    return per_repo.unionByName(ignored)


def ancestor_dirs(path: Column) -> Column:
    """Directories above a path, outermost first.

    The names are bound by an outer one-element ``transform``: inside the inner one
    they would be split again for every level.
    """
    names = F.split(parent_dir(path), "/")
    per_level = F.transform(
        F.array(names),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda depth: F.array_join(F.slice(parts, 1, depth), "/")
        ),
    )
    return F.when(F.instr(path, "/") > 0, per_level[0]).otherwise(F.array().cast("array<string>"))


def topmost_pruned_dir(path: Column, excluded: Callable[[Column], Column]) -> Column:
    """The outermost directory a walk would not enter, or null.

    A directory is not entered when a file called ``x`` inside it would be excluded.
    """
    return F.get(F.filter(ancestor_dirs(path), lambda d: excluded(F.concat(d, F.lit("/x")))), F.lit(0))


class _Excludes:
    """Exclude rules of a run as predicates: those of the configuration, and the row's own."""

    def __init__(self, config: PackConfig, per_row: bool) -> None:
        globs = exclude_globs(config)
        walking = walk_globs(globs)
        self.per_row = per_row
        self.fixed = glob_regex(globs)
        self.fixed_walk = glob_regex(walking) if walking else None

    def matches(self, path: Column) -> Column:
        hit = path.rlike(self.fixed)
        return hit | matches_regex_column(path, F.col("ignore_regex")) if self.per_row else hit

    def walk_matches(self, path: Column) -> Column:
        hit = F.lit(False) if self.fixed_walk is None else path.rlike(self.fixed_walk)
        return hit | matches_regex_column(path, F.col("walk_regex")) if self.per_row else hit

    def has_walk_rule(self) -> Column:
        fixed = F.lit(self.fixed_walk is not None)
        return fixed | F.col("walk_regex").isNotNull() if self.per_row else fixed

    def pruned_dir(self, path: Column) -> Column:
        """Looked for only where it can exist: below a hidden directory a path is either
        excluded itself, or hidden by one of the rules that need a walk."""
        return F.when(self.has_walk_rule() | self.matches(path), topmost_pruned_dir(path, self.matches))

    def hidden_by_walk(self, path: Column) -> Column:
        if self.fixed_walk is None and not self.per_row:
            return F.lit(False)
        return F.coalesce(
            F.when(self.has_walk_rule(), topmost_pruned_dir(path, self.walk_matches).isNotNull()), F.lit(False)
        )


def _with_rules(files: DataFrame, ignore_regexes: DataFrame | None) -> DataFrame:
    """Attach each repository's own exclude expressions (null where it has none).

    One row per ignore file. No broadcast hint: the optimizer broadcasts the side if it
    is small and splits a skewed repository otherwise.
    """
    return files if ignore_regexes is None else files.join(ignore_regexes, "repo", "left")


def _readable(files: DataFrame) -> Column:
    return F.col("readable") if "readable" in files.columns else F.lit(True)


def with_decisions(
    files: DataFrame, config: PackConfig, ignore_regexes: DataFrame | None = None
) -> DataFrame:
    """Add ``pruned_dir`` and ``decision`` to ``(repo, path, size_bytes[, readable])`` rows.

    The first reason that applies wins: pruned directory, pattern, size, readability.
    """
    excludes = _Excludes(config, ignore_regexes is not None)
    path = F.col("path")
    pruned = excludes.pruned_dir(path) if config.prune_dirs else F.lit(None).cast("string")
    decision = (
        F.when(F.col("pruned_dir").isNotNull(), SKIP_DIR)
        .when(~matches_globs(path, config.include) | excludes.matches(path), EXCLUDE)
        .when(F.col("size_bytes") > config.max_file_bytes, SKIP_SIZE)
        .when(~_readable(files), SKIP_UNREADABLE)
        .otherwise(INCLUDE)
    )
    rows = _with_rules(files, ignore_regexes)
    decided = rows.withColumn("pruned_dir", pruned).withColumn("decision", decision)
    return decided.drop("ignore_regex", "walk_regex", "readable")


def directory_excluded(
    dirs: DataFrame, config: PackConfig, ignore_regexes: DataFrame | None, name: str
) -> DataFrame:
    """Add ``name`` to directories (repo, path): whether a walk would not enter them."""
    excludes = _Excludes(config, ignore_regexes is not None)
    hidden = excludes.matches(F.concat("path", F.lit("/x"))) if config.prune_dirs else F.lit(False)
    return _with_rules(dirs, ignore_regexes).withColumn(name, hidden).drop("ignore_regex", "walk_regex")


def selected_files(
    files: DataFrame, config: PackConfig, ignore_regexes: DataFrame | None = None
) -> DataFrame:
    """The files whose decision would be to include them, as far as names and sizes tell: a column ``readable`` stays.

    The tests run from cheap to dear. The size limit is a plain comparison, so it reaches
    the scan; directories above a file are only looked at where a rule asks for it.
    """
    excludes = _Excludes(config, ignore_regexes is not None)
    path = F.col("path")
    kept = (
        _with_rules(files, ignore_regexes)
        .where(F.col("size_bytes") <= config.max_file_bytes)
        .where(matches_globs(path, config.include) & ~excludes.matches(path))
    )
    if config.prune_dirs:
        kept = kept.where(~excludes.hidden_by_walk(path))
    return kept.drop("ignore_regex", "walk_regex")


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Included and excluded counts per repository.

    ``excluded_walk`` counts a pruned directory once, however much it holds;
    ``excluded_flat`` counts every file that was not included.
    """
    included = F.col("decision") == INCLUDE
    pruned = F.col("decision") == SKIP_DIR
    return decisions.groupBy("repo").agg(
        F.count_if(included).alias("included"),
        (F.count_if(~included & ~pruned) + F.count_distinct("pruned_dir")).alias("excluded_walk"),
        F.count_if(~included).alias("excluded_flat"),
    )
