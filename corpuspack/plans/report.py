"""Per-document and per-repository results: sizes, tokens, warnings, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.config import PackConfig
from corpuspack.functions.text import grouped_digits, kilobytes
from corpuspack.functions.tokens import tokens_from_count
from corpuspack.operators.select import INCLUDE, SKIP_UNREADABLE

# Fixed values.
MANY_FILES = 500
MANY_REMOTE_FILES = 50


def outputs(sized_documents: DataFrame) -> DataFrame:
    """One row per document; its tokens come from rendered bytes."""
    return sized_documents.select(
        "repo",
        "output",
        "label",
        "n_files",
        "size_bytes",
        tokens_from_count(F.col("size_bytes")).alias("tokens"),
    )


def _digits(number: int) -> str:
    return f"{number:,}"


def _warning_rows(df: DataFrame, output: Column, warnings: list[tuple[int, Column, Column]]) -> DataFrame:
    """``(ord, condition, text)`` choices as rows: one per condition that holds."""
    choices = F.array(
        *[
            F.when(condition, F.struct(F.lit(order).alias("ord"), text.alias("warning")))
            for order, condition, text in warnings
        ]
    )
    return df.select("repo", output.alias("output"), F.inline(F.array_compact(choices)))


def single_warnings(outs: DataFrame, config: PackConfig) -> DataFrame:
    too_long = F.concat(
        F.lit("Estimated token count (~"),
        grouped_digits(F.col("tokens")),
        F.lit(
            f") exceeds --max-tokens limit ({_digits(config.max_tokens)}). "
            "Consider narrowing your include patterns or using --split."
        ),
    )
    too_many = F.concat(
        F.col("n_files").cast("string"),
        F.lit(" files included — consider using --split for large repos."),
    )
    return _warning_rows(
        outs,
        F.col("output"),
        [
            (0, F.col("tokens") > config.max_tokens, too_long),
            (1, F.col("n_files") > MANY_FILES, too_many),
        ],
    )


def split_warnings(outs: DataFrame, config: PackConfig) -> DataFrame:
    """One row per repository whose total is too large, one per document that is."""
    totals = outs.groupBy("repo").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    total_text = F.concat(
        F.lit("Total estimated tokens (~"),
        grouped_digits(F.col("tokens")),
        F.lit(" across "),
        F.col("documents").cast("string"),
        F.lit(" files) is very large."),
    )
    total = _warning_rows(
        totals,
        F.lit(None).cast("string"),
        [(0, F.col("tokens") > F.lit(config.max_tokens).cast("bigint") * F.col("documents"), total_text)],
    )
    each_text = F.concat(
        F.col("output"),
        F.lit(": ~"),
        grouped_digits(F.col("tokens")),
        F.lit(f" tokens exceeds --max-tokens ({_digits(config.max_tokens)}). Consider narrowing patterns."),
    )
    each = _warning_rows(outs, F.col("output"), [(1, F.col("tokens") > config.max_tokens, each_text)])
    return total.unionByName(each)


def remote_warnings(outs: DataFrame, config: PackConfig) -> DataFrame:
    too_long = F.concat(
        F.lit("Estimated token count (~"),
        grouped_digits(F.col("tokens")),
        F.lit(f") exceeds --max-tokens limit ({_digits(config.max_tokens)})."),
    )
    return _warning_rows(outs, F.col("output"), [(0, F.col("tokens") > config.max_tokens, too_long)])


def listing_notes(decisions: DataFrame, truncated: DataFrame) -> DataFrame:
    """Notices of a remote listing: it was cut short, or matches many files.

    A match counts whether or not its blob can be fetched. Notices are shown to the
    user but do not change a run's status.
    """
    matched = F.col("decision").isin(INCLUDE, SKIP_UNREADABLE)
    counts = decisions.groupBy("repo").agg(F.count_if(matched).alias("matched"))
    per_repo = truncated.join(counts, "repo", "left")
    many = F.concat(
        F.lit("Fetching "),
        F.col("matched").cast("string"),
        F.lit(
            " files. Unauthenticated access allows 60 requests/hour (1 used for tree). "
            "Consider adding a token for a 5,000/hour limit."
        ),
    )
    cut = F.lit("Truncated tree listing: some files may be missing. Consider narrowing your include patterns.")
    rows = _warning_rows(
        per_repo,
        F.lit(None).cast("string"),
        [(0, F.col("truncated"), cut), (1, F.col("matched") > MANY_REMOTE_FILES, many)],
    )
    return rows.select("repo", "ord", F.col("warning").alias("note"))


def oversize_notes(files: DataFrame, config: PackConfig) -> DataFrame:
    """Files that exceed the chunk budget on their own; noted, not counted as warnings."""
    note = F.concat(
        F.col("path"),
        F.lit(" (~"),
        grouped_digits(F.col("tokens")),
        F.lit(f" tokens) exceeds chunk budget ({_digits(config.chunk_tokens)}). Placing in its own chunk."),
    )
    return files.where(F.col("tokens") > config.chunk_tokens).select("repo", "path", "tokens", note.alias("note"))


def warnings(outs: DataFrame, config: PackConfig) -> DataFrame:
    """Warnings that make a run end with status 2, as rows ``(repo, output, ord, warning)``."""
    if config.mode == "split":
        return split_warnings(outs, config)
    if config.mode == "remote":
        return remote_warnings(outs, config)
    if config.mode == "single":
        return single_warnings(outs, config)
    return single_warnings(outs, config).where(F.lit(False))


def run_summary(counts: DataFrame, outs: DataFrame, warning_rows: DataFrame, config: PackConfig) -> DataFrame:
    """One row per repository, including those where nothing matched.

    Status: 0 fine, 1 nothing matched, 2 finished with warnings.
    """
    totals = outs.groupBy("repo").agg(
        F.count("*").alias("documents"),
        F.sum("size_bytes").alias("size_bytes"),
        F.sum("tokens").alias("tokens"),
    )
    warned = warning_rows.groupBy("repo").agg(F.count("*").alias("n_warnings"))
    excluded = "excluded_walk" if config.prune_dirs else "excluded_flat"
    zero = F.lit(0).cast("bigint")
    rows = counts.join(totals, "repo", "left").join(warned, "repo", "left")
    n_warnings = F.coalesce("n_warnings", zero)
    return rows.select(
        "repo",
        "included",
        F.col(excluded).alias("excluded"),
        F.coalesce("documents", zero).alias("documents"),
        F.coalesce("size_bytes", zero).alias("size_bytes"),
        F.coalesce("tokens", zero).alias("tokens"),
        n_warnings.alias("n_warnings"),
        (F.coalesce("documents", zero) > 1).alias("is_split"),
        F.when(F.col("included") == 0, 1).when(n_warnings > 0, 2).otherwise(0).alias("status"),
    )


def dry_run_listing(selected: DataFrame) -> DataFrame:
    """Matched files with language and size."""
    return selected.select("repo", "path", "language", kilobytes(F.col("size_bytes")).alias("kb"))


def of_all(requested: DataFrame, counted: DataFrame) -> DataFrame:
    """A row for every requested repository, with zeros where nothing was counted."""
    return requested.join(counted, "repo", "left").fillna(0)


def dry_run(selected: DataFrame, config: PackConfig, requested: DataFrame) -> DataFrame:
    """Totals a run would start from, estimated from raw sizes; contents are not read."""
    totals = selected.groupBy("repo").agg(
        F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_bytes")
    )
    totals = of_all(requested, totals)
    tokens = tokens_from_count(F.col("total_bytes"))
    return totals.select(
        "repo",
        "n_files",
        "total_bytes",
        kilobytes(F.col("total_bytes")).alias("total_kb"),
        tokens.alias("tokens"),
        (tokens > config.max_tokens).alias("over_budget"),
    )
