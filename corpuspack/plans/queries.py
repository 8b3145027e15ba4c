"""The query catalogue: every operator, run over whole fixture tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.functions import comments, globs, language, text, tokens
from corpuspack.operators import select
from corpuspack.operators.chunks import assign_chunks
from corpuspack.operators.names import split_names as unique_split_names
from corpuspack.operators.names import with_anchors
from corpuspack.operators.tree import tree_families
from corpuspack.operators.tree import tree_lines as drawn_tree
from corpuspack.operators.tree import tree_nodes as nodes_of
from corpuspack.plans import render, report
from corpuspack.plans.fixtures import CONFIG, WHOLE, view
from corpuspack.plans.layout import split_groups as groups_of
from corpuspack.plans.pack import Pack, as_text_files, file_meta, pack_files, pack_listing, with_language
from corpuspack.schema import FRAGMENT_ORDER
from corpuspack.session import materialised
from corpuspack.sources import ignore, references, remote

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPLIT = replace(WHOLE, mode="split")
CHUNK = replace(WHOLE, mode="chunk")
REMOTE = replace(CONFIG, mode="remote", strip_comments=False)
REMOTE_WHOLE = replace(WHOLE, mode="remote", strip_comments=False)
EVERYTHING = replace(CONFIG, include=("**/*",), exclude=(), max_file_kb=500, strip_comments=False)
IGNORING = replace(EVERYTHING, ignore_name=".packignore")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _run(spark: SparkSession, sf_dir: str, config=WHOLE, source: str = "v_whole") -> Pack:
    return pack_files(view(spark, sf_dir, source), config)


def _remote_run(spark: SparkSession, sf_dir: str) -> Pack:
    """All entries of all listings, with all blobs."""
    listings, blobs = view(spark, sf_dir, "v_listings_whole"), view(spark, sf_dir, "v_all_blobs")
    return pack_listing(listings, blobs, REMOTE_WHOLE)


def _documents_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of all files, whatever the selection would say."""
    return file_meta(with_language(view(spark, sf_dir, "v_files")))


def _as_document(files: DataFrame) -> DataFrame:
    """All files of a repository placed in one document."""
    return files.withColumn("output", text.document_name(F.col("repo"), None))


# Sources


@query
def scan_files(spark, sf_dir):
    files = view(spark, sf_dir, "v_files").withColumn("path", F.translate("path", "/", "\\"))
    return as_text_files(files).select("repo", "path", "size_bytes", F.md5("content").alias("digest"))


@query
def tree_listing_explode(spark, sf_dir):
    entries = remote.tree_entries(remote.parsed_listings(view(spark, sf_dir, "v_listings")))
    return entries.where("type = 'blob'").select("repo", "path", "size_bytes", "sha", "truncated")


@query
def tree_listing_truncated(spark, sf_dir):
    return remote.truncated_listings(remote.parsed_listings(view(spark, sf_dir, "v_listings")))


@query
def blob_join(spark, sf_dir):
    entries = remote.tree_entries(remote.parsed_listings(view(spark, sf_dir, "v_listings"))).where("type = 'blob'")
    joined = remote.blob_join(entries, view(spark, sf_dir, "v_blobs"))
    return joined.select(
        "repo", "path", "sha", F.col("content").isNotNull().alias("found"), F.md5("content").alias("digest")
    )


@query
def ignore_patterns(spark, sf_dir):
    patterns = ignore.ignore_patterns(view(spark, sf_dir, "v_teams"), ".packignore")
    return patterns.withColumn("line_no", F.col("line_no").cast("bigint"))


@query
def repo_ref_parse(spark, sf_dir):
    parsed = references.parse_references(view(spark, sf_dir, "v_refs"))
    return parsed.select("page_id", "ref", "owner", "name", "kind")


@query
def repo_ref_kind(spark, sf_dir):
    refs = view(spark, sf_dir, "v_refs")
    return refs.select("page_id", references.is_remote(F.col("ref")).alias("is_remote"))


@query
def repo_ref_label(spark, sf_dir):
    parsed = references.parse_references(view(spark, sf_dir, "v_refs")).where("kind = 'remote'")
    return references.label_references(parsed).select("page_id", "branch_or_default", "label")


# Filters


@query
def glob_include(spark, sf_dir):
    files = view(spark, sf_dir, "v_files")
    return files.where(globs.matches_globs(F.col("path"), ["*.java", "src/**/*.kt", "docs/?oc*"])).select(
        "repo", "path"
    )


@query
def glob_exclude(spark, sf_dir):
    files = view(spark, sf_dir, "v_files")
    path = F.col("path")
    kept = globs.matches_globs(path, ["**/*.java", "**/*.md"]) & ~globs.matches_globs(path, ["**/TEST/**", "docs/**"])
    return files.where(kept).select("repo", "path")


@query
def default_excludes(spark, sf_dir):
    files = view(spark, sf_dir, "v_files")
    excluded = globs.matches_globs(F.col("path"), globs.DEFAULT_EXCLUDES)
    return files.select("repo", "path", excluded.alias("excluded"))


@query
def glob_braces(spark, sf_dir):
    files = view(spark, sf_dir, "v_files")
    path = F.col("path")
    return files.select(
        "repo",
        "path",
        globs.matches_globs(path, ["*.{js,kt}"]).alias("braces"),
        globs.matches_globs(path, ["**/*.{java,md}"]).alias("anchored_braces"),
        globs.matches_globs(path, ["[Dd]oc[!_]*.[jm]*"]).alias("brackets"),
    )


@query
def prune_dirs(spark, sf_dir):
    files = view(spark, sf_dir, "v_files").select("repo", "path", "size_bytes")
    config = replace(EVERYTHING, exclude=("src/main/*", "a?b/**"))
    return select.with_decisions(files, config).select("repo", "path", "pruned_dir", "decision")


@query
def ignore_anti_join(spark, sf_dir):
    files = view(spark, sf_dir, "v_teams")
    rules = ignore.ignore_regexes(files, ".packignore")
    return ignore.without_ignored(files.select("repo", "path"), rules)


@query
def ignore_decisions(spark, sf_dir):
    run = _run(spark, sf_dir, IGNORING, "v_teams")
    return run.decisions.select("repo", "path", "pruned_dir", "decision")


@query
def size_guard(spark, sf_dir):
    files = view(spark, sf_dir, "v_files").where(F.col("size_bytes") <= CONFIG.max_file_bytes)
    return files.select("repo", "path", "size_bytes")


@query
def utf8_guard(spark, sf_dir):
    return as_text_files(view(spark, sf_dir, "v_raw")).where("readable").select("repo", "path", "size_bytes")


@query
def file_decisions(spark, sf_dir):
    run = _run(spark, sf_dir, CONFIG, "v_raw")
    return run.decisions.select("repo", "path", "size_bytes", "pruned_dir", "decision")


@query
def exclude_sources(spark, sf_dir):
    files = view(spark, sf_dir, "v_teams")
    patterns = ignore.ignore_patterns(files, ".packignore")
    rows = select.exclude_sources(CONFIG, files, patterns)
    return rows.withColumn("position", F.col("position").cast("bigint"))


# Projections


@query
def language_tag(spark, sf_dir):
    names = view(spark, sf_dir, "v_names")
    return names.select("doc_id", "name", language.language_tag(F.col("name")).alias("language"))


@query
def strip_comments(spark, sf_dir):
    files = with_language(view(spark, sf_dir, "v_files"))
    stripped = comments.strip_comments(F.col("content"), F.col("language"))
    return files.select("repo", "path", "language", stripped.alias("content"))


@query
def tokens_text(spark, sf_dir):
    documents = view(spark, sf_dir, "documents")
    return documents.select("doc_id", tokens.tokens_from_text(F.col("text")).alias("tokens"))


@query
def tokens_bytes(spark, sf_dir):
    files = view(spark, sf_dir, "v_files").select("repo", "size_bytes")
    totals = files.groupBy("repo").agg(F.sum("size_bytes").alias("size_bytes"))
    return totals.withColumn("tokens", tokens.tokens_from_count(F.col("size_bytes")))


@query
def tokens_rendered(spark, sf_dir):
    return _documents_meta(spark, sf_dir).select("repo", "path", "tokens")


@query
def anchor_slug(spark, sf_dir):
    return view(spark, sf_dir, "v_files").select("repo", "path", text.anchor_slug(F.col("path")).alias("slug"))


# Aggregates


def _decisions(spark, sf_dir):
    return _run(spark, sf_dir, CONFIG, "v_raw").decisions


@query
def run_counts(spark, sf_dir):
    return select.decision_counts(_decisions(spark, sf_dir)).select("repo", "included")


@query
def excluded_walk(spark, sf_dir):
    return select.decision_counts(_decisions(spark, sf_dir)).select("repo", "excluded_walk")


@query
def excluded_flat(spark, sf_dir):
    run = pack_listing(view(spark, sf_dir, "v_listings"), view(spark, sf_dir, "v_blobs"), REMOTE)
    return select.decision_counts(run.decisions).select("repo", "included", "excluded_flat")


def _asked_run(spark, sf_dir, config):
    """Per-team repositories, and some that were asked for and have no file."""
    return pack_files(view(spark, sf_dir, "v_teams_whole"), config, view(spark, sf_dir, "v_asked"))


@query
def dry_run(spark, sf_dir):
    return _asked_run(spark, sf_dir, WHOLE).dry_run()


@query
def dry_run_listing(spark, sf_dir):
    return _run(spark, sf_dir).dry_run_listing()


# Layout


@query
def split_groups(spark, sf_dir):
    groups = groups_of(view(spark, sf_dir, "v_files"))
    return groups.select(
        "repo",
        "dir_key",
        text.leaf_label(F.col("dir_key"), F.col("repo")).alias("label"),
        text.split_name(F.col("dir_key")).alias("base"),
        "n_files",
        "raw_bytes",
    )


@query
def split_names(spark, sf_dir):
    return unique_split_names(groups_of(view(spark, sf_dir, "v_files")).select("repo", "dir_key"))


@query
def anchor_dedup(spark, sf_dir):
    files = _as_document(view(spark, sf_dir, "v_files").select("repo", "path"))
    return with_anchors(files).select("repo", "output", "path", "anchor")


def _chunk_input(meta):
    return meta.select("repo", "path", "tokens")


@query
def chunk_assign(spark, sf_dir):
    return assign_chunks(_chunk_input(_documents_meta(spark, sf_dir)), CHUNK.chunk_tokens)


@query
def chunk_assign_one_repo(spark, sf_dir):
    """The same with three quarters of all files in one repository."""
    meta = file_meta(with_language(view(spark, sf_dir, "v_mono")))
    return assign_chunks(_chunk_input(meta), 4_000)


@query
def chunk_oversize(spark, sf_dir):
    return _run(spark, sf_dir, replace(CHUNK, chunk_tokens=1_000)).notes()


# Trees


@query
def tree_nodes(spark, sf_dir):
    files = _as_document(view(spark, sf_dir, "v_files").select("repo", "path"))
    return nodes_of(files).select("repo", "node_path", F.col("depth").cast("bigint").alias("depth"), "name", "is_dir")


@query
def tree_lines(spark, sf_dir):
    files = _as_document(view(spark, sf_dir, "v_mono").select("repo", "path"))
    families = materialised(tree_families(files), "families")
    return drawn_tree(files, families).select("repo", "node_path", "sort_key", "line")


def _fragments(spark, sf_dir, config=WHOLE):
    return _run(spark, sf_dir, config).fragments()


def _widened(fragments):
    counts = {c: F.col(c).cast("bigint") for c in ("section", "part")}
    return fragments.withColumns(counts)


@query
def tree_document(spark, sf_dir):
    run = _run(spark, sf_dir, SPLIT)
    fixed = render.fixed_fragments(run.layout.documents, SPLIT).where(F.col("section") == render.TREE)
    return _widened(fixed.unionByName(render.tree_fragments(run.layout.files, run.families)))


# Rendering


@query
def toc(spark, sf_dir):
    run = _run(spark, sf_dir)
    lines = render.toc_fragments(run.anchored)
    return _widened(lines).select("repo", "output", "sort_key", "fragment")


@query
def header_render(spark, sf_dir):
    run = _run(spark, sf_dir, CHUNK)
    return run.layout.documents.select("repo", "output", render.header_text(CHUNK).alias("header"))


@query
def footer_render(spark, sf_dir):
    run = _run(spark, sf_dir)
    return run.layout.documents.select("repo", "output", render.footer_text(WHOLE).alias("footer"))


@query
def file_section_render(spark, sf_dir):
    run = _run(spark, sf_dir)
    rows = render.file_rows(run.anchored, run.texts.select("repo", "path", "content"))
    return render.rendered(rows, WHOLE).select("repo", F.col("sort_key").alias("path"), "fragment")


@query
def document_fragments(spark, sf_dir):
    return _widened(_fragments(spark, sf_dir)).select(*FRAGMENT_ORDER, "fragment")


@query
def document_fragments_plain(spark, sf_dir):
    """Without table of contents and tree."""
    return _widened(_fragments(spark, sf_dir, replace(WHOLE, toc=False, tree=False)))


@query
def chunk_documents(spark, sf_dir):
    """Whole documents; the token budget bounds each."""
    return _run(spark, sf_dir, CHUNK).documents()


# Reports


@query
def single_outputs(spark, sf_dir):
    return _run(spark, sf_dir).outputs()


@query
def split_outputs(spark, sf_dir):
    return _run(spark, sf_dir, SPLIT).outputs()


@query
def chunk_outputs(spark, sf_dir):
    return _run(spark, sf_dir, CHUNK).outputs()


@query
def remote_outputs(spark, sf_dir):
    return _remote_run(spark, sf_dir).outputs()


def _with_wide_order(rows):
    return rows.withColumn("ord", F.col("ord").cast("bigint"))


@query
def warnings_single(spark, sf_dir):
    return _with_wide_order(_run(spark, sf_dir, EVERYTHING, "v_mono").warnings())


@query
def warnings_split(spark, sf_dir):
    config = replace(EVERYTHING, mode="split", max_tokens=1_500)
    return _with_wide_order(_run(spark, sf_dir, config, "v_files").warnings())


@query
def warnings_remote(spark, sf_dir):
    return _with_wide_order(_remote_run(spark, sf_dir).warnings())


@query
def listing_notes(spark, sf_dir):
    return _with_wide_order(_remote_run(spark, sf_dir).notes())


def _status_run(spark, sf_dir):
    return _asked_run(spark, sf_dir, replace(SPLIT, max_tokens=1_500)).summary()


@query
def run_summary(spark, sf_dir):
    return _status_run(spark, sf_dir).drop("status")


@query
def run_status(spark, sf_dir):
    return _status_run(spark, sf_dir).select("repo", F.col("status").cast("bigint").alias("status"))
