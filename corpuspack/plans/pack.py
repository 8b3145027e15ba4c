"""End-to-end runs: files or remote listings in, documents and reports out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.config import PackConfig
from corpuspack.functions.comments import strip_comments
from corpuspack.functions.language import language_tag
from corpuspack.functions.text import slash_path
from corpuspack.functions.tokens import rendered_tokens, utf16_length
from corpuspack.operators.names import with_anchors
from corpuspack.operators.select import (
    INCLUDE,
    SKIP_DIR,
    SKIP_UNREADABLE,
    decision_counts,
    selected_files,
    with_decisions,
)
from corpuspack.operators.tree import tree_families
from corpuspack.plans import render, report
from corpuspack.plans.layout import Layout, lay_out
from corpuspack.plans.sink import section_rows, write_manifest, write_narrow, write_sections
from corpuspack.session import materialised
from corpuspack.sources.frontier import Listing, as_text, list_trees, read_files
from corpuspack.sources.ignore import ignore_regexes
from corpuspack.sources.remote import (
    blob_join,
    blob_keys,
    listing_errors,
    parsed_listings,
    tree_entries,
    truncated_listings,
    with_presence,
)


def file_meta(selected: DataFrame) -> DataFrame:
    """Everything later stages need to know about a file except its text.

    ``size_bytes`` stays the size of the original file even if comments were stripped.
    """
    chars = utf16_length(F.col("content"))
    extra = ["label"] if "label" in selected.columns else []
    return selected.select(
        "repo",
        "path",
        "language",
        "size_bytes",
        render.body_bytes(F.col("content")).alias("body_bytes"),
        rendered_tokens(utf16_length(F.col("path")), chars).alias("tokens"),
        *extra,
    )


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_tag(F.col("path")))


def prepared(selected: DataFrame, config: PackConfig) -> DataFrame:
    """Selected files with language, and text as it will be rendered."""
    tagged = with_language(selected)
    if not config.strip_comments:
        return tagged
    return tagged.withColumn("content", strip_comments(F.col("content"), F.col("language")))


def as_text_files(files: DataFrame) -> DataFrame:
    """Normalise paths; decode raw bytes, marking those that are not valid UTF-8."""
    files = files.withColumn("path", slash_path(F.col("path")))
    return as_text(files) if "raw" in files.columns else files


@dataclass(frozen=True)
class Pack:
    """One run over any number of repositories.

    Each table is planned when first asked for. ``decided`` holds every decision that names, sizes and patterns
    allow, as narrow rows; nothing but ignore files is read for it. ``meta``, the metadata of the selected files, is
    written once and shared; file contents are read once for it and once more when documents are rendered. Whether a file
    is text is only known from its bytes, so ``decisions`` read those of the files that would be included, where
    they may turn out not to be.

    ``candidates`` carry their text and have passed every rule known up front. Rules that
    need a join are applied to narrow rows only, so text never moves for them. ``requested`` has a row for every
    repository that reports must name, whether or not anything in it matched.
    """

    config: PackConfig
    decided: DataFrame
    candidates: DataFrame
    requested: DataFrame
    ignore_regexes: DataFrame | None = None
    listings: DataFrame | None = None
    failures: DataFrame | None = None

    @cached_property
    def _checked(self) -> bool:
        return "readable" in self.candidates.columns

    @cached_property
    def decisions(self) -> DataFrame:
        """``(repo, path, size_bytes, pruned_dir, decision)``: why each file is in or out."""
        if not self._checked:
            return self.decided
        closed = self.candidates.where(~F.col("readable")).select("repo", "path", F.lit(True).alias("closed"))
        found = self.decided.join(materialised(closed, "unreadable"), ["repo", "path"], "left")
        unread = (F.col("decision") == INCLUDE) & F.col("closed").isNotNull()
        decision = F.when(unread, SKIP_UNREADABLE).otherwise(F.col("decision"))
        return found.withColumn("decision", decision).drop("closed")

    @cached_property
    def texts(self) -> DataFrame:
        """Candidates that are text."""
        return self.candidates.where("readable").drop("readable") if self._checked else self.candidates

    @cached_property
    def meta(self) -> DataFrame:
        rows = file_meta(prepared(self.texts, self.config))
        if self.ignore_regexes is not None:
            rows = selected_files(rows, self.config, self.ignore_regexes)
        return materialised(rows, "meta")

    @cached_property
    def layout(self) -> Layout:
        return lay_out(self.meta, self.config)

    @cached_property
    def anchored(self) -> DataFrame:
        return with_anchors(self.layout.files)

    @cached_property
    def families(self) -> DataFrame | None:
        if not self.config.tree:
            return None
        return materialised(tree_families(self.layout.files), "families")

    def selected(self) -> DataFrame:
        """``(repo, path, size_bytes)`` of the files a run would include."""
        return self.decisions.where(F.col("decision") == INCLUDE).drop("pruned_dir", "decision")

    def _fragment_rows(self) -> DataFrame:
        contents = self.texts.select("repo", "path", "content")
        return render.fragment_rows(self.layout, self.anchored, self.families, contents, self.config)

    def fragments(self) -> DataFrame:
        """The documents, as ordered rows; see ``corpuspack.schema.FRAGMENTS``."""
        return render.rendered(self._fragment_rows(), self.config)

    def documents(self) -> DataFrame:
        """Whole documents as single strings: chunk mode only, whose documents are bounded."""
        if self.config.mode != "chunk":
            raise ValueError("only chunk mode bounds its documents; use fragments or write")
        return render.bounded_documents(self.fragments())

    def write(self, folder: str) -> None:
        """Write the documents as text below ``folder``, with a manifest of their parts."""
        spark = self.meta.sparkSession
        write_narrow(render.narrow_fragments(self.layout, self.anchored, self.families, self.config), folder)
        write_sections(section_rows(self.anchored, self.texts), folder, self.config)
        write_manifest(spark, folder)

    @cached_property
    def _outputs(self) -> DataFrame:
        sizes = render.document_sizes(self.layout, self.anchored, self.families, self.config)
        return materialised(report.outputs(sizes), "outputs")

    def outputs(self) -> DataFrame:
        """One row per document: label, files, bytes, tokens."""
        return self._outputs

    def warnings(self) -> DataFrame:
        return report.warnings(self.outputs(), self.config)

    def notes(self) -> DataFrame:
        """Notices that leave the status alone: oversize chunks, remote listing limits."""
        if self.config.mode == "remote":
            return report.listing_notes(self.decisions, self.listings)
        return report.oversize_notes(self.meta, self.config)

    def errors(self) -> DataFrame:
        """``(repo, error)`` of listings that could not be read; their repositories end with status 1."""
        if self.failures is None:
            return self.requested.where("false").select("repo", F.lit("").alias("error"))
        return self.failures

    def summary(self) -> DataFrame:
        """One row per requested repository with counts, totals and status."""
        counts = report.of_all(self.requested, decision_counts(self.decisions))
        return report.run_summary(counts, self.outputs(), self.warnings(), self.config)

    def dry_run(self) -> DataFrame:
        """One row per requested repository. Texts are only read to see that files are text, where that is not known."""
        return report.dry_run(self.selected(), self.config, self.requested)

    def dry_run_listing(self) -> DataFrame:
        return report.dry_run_listing(with_language(self.selected()))


def _requested(seen: DataFrame, repos: DataFrame | None) -> DataFrame:
    """Every repository once: those asked for, and those that rows come from."""
    rows = seen.select("repo")
    return materialised((rows if repos is None else rows.union(repos.select("repo"))).distinct(), "requested")


def pack_files(files: DataFrame, config: PackConfig, repos: DataFrame | None = None) -> Pack:
    """Pack a table of files: ``(repo, path, size_bytes)`` and ``content`` or ``raw``.

    A root file called ``config.ignore_name`` adds exclude patterns for its repository. ``repos`` (repo) names
    repositories that were asked for, also ones without a file.
    """
    if config.mode == "remote":
        raise ValueError("remote mode packs listings; use pack_listing")
    regexes = None
    if config.ignore_name is not None:
        own = as_text_files(files.where(F.col("path") == config.ignore_name))
        own = own.where("readable") if "readable" in own.columns else own
        regexes = materialised(ignore_regexes(own, config.ignore_name), "ignore")
    narrow = files.select("repo", slash_path(F.col("path")).alias("path"), "size_bytes")
    decided = with_decisions(narrow, config, regexes)
    return Pack(config, decided, selected_files(as_text_files(files), config), _requested(narrow, repos), regexes)


def pack_listed(listing: Listing, config: PackConfig) -> Pack:
    """Pack listed directory trees. Files are read only once names and sizes have let them in."""
    if config.mode == "remote":
        raise ValueError("remote mode packs listings; use pack_listing")
    files = with_decisions(listing.files, config, listing.rules)
    files = materialised(files, "decided")
    chosen = files.where(F.col("decision") == INCLUDE).select("repo", "path", "size_bytes", "location")
    size, none = F.lit(0).cast("bigint").alias("size_bytes"), F.lit(None).cast("string").alias("pruned_dir")
    hidden = listing.pruned.select("repo", "path", size, F.col("path").alias("pruned_dir"), F.lit(SKIP_DIR).alias("decision"))
    closed = listing.closed.select("repo", "path", size, none, F.lit(SKIP_UNREADABLE).alias("decision"))
    decided = files.drop("location").unionByName(hidden).unionByName(closed)
    return Pack(config, decided, as_text(read_files(chosen, listing.root)), listing.repos)


def pack_trees(spark: SparkSession, root: str, config: PackConfig) -> Pack:
    """Pack every repository below ``root``; excluded directories are never entered."""
    return pack_listed(list_trees(spark, root, config), config)


def pack_listing(
    listings: DataFrame, blobs: DataFrame, config: PackConfig, repos: DataFrame | None = None
) -> Pack:
    """Pack remote tree listings ``(repo, label, tree_json)`` with a table of blobs.

    Listings are filtered before the blobs are looked up; a file whose blob is missing counts as unreadable. A
    repository with a listing that is not JSON has failed: nothing of it is packed.
    """
    if config.mode != "remote":
        raise ValueError("listings are packed in remote mode only")
    parsed = parsed_listings(listings)
    failures = materialised(listing_errors(parsed), "quarantine")
    entries = tree_entries(parsed).join(failures.select("repo").distinct(), "repo", "left_anti")
    files = entries.where(F.col("type") == "blob").select("repo", "label", "path", "size_bytes", "sha")
    decided = with_decisions(files, config)
    known = materialised(blob_keys(blobs), "blob-keys")
    wanted = F.col("decision") == INCLUDE
    found = with_presence(decided, known, wanted)
    missing = wanted & ~F.col("found")
    decided = found.withColumn("decision", F.when(missing, SKIP_UNREADABLE).otherwise(F.col("decision")))
    decided = materialised(decided.drop("found"), "decided")
    chosen = decided.where(wanted).select("repo", "label", "path", "size_bytes", "sha")
    return Pack(
        config,
        decided=decided.select("repo", "path", "size_bytes", "pruned_dir", "decision"),
        candidates=blob_join(chosen, blobs).drop("sha"),
        requested=_requested(listings, repos),
        listings=truncated_listings(parsed),
        failures=failures,
    )
