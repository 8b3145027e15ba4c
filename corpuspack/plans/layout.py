"""Which document each file goes to, and what each document is called."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.config import PackConfig
from corpuspack.functions.text import chunk_name, document_name, leaf_label, parent_dir, repo_name, split_name
from corpuspack.operators.chunks import assign_chunks
from corpuspack.operators.names import split_names
from corpuspack.session import materialised

_DOCUMENT_COLUMNS = ["repo", "output", "label", "context", "root", "n_files", "raw_bytes"]


class Layout(NamedTuple):
    """``files`` are the selected files' metadata plus ``output``; ``documents`` has one row
    per document: label, header context, tree root and totals."""

    files: DataFrame
    documents: DataFrame


def _totals() -> list[Column]:
    return [F.count("*").alias("n_files"), F.sum("size_bytes").alias("raw_bytes")]


def _single(meta: DataFrame, config: PackConfig) -> Layout:
    output = document_name(F.col("repo"), config.output_name)
    documents = (
        meta.groupBy("repo")
        .agg(*_totals())
        .withColumn("output", output)
        .withColumns(
            {
                "label": F.col("output"),
                "context": F.lit(None).cast("string"),
                "root": repo_name(F.col("repo")),
            }
        )
    )
    return Layout(meta.withColumn("output", output), documents.select(_DOCUMENT_COLUMNS))


def _remote(meta: DataFrame, config: PackConfig) -> Layout:
    """As ``single``, but headed by ``label``, the repository reference, a column of ``meta``."""
    output = document_name(F.col("repo"), config.output_name)
    documents = (
        meta.groupBy("repo")
        .agg(*_totals(), F.max("label").alias("label"))
        .withColumn("output", output)
        .withColumns(
            {"context": F.col("label"), "root": repo_name(F.col("repo"))}
        )
    )
    return Layout(meta.drop("label").withColumn("output", output), documents.select(_DOCUMENT_COLUMNS))


def split_groups(meta: DataFrame) -> DataFrame:
    """Leaf directories with their files counted; nothing but the totals is gathered."""
    dir_key = parent_dir(F.col("path")).alias("dir_key")
    return meta.select("repo", dir_key, "size_bytes").groupBy("repo", "dir_key").agg(*_totals())


def _split(meta: DataFrame, config: PackConfig) -> Layout:
    groups = materialised(split_groups(meta), "groups")
    names = split_names(groups)
    documents = groups.join(names, ["repo", "dir_key"]).select(
        "repo",
        "output",
        "dir_key",
        leaf_label(F.col("dir_key"), F.col("repo")).alias("label"),
        F.col("dir_key").alias("context"),
        leaf_label(F.col("dir_key"), F.col("repo")).alias("root"),
        "n_files",
        "raw_bytes",
    )
    documents = materialised(documents, "documents")
    usual = split_name(F.col("dir_key"))
    # Only renamed directories are joined to the files, so a huge directory with an ordinary
    # name meets no join key of its own.
    renamed = documents.where(usual != F.col("output")).select("repo", "dir_key", "output")
    renamed = materialised(renamed, "renamed")
    files = (
        meta.withColumn("dir_key", parent_dir(F.col("path")))
        .join(renamed, ["repo", "dir_key"], "left")
        .withColumn("output", F.coalesce("output", usual))
        .drop("dir_key")
    )
    return Layout(files, documents.select(_DOCUMENT_COLUMNS))


def _chunk(meta: DataFrame, config: PackConfig) -> Layout:
    files = materialised(assign_chunks(meta, config.chunk_tokens), "chunks")
    document = document_name(F.col("repo"), config.output_name)
    per_chunk = files.groupBy("repo", "chunk").agg(*_totals())
    parts = per_chunk.groupBy("repo").agg(F.max("chunk").alias("parts"))
    label = F.format_string("Part %d of %d", "chunk", "parts")
    documents = per_chunk.join(parts, "repo").select(
        "repo",
        chunk_name(document, F.col("chunk")).alias("output"),
        label.alias("label"),
        label.alias("context"),
        repo_name(F.col("repo")).alias("root"),
        "n_files",
        "raw_bytes",
    )
    return Layout(files.withColumn("output", chunk_name(document, F.col("chunk"))).drop("chunk"), documents)


_LAYOUTS = {"single": _single, "remote": _remote, "split": _split, "chunk": _chunk}


def lay_out(meta: DataFrame, config: PackConfig) -> Layout:
    """Place the files described by ``meta`` into documents."""
    return _LAYOUTS[config.mode](meta, config)
