"""Directory trees as tables of files with their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.sources.frontier import list_trees, read_files


def scan_trees(
    spark: SparkSession, folder: str, max_file_kb: int = 500, ignore_name: str | None = ".packignore"
) -> DataFrame:
    """Every file ``(repo, path, size_bytes, raw)`` below ``folder``, hidden ones included, nothing pruned.

    ``raw`` is null above ``max_file_kb``; a root file called ``ignore_name`` decides about others, so it is read at
    any size. ``pack_trees`` leaves out what its configuration excludes before listing it.
    """
    listing = list_trees(spark, folder)
    wanted = F.col("size_bytes") <= max_file_kb * 1024
    if ignore_name is not None:
        wanted = wanted | (F.col("path") == ignore_name)
    rest = listing.files.where(~wanted).drop("location").withColumn("raw", F.lit(None).cast("binary"))
    return read_files(listing.files.where(wanted), listing.root).unionByName(rest)


def scan_visible(spark: SparkSession, folder: str, repo_depth: int = 1) -> DataFrame:
    """The same through Spark's own file listing, for any file system it supports.

    Spark leaves out names that start with a dot or an underscore. Size filters and
    unused contents are dealt with inside the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split("://", 1)[-1]
    start = F.instr(F.col("path"), root + "/") + len(root) + 1
    relative = F.substring(F.col("path"), start, F.length("path"))
    parts = F.split(relative, "/")
    return files.select(
        F.array_join(F.slice(parts, 1, repo_depth), "/").alias("repo"),
        F.array_join(F.slice(parts, F.lit(repo_depth + 1), F.greatest(F.size(parts), F.lit(0))), "/").alias("path"),
        F.col("content").alias("raw"),
        F.col("length").alias("size_bytes"),
    )
