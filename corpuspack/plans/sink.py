"""Write documents as text.

A document is the texts of its parts, ``folder/repo=…/output=…/part=…/*.txt``, in the order of their names, which are
padded; a manifest lists them. What comes before the file sections, narrow rows all, makes parts of its own, and so
does the footer. File sections are cut into blocks of about equal bytes, in the order of repository and path.

Block numbers come from running sums over the metadata of files, so no text is sampled or sorted globally for them. A block's
first key is all that has to be known to deal texts out: they move once, to their block, where they meet their metadata.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspack.config import PackConfig
from corpuspack.operators.ordered import ordered_blocks
from corpuspack.plans.render import FILES, FOOTER, SECTION_CLOSING, rendered, section_opening
from corpuspack.schema import FRAGMENT_ORDER

#: Bytes of a block at least, and how many blocks there are at most: their first keys go to every task.
BLOCK_BYTES, MOST_BLOCKS = 64 << 20, 32_768
#: Number of the first block.
FIRST_BLOCK = 0
_FOLDERS = ["repo", "output", "part"]
_MANIFEST = "_manifest"


def _part(place: int, number: Column) -> Column:
    return F.format_string(f"{place}-%010d", number.cast("bigint"))


def _as_lines(rows: DataFrame, folder: str, mode: str) -> None:
    """Write rows, sorted by document and part, as they are.

    Every fragment ends with a newline, and so does every row the writer writes: one is taken off. The folder columns
    are made non-nullable: the writer then keeps the rows' order instead of sorting on these columns alone.
    """
    text = F.left("fragment", F.length("fragment") - 1).alias("fragment")
    rows.select(*_FOLDERS, text).write.mode(mode).partitionBy(*_FOLDERS).text(folder)


def _not_null(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def write_narrow(fragments: DataFrame, folder: str) -> None:
    """Write all fragments that are not file sections: rendered, narrow rows in document order."""
    ordered = _not_null(fragments, "repo", "output").repartitionByRange(*FRAGMENT_ORDER)
    part = F.when(F.col("section") == FOOTER, _part(2, F.lit(0))).otherwise(_part(0, F.spark_partition_id()))
    numbered = _not_null(ordered.withColumn("part_name", part), "part_name")
    numbered = numbered.sortWithinPartitions("repo", "output", "part_name", *FRAGMENT_ORDER[2:])
    _as_lines(numbered.select("repo", "output", F.col("part_name").alias("part"), "fragment"), folder, "errorifexists")


def in_blocks(files: DataFrame) -> DataFrame:
    """Add ``number``, the block of each file section, to ``(repo, path, …, body_bytes)`` rows.

    Partial sums are per range partition; only these, one row each, are added up in one place.
    """
    size = F.octet_length(section_opening()) + F.col("body_bytes") + len(SECTION_CLOSING.encode())
    rows = ordered_blocks(files.withColumn("_bytes", size.cast("bigint")), ["repo", "path"])
    sums = rows.groupBy("block").agg(F.sum("_bytes").alias("_sum"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    total = sums.agg(F.sum("_sum")).first()[0] or 0
    width = max(BLOCK_BYTES, -(-total // MOST_BLOCKS))
    inside = Window.partitionBy("block").orderBy("repo", "path").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_shift") + F.coalesce(F.sum("_bytes").over(inside), F.lit(0))
    number = (F.floor(start / width) + FIRST_BLOCK).cast("bigint")
    return rows.join(F.broadcast(shifts), "block").withColumn("number", number).select(*files.columns, "number")


def _key(repo: str, path: str) -> bytes:
    """In the order that Spark sorts by."""
    return f"{repo}\0{path}".encode()


def dealt_to_blocks(contents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``number`` to ``(repo, path, content)``: the last block whose first file is not behind. Only the keys pass
    through Python."""
    firsts = blocks.groupBy("number").agg(F.min(F.struct("repo", "path")).alias("first")).orderBy("number").collect()
    keys, numbers = [_key(*r["first"]) for r in firsts], [r["number"] for r in firsts]

    @F.pandas_udf("bigint")
    def number(repo: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([numbers[max(bisect_right(keys, _key(r, p)) - 1, 0)] for r, p in zip(repo, path)], dtype="int64")

    if not numbers:
        return contents.where("false").withColumn("number", F.lit(0).cast("bigint"))
    return contents.withColumn("number", number("repo", "path"))


def section_rows(anchored: DataFrame, contents: DataFrame) -> DataFrame:
    """File sections with their text and ``number``, unrendered, each block sorted in one partition.

    Texts and metadata move to their block together, and there a file's metadata come just before its text.
    """
    blocks = in_blocks(anchored.select("repo", "path", "output", "anchor", "language", "size_bytes", "body_bytes"))
    known = ["output", "anchor", "language", "size_bytes"]
    info = blocks.select("number", "repo", "path", F.lit(0).alias("kind"), F.struct("repo", "path", *known).alias("info"))
    texts = dealt_to_blocks(contents.select("repo", "path", "content"), blocks)
    texts = texts.select("number", "repo", "path", F.lit(1).alias("kind"), "content")
    both = info.unionByName(texts, allowMissingColumns=True)
    beside = F.lag("info").over(Window.partitionBy("number").orderBy("repo", "path", "kind"))
    met = both.withColumn("info", beside).where("kind = 1 AND info.repo = repo AND info.path = path")
    return met.select(
        "number", "repo", "info.output", F.lit(FILES).alias("section"), F.lit(1).alias("part"),
        F.col("path").alias("sort_key"), F.lit(None).cast("string").alias("fragment"),
        *(f"info.{c}" for c in known[1:]), "content",
    )


def write_sections(rows: DataFrame, folder: str, config: PackConfig) -> None:
    """Render and write file sections where they are: nothing moves any more."""
    named = _not_null(rows.withColumn("name", _part(1, F.col("number"))), "repo", "output", "name")
    ordered = named.sortWithinPartitions("repo", "output", "name", "sort_key")
    lines = rendered(ordered, config, "name").withColumn("part", F.col("name"))
    _as_lines(lines, folder, "append")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(repo, output, ordinal, part, file, bytes)`` of the parts below ``folder``, as found there. A document has at
    most one part for each block."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    named = lambda c: F.url_decode(F.replace(F.regexp_extract("path", f"/{c}=([^/]*)", 1), F.lit("+"), F.lit("%2B")))
    rows = found.select(
        *(F.when(named(c) == "__HIVE_DEFAULT_PARTITION__", "").otherwise(named(c)).alias(c) for c in _FOLDERS),
        F.regexp_extract("path", "/(repo=[^/]*/.*)$", 1).alias("file"),
        F.col("length").alias("bytes"),
    )
    order = Window.partitionBy("repo", "output").orderBy("part", "file")
    return rows.select("repo", "output", F.row_number().over(order).alias("ordinal"), "part", "file", "bytes")


def write_manifest(spark: SparkSession, folder: str) -> None:
    manifest(spark, folder).write.parquet(f"{folder}/{_MANIFEST}")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{_MANIFEST}")


def stream_document(spark: SparkSession, folder: str, repo: str, output: str) -> Iterator[bytes]:
    """A written document, a part at a time, in order."""
    mine = (F.col("repo") == repo) & (F.col("output") == output)
    for row in read_manifest(spark, folder).where(mine).orderBy("ordinal").toLocalIterator():
        path = f"{folder}/{row['file']}"
        yield bytes(spark.read.format("binaryFile").load(_literal(path)).select("content").first()[0])


def _literal(path: str) -> str:
    """A path for Spark, which takes some characters for patterns."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)
