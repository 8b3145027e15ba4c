"""Remote repositories as tables: tree listings in JSON and blobs by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.schema import BAD_LISTING, TREE_LISTING


def parsed_listings(listings: DataFrame) -> DataFrame:
    """``tree_json`` parsed once, as ``listing``; a text that is not JSON is kept in its field BAD_LISTING."""
    parsed = F.from_json("tree_json", TREE_LISTING, {"columnNameOfCorruptRecord": BAD_LISTING})
    return listings.withColumn("listing", parsed)


def listing_errors(parsed: DataFrame) -> DataFrame:
    """``(repo, error)`` of listings that are missing or not JSON."""
    bad = F.col("listing")[BAD_LISTING]
    error = F.when(F.col("tree_json").isNull(), "no listing").when(bad.isNotNull(), "listing is not JSON")
    return parsed.select("repo", error.alias("error")).where("error IS NOT NULL")


def _cut(listing: Column) -> Column:
    """The truncation flag: JSON true, also as text, and a number other than 0 set it."""
    said = F.lower(listing["truncated"])
    return F.coalesce((said == "true") | F.coalesce(said.try_cast("double") != 0, F.lit(False)), F.lit(False))


def tree_entries(parsed: DataFrame) -> DataFrame:
    """One row per entry of each listing of ``parsed_listings``.

    Other columns are carried along. Missing texts become empty, a missing size 0, a missing truncation flag false.
    """
    carried = [c for c in parsed.columns if c not in ("tree_json", "listing")]
    entry = F.col("entry")
    return parsed.select(
        *carried, _cut(F.col("listing")).alias("truncated"), F.explode("listing.tree").alias("entry")
    ).select(
        *carried,
        "truncated",
        F.coalesce(entry["path"], F.lit("")).alias("path"),
        F.coalesce(entry["type"], F.lit("")).alias("type"),
        F.coalesce(entry["size"].try_cast("double"), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.coalesce(entry["sha"], F.lit("")).alias("sha"),
    )


def truncated_listings(parsed: DataFrame) -> DataFrame:
    """Whether any listing of a repository was cut short."""
    return parsed.groupBy("repo").agg(F.max(_cut(F.col("listing"))).alias("truncated"))


def blob_keys(blobs: DataFrame) -> DataFrame:
    """The keys of blobs that have a text, once each. Narrow: whether a blob is there never needs its text."""
    return blobs.where("content IS NOT NULL").select("repo", "sha").distinct()


def with_presence(entries: DataFrame, keys: DataFrame, wanted: Column) -> DataFrame:
    """Add ``found``: whether the blob of a wanted entry is there.

    Unwanted entries keep their own hash as key, so they stay spread over the partitions.
    """
    sides = entries.alias("e"), keys.withColumn("found", F.lit(True)).alias("k")
    same = (F.col("e.repo") == F.col("k.repo")) & (F.col("e.sha") == F.col("k.sha"))
    joined = sides[0].join(sides[1], same & wanted, "left")
    return joined.select("e.*", F.coalesce("k.found", F.lit(False)).alias("found"))


def blob_join(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Add ``content`` by ``(repo, sha)``; null where the blob is missing."""
    sides = entries.alias("e"), blobs.select("repo", "sha", "content").alias("b")
    same = (F.col("e.repo") == F.col("b.repo")) & (F.col("e.sha") == F.col("b.sha"))
    return sides[0].join(sides[1], same, "left").select("e.*", "b.content")
