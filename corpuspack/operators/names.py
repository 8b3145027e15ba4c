"""Names that must be unique: anchors within a document, documents within a repository."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.functions.text import anchor_slug, split_name
from corpuspack.operators.ordered import rank_within
from corpuspack.session import materialised

#: A stem that reads as another one with a number of its own, from 2 on; longer numbers are never reached.
_NUMBERED = r"(?s)\A(.*)-([2-9]|[1-9][0-9]{1,8})\z"


def repeated_anchors(files: DataFrame) -> DataFrame:
    """Files whose slug an earlier file of the same document already has.

    Usually few, which is why only these are joined back onto the files.
    """
    slugs = files.select("repo", "output", "path", anchor_slug(F.col("path")).alias("slug"))
    ranked = rank_within(slugs, ["repo", "output", "slug"], ["path"], "nth")
    return ranked.where("nth > 1").select("repo", "path", "nth")


def with_anchors(files: DataFrame) -> DataFrame:
    """Add ``anchor``: the slug, numbered from the second file that has it."""
    repeats = materialised(repeated_anchors(files), "anchors")
    slug = anchor_slug(F.col("path"))
    numbered = F.concat(slug, F.lit("-"), F.col("nth").cast("string"))
    return (
        files.join(repeats, ["repo", "path"], "left")
        .withColumn("anchor", F.when(F.col("nth").isNull(), slug).otherwise(numbered))
        .drop("nth")
    )


def _numbered(stem: Column, number: Column) -> Column:
    return F.concat(stem, F.lit("-"), number.cast("string"), F.lit(".md"))


def _clashes(named: DataFrame) -> DataFrame:
    """(repo, stem, child, number, n_rows, before): stems ``stem-number`` that directories have of themselves.

    ``n_rows`` directories have ``stem``, ``before`` of them precede the first that has ``child``.
    """
    stems = materialised(
        named.groupBy("repo", "stem").agg(F.count("*").alias("n_rows"), F.min("dir_key").alias("first_key")), "stems"
    )
    children = stems.where(F.col("stem").rlike(_NUMBERED)).select(
        "repo",
        F.regexp_extract("stem", _NUMBERED, 1).alias("stem"),
        F.col("stem").alias("child"),
        F.regexp_extract("stem", _NUMBERED, 2).cast("long").alias("number"),
        F.col("first_key").alias("dir_key"),
    )
    clashes = materialised(children.join(stems.select("repo", "stem", "n_rows"), ["repo", "stem"]), "clashes")
    if clashes.isEmpty():
        return clashes
    rows = named.join(clashes.select("repo", "stem").distinct(), ["repo", "stem"], "left_semi")
    both = rows.select("repo", "stem", "dir_key").unionByName(clashes, allowMissingColumns=True)
    met = rank_within(both, ["repo", "stem"], ["dir_key"], "among_all").where("child is not null")
    met = rank_within(met, ["repo", "stem"], ["dir_key"], "among_children")
    before = F.col("among_all") - F.col("among_children")
    return met.select("repo", "stem", "child", "number", "n_rows", before.cast("long").alias("before"))


def _walk_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Who gets the number of each clash, for a stem that keeps its plain name (0) and for one that lost it (1).

    Clashes come by stem and number; all that is kept of a stem is how many numbers it has left out so far.
    """
    current, left_out = None, [0, 0]
    for batch in batches:
        out = {name: [] for name in ("taken", "skipped", "position")}
        columns = (batch.column(name).to_pylist() for name in ("repo", "stem", "number", "n_rows", "before"))
        for repo, stem, number, n_rows, before in zip(*columns):
            if (repo, stem) != current:
                current, left_out = (repo, stem), [0, 0]
            taken, skipped, position = [], [], []
            for lost in (0, 1):
                free_below = number - 2 - left_out[lost]
                skip = free_below >= max(0, before - 1 + lost)
                taken.append(not skip and free_below < n_rows - 1 + lost)
                skipped.append(skip)
                position.append(free_below)
                left_out[lost] += skip
            for name, values in (("taken", taken), ("skipped", skipped), ("position", position)):
                out[name].append(values)
        arrays = [pa.array(out["taken"], pa.list_(pa.bool_())), pa.array(out["skipped"], pa.list_(pa.bool_()))]
        arrays.append(pa.array(out["position"], pa.list_(pa.int64())))
        kept = [batch.column(name) for name in ("repo", "stem", "child")]
        yield pa.RecordBatch.from_arrays([*kept, *arrays], ["repo", "stem", "child", "taken", "skipped", "position"])


def _displaced(walked: DataFrame) -> DataFrame:
    """(repo, stem): stems whose plain name an earlier directory got as a numbered one.

    Whether a stem loses its name depends on whether the stem before it lost its own: two answers for each clash. Such
    functions are composed along chains of stems, over twice the distance in each round, so a chain of any length
    takes as many rounds as its length has binary digits.
    """
    step = walked.select(
        "repo", F.col("child").alias("stem"), F.col("stem").alias("above"), F.col("taken")[0].alias("if_kept"), F.col("taken")[1].alias("if_lost")
    )
    endings = F.regexp_extract("stem", r"((?:-[0-9]+)+)\z", 1)
    depth = step.where("if_kept <> if_lost").agg(F.max(F.length(F.regexp_replace(endings, "[^-]", "")))).first()[0] or 0
    for _ in range(ceil(log2(depth)) if depth > 1 else 0):
        step = materialised(step, "displaced")
        above = step.select(
            "repo",
            F.col("stem").alias("above"),
            F.col("above").alias("further"),
            F.col("if_kept").alias("above_kept"),
            F.col("if_lost").alias("above_lost"),
        )
        through = lambda answer: F.when(F.col(answer), F.col("if_lost")).otherwise(F.col("if_kept"))
        no_further = F.col("further").isNull()
        step = step.join(above, ["repo", "above"], "left").select(
            "repo",
            "stem",
            F.when(no_further, F.col("above")).otherwise(F.col("further")).alias("above"),
            F.when(no_further, F.col("if_kept")).otherwise(through("above_kept")).alias("if_kept"),
            F.when(no_further, F.col("if_lost")).otherwise(through("above_lost")).alias("if_lost"),
        )
    return step.where("if_kept").select("repo", "stem")


def split_names(dirs: DataFrame) -> DataFrame:
    """Document name of each ``(repo, dir_key)``, unique within the repository.

    The first directory of a base name keeps it, later ones get its next free number. Where no directory has a numbered
    name of itself (``a``, ``a-2``), the number is the rank in directory order. Elsewhere:

    * The numbers that directories of a stem get rise, and leave out those that another directory took before. Which ones
      these are follows from the first directories of the stems ``stem-number`` alone, in one pass by number.
    * A stem loses its plain name if the stem before it came to that number first; see ``_displaced``.
    * Numbers left out and directories, merged by position, are ranked: the rank is the number. No stem, and no
      family of stems, is gathered.
    """
    base = split_name(F.col("dir_key"))
    stems = dirs.select("repo", "dir_key", F.regexp_replace(base, r"\.md\z", "").alias("stem"))
    named = materialised(rank_within(stems, ["repo", "stem"], ["dir_key"], "nth"), "names")
    name = lambda number: F.when(number == 1, F.concat("stem", F.lit(".md"))).otherwise(_numbered(F.col("stem"), number))
    clashes = _clashes(named)
    if clashes.isEmpty():
        return named.select("repo", "dir_key", name(F.col("nth")).alias("output"))
    by_number = clashes.repartition("repo", "stem").sortWithinPartitions("repo", "stem", "number")
    schema = "repo string, stem string, child string, taken array<boolean>, skipped array<boolean>, position array<bigint>"
    walked = materialised(by_number.mapInArrow(_walk_numbers, schema), "numbers")
    displaced = materialised(_displaced(walked).withColumn("lost", F.lit(1)), "displaced")

    lost = F.coalesce("lost", F.lit(0))
    number = F.col("nth") + lost
    placed = named.join(displaced, ["repo", "stem"], "left").select("repo", "dir_key", "stem", number.alias("number"))
    contested = walked.select("repo", "stem").distinct()
    plain = placed.join(contested, ["repo", "stem"], "left_anti").unionByName(
        placed.where("number = 1").join(contested, ["repo", "stem"], "left_semi")
    )
    left_out = (
        walked.join(displaced, ["repo", "stem"], "left")
        .where(F.element_at("skipped", lost + 1))
        .select("repo", "stem", F.element_at("position", lost + 1).alias("position"), F.lit(1).alias("kind"))
    )
    wanting = placed.where("number > 1").join(contested, ["repo", "stem"], "left_semi")
    wanting = wanting.select("repo", "dir_key", "stem", (F.col("number") - 1).cast("long").alias("position"), F.lit(0).alias("kind"))
    # a number left out with p free ones below it comes after the p-th directory
    merged = wanting.unionByName(left_out, allowMissingColumns=True)
    ranked = rank_within(merged, ["repo", "stem"], ["position", "kind"], "rank").where("kind = 0")
    ranked = ranked.select("repo", "dir_key", "stem", (F.col("rank") + 1).alias("number"))
    return plain.unionByName(ranked).select("repo", "dir_key", name(F.col("number")).alias("output"))
