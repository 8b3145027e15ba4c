"""File trees as tables: nodes, directory families and drawn lines.

A *family* is a directory with what its children need to know: the prefix of their
lines and which child comes last. Families are far fewer than files, so all the
work on tree structure happens on them, and files meet their family in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.functions.text import base_name, parent_dir, tree_key
from corpuspack.operators.select import ancestor_dirs
from corpuspack.session import materialised

_DOCUMENT = ["repo", "output"]
_FAMILY = [*_DOCUMENT, "dir"]
_LAST, _INNER = "└── ", "├── "
_GAP, _BAR = "    ", "│   "


def _self_and_above(dir_key: Column) -> Column:
    return ancestor_dirs(F.concat(dir_key, F.lit("/")))


def _directories(leaves: DataFrame) -> DataFrame:
    """Distinct directories, from those that hold files and everything above them."""
    above = leaves.where(F.col("dir") != "").select(
        *_DOCUMENT, F.explode(_self_and_above(F.col("dir"))).alias("node_path")
    )
    return above.distinct().select(
        *_DOCUMENT,
        "node_path",
        parent_dir(F.col("node_path")).alias("dir"),
        base_name(F.col("node_path")).alias("name"),
    )


def _leaves(files: DataFrame) -> DataFrame:
    """Directories that hold files, each with totals of its own files."""
    named = files.select(
        *_DOCUMENT, parent_dir(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name")
    )
    return named.groupBy(*_FAMILY).agg(
        F.count("*").alias("n_files"),
        F.sum(F.octet_length("name")).alias("file_name_bytes"),
        F.max("name").alias("last_file"),
    )


def tree_nodes(files: DataFrame) -> DataFrame:
    """Every directory and file of each document once."""
    dirs = _directories(files.select(*_DOCUMENT, parent_dir(F.col("path")).alias("dir")).distinct())
    own = files.select(
        *_DOCUMENT,
        F.col("path").alias("node_path"),
        parent_dir(F.col("path")).alias("dir"),
        base_name(F.col("path")).alias("name"),
    )
    nodes = dirs.withColumn("is_dir", F.lit(True)).unionByName(own.withColumn("is_dir", F.lit(False)))
    return nodes.withColumn("depth", F.size(F.split("node_path", "/")))


def _last_levels(families: DataFrame) -> DataFrame:
    """For each directory, the levels at which it or a directory above it is a last child.

    Directories come before files, so a directory is last only where its parent holds no
    files. Grouping is per directory and yields at most as many numbers as it has levels.
    """
    top = F.col("dir") == ""
    last = families.where(F.col("last_file").isNull()).select(
        *_DOCUMENT,
        F.when(top, F.col("last_dir")).otherwise(F.concat_ws("/", "dir", "last_dir")).alias("above"),
        F.when(top, 1).otherwise(F.size(F.split("dir", "/")) + 1).alias("level"),
    )
    chains = families.where(~top).select(
        *_FAMILY, F.explode(_self_and_above(F.col("dir"))).alias("above")
    )
    found = chains.join(last, [*_DOCUMENT, "above"])
    return found.groupBy(*_FAMILY).agg(F.collect_list("level").alias("last_levels"))


def _prefix() -> Column:
    """What precedes the connector inside a directory: a gap below last children, else a bar."""
    levels = F.sequence(F.lit(1), F.size(F.split("dir", "/")))
    # A missing list makes the condition null, which counts as false.
    marks = F.transform(
        levels, lambda level: F.when(F.array_contains("last_levels", level), _GAP).otherwise(_BAR)
    )
    return F.when(F.col("dir") == "", "").otherwise(F.array_join(marks, ""))


def tree_families(files: DataFrame) -> DataFrame:
    """One row per directory of each document, the top (an empty ``dir``) included.

    The last child comes from an aggregate, which combines map-side, and not from a window
    that would gather all siblings in one task.
    """
    leaves = materialised(_leaves(files), "leaves")
    dirs = _directories(leaves)
    zero, no_name = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    as_child = dirs.select(
        *_FAMILY,
        zero.alias("n_files"),
        zero.alias("file_name_bytes"),
        no_name.alias("last_file"),
        F.lit(1).cast("bigint").alias("n_dirs"),
        (F.octet_length("name") + 1).cast("bigint").alias("dir_name_bytes"),
        F.col("name").alias("last_dir"),
    )
    as_parent = leaves.withColumns({"n_dirs": zero, "dir_name_bytes": zero, "last_dir": no_name})
    families = (
        as_parent.unionByName(as_child)
        .groupBy(*_FAMILY)
        .agg(
            F.max("last_file").alias("last_file"),
            F.max("last_dir").alias("last_dir"),
            (F.sum("n_files") + F.sum("n_dirs")).alias("n_children"),
            (F.sum("file_name_bytes") + F.sum("dir_name_bytes")).alias("name_bytes"),
        )
    )
    families = materialised(families, "families")
    return (
        families.join(_last_levels(families), _FAMILY, "left")
        .withColumn("prefix", _prefix())
        .drop("last_levels")
    )


def _line(name: Column, is_last: Column, tail: str) -> Column:
    return F.concat("prefix", F.when(is_last, _LAST).otherwise(_INNER), name, F.lit(f"{tail}\n"))


def tree_lines(files: DataFrame, families: DataFrame) -> DataFrame:
    """One drawn line per node, with the key that puts the lines in order.

    ``families`` has a known size: the join broadcasts it if it is small, and adaptive
    execution splits a directory with very many files otherwise.
    """
    file_lines = (
        files.select(*_DOCUMENT, F.col("path").alias("node_path"), parent_dir(F.col("path")).alias("dir"))
        .join(families.select(*_FAMILY, "prefix", "last_file"), _FAMILY)
        .select(
            *_DOCUMENT,
            "node_path",
            tree_key(F.col("node_path"), F.lit(False)).alias("sort_key"),
            _line(base_name(F.col("node_path")), base_name(F.col("node_path")) == F.col("last_file"), "").alias("line"),
        )
    )
    own_lines = families.where(F.col("dir") != "").select(
        *_DOCUMENT,
        F.col("dir").alias("node_path"),
        parent_dir(F.col("dir")).alias("dir"),
        base_name(F.col("dir")).alias("name"),
    )
    last = F.col("last_file").isNull() & (F.col("name") == F.col("last_dir"))
    dir_lines = own_lines.join(
        families.select(*_FAMILY, "prefix", "last_file", "last_dir"), _FAMILY
    ).select(
        *_DOCUMENT,
        "node_path",
        tree_key(F.col("node_path"), F.lit(True)).alias("sort_key"),
        _line(F.col("name"), last, "/").alias("line"),
    )
    return file_lines.unionByName(dir_lines)


def tree_bytes(families: DataFrame) -> DataFrame:
    """Length of each document's tree lines, without drawing them."""
    per_line = F.octet_length("prefix") + len(f"{_INNER}\n".encode())
    size = F.col("n_children") * per_line + F.col("name_bytes")
    return families.groupBy(*_DOCUMENT).agg(F.sum(size).alias("bytes"))
