"""Names, keys and display forms derived from paths and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sorts below every character a file name can hold.
KEY_SEPARATOR = "\0"


def slash_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory part of a path; empty at the top level."""
    return F.left(path, F.length(path) - F.length(base_name(path)) - 1)


def repo_name(repo: Column) -> Column:
    """Short name of a repository whose key is a path or ``owner/name``."""
    return base_name(repo)


def leaf_label(dir_key: Column, repo: Column) -> Column:
    return F.when(dir_key == "", repo_name(repo)).otherwise(base_name(dir_key))


def split_name(dir_key: Column) -> Column:
    """File name of a directory's document, before collisions are resolved."""
    return F.when(dir_key == "", F.lit("_root.md")).otherwise(
        F.concat(F.translate(dir_key, "/", "."), F.lit(".md"))
    )


def document_name(repo: Column, output_name: str | None) -> Column:
    """Name of a repository's single document."""
    return F.concat(repo_name(repo), F.lit("-context.md")) if output_name is None else F.lit(output_name)


def chunk_name(document: Column, chunk: Column) -> Column:
    return F.concat(F.regexp_replace(document, r"\.md\z", ""), F.lit("-"), chunk.cast("string"), F.lit(".md"))


def anchor_slug(path: Column) -> Column:
    """Lower-case link target: everything but letters and digits becomes a dash."""
    dashed = F.regexp_replace(F.lower(path), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"\A-|-\z", "")


def kilobytes(size: Column) -> Column:
    return F.format_string("%.1f", size / F.lit(1024.0))


def grouped_digits(number: Column) -> Column:
    return F.format_string("%,d", number)


def tree_key(path: Column, is_dir: Column) -> Column:
    """String whose byte order is the depth-first, directories-first order of the tree."""
    dirs = F.transform(
        F.filter(F.split(parent_dir(path), "/"), lambda name: name != ""),
        lambda name: F.concat(F.lit("0"), name, F.lit(KEY_SEPARATOR)),
    )
    own = F.concat(F.when(is_dir, "0").otherwise("1"), base_name(path), F.lit(KEY_SEPARATOR))
    return F.concat(F.array_join(dirs, ""), own)
