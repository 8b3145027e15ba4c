"""Repository references: hosted URL, ``owner/name`` shorthand, or a local path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two reference forms. The first may match anywhere up to the end of
# the text, the second only the whole text.
_URL = r"(?i)(?:https?://)?github\.com/([^/]+)/([^/\.]+?)(?:\.git)?/?\z"
_SHORTHAND = r"\A([a-zA-Z0-9][a-zA-Z0-9_.-]*)/([a-zA-Z0-9][a-zA-Z0-9_.-]+)\z"

DEFAULT_BRANCH = "HEAD"


def _trimmed(ref: Column) -> Column:
    return F.regexp_replace(ref, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def is_remote(ref: Column) -> Column:
    """True for URLs and shorthands; false for anything else, including null."""
    text = _trimmed(ref)
    return F.coalesce(text.rlike(_URL) | text.rlike(_SHORTHAND), F.lit(False))


def _part(ref: Column, group: int) -> Column:
    text = _trimmed(ref)
    return F.when(text.rlike(_URL), F.regexp_extract(text, _URL, group)).when(
        text.rlike(_SHORTHAND), F.regexp_extract(text, _SHORTHAND, group)
    )


def parse_references(refs: DataFrame) -> DataFrame:
    """Add ``owner``, ``name`` and ``kind``; unrecognised references keep null parts."""
    remote = is_remote(F.col("ref"))
    return refs.withColumns(
        {
            "owner": _part(F.col("ref"), 1),
            "name": _part(F.col("ref"), 2),
            "kind": F.when(remote, "remote").otherwise("unrecognised"),
        }
    )


def label_references(parsed: DataFrame) -> DataFrame:
    """Add ``branch_or_default`` and the ``owner/name[@branch]`` label of parsed references."""
    suffix = F.coalesce(F.concat(F.lit("@"), F.col("branch")), F.lit(""))
    return parsed.withColumns(
        {
            "branch_or_default": F.coalesce("branch", F.lit(DEFAULT_BRANCH)),
            "label": F.concat("owner", F.lit("/"), "name", suffix),
        }
    )
