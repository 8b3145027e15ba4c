"""C-style comment removal as native regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages whose comments can be stripped.
STRIPPABLE = (
    "c",
    "cpp",
    "csharp",
    "fsharp",
    "go",
    "groovy",
    "java",
    "javascript",
    "jsx",
    "kotlin",
    "php",
    "rust",
    "scala",
    "swift",
    "tsx",
    "typescript",
)

# Literals are captured and kept; comments are matched and dropped. A literal that is
# never closed runs to the end of the text. A block comment that is never closed
# swallows all but the last character.
_LITERAL_OR_COMMENT = (
    r"(?=[\"'/])(?:"
    r'("[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z)'
    r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\\?\z))"
    r"|//[^\n]*+"
    r"|/\*(?:[\s\S]*?\*/|[\s\S]*(?=[\s\S]\z)|\z))"
)


def strip_comments(content: Column, language: Column) -> Column:
    """``content`` without ``//`` and ``/* */`` comments, for the languages that have them.

    Plain substring tests come first: most texts need neither replacement, and a text
    without a comment opener is returned as it is.
    """
    has_comment = content.contains("//") | content.contains("/*")
    bare = F.when(
        has_comment, F.regexp_replace(content, F.lit(_LITERAL_OR_COMMENT), F.lit("$1"))
    ).otherwise(content)
    return F.when(language.isin(*STRIPPABLE), collapse_blank_lines(bare)).otherwise(content)


def collapse_blank_lines(text: Column) -> Column:
    """Runs of three or more newlines become two."""
    return F.regexp_replace(text, F.lit("\n{3,}"), F.lit("\n\n"))
