"""Token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CHARS_PER_TOKEN = 3.7
SECTION_OVERHEAD_CHARS = 68


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units.

    ASCII text is recognised by its byte count and never re-encoded.
    """
    chars = F.length(text)
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return F.when(F.octet_length(text) == chars, chars).otherwise(units).cast("bigint")


def tokens_from_count(count: Column) -> Column:
    """Tokens for a number of characters or bytes, rounded half up."""
    return F.floor(count / F.lit(CHARS_PER_TOKEN) + F.lit(0.5)).cast("bigint")


def tokens_from_text(text: Column) -> Column:
    return F.coalesce(tokens_from_count(utf16_length(text)), F.lit(0).cast("bigint"))


def rendered_tokens(path_chars: Column, content_chars: Column) -> Column:
    """Estimated cost of a file once rendered: text, twice the path, and fixed markup."""
    return tokens_from_count(F.lit(SECTION_OVERHEAD_CHARS) + path_chars * 2 + content_chars)
