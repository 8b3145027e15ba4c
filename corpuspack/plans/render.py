"""Documents as ordered fragments, never as one giant string.

A document may be larger than any machine's memory, so it stays a set of rows:
``(repo, output, section, part, sort_key, fragment)``. Sorted by these columns, the
fragments of a document concatenate to its text. Sizes come from the lengths of the
pieces, so measuring a document never touches file contents again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.config import PackConfig
from corpuspack.functions.comments import strip_comments
from corpuspack.functions.text import kilobytes, repo_name
from corpuspack.operators.tree import tree_bytes, tree_lines
from corpuspack.plans.layout import Layout
from corpuspack.schema import FRAGMENT_ORDER

HEADER, TOC, TREE, FILES, FOOTER = range(5)
OPENING, BODY, CLOSING = range(3)

_FENCE = "```"
_RULE = "\n---\n\n"
_COLUMNS = [*FRAGMENT_ORDER, "fragment"]


def _quoted_list(patterns: tuple[str, ...]) -> str:
    return "`" + "`, `".join(patterns) + "`"


def header_text(config: PackConfig) -> Column:
    """Title and property table of a document row."""
    context = F.col("context")
    title = F.concat(
        F.lit("# Repository Context: `"),
        repo_name(F.col("repo")),
        F.when(context.isNotNull() & (context != ""), F.concat(F.lit("` — `"), context)).otherwise(""),
        F.lit("`\n\n"),
    )
    directory = F.when(context.isNotNull(), F.concat(F.lit("> | Directory | `"), context, F.lit("` |\n")))
    excludes = f"> | Exclude patterns | {_quoted_list(config.exclude)} |\n" if config.exclude else ""
    repo_path = repo_name(F.col("repo")) if config.mode == "remote" else F.col("repo")
    stripping = "enabled" if config.strip_comments else "disabled"
    return F.concat(
        title,
        F.lit(f"> **Generated by {config.generator}** · {config.generated_at}\n>\n"),
        F.lit("> | Property | Value |\n> |---|---|\n> | Repo path | `"),
        repo_path,
        F.lit("` |\n"),
        F.coalesce(directory, F.lit("")),
        F.lit(f"> | Include patterns | {_quoted_list(config.include)} |\n{excludes}> | Files included | "),
        F.col("n_files").cast("string"),
        F.lit(f" |\n> | Comment stripping | {stripping} |\n{_RULE}"),
    )


def footer_text(config: PackConfig) -> Column:
    return F.concat(
        F.lit(f"<!-- {config.generator}: "),
        F.col("n_files").cast("string"),
        F.lit(" files, "),
        kilobytes(F.col("raw_bytes")),
        F.lit(" KB total -->\n"),
    )


def toc_line() -> Column:
    return F.concat(F.lit("- [`"), F.col("path"), F.lit("`](#"), F.col("anchor"), F.lit(")\n"))


def section_opening(path: Column | None = None) -> Column:
    """A file section up to its text: heading, language and size, opening fence."""
    path = F.col("path") if path is None else path
    language = F.col("language")
    return F.concat(
        F.lit('### <a id="'),
        F.col("anchor"),
        F.lit('"></a>`'),
        path,
        F.lit("`\n\n> **Language:** "),
        F.when(language == "", "text").otherwise(language),
        F.lit(" · **Size:** "),
        kilobytes(F.col("size_bytes")),
        F.lit(f" KB\n\n{_FENCE}"),
        language,
        F.lit("\n"),
    )


SECTION_CLOSING = f"{_FENCE}\n\n---\n\n"


def body_text(content: Column) -> Column:
    """File text with a final newline."""
    return F.when(F.endswith(content, F.lit("\n")), content).otherwise(F.concat(content, F.lit("\n")))


def body_bytes(content: Column) -> Column:
    """Length of ``body_text`` without building it."""
    missing = F.when(F.endswith(content, F.lit("\n")), 0).otherwise(1)
    return (F.octet_length(content) + missing).cast("bigint")


def _fixed_pieces(config: PackConfig) -> list[tuple[int, int, Column]]:
    """Per-document fragments that do not depend on single files, in order."""
    pieces: list[tuple[int, int, Column]] = [(HEADER, BODY, header_text(config))]
    if config.toc:
        pieces.append((TOC, OPENING, F.lit("## Table of Contents\n\n")))
        pieces.append((TOC, CLOSING, F.lit(_RULE)))
    if config.tree:
        root = F.concat(F.lit(f"## Repository Structure\n\n{_FENCE}\n"), F.col("root"), F.lit("/\n"))
        pieces.append((TREE, OPENING, root))
        pieces.append((TREE, CLOSING, F.lit(f"{_FENCE}\n{_RULE}")))
    pieces.append((FILES, OPENING, F.lit("## Source Files\n\n")))
    pieces.append((FOOTER, BODY, footer_text(config)))
    return pieces


def fixed_fragments(documents: DataFrame, config: PackConfig) -> DataFrame:
    structs = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(part).alias("part"),
            F.lit("").alias("sort_key"),
            text.alias("fragment"),
        )
        for section, part, text in _fixed_pieces(config)
    ]
    return documents.select("repo", "output", F.inline(F.array(*structs)))


def _body_rows(df: DataFrame, section: int, sort_key: Column, fragment: Column) -> DataFrame:
    return df.select(
        "repo",
        "output",
        F.lit(section).alias("section"),
        F.lit(BODY).alias("part"),
        sort_key.alias("sort_key"),
        fragment.alias("fragment"),
    )


def toc_fragments(anchored: DataFrame) -> DataFrame:
    return _body_rows(anchored, TOC, F.col("path"), toc_line())


def tree_fragments(files: DataFrame, families: DataFrame) -> DataFrame:
    return _body_rows(tree_lines(files, families), TREE, F.col("sort_key"), F.col("line"))


def file_rows(anchored: DataFrame, contents: DataFrame) -> DataFrame:
    """File sections still to be rendered: their ingredients, and no fragment yet.

    ``contents`` is ``(repo, path, content)``, joined on its unique key.
    """
    return anchored.join(contents, ["repo", "path"]).select(
        "repo",
        "output",
        F.lit(FILES).alias("section"),
        F.lit(BODY).alias("part"),
        F.col("path").alias("sort_key"),
        F.lit(None).cast("string").alias("fragment"),
        "anchor",
        "language",
        "size_bytes",
        "content",
    )


def narrow_fragments(
    layout: Layout, anchored: DataFrame, families: DataFrame | None, config: PackConfig
) -> DataFrame:
    """All fragments but the file sections. Switched-off sections are left out of the union."""
    parts = fixed_fragments(layout.documents, config)
    if config.toc:
        parts = parts.unionByName(toc_fragments(anchored))
    if config.tree:
        parts = parts.unionByName(tree_fragments(layout.files, families))
    return parts


def fragment_rows(
    layout: Layout,
    anchored: DataFrame,
    families: DataFrame | None,
    contents: DataFrame,
    config: PackConfig,
) -> DataFrame:
    """All fragments of all documents, file sections unrendered."""
    parts = narrow_fragments(layout, anchored, families, config)
    return parts.unionByName(file_rows(anchored, contents), allowMissingColumns=True)


def rendered(rows: DataFrame, config: PackConfig, *kept: str) -> DataFrame:
    """Fragment rows with every file section rendered; columns ``kept`` stay.

    A projection, so it can run wherever it is cheapest: a sink orders the rows first
    and renders them after the shuffle.
    """
    content = F.col("content")
    if config.strip_comments:
        content = strip_comments(content, F.col("language"))
    text = F.concat(section_opening(F.col("sort_key")), body_text(F.col("stripped")), F.lit(SECTION_CLOSING))
    return (
        rows.withColumn("stripped", content)
        .withColumn("fragment", F.coalesce("fragment", text))
        .select(*_COLUMNS, *kept)
    )


def document_sizes(
    layout: Layout, anchored: DataFrame, families: DataFrame | None, config: PackConfig
) -> DataFrame:
    """Bytes of each document, added up from the lengths of its fragments."""
    size = F.octet_length(section_opening()) + F.col("body_bytes") + len(SECTION_CLOSING.encode())
    if config.toc:
        size = size + F.octet_length(toc_line())
    parts = anchored.groupBy("repo", "output").agg(F.sum(size).alias("bytes"))
    if config.tree:
        parts = parts.unionByName(tree_bytes(families))
    variable = parts.groupBy("repo", "output").agg(F.sum("bytes").alias("variable"))
    fixed = sum((F.octet_length(text) for _, _, text in _fixed_pieces(config)), F.lit(0)).cast("bigint")
    return layout.documents.join(variable, ["repo", "output"]).select(
        *layout.documents.columns, (F.col("variable") + fixed).alias("size_bytes")
    )


def bounded_documents(all_fragments: DataFrame) -> DataFrame:
    """Whole documents as single strings. For chunk mode only, where the token budget bounds them."""
    order = F.struct(*FRAGMENT_ORDER[2:])
    pieces = F.array_sort(F.collect_list(F.struct(order.alias("order"), F.col("fragment"))))
    text = F.array_join(F.transform(pieces, lambda p: p["fragment"]), "")
    return all_fragments.groupBy("repo", "output").agg(text.alias("document"))
