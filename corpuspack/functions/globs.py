"""Glob lists as one regular expression.

A list of globs becomes a single pattern, built on the driver, so that matching a
path costs one ``rlike`` however many globs there are. A path matches a glob when
either reading of it matches:

* plain: only ``*``, ``**`` and ``?`` are special, letter case (ASCII) is ignored;
* extended: ``[ab]`` and ``{a,b}`` work too, case counts, and the glob is tried on
  the whole path and on the file name alone.

Unless a glob starts with ``**`` it may also match below any directory.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that are never packed, whatever the configuration says.
DEFAULT_EXCLUDES = (
    ".git/**",
    ".gradle/**",
    ".idea/**",
    ".vscode/**",
    "build/**",
    "out/**",
    "target/**",
    ".mvn/**",
    "node_modules/**",
    "**/.DS_Store",
    "**/Thumbs.db",
)

_MATCHES_NOTHING = "(?!)"
_WILDCARDS = {"**/": "(?:.+/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
_PLAIN_TOKEN = re.compile(r"\*\*/|\*\*|[*?]|[\\.\[\]{}()+^$|]")
_EXTENDED_TOKEN = re.compile(r"\*\*|[*?{},]|\[[^\]]*\]|[\s\S]")
_RANGE = re.compile(r"(.)-(.)")


def _plain(glob: str) -> str:
    return _PLAIN_TOKEN.sub(lambda m: _WILDCARDS.get(m[0], "\\" + m[0]), glob)


def _character_class(body: str) -> str | None:
    negated = body.startswith("!")
    members = body[1:] if negated else body
    if not members or "/" in members:
        return None
    if any(low > high for low, high in _RANGE.findall(members.removeprefix("-"))):
        return None
    escaped = re.sub(r"[\\\[&^]", lambda m: "\\" + m[0], members)
    if escaped.startswith("-"):
        escaped = "\\" + escaped
    return f"[[^/]&&[{'^' if negated else ''}{escaped}]]"


def _extended(glob: str) -> str | None:
    """The extended reading, or None where the glob is malformed as such."""
    pieces: list[str] = []
    in_braces = False
    for token in _EXTENDED_TOKEN.findall(glob):
        if token in _WILDCARDS:
            pieces.append(_WILDCARDS[token])
        elif token == "{":
            if in_braces:
                return None
            in_braces = True
            pieces.append("(?:(?:")
        elif token == "}" and in_braces:
            in_braces = False
            pieces.append("))")
        elif token == "," and in_braces:
            pieces.append(")|(?:")
        elif len(token) > 1:
            members = _character_class(token[1:-1])
            if members is None:
                return None
            pieces.append(members)
        elif token == "[":
            return None
        else:
            pieces.append(_PLAIN_TOKEN.sub(lambda m: "\\" + m[0], token))
    return None if in_braces else "".join(pieces)


def _alternatives(patterns: list[str], prefix: str) -> list[str]:
    return [f"{prefix}(?:{'|'.join(patterns)})"] if patterns else []


def glob_regex(globs: Iterable[str]) -> str:
    """One Java regular expression that finds a match iff any glob matches the path.

    Globs that may start below any directory share one leading group, so a path is
    searched for its possible starting points once and not once per glob.
    """
    rooted: list[str] = []
    anywhere: list[str] = []
    whole: list[str] = []
    names: list[str] = []
    for glob in globs:
        glob = glob.replace("\\", "/")
        unanchored = not glob.startswith("**")
        plain = _plain(glob)
        if unanchored or plain.startswith(_WILDCARDS["**/"]):
            anywhere.append(plain.removeprefix(_WILDCARDS["**/"]))
        else:
            rooted.append(plain)
        # Without brackets and braces the plain reading already covers the extended one.
        if any(mark in glob for mark in "[]{}"):
            extended = _extended(glob)
            if extended is not None:
                whole.append(("(?:.*/)?" if unanchored else "") + extended)
                names.append(extended)
    plain_forms = rooted + _alternatives(anywhere, _WILDCARDS["**/"])
    if not plain_forms:
        return _MATCHES_NOTHING
    regex = rf"(?i:\A(?:{'|'.join(plain_forms)})\z)"
    if whole:
        regex += rf"|\A(?:{'|'.join(whole)})\z|(?:\A|/)(?=[^/]*\z)(?:{'|'.join(names)})\z"
    return regex


def walk_globs(globs: Iterable[str]) -> list[str]:
    """Globs that can hide a directory without matching all files below it.

    A directory is hidden when a file ``x`` in it would match. A glob ending in ``/**``
    then matches everything below too, and one that cannot match a name ``x`` hides
    nothing. Only what is left needs the directories above a file to be looked at.
    """
    return [g for g in globs if g != "**" and not g.endswith("/**") and g and g[-1] in "*?]}xX"]


def matches_globs(path: Column, globs: Iterable[str]) -> Column:
    """True where ``path`` matches any of the globs known on the driver."""
    return path.rlike(glob_regex(globs))


def matches_regex_column(path: Column, regex: Column) -> Column:
    """True where ``path`` matches the row's own expression; a null expression matches nothing.

    ``regexp_instr`` keeps the last compiled pattern, so runs of rows of one
    repository compile it once.
    """
    return F.coalesce(F.regexp_instr(path, regex) > 0, F.lit(False))
