"""Directory trees listed in rounds, and files read once it is known which are wanted.

The frontier is a table of directories still to be listed. A round deals it out anew over tasks, so a repository of
any size or shape is spread, lists each directory once and writes what it found. Directories that
a rule excludes are never opened: the rules, those of the configuration and of the repository's own ignore file, are
applied by Spark to the directories found, before these become the next frontier. There are as many rounds as levels.

Local folders are listed by the operating system, so links are not followed and names need not be valid text; any other
file system that Arrow knows is listed through it. Hidden names are kept either way.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.config import PackConfig
from corpuspack.operators.select import directory_excluded
from corpuspack.session import materialised
from corpuspack.sources.ignore import ignore_regexes

FILE, DIRECTORY, CLOSED = "file", "directory", "closed"
_ENTRIES = "repo string, path string, kind string, size_bytes bigint, location binary"
_ENTRY_FIELDS = pa.schema(
    [("repo", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("size_bytes", pa.int64()), ("location", pa.binary())]
)
_ROWS = 4096
#: Directories, files and bytes that a task takes, about.
DIRECTORIES_PER_TASK, FILES_PER_TASK, BYTES_PER_TASK = 64, 4096, 64 << 20
_BATCH_BYTES = 16 << 20


class Store:
    """Lists and reads below a root: a local folder, or a folder of any file system that Arrow knows by its address."""

    def __init__(self, root: str) -> None:
        self.local = "://" not in root
        self.files, self.root = (None, root) if self.local else fs.FileSystem.from_uri(root)

    def entries(self, location: bytes) -> Iterator[tuple[bytes, str, int]]:
        """(name, kind, size) of what a directory holds. A linked directory counts as a file."""
        if self.local:
            with os.scandir(os.path.join(os.fsencode(self.root), location)) as found:
                for one in found:
                    if one.is_dir(follow_symlinks=False):
                        yield one.name, DIRECTORY, 0
                    else:
                        yield one.name, FILE, one.stat(follow_symlinks=False).st_size
            return
        for one in self.files.get_file_info(fs.FileSelector(self._name(location))):
            yield one.base_name.encode(), DIRECTORY if one.type == fs.FileType.Directory else FILE, one.size or 0

    def read(self, location: bytes) -> bytes | None:
        """Null where the file is gone, closed to us or no file."""
        try:
            if self.local:
                with open(os.path.join(os.fsencode(self.root), location), "rb") as file:
                    return file.read()
            with self.files.open_input_stream(self._name(location)) as file:
                return file.read()
        except (FileNotFoundError, IsADirectoryError, PermissionError):
            return None

    def _name(self, location: bytes) -> str:
        return f"{self.root}/{location.decode()}".rstrip("/")


def listed(store: Store, repo: str, path: str, location: bytes) -> Iterator[tuple]:
    """Rows for what a directory holds; a single one, of kind CLOSED, where we may not look into it. One that has gone
    since it was found holds nothing; any other error ends the run rather than hide files."""
    rows = []
    try:
        for name, kind, size in store.entries(location):
            text = name.decode("utf-8", "replace")
            rows.append((repo, f"{path}/{text}" if path else text, kind, size, location + b"/" + name if location else name))
    except PermissionError:
        rows.append((repo, path, CLOSED, 0, location))
    except (FileNotFoundError, NotADirectoryError):
        pass
    return iter(rows)


def _listing(frontier: DataFrame, root: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, rows = Store(root), []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "location"))):
                rows += listed(store, *row)
                while len(rows) >= _ROWS:
                    yield _entry_batch(rows[:_ROWS])
                    rows = rows[_ROWS:]
        if rows:
            yield _entry_batch(rows)

    return frontier.select("repo", "path", "location").mapInArrow(work, _ENTRIES)


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ENTRY_FIELDS)], schema=_ENTRY_FIELDS)


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(max(1, tasks), "repo", "path")


@dataclass(frozen=True)
class Listing:
    """What a listing found: ``repos`` (repo), also empty ones; ``files`` (repo, path, size_bytes, location);
    ``pruned`` and ``closed`` (repo, path): directories that a rule hides, and those we may not look into.
    ``rules``: one row per repository with an ignore file, or None."""

    root: str
    repos: DataFrame
    files: DataFrame
    pruned: DataFrame
    closed: DataFrame
    rules: DataFrame | None


def list_trees(spark: SparkSession, root: str, config: PackConfig | None = None) -> Listing:
    """Every directory below ``root`` is a repository; ``root`` is a folder that all executors can see, or an address
    such as ``hdfs://host/folder``. Files directly below ``root`` belong to none. Without ``config`` nothing is hidden."""
    root = root.rstrip("/")
    top = _listing(spark.createDataFrame([("", "", b"")], "repo string, path string, location binary"), root)
    repos = top.where(F.col("kind") == DIRECTORY).select(F.col("path").alias("repo"), F.lit("").alias("path"), "location")
    repos = materialised(repos, "repos")
    frontier, levels, hidden, rules = repos, [], [], None
    while waiting := frontier.count():
        level = materialised(_listing(_dealt(frontier, -(-waiting // DIRECTORIES_PER_TASK)), root), "listing")
        if not levels and config is not None and config.ignore_name is not None:
            own = level.where((F.col("path") == config.ignore_name) & (F.col("kind") == FILE))
            rules = materialised(ignore_regexes(as_text(read_files(own, root)), config.ignore_name), "rules")
        levels.append(level)
        found = level.where(F.col("kind") == DIRECTORY).select("repo", "path", "location")
        found = found.withColumn("hidden", F.lit(False)) if config is None else directory_excluded(found, config, rules, "hidden")
        found = materialised(found, "directories")
        hidden.append(found.where("hidden"))
        frontier = found.where("NOT hidden").drop("hidden")
    if not levels:
        empty = spark.createDataFrame([], _ENTRIES)
        levels, hidden = [empty], [empty.withColumn("hidden", F.lit(True))]
    every = reduce(DataFrame.union, levels)
    return Listing(
        root,
        repos.select("repo"),
        every.where(F.col("kind") == FILE).drop("kind"),
        reduce(DataFrame.union, hidden).select("repo", "path"),
        every.where(F.col("kind") == CLOSED).select("repo", "path"),
        rules,
    )


def read_files(files: DataFrame, root: str) -> DataFrame:
    """Add ``raw`` to files (repo, path, size_bytes, location): their bytes, null where they can't be read.

    Narrow rows are dealt out by bytes and number first, so that tasks read about as much each.
    """
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    tasks = -(-n // FILES_PER_TASK) + size // BYTES_PER_TASK
    kept = [c for c in files.columns if c != "location"]
    fields = [pa.field("raw", pa.binary())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            own = batch.select(kept)
            start, held, weight = 0, [], 0
            for location in batch.column("location").to_pylist():
                held.append(store.read(location))
                weight += len(held[-1] or b"") + 256
                if weight >= _BATCH_BYTES:
                    yield _with_raw(own.slice(start, len(held)), held, fields)
                    start, held, weight = start + len(held), [], 0
            if held:
                yield _with_raw(own.slice(start, len(held)), held, fields)

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c != "location")
    return _dealt(files, tasks).mapInArrow(work, f"{schema}, raw binary")


def _with_raw(rows: pa.RecordBatch, raw: list[bytes | None], fields: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(raw, pa.binary())], schema=pa.schema([*rows.schema, *fields]))


def as_text(files: DataFrame) -> DataFrame:
    """``raw`` as ``content``, and whether that is valid text."""
    text = F.col("raw").cast("string")
    readable = F.coalesce(F.is_valid_utf8(text), F.lit(False))
    return files.withColumns({"content": text, "readable": readable}).drop("raw")
