"""Greedy token-budget chunks, exact, with no repository confined to one task.

Files of a repository, in path order, fill a chunk until the next one would exceed the
budget. That is a sequential fold, but its state is one number, the running cost of
the open chunk, so a block of consecutive files acts as a step function from the
state before it to the state after it: constant between a few breakpoints, apart from the states in
which the open chunk takes in the whole block.

1. Every block computes its own function in parallel.
2. Functions of neighbouring blocks are composed, FAN at a time, in a tree; a composition is such a
   function again, and has no more breakpoints than a chunk has files.
3. Entry states go down the same tree, from the whole to the blocks.
4. Every block replays the fold from its entry state in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspack.operators.ordered import ordered_blocks
from corpuspack.session import materialised

# Fixed value: tokens set aside in every chunk for header, contents and tree.
CHUNK_OVERHEAD = 1_000

#: Neighbours whose functions one task composes.
FAN = 16
#: Shorter runs of files are folded one by one.
SHORT_RUN = 48

_NO_LIMIT = np.iinfo(np.int64).max
_NOTHING = np.empty(0, np.int64)
_STEPS = (
    "block bigint, first string, last string, fixed boolean, begun bigint, running bigint, total bigint, "
    "absorbs bigint, upto array<bigint>, counts array<bigint>, exits array<bigint>"
)
_STEPS_FIELDS = pa.schema(
    [("block", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("fixed", pa.bool_())]
    + [(c, pa.int64()) for c in ("begun", "running", "total", "absorbs")]
    + [(c, pa.list_(pa.int64())) for c in ("upto", "counts", "exits")]
)
_ENTRY = "block bigint, repo string, begun bigint, running bigint"
_ENTRY_FIELDS = pa.schema([("block", pa.int64()), ("repo", pa.string()), ("begun", pa.int64()), ("running", pa.int64())])


@dataclass
class Steps:
    """What a run of consecutive files does to the state (chunks begun, running cost) before it.

    From a fresh start it leads to ``begun`` and ``running``; if ``fixed``, from any state, because a repository
    begins within the run. Otherwise a running cost up to ``absorbs`` just grows by ``total``, and a larger one, up
    to ``upto[i]``, leads to ``exits[i]`` with ``counts[i]`` more chunks begun.
    """

    first: str
    last: str
    fixed: bool
    begun: int
    running: int
    total: int = 0
    absorbs: int = 0
    upto: np.ndarray = None
    counts: np.ndarray = None
    exits: np.ndarray = None

    def after(self, begun: np.ndarray, running: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after those given, of the repository that the run begins with."""
        if self.fixed:
            return np.full(len(begun), self.begun), np.full(len(begun), self.running)
        at = np.minimum(np.searchsorted(self.upto, running), max(len(self.upto) - 1, 0))
        fresh, taken = running == CHUNK_OVERHEAD, running <= self.absorbs
        more, exits = (x[at] if len(x) else np.zeros(len(begun), np.int64) for x in (self.counts, self.exits))
        more = np.where(fresh, self.begun, np.where(taken, 0, more))
        return begun + more, np.where(fresh, self.running, np.where(taken, running + self.total, exits))

    def enter(self, repo: str | None, begun: int, running: int) -> tuple[int, int]:
        """The state in which the run is entered: a fresh one where another repository begins."""
        return (begun, running) if repo == self.first else (0, CHUNK_OVERHEAD)

    def leave(self, repo: str | None, begun: int, running: int) -> tuple[str, int, int]:
        """The state after the run."""
        state = self.enter(repo, begun, running)
        (begun,), (running,) = self.after(*(np.array([x]) for x in state))
        return self.last, int(begun), int(running)


def next_starts(costs: np.ndarray, budget: int) -> np.ndarray:
    """For each file, where the following chunk begins if a chunk begins at that file."""
    n = len(costs)
    prefix = np.concatenate([[0], np.cumsum(costs)])
    position = np.arange(n)
    fits = np.searchsorted(prefix, budget - CHUNK_OVERHEAD + prefix[:-1], side="right") - 1
    oversize = np.append(np.flatnonzero(costs > budget), n)
    stop = oversize[np.searchsorted(oversize, position, side="left")]
    # An oversize file stands alone; any other chunk takes at least its first file.
    return np.where(stop == position, position + 1, np.clip(fits, position + 1, stop))


def from_starts(costs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks begun, and running cost at the end, for every file as first chunk start. Chains of starts are followed
    by doubling."""
    n = len(costs)
    jump = np.append(next_starts(costs, budget), n)
    begun = np.append(np.ones(n, np.int64), 0)
    last = np.where(jump < n, jump, np.arange(n + 1))
    while (jump < n).any():
        begun = begun + begun[jump]
        jump = jump[jump]
        last = last[last]
    last = last[last][:n]
    suffix = np.cumsum(costs[::-1])[::-1]
    return begun[:n], np.where(costs[last] > budget, CHUNK_OVERHEAD, CHUNK_OVERHEAD + suffix[last])


def _merged(upto: np.ndarray, counts: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring pieces of the same value as one; what no running cost reaches is left out."""
    keep = upto > CHUNK_OVERHEAD
    upto, counts, exits = upto[keep], counts[keep], exits[keep]
    ends = np.ones(len(upto), bool)
    ends[:-1] = (counts[1:] != counts[:-1]) | (exits[1:] != exits[:-1])
    return upto[ends], counts[ends], exits[ends]


def steps_of(repo: str, costs: np.ndarray, budget: int) -> Steps:
    """The function of files of one repository."""
    begun, running = from_starts(costs, budget)
    prefix = np.concatenate([[0], np.cumsum(costs)])
    oversize = np.flatnonzero(costs > budget)
    # An open chunk takes files up to the first that is oversize or no longer fits, where the next chunk begins.
    latest = int(oversize[0]) if len(oversize) else len(costs) - 1
    latest = min(latest, int(np.searchsorted(prefix, budget - CHUNK_OVERHEAD, side="right")))
    starts = np.arange(latest, -1, -1)
    upto = budget - prefix[starts]
    upto[-1] = _NO_LIMIT
    absorbs = 0 if len(oversize) else max(0, int(budget - prefix[-1]))
    pieces = _merged(upto, begun[starts], running[starts])
    return Steps(repo, repo, False, int(begun[0]), int(running[0]), int(prefix[-1]), absorbs, *pieces)


def composed(one: Steps, other: Steps) -> Steps:
    """``one``, then ``other``."""
    if other.fixed or one.last != other.first:
        return Steps(one.first, other.last, True, other.begun, other.running, upto=_NOTHING, counts=_NOTHING, exits=_NOTHING)
    if one.fixed:
        _, begun, running = other.leave(one.last, one.begun, one.running)
        return Steps(one.first, other.last, True, begun, running, upto=_NOTHING, counts=_NOTHING, exits=_NOTHING)
    (begun,), (running,) = other.after(np.array([one.begun]), np.array([one.running]))
    counts, exits = other.after(one.counts, one.exits)
    absorbs = max(0, min(one.absorbs, other.absorbs - one.total))
    # Costs that the first run absorbs meet the second one's pieces, grown by its total.
    limits = np.minimum(np.where(other.upto == _NO_LIMIT, _NO_LIMIT, other.upto - one.total), one.absorbs)
    inside = limits > absorbs
    inside[1:] &= limits[:-1] < one.absorbs
    pieces = _merged(
        np.concatenate((limits[inside], one.upto)),
        np.concatenate((other.counts[inside], counts)),
        np.concatenate((other.exits[inside], exits)),
    )
    return Steps(one.first, other.last, False, int(begun), int(running), one.total + other.total, absorbs, *pieces)


# Passes over blocks


def _rows(steps: list[tuple[int, Steps]]) -> list[list]:
    return [[block, *(x.tolist() if isinstance(x, np.ndarray) else x for x in astuple(one))] for block, one in steps]


def _table(rows: list[list], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def _read(table: pa.Table) -> list[tuple[int, Steps]]:
    """Functions in block order."""
    names = [f.name for f in fields(Steps)]
    lists = ("upto", "counts", "exits")
    rows = table.sort_by("block").to_pylist()
    return [(r["block"], Steps(*(np.array(r[c], np.int64) if c in lists else r[c] for c in names))) for r in rows]


def _summarise(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first = last = None
        pieces: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            repos = batch.column("repo")
            if first is None:
                block, first = batch.column("block")[0].as_py(), repos[0].as_py()
            tail = repos[-1].as_py()
            costs = batch.column("tokens").to_numpy()
            if tail != last:
                # Only the last repository of a block has state to hand on.
                own = pc.equal(repos, tail).to_numpy(zero_copy_only=False)
                costs, pieces, last = costs[own], [], tail
            pieces.append(costs)
        if first is None:
            return
        steps = steps_of(last, np.concatenate(pieces), budget)
        if first != last:
            steps = Steps(first, last, True, steps.begun, steps.running, upto=_NOTHING, counts=_NOTHING, exits=_NOTHING)
        yield from _table(_rows([(block, steps)]), _STEPS_FIELDS).to_batches()

    return run


def _compose(table: pa.Table) -> pa.Table:
    """The function of up to FAN neighbours."""
    (block, whole), *others = _read(table)
    for _, one in others:
        whole = composed(whole, one)
    return _table(_rows([(block // FAN, whole)]), _STEPS_FIELDS)


def _enter(table: pa.Table, above: pa.Table) -> pa.Table:
    """Entry states of neighbours, from the one in which all of them are entered."""
    rows = []
    for state in above.to_pylist():
        repo, begun, running = state["repo"], state["begun"], state["running"]
        for block, one in _read(table):
            rows.append([block, repo if repo == one.first else None, *one.enter(repo, begun, running)])
            repo, begun, running = one.leave(repo, begun, running)
    return _table(rows, _ENTRY_FIELDS)


def _group() -> F.Column:
    return F.floor(F.col("block") / FAN).cast("bigint").alias("family")


def entry_states(functions: DataFrame) -> DataFrame:
    """``(block, repo, begun, running)``: the state in which each block is entered; ``repo`` is null for a fresh start."""
    levels = [functions]
    while levels[-1].count() > FAN:
        above = levels[-1].groupBy(_group()).applyInArrow(_compose, _STEPS)
        levels.append(materialised(above, "steps"))
    spark = functions.sparkSession
    # The last level has at most FAN functions; their numbers may lie in two families.
    top = levels.pop()
    entries = top.withColumn("family", F.lit(0).cast("bigint")).groupBy("family")
    start = spark.createDataFrame([(0, None, 0, CHUNK_OVERHEAD)], _ENTRY)
    entries = entries.cogroup(start.groupBy("block")).applyInArrow(_enter, _ENTRY)
    for level in reversed(levels):
        entries = level.groupBy(_group()).cogroup(entries.groupBy("block")).applyInArrow(_enter, _ENTRY)
    return entries


def _fold(costs: np.ndarray, begun: int, running: int, budget: int) -> tuple[np.ndarray, int, int]:
    """Chunk of each file from a state on, and the state after."""
    if len(costs) < SHORT_RUN:
        chunks = []
        for cost in costs.tolist():
            if running == CHUNK_OVERHEAD or running + cost > budget:
                begun, running = begun + 1, CHUNK_OVERHEAD
            chunks.append(begun)
            running = CHUNK_OVERHEAD if cost > budget else running + cost
        return np.array(chunks, np.int64), begun, running
    start = 0
    if running != CHUNK_OVERHEAD:
        oversize = np.flatnonzero(costs > budget)
        absorbed = int(np.searchsorted(np.cumsum(costs), budget - running, side="right"))
        start = min(absorbed, int(oversize[0])) if len(oversize) else absorbed
    n, following = len(costs), next_starts(costs, budget)
    starts = []
    while start < n:
        starts.append(start)
        start = int(following[start])
    if not starts:
        return np.full(n, begun), begun, running + int(costs.sum())
    chunks = begun + np.searchsorted(starts, np.arange(n), side="right")
    last = starts[-1]
    running = CHUNK_OVERHEAD if costs[last] > budget else CHUNK_OVERHEAD + int(costs[last:].sum())
    return chunks, begun + len(starts), running


def _replay(budget: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, begun, running, entered = None, 0, CHUNK_OVERHEAD, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not entered:
                repo, begun, running = (batch.column(c)[0].as_py() for c in ("entry_repo", "entry_begun", "entry_running"))
                entered = True
            costs, owners = batch.column("tokens").to_numpy(), pc.run_end_encode(batch.column("repo"))
            chunks, at = [], 0
            for owner, end in zip(owners.values.to_pylist(), owners.run_ends.to_pylist()):
                if owner != repo:
                    repo, begun, running = owner, 0, CHUNK_OVERHEAD
                part, begun, running = _fold(costs[at:end], begun, running, budget)
                chunks.append(part)
                at = end
            found = pa.array(np.concatenate(chunks), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [found], [*columns, "chunk"])

    return run


def assign_chunks(files: DataFrame, budget: int) -> DataFrame:
    """Add ``chunk`` to file metadata holding ``repo``, ``path`` and ``tokens``.

    The other columns travel along untouched, which spares joining the result back.
    Texts must not be among them.
    """
    columns = files.columns
    blocks = ordered_blocks(files, ["repo", "path"])
    functions = blocks.select("repo", "tokens", F.col("block").cast("bigint").alias("block"))
    functions = materialised(functions.mapInArrow(_summarise(budget), _STEPS), "steps")
    entries = entry_states(functions).select(
        F.col("block").cast("int").alias("block"),
        F.col("repo").alias("entry_repo"),
        F.col("begun").alias("entry_begun"),
        F.col("running").alias("entry_running"),
    )
    # One row per block, so the broadcast is bounded by the number of partitions.
    started = blocks.join(F.broadcast(entries), "block", "left")
    schema = T.StructType([*files.schema.fields, T.StructField("chunk", T.LongType())])
    return started.select(*columns, "entry_repo", "entry_begun", "entry_running").mapInArrow(
        _replay(budget, columns), schema
    )
