"""Exact nearest neighbours of a stated query set: a block matrix join of int8 tiles with error bounds.

Queries and candidates are dealt by id into groups of bounded size, and packed into blocks by falling norm. A cell of the
grid of groups is one task's work: it holds its queries and meets its candidates block by block. What moves is each side
once per group of the other. The product of two blocks is one tile: both sides are rounded to int8 with one scale per
vector, the product of the integers is exact, and what rounding can have changed is bounded by

    |q.c - sq sc Q.C| <= |Q sq| . |c - C sc| + |q - Q sq| . |c|

in Euclidean norms. A pair survives if its upper bound reaches the k-th largest lower bound of its query so far.
Tiles whose largest norms can't reach it are left out. Survivors are computed from the original vectors in double
precision, component by component in order, and kept in a heap per query and cell. A window over each query merges the
heaps of its cells.

Vectors that are null or zero, hold null or non-finite components, or lack a vec_id take no part. Rows that repeat a
vec_id count once, with the least of their vectors. Vectors of another length than a query's are no candidates for it. Ties go
to the smaller vec_id; with fewer than k candidates all are returned. Other columns aren't used. Empty tables give
empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors in a block of queries and of candidates, at most, and components in a block from which it is closed.
QUERY_BLOCK, CANDIDATE_BLOCK, BLOCK_COMPONENTS = 256, 2048, 1 << 17
#: Components that one group of queries and one of candidates holds on average.
QUERY_GROUP, CANDIDATE_GROUP = 1 << 20, 1 << 19


def component(vectors: DataFrame) -> str:
    """Vectors of floats stay so; any others are taken as doubles, so that no score loses precision."""
    return "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dims) of the vectors that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    kept = vectors.where(F.col("vec_id").isNotNull() & good & some)
    kept = kept.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast(f"array<{component(vectors)}>"))
    return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dims", F.size("embedding"))


def length(vector: str) -> Column:
    """The Euclidean norm, up to rounding; it orders blocks and decides nothing."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def packed(vectors: DataFrame, groups: int, rows: int) -> DataFrame:
    """(group, dims, ids, data, top): blocks of up to ``rows`` vectors of one group and one length, as bytes, and the
    largest norm. Groups are drawn by id; within one, norms fall from block to block."""
    kind = np.float32 if component(vectors) == "float" else np.float64
    schema = pa.schema([("group", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("top", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, parts, top = None, [], [], 0.0

        def block():
            data = np.concatenate(parts).astype(kind)
            arrays = [[place[0]], [place[1]], [np.array(ids, np.int64).tobytes()], [data.tobytes()], [top]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(arrays, schema)], schema=schema)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("vec_id", "group", "dims", "norm"))
            for key, group, dims, norm, vector in zip(*columns, batch.column("embedding")):
                if ids and (place != (group, dims) or len(ids) >= rows or len(ids) * dims >= BLOCK_COMPONENTS):
                    yield block()
                    ids, parts = [], []
                if not ids:
                    place, top = (group, dims), norm
                ids.append(key)
                parts.append(vector.values.to_numpy(zero_copy_only=False))
        if ids:
            yield block()

    dealt = vectors.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("norm", length("embedding"))
    dealt = dealt.repartition("group", "dims").sortWithinPartitions("group", "dims", F.desc("norm"), "vec_id")
    return dealt.mapInArrow(work, "group int, dims int, ids binary, data binary, top double")


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, and per vector: scale, norm of the rounded vector, norm of the rounding error."""
    scale = np.abs(x).max(1, initial=0) / 127
    scale[scale == 0] = 1
    whole = np.rint(x / scale[:, None]).astype(np.int8)
    back = whole * scale[:, None]
    return whole, scale, np.sqrt((back**2).sum(1)), np.sqrt(((x - back) ** 2).sum(1))


class Heaps:
    """The best k candidates of each query of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x.astype(np.float64), k
        self.whole, self.scale, self.norm, self.error = rounded(self.x)
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)
        self.reach = np.sqrt((self.x**2).sum(1)) * (1 + 1e-9)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        x = x.astype(np.float64)
        if len(ids) and (self.reach * np.sqrt((x**2).sum(1).max()) < self.least).all():
            return
        whole, scale, _, error = rounded(x)
        # Products of int8 vectors of up to 1,000 components are exact in float32; longer ones take float64.
        kind = np.float32 if x.shape[1] <= 1000 else np.float64
        tile = (self.whole.astype(kind) @ whole.T.astype(kind)).astype(np.float64) * self.scale[:, None] * scale
        slack = self.norm[:, None] * error + self.error[:, None] * np.sqrt((x**2).sum(1))
        slack = slack * (1 + 1e-9) + 1e-12 * (1 + np.abs(tile))
        tile[self.ids[:, None] == ids] = -np.inf
        lower = tile - slack
        floor = self.least
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(lower, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        q, c = np.nonzero((tile + slack >= floor[:, None]) & np.isfinite(tile))
        score = np.zeros(len(q))
        for d in range(x.shape[1]):
            score += self.x[q, d] * x[c, d]
        edges = np.searchsorted(q, np.arange(len(self.ids) + 1))
        for i in range(len(self.ids)):
            if (lo := edges[i]) < (hi := edges[i + 1]):
                found = list(zip(score[lo:hi].tolist(), (-ids[c[lo:hi]]).tolist()))
                self.best[i] = heapq.nlargest(self.k, self.best[i] + found)
                if len(self.best[i]) == self.k:
                    self.least[i] = self.best[i][-1][0]

    def rows(self) -> tuple[list, list, list]:
        each = [(q, -negative, s) for q, best in zip(self.ids.tolist(), self.best) for s, negative in best]
        return tuple(map(list, zip(*each))) if each else ([], [], [])


def groups_of(vectors: DataFrame, is_query: Column) -> tuple[int, int]:
    """How many groups queries and candidates are dealt into, by the components they hold."""
    held = F.greatest(F.size("embedding"), F.lit(0)).cast("bigint")
    queries, candidates = vectors.agg(F.sum(F.when(is_query, held)), F.sum(held)).first()
    return -(-(queries or 1) // QUERY_GROUP), -(-(candidates or 1) // CANDIDATE_GROUP)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product for each query."""
    kept = usable(vectors)
    kind = np.float32 if component(vectors) == "float" else np.float64
    query_groups, candidate_groups = groups_of(vectors, is_query)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = packed(kept.where(is_query), query_groups, QUERY_BLOCK)
    queries = queries.select(F.col("group").alias("row"), each(candidate_groups).alias("column"), F.lit(0).alias("side"), "dims", "ids", "data", "top")
    candidates = packed(kept, candidate_groups, CANDIDATE_BLOCK)
    candidates = candidates.select(each(query_groups).alias("row"), F.col("group").alias("column"), F.lit(1).alias("side"), "dims", "ids", "data", "top")
    # A cell (row, column) of one length: first its queries, then its candidates by falling norm.
    cells = queries.unionByName(candidates).repartition("dims", "row", "column")
    cells = cells.sortWithinPartitions("dims", "row", "column", "side", F.desc("top"), "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def flushed():
            for heaps in held:
                q, c, s = heaps.rows()
                arrays = [pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("dims", "row", "column", "side")))
            for at, (dims, row, column, side) in enumerate(places):
                if cell != (dims, row, column):
                    yield from flushed()
                    cell, held = (dims, row, column), []
                if side and not held:
                    continue  # candidates of a length that no query has
                ids = np.frombuffer(batch.column("ids")[at].as_py(), np.int64)
                x = np.frombuffer(batch.column("data")[at].as_py(), kind).reshape(-1, dims)
                if not side:
                    held.append(Heaps(ids, x, k))
                    continue
                for heaps in held:
                    heaps.meet(ids, x)
        yield from flushed()

    found = cells.mapInArrow(work, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
