"""N-gram Jaccard join: every pair of texts whose shingle sets are similar enough, by a size-aware join.

Sets are of distinct 5-word shingles. Two sets of sizes p <= q can have a Jaccard similarity of t or more only if
they share t * q shingles. In any order of shingles common to all sets, they then share at least c among the first
``size - ceil(t * size) + c`` of each. The join has a light and a heavy side:

* Small sets enumerate all subsets of two of those (c = 2); equal subsets make candidates.
* Large sets scan inverted lists of single shingles (c = 1), which also hold the small sets within reach.

The boundary between them minimises a cost taken from a histogram of all sizes and the mean length of a list. The
order puts widespread shingles last. Which ones those are is counted over all documents (a bounded list of the most
frequent); it steers the work and cannot change the result.

Equal sets become one node. A list of few nodes yields all its pairs; a longer one links each node to the first and
to the next, and its other pairs are examined where nodes remain in different components. Candidates pass an
exact bound first: parity bitmaps of the sets differ in at most as many bits as the sets have elements that differ.
The rest are verified on their texts. Links between nodes of a long list that are connected already can't change a
component; they are counted, not emitted: the sets of such nodes of a component are dealt into parts of bounded size,
and every two parts meet once in a matrix of overlaps.

Null and blank texts have an empty set and are linked with nothing. Texts of any length count as a whole. Rows are
told apart by a digest of doc_id and text. Rows that repeat a doc_id are separate rows, and so are rows without one; a
null doc_id never names a component unless no other doc_id is in it. Rows that repeat doc_id and text count as equal
copies. Other columns of the input aren't used. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import batches_of, rows_of
from corpuspack.llm.components import connected_components
from corpuspack.llm.shingles import mixed, set_digest, shingle_sets
from corpuspack.session import materialised

#: Frequent shingles that are put last: the bound of what is sent to workers.
FREQUENT = 100_000
#: A worker reports a shingle that it meets this often among COUNTED shingles. It counts equal sets once.
REPORTED, COUNTED = 2, 1 << 20
#: Lists of up to this many nodes yield all their pairs at once.
SMALL_LIST = 8
#: The boundary is sought among sizes up to this.
LARGEST_LIGHT = 64
#: Rounds in which what a long list leaves apart meets HUBS nodes of its largest component.
HUB_ROUNDS, HUBS = 2, 4
#: Lists that a node knows it is in, to be compared with another node once.
KNOWN_LISTS = 64
#: Nodes of a long list that are compared in one place.
LIST_PART = 4096
#: Keys that one block holds on average.
BLOCK_KEYS = 200_000
#: Nodes and shingles that a part of a component holds on average when its links are counted.
COUNT_NODES, COUNT_SHINGLES = 2048, 1 << 19
#: Bits of the map by which rows that no pair asks for stay where they are: 8 MB, whatever the input's size.
MAP_BITS = 1 << 26

_ENTRY = np.dtype([("key", "<u4"), ("size", "<u4"), ("node", "<i8")])
_NODE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def needed(percent: int, size):
    """The least overlap that a set of this size must have with one no larger."""
    return -(-size * percent // 100)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ``row`` stands for doc_id and text."""
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("row"), "text")


def facts(docs: DataFrame, words: int) -> DataFrame:
    """One row per document (doc_id, row, node, size, bitmap), and rows (node: shingle, size: count, no bitmap)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, count = [], 0
            seen: set[int] = set()
            for keys, owner, values in shingle_sets(keyed(batches), words):
                edges = np.searchsorted(owner, np.arange(len(keys) + 1))
                for key, lo, hi in zip(keys, edges, edges[1:]):
                    own = values[lo:hi]
                    node = set_digest(own) if len(own) else None
                    yield (*key, node, len(own), parity(own)), 48 + len(own) // 4
                    if len(own) and node not in seen:
                        seen.add(node)
                        held.append(own)
                        count += len(own)
                if count >= COUNTED:
                    yield from frequent(held)
                    held, count = [], 0
            yield from frequent(held)

        def frequent(held):
            if held:
                values, counts = np.unique(np.concatenate(held), return_counts=True)
                often = counts >= REPORTED
                for value, n in zip(values[often].view(np.int64).tolist(), counts[often].tolist()):
                    yield (None, None, value, n, None), 24

        whole = [(name, pa.int64()) for name in ("doc_id", "row", "node", "size")]
        yield from batches_of(rows(), pa.schema([*whole, ("bitmap", pa.binary())]))

    def keyed(batches):
        return (((key, row), text) for key, row, text in rows_of(batches, "doc_id", "row", "text"))

    return numbered(docs).mapInArrow(work, "doc_id bigint, row bigint, node bigint, size bigint, bitmap binary")


def parity(values: np.ndarray) -> bytes:
    """A bitmap of at least two bits per element; each element flips one."""
    bits = max(64, 1 << (2 * len(values) - 1).bit_length()) if len(values) else 64
    flips = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(one: bytes, other: bytes) -> int:
    """A lower bound of the number of elements in which two sets differ."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def boundary(histogram: dict[int, int], mean_list: float, percent: int) -> int:
    """The largest size whose sets enumerate subsets. Sizes over LARGEST_LIGHT count as one more."""

    def subsets(s):
        p = s - needed(percent, s) + 2
        return p * (p - 1) // 2

    def scans(s):
        return (s - needed(percent, s) + 1) * mean_list

    def cost(x):
        light = sum(n * subsets(s) for s, n in histogram.items() if s <= x)
        return light + sum(n * scans(s) for s, n in histogram.items() if s * 100 > x * percent)

    return min(range(LARGEST_LIGHT + 1), key=cost)


def keys_of(
    owner: np.ndarray, values: np.ndarray, sizes: np.ndarray, late: np.ndarray, light: int, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of all candidate keys. ``late``: frequent shingles by rising frequency's rank, sorted by shingle."""
    rank = np.zeros(len(values), np.int64)
    if len(late):
        at = np.minimum(np.searchsorted(late["value"], values), len(late) - 1)
        hit = late["value"][at] == values
        rank[hit] = late["rank"][at[hit]]
        order = np.lexsort((values, rank, owner))
        owner, values = owner[order], values[order]
    edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
    place = np.arange(len(values)) - edges[owner]
    prefix = sizes - needed(percent, sizes) + 1
    scans = (sizes > light) | (sizes * 100 > light * percent)
    single = scans[owner] & (place < prefix[owner])
    owners, keys = [owner[single]], [values[single]]
    for d in np.flatnonzero((sizes > 1) & (sizes <= light)):
        head = values[edges[d] : edges[d] + prefix[d] + 1]
        i, j = np.triu_indices(len(head), 1)
        lo, hi = np.minimum(head[i], head[j]), np.maximum(head[i], head[j])
        keys.append(mixed(mixed(lo + np.uint64(1)) ^ hi))
        owners.append(np.full(len(i), d))
    return np.concatenate(owners), np.concatenate(keys)


def blocks(docs: DataFrame, words: int, percent: int, late: np.ndarray, light: int, n_blocks: int) -> DataFrame:
    """(block, entries): keys with their nodes, dealt out by key. A worker sends each node once."""
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            seen: set[int] = set()
            held, count = [], 0
            for keys, owner, values in shingle_sets(rows_of(batches, "doc_id", "text"), words):
                edges = np.searchsorted(owner, np.arange(len(keys) + 1))
                sizes = np.diff(edges)
                nodes = np.array([set_digest(values[a:b]) if b > a else 0 for a, b in zip(edges, edges[1:])], np.int64)
                fresh = np.zeros(len(nodes), bool)
                for i, node in enumerate(nodes.tolist()):
                    if sizes[i] and node not in seen:
                        seen.add(node)
                        fresh[i] = True
                owners, found = keys_of(owner, values, sizes, shared.value, light, percent)
                use = fresh[owners]
                held.append((found[use], nodes[owners[use]], sizes[owners[use]]))
                count += int(use.sum())
                if count >= COUNTED // 2:
                    yield from packed(held)
                    held, count = [], 0
            yield from packed(held)

        def packed(held):
            if not held:
                return
            key, node, size = (np.concatenate(x) for x in zip(*held))
            block = ((key >> np.uint64(32)) % np.uint64(n_blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            entries = np.empty(len(key), _ENTRY)
            entries["key"], entries["node"], entries["size"] = key[order] & np.uint64(0xFFFFFFFF), node[order], size[order]
            cut = np.searchsorted(block[order], np.arange(n_blocks + 1))
            for b in range(n_blocks):
                if cut[b] < cut[b + 1]:
                    data = entries[cut[b] : cut[b + 1]].tobytes()
                    yield (b, data), len(data)

        yield from batches_of(rows(), pa.schema([("block", pa.int32()), ("entries", pa.binary())]))

    return docs.select("doc_id", "text").mapInArrow(work, "block int, entries binary")


def listed(entries: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Candidate pairs (a, b) of one block, and its longer lists of nodes. Equal lists appear once."""
    entries = np.unique(entries)  # by key, then size, then node
    edge = np.flatnonzero(np.concatenate(([True], entries["key"][1:] != entries["key"][:-1], [True])))
    length = np.diff(edge)
    node, size = entries["node"], entries["size"].astype(np.int64)
    start = np.repeat(edge[:-1], length)
    rest = np.repeat(length, length)
    at = np.arange(len(entries))
    left, right = [], []
    for step in range(1, SMALL_LIST):
        # every pair of a short list; of a longer one, neighbours
        here = at[(at - start + step < rest) & ((rest <= SMALL_LIST) | (step == 1))]
        left.append(here)
        right.append(here + step)
    hub = at[(rest > SMALL_LIST) & (at > start)]
    left.append(start[hub])
    right.append(hub)
    a, b = np.concatenate(left), np.concatenate(right)
    fit = size[a] * 100 >= size[b] * percent
    a, b = node[a[fit]], node[b[fit]]
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
    lists = {}
    for lo, n in zip(edge[:-1][length > SMALL_LIST], length[length > SMALL_LIST]):
        members = np.sort(node[lo : lo + n])
        lists[members.tobytes()] = members
    return pairs[:, 0], pairs[:, 1], list(lists.values())


def candidates(packed: DataFrame, percent: int) -> DataFrame:
    """(a, b, members): pairs without members, and longer lists without a pair."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        entries = np.concatenate([np.frombuffer(x, _ENTRY) for x in part["entries"]])
        a, b, lists = listed(entries, percent)
        pairs = pd.DataFrame({"a": a, "b": b, "members": None})
        return pd.concat([pairs, pd.DataFrame({"a": 0, "b": 0, "members": lists}, dtype=object)]) if lists else pairs

    return packed.groupBy("block").applyInPandas(work, "a bigint, b bigint, members array<bigint>")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their bitmaps don't rule out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("bitmap").alias(f"bitmap_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for a, b, m, n, one, other in rows_of(batches, "a", "b", "size_a", "size_b", "bitmap_a", "bitmap_b"):
                # the overlap is half of what both sizes exceed the difference by
                overlap = (m + n - least_difference(one, other)) // 2
                if overlap * 100 >= percent * (m + n - overlap):
                    yield (a, b), 16

        yield from batches_of(rows(), _NODE)

    return both.mapInArrow(work, "a bigint, b bigint")


def asked(docs: DataFrame, sides: DataFrame) -> DataFrame:
    """(row, text) of the rows that ``sides`` (row) names, and of a few more: a map of a fixed number of bits, sent to all
    tasks, tells most others before any text moves."""
    place = F.pmod("row", F.lit(MAP_BITS))
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = sides.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, int(bit div 8) + 1, 1)")), 16, 10).cast("int")
    found = numbered(docs).withColumns({"bucket": bucket, "bit": bit}).join(F.broadcast(maps), "bucket")
    return found.where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select("row", "text")


def verified(pairs: DataFrame, chosen: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sets are similar enough. ``chosen`` (node, row) names a row of each node.

    The narrow side is written first, so its real size decides how it meets the texts; no other text moves on.
    """
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    sides = materialised(sides.join(chosen, "node").select("a", "b", "row"), "jaccard-sides")
    met = asked(docs, sides).join(sides, "row")
    met = met.groupBy("a", "b").agg(F.collect_set("text").alias("texts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for a, b, found in rows_of(batches, "a", "b", "texts"):
                for text in found:
                    yield (a, b), text

        def rows():
            pair, sets = None, {}
            for keys, owner, values in shingle_sets(each(), words):
                edges = np.searchsorted(owner, np.arange(len(keys) + 1))
                for key, lo, hi in zip(keys, edges, edges[1:]):
                    if key != pair:
                        pair, sets = key, {}
                    # digests of rows that clash can bring in other texts: only the two sets asked for count
                    digest = set_digest(values[lo:hi])
                    if digest in key and digest not in sets:
                        sets[digest] = values[lo:hi]
                        if len(sets) == 2:
                            one, other = sets.values()
                            overlap = len(np.intersect1d(one, other, assume_unique=True))
                            if overlap * 100 >= percent * (len(one) + len(other) - overlap):
                                yield key, 16

        yield from batches_of(rows(), _NODE)

    return met.mapInArrow(work, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, percent: int = 75, words: int = 5, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): n_links counts the other rows that a row's set is similar enough to.
    Without ``count_links`` that column is left out; components are the same."""
    spark = docs.sparkSession
    known = materialised(facts(docs, words), "jaccard-facts")
    rows = known.where("bitmap is not null")
    sized = rows.where("size > 0")
    nodes = materialised(
        sized.groupBy("node").agg(F.min("size").alias("size"), F.min("bitmap").alias("bitmap")), "jaccard-nodes"
    )
    counted = known.where("bitmap is null").groupBy("node").agg(F.sum("size").alias("n"))
    top = counted.orderBy(F.desc("n"), "node").limit(FREQUENT).collect()
    late = np.array([(value % (1 << 64), rank) for rank, (value, _) in zip(range(len(top), 0, -1), top)], [("value", "<u8"), ("rank", "<i8")])
    late = np.sort(late, order="value")
    by_size = {
        r["s"]: r["n"]
        for r in nodes.groupBy(F.least("size", F.lit(LARGEST_LIGHT + 1)).alias("s")).agg(F.count("*").alias("n")).collect()
    }
    total = nodes.agg(F.sum("size")).first()[0] or 0
    mean_list = 1 + sum(n * n for _, n in top) / max(1, total)
    light = boundary(by_size, mean_list, percent)
    n_blocks = max(1, ceil(total * (100 - percent) / 100 / BLOCK_KEYS), min(total // 1000, 24))

    found = materialised(candidates(blocks(docs, words, percent, late, light, n_blocks), percent), "jaccard-candidates")
    pairs = found.where("members is null").select("a", "b").distinct()
    near = materialised(plausible(pairs, nodes, percent), "jaccard-pairs")
    lists = found.where("members is not null").select("members").distinct()
    lists = materialised(lists.withColumn("list", F.monotonically_increasing_id()), "jaccard-lists")
    members = lists.select("list", F.explode("members").alias("node"))

    # One row for each node stands for its set; where there is a choice, one with a doc_id.
    chosen = sized.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"), F.count("*").alias("copies"))
    chosen = materialised(chosen.select("node", F.col("least.row").alias("row"), F.col("least.doc_id").alias("first"), "copies"), "jaccard-chosen")
    links = materialised(verified(near, chosen, docs, words, percent), "jaccard-links")
    labels = connected_components(links)

    # Pairs of long lists whose nodes aren't connected yet: first with a few nodes of the list's largest component,
    # which settles most, then with all.
    for turn in range(HUB_ROUNDS + 1):
        placed = members.join(labels, "node", "left").select("list", "node", F.coalesce("component", "node").alias("component"))
        if turn < HUB_ROUNDS:
            rest = materialised(to_hubs(placed, turn).join(near, ["a", "b"], "left_anti"), "jaccard-hub-pairs")
            if rest.isEmpty():
                continue
            rest = plausible(rest, nodes, percent)
        else:
            rest = across(placed, nodes, percent).distinct().join(near, ["a", "b"], "left_anti")
        rest = materialised(rest, "jaccard-pairs")
        if rest.isEmpty():
            continue
        more = materialised(verified(rest, chosen, docs, words, percent), "jaccard-links")
        near, links = near.union(rest), links.union(more)
        if not more.isEmpty():
            labels = connected_components(links)

    per_node = chosen.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = per_node.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = per_node.join(least, "component").select("node", "component_id", "copies")
    out = ["doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    if not count_links:
        return rows.join(placed, "node", "left").select(*out)
    degree = degrees(docs, members, labels, links, chosen, words, percent)
    placed = placed.join(degree, "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    return rows.join(placed, "node", "left").select(*out, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def split(placed: DataFrame) -> DataFrame:
    """(list, major, n) of the lists whose nodes are in several components: the largest one, and all nodes."""
    parts = placed.groupBy("list", "component").agg(F.count("*").alias("n"))
    parts = parts.groupBy("list").agg(
        F.max(F.struct("n", "component")).alias("major"), F.sum("n").alias("n"), F.count("*").alias("components")
    )
    return parts.where("components > 1").select(
        "list", F.col("major.component").alias("major"), F.col("major.n").alias("major_n"), "n"
    )


def to_hubs(placed: DataFrame, turn: int) -> DataFrame:
    """(a, b): nodes outside a list's largest component, each with HUBS nodes inside it.

    Only for lists of which it is the larger part; elsewhere there is nothing to settle that way.
    """
    met = placed.join(split(placed).where("2 * major_n > n").select("list", "major"), "list")
    inside = F.col("component") == F.col("major")
    drawn = [F.min(F.when(inside, F.struct(F.xxhash64("node", F.lit(HUBS * turn + k)), "node"))).alias(f"hub_{k}") for k in range(HUBS)]
    hubs = met.groupBy("list").agg(*drawn)
    hubs = hubs.select("list", F.explode(F.array(*[F.col(f"hub_{k}.node") for k in range(HUBS)])).alias("hub"))
    pairs = met.where(~inside).select("list", "node").join(hubs, "list")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def across(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): plausible pairs of one list in different components. ``placed``: (list, node, component).

    A list is dealt out in parts of about LIST_PART nodes, and its nodes outside its largest component, the visitors, in
    parts of as many. Each part meets each part of visitors in a place of its own.
    """
    parts_of = lambda n: F.ceil(n / LIST_PART).cast("int")
    parts = split(placed).select("list", "major", parts_of(F.col("n")).alias("parts"), parts_of(F.col("n") - F.col("major_n")).alias("visits"))
    dealt = placed.join(parts, "list").withColumn("visitor", F.col("component") != F.col("major"))
    part = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    homes = dealt.select("list", "node", "component", "visitor", F.lit(True).alias("home"), part("parts").alias("i"), every("visits").alias("j"))
    visitors = dealt.where("visitor").select(
        "list", "node", "component", "visitor", F.lit(False).alias("home"), every("parts").alias("i"), part("visits").alias("j")
    )
    # Two nodes that meet in several lists are compared in the first, as far as each knows its first lists.
    lists = dealt.groupBy("node").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    lists = lists.select("node", F.slice("lists", 1, KNOWN_LISTS).alias("lists"))
    met = homes.unionByName(visitors).join(nodes.select("node", "size", "bitmap"), "node").join(lists, "node")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        here = group["list"].iloc[0]
        group = group.sort_values(["size", "node"])
        home, visitor = group[group["home"]], group[~group["home"]]
        size, node, component, outside = (home[c].to_numpy() for c in ("size", "node", "component", "visitor"))
        known = [frozenset(x[x < here].tolist()) for x in home["lists"]]
        maps = [np.frombuffer(x, np.uint64) for x in home["bitmap"]]
        widths = np.array([len(x) for x in maps])
        stacks = {w: (np.flatnonzero(widths == w), np.stack([m for m in maps if len(m) == w])) for w in set(widths.tolist())}
        folded: dict[tuple[int, int], np.ndarray] = {}

        def differences(own: np.ndarray, width: int, lo: int, hi: int) -> np.ndarray:
            """In how many bits the map differs from those of the homes of a width and of places from lo to hi."""
            least = min(width, len(own))
            if (width, least) not in folded:
                folded[width, least] = np.bitwise_xor.reduce(stacks[width][1].reshape(-1, width // least, least), axis=1)
            own = np.bitwise_xor.reduce(own.reshape(-1, least), axis=0)
            return np.bitwise_count(folded[width, least][lo:hi] ^ own).sum(1).astype(np.int64)

        left, right = [], []
        for n, key, place, bits, lists in zip(*(visitor[c] for c in ("size", "node", "component", "bitmap", "lists"))):
            own, before = np.frombuffer(bits, np.uint64), lists[lists < here].tolist()
            low, high = np.searchsorted(size * 100, n * percent), np.searchsorted(size * percent, n * 100, side="right")
            for width, (rows, _) in stacks.items():
                lo, hi = np.searchsorted(rows, [low, high])
                if lo >= hi:
                    continue
                other = rows[lo:hi]
                overlap = (n + size[other] - differences(own, width, lo, hi)) // 2
                near = overlap * 100 >= percent * (n + size[other] - overlap)
                # two visitors meet twice, each as the other's home
                other = other[near & (component[other] != place) & (~outside[other] | (node[other] < key))]
                if before:
                    other = other[[known[k].isdisjoint(before) for k in other]] if len(other) else other
                left.append(np.full(len(other), key))
                right.append(node[other])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return met.groupBy("list", "i", "j").applyInPandas(work, "a bigint, b bigint")


def degrees(
    docs: DataFrame, members: DataFrame, labels: DataFrame, links: DataFrame, chosen: DataFrame, words: int, percent: int
) -> DataFrame:
    """(node, links): the other rows, by their nodes' copies, that a node is linked with.

    Verified links are complete but for nodes that share a long list and a component. Such nodes of a component are
    open: links among them are counted anew from their sets.
    """
    together = members.join(labels, "node").groupBy("list", "component").agg(F.collect_set("node").alias("nodes"), F.count("*").alias("n"))
    opened = together.where("n > 1").select("component", F.explode("nodes").alias("node")).distinct()
    opened = materialised(opened.join(chosen.select("node", "row", "copies"), "node"), "jaccard-open")
    mark = opened.select("node", F.lit(True).alias("open"))
    sides = links.join(mark.withColumnsRenamed({"node": "a", "open": "open_a"}), "a", "left")
    sides = sides.join(mark.withColumnsRenamed({"node": "b", "open": "open_b"}), "b", "left")
    sides = sides.where("open_a is null or open_b is null")
    ends = sides.select("a", "b").union(sides.select(F.col("b").alias("a"), F.col("a").alias("b")))
    direct = ends.join(chosen.select(F.col("node").alias("b"), "copies"), "b").select(F.col("a").alias("node"), F.col("copies").alias("links"))
    return direct.union(counted(sets_of(docs, opened, words), percent)).groupBy("node").agg(F.sum("links").alias("links"))


def sets_of(docs: DataFrame, opened: DataFrame, words: int) -> DataFrame:
    """(component, node, copies, size, shingles) of the open nodes, written once."""
    met = asked(docs, opened).join(opened, "row").groupBy("component", "node", "copies").agg(F.collect_set("text").alias("texts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for component, node, copies, texts in rows_of(batches, "component", "node", "copies", "texts"):
                for text in texts:
                    yield (component, node, copies), text

        def rows():
            for keys, owner, values in shingle_sets(each(), words):
                edges = np.searchsorted(owner, np.arange(len(keys) + 1))
                for key, lo, hi in zip(keys, edges, edges[1:]):
                    if set_digest(values[lo:hi]) == key[1]:
                        yield (*key, int(hi - lo), values[lo:hi].tobytes()), 8 * int(hi - lo) + 32

        whole = [(name, pa.int64()) for name in ("component", "node", "copies", "size")]
        yield from batches_of(rows(), pa.schema([*whole, ("shingles", pa.binary())]))

    found = met.mapInArrow(work, "component bigint, node bigint, copies bigint, size bigint, shingles binary")
    return materialised(found, "jaccard-sets")


def counted(sets: DataFrame, percent: int) -> DataFrame:
    """(node, links): the copies of the nodes that each is linked with, part by part of its component."""
    sums = sets.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    parts = F.greatest(F.ceil(F.col("n") / COUNT_NODES), F.ceil(F.col("total") / COUNT_SHINGLES)).cast("int")
    dealt = sets.join(sums.select("component", parts.alias("parts")), "component")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["component", "i", "j"]
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    dealt = dealt.select(*key, "own", "node", "copies", "shingles").repartition(*key).sortWithinPartitions(*key, "own")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            place, held = None, []
            for *here, own, node, copies, shingles in rows_of(batches, *key, "own", "node", "copies", "shingles"):
                if here != place:
                    yield from found(place, held)
                    place, held = here, []
                held.append((own, node, copies, np.frombuffer(shingles, np.uint64)))
            yield from found(place, held)

        def found(place, held):
            if not held:
                return
            one = [x for x in held if x[0] == place[1]]
            two = one if place[1] == place[2] else [x for x in held if x[0] == place[2]]
            if not one or not two:
                return
            linked = alike([x[3] for x in one], [x[3] for x in two], percent)
            if one is two:
                np.fill_diagonal(linked, False)
            for side, other, hits in [(one, two, linked)] + ([] if one is two else [(two, one, linked.T)]):
                weights = hits @ np.array([x[2] for x in other], np.int64)
                yield from (((x[1], n), 16) for x, n in zip(side, weights.tolist()) if n)

        yield from batches_of(rows(), pa.schema([("node", pa.int64()), ("links", pa.int64())]))

    return dealt.mapInArrow(work, "node bigint, links bigint")


def alike(one: list[np.ndarray], two: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of the two sides are similar enough. Shingles that many sets of both sides hold are multiplied as a
    matrix, those that few hold pair by pair."""
    m, n = len(one), len(two)
    sizes = [np.array([len(x) for x in side], np.int64) for side in (one, two)]
    distinct, column = np.unique(np.concatenate(one + two), return_inverse=True)
    rows = [np.repeat(np.arange(len(side)), size) for side, size in zip((one, two), sizes)]
    columns = column[: len(rows[0])], column[len(rows[0]) :]
    often = [np.bincount(c, minlength=len(distinct)) for c in columns]
    work = often[0] * often[1]
    overlap = np.zeros(m * n, np.int32)

    dense = np.flatnonzero(work * 128 > m * n)
    for at in range(0, len(dense), 1024):
        number = np.full(len(distinct), -1)
        number[dense[at : at + 1024]] = np.arange(len(dense[at : at + 1024]))
        sides = []
        for row, c, count in zip(rows, columns, (m, n)):
            use = number[c] >= 0
            side = np.zeros((count, 1024), np.float32)
            side[row[use], number[c[use]]] = 1
            sides.append(side)
        overlap += (sides[0] @ sides[1].T).astype(np.int32).ravel()

    few = (work > 0) & (work * 128 <= m * n)
    use = [few[c] for c in columns]
    left = rows[0][use[0]], columns[0][use[0]]
    order = np.argsort(columns[1][use[1]], kind="stable")
    right, sorted_ = rows[1][use[1]][order], columns[1][use[1]][order]
    first, count = np.searchsorted(sorted_, left[1]), often[1][left[1]]
    steps = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(steps, (steps[lo - 1] if lo else 0) + (1 << 21), side="right")))
        c = count[lo:hi]
        within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        pair = np.repeat(left[0][lo:hi], c) * n + right[np.repeat(first[lo:hi], c) + within]
        if len(pair) * 8 > m * n:
            overlap += np.bincount(pair, minlength=m * n).astype(np.int32)
        else:
            np.add.at(overlap, pair, 1)
        lo = hi
    overlap = overlap.reshape(m, n).astype(np.int64)
    return overlap * 100 >= percent * (sizes[0][:, None] + sizes[1] - overlap)
