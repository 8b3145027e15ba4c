"""Repeated passages, removed exactly: suffixes that start at content-defined anchors are sorted by hashes.

A byte goes if a passage of ``length`` bytes that covers it also starts anywhere else, in the same document or
another; overlaps count, and all is judged on the input. Each passage holds an anchor that depends on it alone, and
reaches at most ``length - k`` bytes before it. So passages can only be equal if their anchors' k-grams are, and:

* Anchors are dealt out by hash. One that stands alone ends there. Where the whole reach around an anchor is equal
  elsewhere (compared by a 64-bit digest besides the k-gram's), all of it is repeated; one of each kind stays as a witness.
* Kinds that share a k-gram but not the whole reach get their bytes. Their suffixes from the anchor, and their
  prefixes before it, read backwards, are sorted within the group; for each offset of a passage before the anchor,
  those in the same run of both orders are equal.
* A group of more than GROUP kinds is not gathered: its passages are dealt out by their own digests and counted.

Null texts count as empty. Texts under ``length`` bytes lose nothing. Texts of any length are taken whole, in
overlapping pieces. Rows that repeat both doc_id and text repeat each other. A null doc_id is a document like any
other. Other columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.anchors import Anchors, batches
from corpuspack.llm.common import batches_of, rows_of, text_or_empty
from corpuspack.llm.suffixes import Suffixes
from corpuspack.session import materialised

LENGTH, GRAM = 200, 48
#: Kinds of one k-gram that are sorted together at most.
GROUP = 16_384
#: Anchors, and kinds with their bytes, that a block holds on average.
BLOCK_ANCHORS, BLOCK_KINDS = 400_000, 8192
#: Anchors that a worker gathers before it deals them out.
HELD = 1 << 19

_ANCHOR = np.dtype([("gram", "<u4"), ("reach", "<u8"), ("row", "<i8"), ("place", "<u4"), ("right", "<u2")])
_OPEN = np.dtype([("gram", "<u8"), ("place", "<u4"), ("alone", "u1"), ("hot", "u1")])
_SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
_WINDOW = np.dtype([("digest", "<u8"), ("row", "<i8"), ("start", "<u4")])

SPANS = pa.schema([("row", pa.int64()), ("spans", pa.binary()), ("open", pa.binary())])


def dealt(block: np.ndarray, entries: np.ndarray, n_blocks: int) -> Iterator[tuple[tuple, int]]:
    """Rows (block, bytes) of entries."""
    order = np.argsort(block, kind="stable")
    cut = np.searchsorted(block[order], np.arange(n_blocks + 1))
    entries = entries[order]
    for b in np.flatnonzero(np.diff(cut)):
        data = entries[cut[b] : cut[b + 1]].tobytes()
        yield (int(b), data), len(data)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): ``row`` stands for doc_id and text."""
    text = text_or_empty()
    return docs.select(F.xxhash64("doc_id", text).alias("row"), "doc_id", text.alias("text"))


def anchored(rows: DataFrame, length: int, gram: int, n_blocks: int) -> DataFrame:
    """(block, entries): every anchor with a digest of all that passages around it can hold."""
    left_most = length - gram

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(gram, length - gram + 1)

        def out():
            held, count = [], 0
            texts = ((row, text.encode()) for row, text in rows_of(parts, "row", "text"))
            for batch in batches(texts, 2 * length, length):
                places, owner, grams = find.of(batch)
                piece = np.array([(row, first, size) for row, first, _, _, size in batch.pieces], np.int64).reshape(-1, 3)
                place = places - batch.begins[owner] + piece[owner, 1]
                right = np.minimum(piece[owner, 2] - place, length)
                left = np.minimum(place, left_most)
                view = memoryview(batch.data)
                digest = xxhash.xxh3_64_intdigest
                reach = [
                    digest(view[a:b], seed=s)
                    for a, b, s in zip((places - left).tolist(), (places + right).tolist(), left.tolist())
                ]
                entries = np.empty(len(places), _ANCHOR)
                entries["gram"], entries["reach"] = grams & np.uint64(0xFFFFFFFF), np.array(reach, np.uint64)
                entries["row"], entries["place"], entries["right"] = piece[owner, 0], place, right
                held.append((((grams >> np.uint64(32)) % np.uint64(n_blocks)).astype(np.int64), entries))
                count += len(entries)
                if count >= HELD:
                    yield from dealt(*map(np.concatenate, zip(*held)), n_blocks)
                    held, count = [], 0
            if held:
                yield from dealt(*map(np.concatenate, zip(*held)), n_blocks)

        yield from batches_of(out(), pa.schema([("block", pa.int32()), ("entries", pa.binary())]))

    return rows.select("row", "text").mapInArrow(work, "block int, entries binary")


def by_row(row: np.ndarray, entries: np.ndarray) -> dict[int, bytes]:
    order = np.argsort(row, kind="stable")
    row, entries = row[order], entries[order]
    edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else [0]
    return {int(row[a]): entries[a:b].tobytes() for a, b in zip(edge, edge[1:])}


def frame(spans: dict[int, bytes], opened: dict[int, bytes]) -> pd.DataFrame:
    rows = list(spans.keys() | opened.keys())
    return pd.DataFrame(
        {"row": np.array(rows, np.int64), "spans": [spans.get(r) for r in rows], "open": [opened.get(r) for r in rows]}
    )


def met(packed: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """(row, spans, open): what is repeated for certain, and kinds whose bytes are needed."""
    left_most = length - gram

    def work(part: pd.DataFrame) -> pd.DataFrame:
        block = np.uint64(part["block"].iloc[0])
        entries = np.concatenate([np.frombuffer(x, _ANCHOR) for x in part["entries"]])
        entries = entries[np.lexsort((entries["place"], entries["row"], entries["reach"], entries["gram"]))]
        new_gram = np.concatenate(([True], entries["gram"][1:] != entries["gram"][:-1]))
        new_kind = new_gram | np.concatenate(([True], entries["reach"][1:] != entries["reach"][:-1]))
        kind = np.cumsum(new_kind) - 1
        in_kind = np.bincount(kind)[kind]
        group_of = np.cumsum(new_gram) - 1
        kinds = np.bincount(group_of, weights=new_kind).astype(np.int64)[group_of]
        place, right = entries["place"].astype(np.int64), entries["right"].astype(np.int64)
        left = np.minimum(place, left_most)
        sure = (in_kind > 1) & (left + right >= length)
        spans = np.empty(int(sure.sum()), _SPAN)
        spans["start"], spans["end"] = (place - left)[sure], (place + right)[sure]
        asks = new_kind & (kinds > 1)
        opened = np.empty(int(asks.sum()), _OPEN)
        opened["gram"] = (block << np.uint64(32)) | entries["gram"][asks].astype(np.uint64)
        opened["place"], opened["alone"], opened["hot"] = place[asks], in_kind[asks] == 1, kinds[asks] > group
        return frame(by_row(entries["row"][sure], spans), by_row(entries["row"][asks], opened))

    return packed.groupBy("block").applyInPandas(work, "row bigint, spans binary, open binary")


def gathered(found: DataFrame) -> DataFrame:
    """(row, open): what is open in each document."""
    return found.where("open is not null").groupBy("row").agg(F.collect_list("open").alias("open"))


def kinds_with_bytes(rows: DataFrame, opened: DataFrame, length: int, gram: int, n_blocks: int) -> DataFrame:
    """(block, hot, entries, texts): open kinds with their bytes; passages of hot groups by their digests."""
    left_most = length - gram
    # a repeated row would offer its kinds twice
    joined = rows.select("row", "text").join(opened.hint("shuffle_hash"), "row")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(gram, length - gram + 1)

        def out():
            seen: set[int] = set()
            held, size = [], 0
            for row, text, packed in rows_of(parts, "row", "text", "open"):
                if row in seen:
                    continue
                seen.add(row)
                data = text.encode()
                opened = np.concatenate([np.frombuffer(x, _OPEN) for x in packed])
                hot = opened[opened["hot"] == 1]
                if len(hot):
                    yield from windows(row, data, hot)
                for gram_, place, alone in opened[opened["hot"] == 0][["gram", "place", "alone"]].tolist():
                    left = min(place, left_most)
                    body = data[place - left : place + length]
                    held.append((gram_ % n_blocks, gram_, row, place, alone, left, body))
                    size += len(body) + 64
                if size >= 4 << 20:
                    yield from packed_kinds(held)
                    held, size = [], 0
            yield from packed_kinds(held)

        def windows(row, data, hot):
            """Digests of the passages whose anchor is hot, each passage under its own anchor only."""
            whole = np.frombuffer(data, np.uint8)
            view = memoryview(data)
            wanted = set(hot["place"].tolist())
            step = 1 << 18
            for first in range(0, len(data) - length + 1, step):
                part = whole[first : first + step + length - 1]
                least = find.least(find.grams(part)) + first
                use = np.flatnonzero(np.isin(least, np.array(list(wanted))))
                entries = np.empty(len(use), _WINDOW)
                entries["digest"] = [xxhash.xxh3_64_intdigest(view[s : s + length]) for s in (use + first).tolist()]
                entries["row"], entries["start"] = row, use + first
                for (block, packed), size in dealt((entries["digest"] % np.uint64(n_blocks)).astype(np.int64), entries, n_blocks):
                    yield (block, True, packed, None), size

        def packed_kinds(held):
            by: dict[int, list] = {}
            for one in held:
                by.setdefault(one[0], []).append(one)
            for block, own in by.items():
                head = np.array([(g, r, p, a, lf, len(b)) for _, g, r, p, a, lf, b in own], _KIND)
                texts = b"".join(x[-1] for x in own)
                yield (block, False, head.tobytes(), texts), len(texts) + head.nbytes

        schema = pa.schema([("block", pa.int32()), ("hot", pa.bool_()), ("entries", pa.binary()), ("texts", pa.binary())])
        yield from batches_of(out(), schema)

    return joined.mapInArrow(work, "block int, hot boolean, entries binary, texts binary")


_KIND = np.dtype([("gram", "<u8"), ("row", "<i8"), ("place", "<u4"), ("alone", "u1"), ("left", "<u2"), ("size", "<u2")])


def compared(packed: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, spans, open): passages that are repeated according to the kinds' bytes or the counts of hot passages."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        if part["hot"].iloc[0]:
            return frame(counted(np.concatenate([np.frombuffer(x, _WINDOW) for x in part["entries"]]), length), {})
        head = np.concatenate([np.frombuffer(x, _KIND) for x in part["entries"]])
        data = np.frombuffer(b"".join(part["texts"]), np.uint8)
        return frame(sorted_spans(head, data, length, gram), {})

    return packed.groupBy("block", "hot").applyInPandas(work, "row bigint, spans binary, open binary")


def counted(windows: np.ndarray, length: int) -> dict[int, bytes]:
    windows = np.sort(windows, order="digest")
    same = windows["digest"][1:] == windows["digest"][:-1]
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    hit = windows[again]
    spans = np.empty(len(hit), _SPAN)
    spans["start"], spans["end"] = hit["start"], hit["start"] + length
    return by_row(hit["row"], spans)


def sorted_spans(head: np.ndarray, data: np.ndarray, length: int, gram: int) -> dict[int, bytes]:
    """Spans of the kinds that stand alone, from both orders of their group."""
    start = np.cumsum(head["size"].astype(np.int64)) - head["size"]
    by_gram = np.argsort(head["gram"], kind="stable")
    head, start = head[by_gram], start[by_gram]
    left, size = head["left"].astype(np.int64), head["size"].astype(np.int64)
    right = size - left
    _, group = np.unique(head["gram"], return_inverse=True)
    after = Suffixes(data, start + left, right)
    ahead, ahead_common = after.sort(group)
    backwards = Suffixes(data[::-1], len(data) - (start + left), left)
    behind, behind_common = backwards.sort(group)
    n = len(head)
    found = np.zeros((n, length - gram + 1), bool)
    runs, mirrored = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(length - gram + 1):
        use = np.flatnonzero((left >= offset) & (right >= length - offset))
        if len(use) < 2:
            continue
        runs[ahead] = np.cumsum(ahead_common < length - offset)
        mirrored[behind] = np.cumsum(behind_common < offset)
        key = runs[use] * (n + 1) + mirrored[use]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        found[use[order[1:][same]], offset] = True
        found[use[order[:-1][same]], offset] = True
    found[head["alone"] == 0] = False
    padded = np.zeros((n, found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    change = np.diff(padded, axis=1)
    kind, first = np.nonzero(change == 1)
    _, stop = np.nonzero(change == -1)
    place = head["place"].astype(np.int64)[kind]
    spans = np.empty(len(kind), _SPAN)
    spans["start"], spans["end"] = place - (stop - 1), place - first + length
    return by_row(head["row"][kind], spans)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs: overlapping and touching spans become one."""
    spans = np.sort(spans, order=["start", "end"])
    reach = np.maximum.accumulate(spans["end"])
    new = np.concatenate(([True], spans["start"][1:] > reach[:-1]))
    first = np.flatnonzero(new)
    out = np.empty(len(first), _SPAN)
    out["start"] = spans["start"][first]
    out["end"] = reach[np.concatenate((first[1:] - 1, [len(spans) - 1]))]
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed runs of bytes of each document, and what remains of it."""
    rows = numbered(docs)
    total = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    anchors = 2 * total / (length - gram + 2)
    n_blocks = max(1, ceil(anchors / BLOCK_ANCHORS), min(int(anchors // 500), 24))
    found = materialised(met(anchored(rows, length, gram, n_blocks), length, gram, group), "repeats-met")
    n_open = found.agg(F.sum(F.octet_length("open"))).first()[0] or 0
    n_kinds = max(1, ceil(n_open / _OPEN.itemsize / BLOCK_KINDS), min(n_open // 2000, 24))
    more = compared(kinds_with_bytes(rows, gathered(found), length, gram, int(n_kinds)), length, gram)
    spans = found.select("row", "spans").union(more.select("row", "spans")).where("spans is not null")
    spans = materialised(spans.groupBy("row").agg(F.collect_list("spans").alias("spans")), "repeats-spans")
    joined = rows.join(spans.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "spans")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for key, text, packed in rows_of(parts, "doc_id", "text", "spans"):
                data = text.encode()
                runs = merged(np.concatenate([np.frombuffer(x, _SPAN) for x in packed])).tolist() if packed else []
                edges = [0] + [x for run in runs for x in run] + [len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                yield (key, len(data), [{"start": a, "end": b} for a, b in runs], kept), len(kept) + 32 * len(runs)

        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
        yield from batches_of(out(), schema)

    schema = "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return joined.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(work, schema)
