"""Two tokenizers' tokens of one text, aligned by divide and conquer at shared cuts.

A token covers a range of bytes. Byte offsets at which tokens of both sides end are shared cuts; the tokens between two
neighbouring cuts form a group. Cuts are found by halving: an interval's end of an A token next to its middle is looked
up among the ends of B tokens by bisection; if it isn't one of them, its neighbours are tried, ever farther from the
middle. At the common end so found the interval falls into two, which are halved in turn; an interval without a common
end inside is a group. All intervals of a slice of documents are halved at the same time, so each step is a few array operations.

Two tokens of the two sides are linked where their byte ranges overlap. How often two ids are linked, is counted over
the whole corpus. A task encodes and aligns its documents a slice at a time; documents of about BATCH_BYTES make up a
batch, which keeps each pair of ids once. Batches are written; pairs are summed over them by shuffles, each pair's sum
goes back to the batches that hold the pair, and there meets the documents, which refer to pairs by their number in the batch.

A text that is null or empty has no tokens; neither has one whose tokens of either side, joined, are not a blank
followed by the text. Counts are 0 there and the digest is ''. Texts of any length are encoded whole. Rows are
independent, so repeated rows or a null doc_id only add to the counts. Other columns aren't used. An empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import rows_of
from corpuspack.session import checkpoint_dir

#: Characters that are aligned in one go, and that make up a batch, about. A longer text is taken by itself.
SLICE_CHARS, BATCH_CHARS = 1 << 20, 16 << 20
#: Ends that are tried one after the other, from an interval's middle outwards, before all are tried at once.
NEAR = 6
#: Characters that the second tokenizer takes at a time, about.
PIECE = 1000
#: A pair of ids is a number: the A id times this, plus the B id.
BASE = 1 << 16


# Vocabularies


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others,
    in order, for characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def read_byte_level(path: str) -> dict[bytes, int]:
    """Ids of a byte-level BPE file, which are also the ranks of its merges; special tokens are left out."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    alphabet = byte_alphabet()
    special = {one["content"] for one in made["added_tokens"]}
    return {bytes(map(alphabet.__getitem__, t)): i for t, i in made["model"]["vocab"].items() if t not in special}


def pieces_of(text: str) -> Iterator[str]:
    """The text without a blank here and there: it is cut about every PIECE characters, where a blank follows a
    character that isn't white space, and that blank is left out."""
    start = 0
    while start < len(text):
        cut = text.find(" ", start + PIECE)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut == len(text) - 1:  # a last blank alone would be lost
            cut = len(text)
        yield text[start:cut]
        start = cut + 1


class Vocabulary:
    """The bytes of each id, one after the other."""

    def __init__(self, tokens: list[bytes]):
        if len(tokens) > BASE:
            raise ValueError(f"ids must be below {BASE}")
        self.sizes = np.array([*map(len, tokens)])
        self.at = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        first = np.cumsum(sizes) - sizes
        return self.data[np.repeat(self.at[ids] - first, sizes) + np.arange(sizes.sum())]


class Pair:
    """Both tokenizers. The second one puts a blank before a text, and merges over long texts slowly, so it takes
    pieces; as is checked, none of its tokens reaches over the places where these are cut."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        self.first = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.a = Vocabulary(tokens)
        n = self.second.get_piece_size()
        if any(re.search("[^▁]▁", self.second.id_to_piece(i)) for i in range(n)):
            raise ValueError("a token goes on with a blank")
        self.b = Vocabulary([self._piece(i) for i in range(n)])

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides, none where one of them doesn't spell the text."""
        if text:
            spaced = " " + text
            a = np.array(array("H", self.first.encode_ordinary(spaced)), np.int64)
            b = array("H")
            for piece in pieces_of(text):
                b.extend(self.second.encode(piece))
            b = np.array(b, np.int64)
            whole = np.frombuffer(spaced.encode(), np.uint8)
            if np.array_equal(self.a.spell(a), whole) and np.array_equal(self.b.spell(b), whole):
                return a, b
        return np.empty(0, np.int64), np.empty(0, np.int64)


# Alignment


def common_end(ends_a, ends_b, a0, a1) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of A tokens [a0, a1), the token inside whose end is common and next to the middle, or -1,
    and the B token that ends there."""
    found, there = np.full(len(a0), -1), np.zeros(len(a0), np.int64)
    middle = (a0 + a1 - 2) // 2
    todo = np.arange(len(a0))
    for step in range(NEAR):
        at = middle[todo] + (step + 1) // 2 * (1 if step % 2 else -1)
        inside = (at >= a0[todo]) & (at < a1[todo] - 1)
        # a place outside comes up only when all inside have been tried
        todo, at = todo[inside], at[inside]
        wanted = ends_a[at]
        place = np.searchsorted(ends_b, wanted)
        hit = ends_b[place] == wanted
        found[todo[hit]], there[todo[hit]] = at[hit], place[hit]
        todo = todo[~hit]
    todo = todo[a1[todo] - a0[todo] - 1 > NEAR]
    if len(todo):  # none near the middle: try all ends inside
        sizes = a1[todo] - a0[todo] - 1
        owner = np.repeat(todo, sizes)
        first = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(first - a0[todo], sizes)
        place = np.searchsorted(ends_b, ends_a[at])
        hit = ends_b[place] == ends_a[at]
        owner, at, place = owner[hit], at[hit], place[hit]
        order = np.lexsort((np.abs(at - middle[owner]), owner))
        owner, at, place = owner[order], at[order], place[order]
        nearest = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.empty(0, bool)
        found[owner[nearest]], there[owner[nearest]] = at[nearest], place[nearest]
    return found, there


def leaf_groups(ends_a, ends_b, a0, a1, b0, b1) -> tuple[np.ndarray, ...]:
    """Halve intervals of tokens, [a0, a1) and [b0, b1), until none has a common end inside; sorted."""
    done = []
    while len(a0):
        cut, there = np.full(len(a0), -1), np.zeros(len(a0), np.int64)
        wide = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        cut[wide], there[wide] = common_end(ends_a, ends_b, a0[wide], a1[wide])
        leaf = cut < 0
        done.append((a0[leaf], a1[leaf], b0[leaf], b1[leaf]))
        more = ~leaf
        cut, there, a0, a1, b0, b1 = (x[more] for x in (cut + 1, there + 1, a0, a1, b0, b1))
        a0, a1, b0, b1 = (np.concatenate(x) for x in ((a0, cut), (cut, a1), (b0, there), (there, b1)))
    parts = [np.concatenate(x) for x in zip(*done)] if done else [np.empty(0, np.int64)] * 4
    order = np.argsort(parts[0])
    return tuple(x[order] for x in parts)


def _starts(sizes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


@dataclass
class Aligned:
    """Tokens of several documents, one after the other, and their groups. ``*_start``: of each document, and the end."""

    a: np.ndarray
    b: np.ndarray
    a_start: np.ndarray
    b_start: np.ndarray
    groups: tuple[np.ndarray, ...]
    group_start: np.ndarray
    links: np.ndarray
    link_start: np.ndarray

    @classmethod
    def of(cls, sides: Pair, texts: list[str | None]) -> Aligned:
        encoded = [sides.encode(t) for t in texts]
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*encoded)) if encoded else (np.empty(0, np.int64),) * 2
        a_start, b_start = (_starts([len(x) for x in one]) for one in zip(*encoded)) if encoded else (_starts([]),) * 2
        ends_a, ends_b = np.cumsum(sides.a.sizes[a]), np.cumsum(sides.b.sizes[b])
        full = np.flatnonzero(np.diff(a_start))
        groups = leaf_groups(ends_a, ends_b, a_start[full], a_start[full + 1], b_start[full], b_start[full + 1])
        # Two tokens overlap just where a piece between neighbouring ends, of either side, lies in both.
        a_ends, b_ends = np.zeros((2, ends_a[-1] + 1 if len(a) else 1), np.int8)
        a_ends[ends_a], b_ends[ends_b] = 1, 1
        ends = np.flatnonzero(a_ends | b_ends)
        links = a[np.cumsum(a_ends, dtype=np.int64)[ends - 1]] * BASE + b[np.cumsum(b_ends, dtype=np.int64)[ends - 1]]
        until = np.concatenate(([0], ends_a))[a_start]
        return cls(a, b, a_start, b_start, groups, np.searchsorted(groups[0], a_start), links, np.searchsorted(ends, until, "right"))

    def spelled(self, a_ids: list[bytes], b_ids: list[bytes]) -> Iterator[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``. Of each id: itself with ',' and with what ends a run."""
        a0, a1, b0, b1 = self.groups
        out = np.empty(len(self.a) + len(self.b), np.int64)
        if len(a0):
            last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
            last_a[a1 - 1] = last_b[b1 - 1] = 1
            out[np.arange(len(self.a)) + np.repeat(b0, a1 - a0)] = 2 * self.a + last_a
            out[np.arange(len(self.b)) + np.repeat(a1, b1 - b0)] = 2 * (self.b + len(a_ids) // 2) + last_b
        texts = a_ids + b_ids
        for start, stop in zip(self.a_start[:-1] + self.b_start[:-1], self.a_start[1:] + self.b_start[1:]):
            yield b"".join(map(texts.__getitem__, out[start:stop].tolist()))[:-1]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    keys, texts, size = [], [], 0
    for key, text in rows_of(batches, "doc_id", "text"):
        keys.append(key)
        texts.append(text)
        size += len(text or "") + 64
        if size >= SLICE_CHARS:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _shared(docs: DataFrame, ranks: dict[bytes, int], pattern: str, model: bytes):
    """Both vocabularies have fixed sizes."""
    return docs.sparkSession.sparkContext.broadcast((ranks, pattern, model))


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int32)))


def token_groups(docs: DataFrame, ranks: dict[bytes, int], pattern: str, model: bytes) -> DataFrame:
    """(doc_id, groups): the ids of both sides in each group of a document, in order."""
    shared = _shared(docs, ranks, pattern, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Pair(*shared.value)
        for keys, texts in _slices(batches):
            one = Aligned.of(sides, texts)
            a0, a1, b0, b1 = one.groups
            pairs = [_lists(one.a, np.append(a0, len(one.a))), _lists(one.b, np.append(b0, len(one.b)))]
            both = pa.StructArray.from_arrays(pairs, ["a", "b"])
            groups = pa.ListArray.from_arrays(pa.array(one.group_start.astype(np.int32)), both)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), groups], names=["doc_id", "groups"])

    wanted = docs.select(F.col("doc_id").cast("bigint"), "text")
    return wanted.mapInArrow(work, "doc_id bigint, groups array<struct<a:array<int>,b:array<int>>>")


# Corpus-wide counts

_COUNTS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_BATCHES = f"batch bigint, {_COUNTS}, held binary, times binary, pairs array<bigint>, links array<bigint>"
_FIELDS = ("batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "times", "pairs", "links")
_NUMBERS, _LONGS = pa.int64(), pa.list_(pa.int64())
_TYPES = (*[_NUMBERS] * 6, pa.string(), pa.binary(), pa.binary(), _LONGS, _LONGS)


class Batch:
    """Documents of a batch; ``held``: (document's place, pair) of each, ``times``: how often."""

    def __init__(self, number: int):
        self.number, self.rows, self.held, self.times, self.size = number, [], [], [], 0

    def add(self, keys: list, one: Aligned, spelled: Iterator[bytes]) -> None:
        owner = np.repeat(np.arange(len(keys)) + len(self.rows), np.diff(one.link_start))
        held = np.sort(owner << 32 | one.links)
        first = np.flatnonzero(np.diff(held, prepend=-1))
        self.held.append(held[first])
        self.times.append(np.diff(first, append=len(held)))
        counts = (np.diff(x).tolist() for x in (one.a_start, one.b_start, one.group_start, one.link_start))
        digests = (hashlib.sha256(x).hexdigest() if x else "" for x in spelled)
        self.rows += zip(keys, *counts, digests)
        self.size += len(one.a) * 4 + len(keys) * 64

    def written(self) -> Iterator[pa.RecordBatch]:
        """Rows of documents, then one row that names the batch's pairs."""
        held, times = np.concatenate(self.held), np.concatenate(self.times)
        pairs, number = np.unique(held & 0xFFFFFFFF, return_inverse=True)
        links = np.bincount(number, times, len(pairs)).astype(np.int64)
        start = np.searchsorted(held >> 32, np.arange(len(self.rows) + 1))
        for first in range(0, len(self.rows), 256):
            rows = self.rows[first : first + 256]
            packed = []
            for k in range(first, first + len(rows)):
                mine = slice(start[k], start[k + 1])
                # numbers rise within a document, so small steps are stored
                steps = np.diff(number[mine], prepend=0).astype(np.uint32)
                packed.append((steps.tobytes(), times[mine].astype(np.uint32).tobytes()))
            columns = [[self.number] * len(rows), *zip(*rows), *zip(*packed), [None] * len(rows), [None] * len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES)], names=_FIELDS)
        ends = pa.array([0, len(pairs)], pa.int32())
        last = [pa.array([self.number]), *(pa.nulls(1, t) for t in _TYPES[1:9])]
        last += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pairs, links)]
        yield pa.RecordBatch.from_arrays(last, names=_FIELDS)


def batches_of_links(docs: DataFrame, ranks: dict[bytes, int], pattern: str, model: bytes) -> DataFrame:
    """Encode and align all documents once; the result is written to the shared folder."""
    spark = docs.sparkSession
    shared = _shared(docs, ranks, pattern, model)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Pair(*shared.value)
        spell = lambda n, end: [x for i in range(n) for x in (b"%d," % i, b"%d%s" % (i, end))]
        a_ids, b_ids = spell(len(sides.a.sizes), b"|"), spell(len(sides.b.sizes), b";")
        # a task that runs again makes the same batches; only one attempt's file is kept
        number = TaskContext.get().partitionId() << 32
        batch = Batch(number)
        for keys, texts in _slices(parts):
            one = Aligned.of(sides, texts)
            batch.add(keys, one, one.spelled(a_ids, b_ids))
            if batch.size >= BATCH_CHARS:
                yield from batch.written()
                number += 1
                batch = Batch(number)
        if batch.rows:
            yield from batch.written()

    path = f"{checkpoint_dir(spark)}/links-{uuid.uuid4().hex}"
    wanted = docs.select(F.col("doc_id").cast("bigint"), "text")
    wanted.mapInArrow(work, _BATCHES).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_BATCHES).parquet(path)


def link_counts(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch, place, n, pair) of each batch's pairs, and (pair, links, best) over the corpus; best: no other pair of
    its B id has more links. A B id has at most as many pairs as there are A ids."""
    both = F.posexplode(F.arrays_zip("pairs", "links")).alias("place", "one")
    told = batches.where("pairs IS NOT NULL").select("batch", both).select("batch", "place", "one.pairs", "one.links")
    told = told.select("batch", "place", F.col("pairs").alias("pair"), F.col("links").alias("n"))
    summed = told.groupBy("pair").agg(F.sum("n").alias("links"))
    b = F.pmod("pair", F.lit(BASE))
    most = summed.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    joined = summed.join(most, b == F.col("b"))
    return told, joined.select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def alignment_statistics(docs: DataFrame, ranks: dict[bytes, int], pattern: str, model: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for every row."""
    batches = batches_of_links(docs, ranks, pattern, model)
    told, counts = link_counts(batches)
    known = told.join(counts, "pair").select(F.col("batch").alias("of"), "place", "links", "best")
    own = batches.where("pairs IS NULL").drop("pairs", "links")

    def work(mine: pa.Table, known: pa.Table) -> pa.Table:
        place = known["place"].to_numpy()
        links, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        links[place], best[place] = known["links"].to_numpy(), known["best"].to_numpy()
        sums, bests = [], []
        for held, times in zip(mine["held"], mine["times"]):
            at = np.cumsum(np.frombuffer(held.as_py(), np.uint32), dtype=np.int64)
            n = np.frombuffer(times.as_py(), np.uint32).astype(np.int64)
            sums.append(int(n @ links[at]))
            bests.append(int(n @ best[at]))
        kept = mine.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return kept.append_column("n_best", pa.array(bests, _NUMBERS)).append_column("count_sum", pa.array(sums, _NUMBERS))

    met = own.groupBy("batch").cogroup(known.groupBy("of"))
    return met.applyInArrow(work, f"{_COUNTS}, n_best bigint, count_sum bigint")
