"""Byte-level BPE as a monoid: encodings of neighbours are joined at their boundary.

A text is cut into matches of a pattern; each match is encoded on its own. Both levels use the
same tree reduction. Halves are encoded recursively, then joined by encoding a window around the
boundary anew and widening it until what lies outside is proven not to change:

* Tokens of one match: a sequence of tokens is what the merges produce exactly if that holds for
  each pair of neighbours. So a join is done when the pairs at both edges of the window hold.
* Matches of a text: no match goes on from a character that isn't white space to one that is, and
  what follows such a place doesn't depend on what precedes it. So a window that reaches from such
  a place to another leaves the rest alone.

Decoding concatenates the bytes of tokens, which is the same monoid's image.

Null texts count as empty. An empty text has no tokens and decodes to no bytes. Texts of any length
are encoded whole. Null ids decode to no bytes. Rows are mapped one by one, so repeated rows and
columns of any other name change nothing.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import FLUSH_BYTES, kept_in_worker, rows_of

#: Characters of a text, and bytes of a match, that are encoded without halving.
TEXT_LEAF = 1024
MATCH_LEAF = 16
#: Bytes up to which merges are found by scanning all neighbours.
SCANNED = 24
#: Matches remembered by a worker, in two halves: when the newer half is full, it becomes the older one.
REMEMBERED = 600_000
#: Pairs of tokens of which a worker remembers whether they stay apart.
REMEMBERED_PAIRS = 150_000

_CUT = regex.compile(r"(?<=\S)(?=\s)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Matches(dict):
    """Packed tokens (4 bytes each) of matches, encoded when first asked for; no more than a bound is remembered."""

    def __init__(self, encode: Callable[[str], bytes], longest: int):
        super().__init__()
        self.encode, self.longest, self.older = encode, longest, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece) or self.encode(piece)
        if len(piece) <= self.longest:
            self[piece] = packed
        return packed

    def age(self) -> None:
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()


class Segment:
    """An encoded piece of text, its tokens packed. ``head`` and ``tail`` are the (characters, bytes of tokens)
    before its first and last place where a match is certain to end, or None."""

    __slots__ = ("text", "ids", "head", "tail")

    def __init__(self, text, ids, head, tail):
        self.text, self.ids, self.head, self.tail = text, ids, head, tail


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, text_leaf: int = TEXT_LEAF, match_leaf: int = MATCH_LEAF):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.text_leaf, self.match_leaf = text_leaf, match_leaf
        self.known = Matches(self.match, match_leaf)
        self.pairs: dict[tuple[int, int], bool] = {}
        # Lengths of the tokens that begin with up to three bytes, longest first.
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) >= 3:
                lengths.setdefault(token[:3], set()).add(len(token))
        self.lengths = {start: (*sorted(found, reverse=True), 2, 1) for start, found in lengths.items()}

    # Tokens of one match

    def merged(self, data: bytes) -> list[int]:
        """Apply merges in order of rank, leftmost first."""
        ranks, n = self.ranks, len(data)
        if n < 2:
            return [ranks[data]] if n else []
        if n <= SCANNED:
            return self.scanned(data)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        end = list(range(1, n + 1))
        alive = bytearray(b"\1") * n

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (rank := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(queue, (rank, i, end[j]))

        queue: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = right[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], right[i] = 0, stop, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def scanned(self, data: bytes) -> list[int]:
        """The same for few bytes: look for the least rank of all neighbours again and again."""
        get, never = self.ranks.get, len(self.ranks) << 8
        cuts = list(range(len(data) + 1))
        offers = [get(data[i : i + 2], never) for i in range(len(data) - 1)]
        while offers and (least := min(offers)) != never:
            i = offers.index(least)
            del cuts[i + 1], offers[i]
            if i < len(offers):
                offers[i] = get(data[cuts[i] : cuts[i + 2]], never)
            if i:
                offers[i - 1] = get(data[cuts[i - 1] : cuts[i + 1]], never)
        return [self.ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded."""
        if (a, b) not in self.pairs:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return self.pairs[a, b]

    def walked(self, data: bytes) -> list[int]:
        """What merging gives, found by walking: tokens that stay apart from their neighbours are the only such
        sequence. Take the longest token that stays apart from the last one; where none leads on, go back."""
        get, lengths, pairs, fits = self.ranks.get, self.lengths.get, self.pairs.get, self.fits
        ids: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, n, last, below = 0, len(data), None, len(data) + 1
        while at < n:
            for size in lengths(data[at : at + 3], (2, 1)):
                stop = at + size
                if size >= below or stop > n:
                    continue
                token = get(data[at:stop])
                if token is None or stop in dead:
                    continue
                if last is None:
                    break
                apart = pairs((last, token))
                if fits(last, token) if apart is None else apart:
                    break
            else:
                dead.add(at)
                ids.pop()
                last = ids[-1] if ids else None
                below = at - starts[-1]
                at = starts.pop()
                continue
            ids.append(token)
            starts.append(at)
            at, last, below = stop, token, n + 1
        return ids

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        if self.fits(left[-1], right[0]):
            return left + right
        reach = 2
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self.walked(self.decode(left[i:] + right[:j]))
            if (i == 0 or self.fits(left[i - 1], window[0])) and (
                j == len(right) or self.fits(window[-1], right[j])
            ):
                return left[:i] + window + right[j:]
            reach *= 2

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= self.match_leaf:
            return self.walked(data)
        half = len(data) // 2
        return self.joined(self.tree(data[:half]), self.tree(data[half:]))

    def match(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        return array("i", [whole] if whole is not None else self.tree(data)).tobytes()

    # Matches of a text

    def leaf(self, text: str) -> bytes:
        self.known.age()
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def segment(self, text: str) -> Segment:
        """A leaf, encoded between the places where matches are certain to end."""
        places = [m.start() for m in (_CUT.search(text), _last_cut(text)) if m]
        if not places:
            return Segment(text, self.leaf(text), None, None)
        first, last = places
        ids = self.leaf(text[:first])
        head = (first, len(ids))
        ids += self.leaf(text[first:last])
        tail = (last, len(ids))
        return Segment(text, ids + self.leaf(text[last:]), head, tail)

    def combined(self, a: Segment, b: Segment) -> Segment:
        start, kept = a.tail or (0, 0)
        stop, gone = b.head or (len(b.text), len(b.ids))
        window = self.segment(a.text[start:] + b.text[:stop])
        ids = a.ids[:kept] + window.ids + b.ids[gone:]
        text = a.text + b.text
        shifted = len(a.text), kept + len(window.ids) - gone
        head = a.head or (window.head and (start + window.head[0], kept + window.head[1]))
        tail = (b.tail and (b.tail[0] + shifted[0], b.tail[1] + shifted[1])) or (
            window.tail and (start + window.tail[0], kept + window.tail[1])
        )
        if b.head and not a.head and not window.head:
            head = (b.head[0] + shifted[0], b.head[1] + shifted[1])
        if a.tail and not b.tail and not window.tail:
            tail = a.tail
        return Segment(text, ids, head, tail)

    def text_tree(self, text: str) -> Segment:
        if len(text) <= self.text_leaf:
            return self.segment(text)
        half = len(text) // 2
        return self.combined(self.text_tree(text[:half]), self.text_tree(text[half:]))

    def packed(self, text: str | None) -> bytes:
        """Tokens of a text, 4 bytes each."""
        text = text or ""
        return self.leaf(text) if len(text) <= self.text_leaf else self.text_tree(text).ids

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _last_cut(text: str):
    """The last place between a character that isn't white space and one that is."""
    return regex.search(r"(?r)(?<=\S)(?=\s)", text)


def _ids_batch(keys: list, packed: list[bytes], key_type: pa.DataType) -> pa.RecordBatch:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(packed), np.int32))
    lists = pa.ListArray.from_arrays(pa.array(offsets), values)
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), lists], names=["doc_id", "ids"])


def _encoded(batches: Iterator[pa.RecordBatch], bpe: Bpe) -> Iterator[pa.RecordBatch]:
    keys, ids, weight = [], [], 0
    for key, text in rows_of(batches, "doc_id", "text"):
        keys.append(key)
        ids.append(bpe.packed(text))
        weight += len(ids[-1]) + 16
        if weight >= FLUSH_BYTES:
            yield _ids_batch(keys, ids, pa.int64())
            keys, ids, weight = [], [], 0
    if keys:
        yield _ids_batch(keys, ids, pa.int64())


def _token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    tokens = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.binary())


def _decoded(batches: Iterator[pa.RecordBatch], tokens: pa.Array) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, 256)
            start += 256
            ids = part.column("ids")
            pieces = tokens.take(ids.flatten())
            if pieces.null_count:
                raise ValueError("an id is not in the vocabulary")
            # The bytes of all tokens follow one another, so a row's bytes lie between two of their offsets.
            _, ends, data = pieces.buffers()
            ends = np.frombuffer(ends, np.int32)[pieces.offset :]
            sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows = np.concatenate(([0], np.cumsum(sizes)))
            offsets = pa.py_buffer(ends[rows].tobytes()) if len(pieces) else pa.py_buffer(bytes(4 * len(rows)))
            whole = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, data])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, whole], names=["doc_id", "ids", "data"])


def _mapped(docs: DataFrame, ranks: dict[bytes, int], pattern: str, decode: bool) -> DataFrame:
    """Ranks are sent to workers: a vocabulary has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # it remembers what later tasks of the same encoding need again
        bpe = kept_in_worker(name, lambda: Bpe(shared.value, pattern))
        encoded = _encoded(batches, bpe)
        return _decoded(encoded, _token_bytes(shared.value)) if decode else encoded

    schema = "doc_id bigint, ids array<int>" + (", data binary" if decode else "")
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, schema)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids): the tokens of every whole text."""
    return _mapped(docs, ranks, pattern, decode=False)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids, data): the tokens of every whole text, and the bytes that these decode to. Both in one worker:
    ids need not go through Spark in between, and no second worker holds memory."""
    return _mapped(docs, ranks, pattern, decode=True)


def decode_ids(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, data): the bytes that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    work = lambda batches: _decoded(batches, _token_bytes(shared.value))
    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, ids array<int>, data binary")
