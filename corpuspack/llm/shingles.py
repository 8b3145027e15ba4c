"""Hashed word shingles of texts, many documents at a time, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from corpuspack.llm.common import forget_in_worker

#: Documents are hashed together until they hold this many bytes.
BATCH_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, lower


class Words:
    """Word hashes of texts. Words are separated by the six blank ASCII characters; A-Z count as a-z."""

    def __init__(self):
        self.space, self.lower = _tables()
        self.up = self.down = powers(_BASE, 0)

    def hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the words in UTF-8 bytes."""
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = powers(_BASE, n + 1), powers(_INVERSE, n + 1)
        blank = self.space[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return starts, np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.lower[data].astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        code = (sums[ends] - sums[starts]) * self.down[starts]
        return starts, mixed(code ^ mixed((ends - starts).astype(np.uint64)))


def shingle_sets(
    rows: Iterator[tuple], words: int = 5, batch_bytes: int = BATCH_BYTES
) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(keys, owner, hashes) for batches of (key, text): distinct shingles, sorted by owner and hash."""
    forget_in_worker()  # sets need the memory
    hasher = Words()
    keys: list = []
    texts: list[bytes] = []
    weight = 0
    for key, text in rows:
        keys.append(key)
        texts.append((text or "").encode())
        weight += len(texts[-1]) + 1
        if weight >= batch_bytes:
            yield keys, *_sets(hasher, texts, words)
            keys, texts, weight = [], [], 0
    if keys:
        yield keys, *_sets(hasher, texts, words)


def _sets(hasher: Words, texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, codes = hasher.hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    owner = np.searchsorted(begins, starts, side="right") - 1
    n = len(codes)
    full = max(0, n - words + 1)
    value = np.zeros(full, np.uint64)
    for i in range(words):
        value = mixed(value + codes[i : i + full] * np.uint64(2 * i + 1))
    inside = owner[:full] == owner[words - 1 : words - 1 + full] if full else np.zeros(0, bool)
    owners, values = owner[:full][inside], value[inside]
    counts = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.searchsorted(owner, short)
        whole = []
        for s, at in zip(short, first):
            x = counts[s : s + 1].astype(np.uint64)
            for i in range(at, at + counts[s]):
                x = mixed(x + codes[i : i + 1] * np.uint64(3))
            whole.append(x[0])
        owners = np.concatenate((owners, short))
        values = np.concatenate((values, np.array(whole, np.uint64)))
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (owners[1:] != owners[:-1]) | (values[1:] != values[:-1])
    return owners[fresh], values[fresh]


def set_digest(values: np.ndarray) -> int:
    """64 bits that stand for a sorted set, signed."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)
