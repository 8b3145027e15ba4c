"""Content-defined places in texts: equal passages get the same ones wherever they stand.

Of each run of ``window`` successive k-grams the one with the least hash is an anchor, the leftmost if several tie. So
every passage of ``window + k - 1`` bytes holds an anchor whose place depends on that passage alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from corpuspack.llm.shingles import _BASE, _INVERSE, mixed, powers

#: Bytes hashed together. Places in such a batch take PLACE_BITS of a key.
BATCH_BYTES, PLACE_BITS = 1 << 19, 20
#: Longer texts are cut into overlapping pieces of this many bytes.
PIECE_BYTES = 1 << 18

_PLACE = np.uint64((1 << PLACE_BITS) - 1)


@dataclass
class Batch:
    """Pieces of texts, joined. A piece is (key, offset of its first byte in its text, first and last place reported)."""

    data: np.ndarray
    begins: np.ndarray
    pieces: list[tuple]


def batches(rows: Iterator[tuple], margin: int, least: int, batch_bytes: int = BATCH_BYTES) -> Iterator[Batch]:
    """Batches of (key, bytes) rows, of about ``batch_bytes``. Pieces overlap by ``margin`` bytes on either side; texts under ``least`` bytes are left out."""
    parts, pieces, size = [], [], 0
    for key, data in rows:
        if len(data) < least:
            continue
        for start in range(0, len(data), PIECE_BYTES):
            stop = min(start + PIECE_BYTES, len(data))
            first, last = max(0, start - margin), min(len(data), stop + margin)
            parts.append(data[first:last])
            pieces.append((key, first, start - first, stop - first, len(data)))
            size += last - first
            if size >= batch_bytes:
                yield _batch(parts, pieces)
                parts, pieces, size = [], [], 0
    if parts:
        yield _batch(parts, pieces)


def _batch(parts: list[bytes], pieces: list[tuple]) -> Batch:
    begins = np.cumsum([0] + [len(x) for x in parts])
    return Batch(np.frombuffer(b"".join(parts), np.uint8), begins, pieces)


class Anchors:
    def __init__(self, k: int, window: int):
        self.k, self.window = k, window
        self.up = self.down = powers(_BASE, 0)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """Hashes of all k-grams."""
        n = len(data)
        if len(self.up) < n:
            self.up, self.down = powers(_BASE, n), powers(_INVERSE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        count = max(0, n - self.k + 1)
        return mixed((sums[self.k :] - sums[:count]) * self.down[:count]) if count else np.zeros(0, np.uint64)

    def least(self, grams: np.ndarray) -> np.ndarray:
        """For each window of successive k-grams, the place of its least."""
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= self.window:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        if span < self.window:
            keys = np.minimum(keys[: len(keys) - (self.window - span)], keys[self.window - span :])
        return (keys & _PLACE).astype(np.int64)

    def of(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, pieces, hashes) of a batch's anchors, in order."""
        grams = self.grams(batch.data)
        if len(grams) < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = self.least(grams)
        piece = np.repeat(np.arange(len(batch.pieces)), np.diff(batch.begins))
        reach = self.window + self.k - 2
        whole = piece[: len(least)] == piece[reach : reach + len(least)]
        flags = np.zeros(len(grams), bool)
        flags[least[whole]] = True
        places = np.flatnonzero(flags)
        owner = piece[places]
        inside = places - batch.begins[owner]
        bounds = np.array([p[2:4] for p in batch.pieces]).reshape(-1, 2)
        use = (inside >= bounds[owner, 0]) & (inside < bounds[owner, 1])
        return places[use], owner[use], grams[places[use]]
