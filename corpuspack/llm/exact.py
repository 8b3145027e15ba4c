"""Exact duplicates: static binary-fuse filters of immutable snapshots screen what comes in.

Texts are equal when they are identical after deleting blank ASCII characters. A snapshot is a table of groups that
never changes; a static filter for each bucket of its digests answers "certainly not here" or "perhaps". Incoming
digests are first grouped among themselves. Those that a filter lets through join the exact bucket; the others are
new groups. Every member of a group of two or more is then compared, byte for byte, with one text of the group;
should digests ever agree where texts don't, such rows are grouped by their text instead.

The row that stays is the one with most code points in the original text, then the smallest doc_id, then, among rows
that repeat a doc_id, any one of them, the same on each run over the same table. Null texts count as empty; a null
doc_id is smaller than any other. Texts of any length count as a whole. Other columns aren't used.
"""

from __future__ import annotations

from math import ceil, floor, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.llm.common import BLANKS, text_or_empty, unused
from corpuspack.llm.shingles import mixed
from corpuspack.session import materialised

#: Digests of a snapshot that share a filter, on average.
BUCKET_KEYS = 8192
#: Parts into which the members of a group are dealt while their texts are compared.
PARTS = 8


class BinaryFuse:
    """A static 3-wise binary fuse filter with 8-bit fingerprints: no false negatives, about 0.4 % false positives."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _hashes(keys: np.ndarray, seed: int) -> np.ndarray:
        return mixed(keys + mixed(np.array([seed + 1], np.uint64)))

    @staticmethod
    def _slots(hashes: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three slots in three consecutive segments."""
        mask = np.uint64(segment - 1)
        first = ((hashes >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
        base = first - (first & mask)
        second = base + np.uint64(segment) + ((first ^ (hashes >> np.uint64(18))) & mask)
        third = base + np.uint64(2 * segment) + ((first ^ hashes) & mask)
        return np.stack((first, second, third)).astype(np.int64)

    @staticmethod
    def _prints(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(40))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << max(2, floor(log(n) / log(3.33) + 2.25))
        size = round(n * max(1.125, 0.875 + 0.25 * log(1_000_000) / log(n)))
        segments = max(1, ceil(size / segment) - 2)
        for seed in range(1000):
            if (prints := cls._peel(keys, seed, segment, segments)) is not None:
                return cls(seed, segment, segments, prints)
            if seed % 20 == 19:
                segments += 1
        raise ValueError("no binary fuse filter found")

    @classmethod
    def _peel(cls, keys, seed, segment, segments):
        """Take away, again and again, the keys that are alone in a slot; assign in reverse."""
        hashes = cls._hashes(keys, seed)
        slots = cls._slots(hashes, segment, segments)
        size = segment * (segments + 2)
        count = np.bincount(slots.ravel(), minlength=size)
        owners = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owners, row, np.arange(len(keys)))
        layers = []
        left = len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            key, pick = np.unique(owners[alone], return_index=True)
            layers.append((key, alone[pick]))
            left -= len(key)
            touched = slots[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(owners, row, key)
            near = np.unique(touched)
            alone = near[count[near] == 1]
        if left:
            return None
        prints, marks = np.zeros(size, np.uint8), cls._prints(hashes)
        for key, slot in reversed(layers):
            prints[slot] = 0
            a, b, c = slots[:, key]
            prints[slot] = marks[key] ^ prints[a] ^ prints[b] ^ prints[c]
        return prints

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        hashes = self._hashes(keys.astype(np.uint64), self.seed)
        a, b, c = self.prints[self._slots(hashes, self.segment, self.segments)]
        return (a ^ b ^ c) == self._prints(hashes)


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, points, digest, incoming): written once, so that row numbers stay as they are."""
    original = text_or_empty()
    digest = F.sha2(F.translate(original, BLANKS, ""), 256)
    return materialised(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.length(original).cast("bigint").alias("points"),
            digest.alias("digest"),
        ),
        "exact-digests",
    )


def groups(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per group: how many rows it has and which one stays."""
    best = F.min(F.struct((-F.col("points")).alias("less"), "doc_id", "row")).alias("best")
    return rows.groupBy(*keys).agg(best, F.count("*").alias("n"))


def keyed(found: DataFrame, n_buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return found.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftright(key, 20), F.lit(n_buckets)))


def build_filters(snapshot: DataFrame) -> DataFrame:
    """(bucket, seed, segment, segments, prints) for a snapshot's groups with key and bucket."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuse.build(part["key"].to_numpy().view(np.uint64))
        return pd.DataFrame(
            {
                "bucket": part["bucket"].iloc[:1],
                "seed": [made.seed],
                "segment": [made.segment],
                "segments": [made.segments],
                "prints": [made.prints.tobytes()],
            }
        )

    schema = "bucket bigint, seed bigint, segment bigint, segments bigint, prints binary"
    return snapshot.select("bucket", "key").groupBy("bucket").applyInPandas(work, schema)


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """(key, bucket, maybe): whether the bucket's filter lets each incoming key through."""

    def work(keys: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        if len(made):
            row = made.iloc[0]
            fuse = BinaryFuse(int(row["seed"]), int(row["segment"]), int(row["segments"]), np.frombuffer(row["prints"], np.uint8))
            maybe = fuse.may_hold(keys["key"].to_numpy().view(np.uint64))
        else:
            maybe = np.zeros(len(keys), bool)
        return pd.DataFrame({"key": keys["key"], "bucket": keys["bucket"], "maybe": maybe})

    asked = incoming.select("key", "bucket").distinct()
    return asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(work, "key bigint, bucket bigint, maybe boolean")


def against_snapshot(batch: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Groups of a batch merged with a snapshot's: (digest, best, n) for every digest of either."""
    largest = max(batch.count(), snapshot.count())
    n_buckets = max(1, ceil(largest / BUCKET_KEYS))
    new, old = keyed(batch, n_buckets), keyed(snapshot, n_buckets)
    answers = materialised(screen(new, build_filters(old)), "exact-screened")
    asked = new.join(answers, ["bucket", "key"])
    fresh = asked.where(~F.col("maybe")).select("digest", "best", "n")
    # Exact buckets are only joined by what a filter lets through.
    bucket = old.select("digest", F.col("best").alias("old_best"), F.col("n").alias("old_n"))
    met = asked.where("maybe").select("digest", "best", "n").join(bucket, "digest", "full")
    merged = met.select(
        "digest",
        F.least("best", "old_best").alias("best"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("old_n", F.lit(0))).alias("n"),
    )
    return fresh.unionByName(merged)


def compared(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Digests whose texts are not all equal, byte for byte. ``repeated``: digests of more than one row."""
    body = F.translate(text_or_empty(), BLANKS, "")
    part = F.pmod(F.hash("doc_id", F.length(text_or_empty())), F.lit(PARTS))
    texts = docs.select(F.sha2(body, 256).alias("digest"), part.alias("part"), body.alias("body"))
    asked = repeated.select("digest", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    met = texts.join(asked.hint("shuffle_hash"), ["digest", "part"])
    ends = met.groupBy("digest", "part").agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    ends = ends.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return ends.where("lo <> hi").select("digest")


def exact_duplicates(docs: DataFrame, incoming: Column | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, row) for every row of ``docs``.

    ``incoming`` marks the rows that come as a new batch; the others are the snapshot. By default a hash of doc_id
    and digest deals the rows out evenly; which rows are in the snapshot doesn't change the result.
    """
    if incoming is None:
        incoming = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(2)) == 1
    rows = digests(docs)
    snapshot = materialised(groups(rows.where(~incoming), "digest"), "exact-snapshot")
    batch = materialised(groups(rows.where(incoming), "digest"), "exact-batch")
    merged = materialised(against_snapshot(batch, snapshot), "exact-groups")
    clashing = materialised(compared(docs, merged.where("n > 1")), "exact-clashes")
    if not clashing.isEmpty():
        merged = merged.join(clashing, "digest", "left_anti")
    result = rows.join(merged, "digest").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    if clashing.isEmpty():
        return result
    return result.unionByName(by_text(docs, clashing))


def by_text(docs: DataFrame, clashing: DataFrame) -> DataFrame:
    """The rows of digests that several texts share, grouped by their text."""
    original = text_or_empty()
    body = F.translate(original, BLANKS, "")
    rows = docs.select("doc_id", F.length(original).alias("points"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    rows = materialised(rows.join(clashing, "digest").withColumn("row", F.monotonically_increasing_id()), "exact-clashing")
    return rows.join(groups(rows, "digest", "body"), ["digest", "body"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, all columns as they were."""
    digest, keeper, nth = (unused(docs.columns, name) for name in ("copy_digest", "copy_keeper", "copy_nth"))
    kept = exact_duplicates(docs).where("kept").select(F.struct("doc_id", "text_sha256").alias(keeper))
    marked = docs.withColumn(digest, F.sha2(F.translate(text_or_empty(), BLANKS, ""), 256))
    same = F.col("doc_id").eqNullSafe(F.col(f"{keeper}.doc_id")) & (F.col(digest) == F.col(f"{keeper}.text_sha256"))
    joined = marked.join(kept, same)
    # Rows that repeat both doc_id and text meet the same kept row; the longest original stays.
    again = Window.partitionBy(keeper).orderBy(F.length(text_or_empty()).desc())
    return joined.withColumn(nth, F.row_number().over(again)).where(F.col(nth) == 1).select(*docs.columns)
