"""Quality classifier: Bradley-Terry ranking from preference pairs, thresholded by a quantile of scores.

Each labelled good document is preferred to each labelled bad one. A linear strength is learnt by logistic loss on
differences of features over such pairs. The quantile of strengths that corresponds to the share of bad labels, taken
exactly over all labelled rows that aren't held out, becomes the threshold; scores are logistic in the distance to it, so
that a score of THRESHOLD lies there.

Features describe a whole text: shares of kinds of characters, words, repeats and lines. Labels, language, source and
ids are never among them. Training uses a bounded sample, TRAINED rows of each label, those with the smallest hashes
of their doc_id, and never a row that is held out: one whose crc32(doc_id as text) is a multiple of FOLDS.

Null and empty texts have features of their own and a score like any other. A null doc_id isn't held out (its remainder
is null, so it counts as false) and has no label. A doc_id with several labels trains with each; of rows that repeat a doc_id, the least text does, while
each such row counts for the threshold. Texts of any length
are used whole. If either label has no row to learn from, all strengths are equal and everything scores 0.5. Other columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import forget_in_worker
from corpuspack.llm.shingles import Words
from corpuspack.session import materialised

#: Rows of each label that training takes at most.
TRAINED = 4000
#: Preference pairs drawn for each round of training.
PAIRS = 40_000
#: Bins into which a pass over the strengths divides the range that holds the quantile.
BINS = 4096
FOLDS, THRESHOLD = 5, 0.3

N_KINDS = 8
FEATURES = (
    "letters", "capitals", "digits", "blanks", "stops", "marks", "controls", "high_bytes",
    "letters_2", "capitals_2", "marks_2", "word_length", "word_length_2", "long_words", "distinct_words",
    "same_as_last", "top_word", "shouted", "marked_words", "line_length", "distinct_lines", "log_words", "no_words",
)


def _kinds() -> np.ndarray:
    kinds = np.full(256, 5, np.uint8)
    kinds[:32] = 6
    for first, last, kind in ((97, 122, 0), (65, 90, 1), (48, 57, 2), (128, 255, 7)):
        kinds[first : last + 1] = kind
    kinds[[9, 10, 11, 12, 13, 32]] = 3
    kinds[[ord(c) for c in ".,;:?'-"]] = 4
    return kinds


class Describer:
    def __init__(self):
        self.kinds = _kinds()
        self.words = Words()

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        out = np.zeros(len(FEATURES))
        if not len(data):
            out[-1] = 1
            return out
        kind = self.kinds[data]
        share = np.bincount(kind, minlength=N_KINDS) / len(data)
        out[:8] = share
        out[8:11] = np.sqrt(share[[0, 1, 5]])
        starts, codes = self.words.hashes(data)
        n = len(starts)
        if not n:
            out[-1] = 1
            return out
        blank = np.concatenate((np.flatnonzero(kind == 3), [len(data)]))
        ends = blank[np.searchsorted(blank, starts)]
        length = ends - starts
        _, counts = np.unique(codes, return_counts=True)
        marks = np.concatenate(([0], np.cumsum(kind == 5)))
        shouted = np.concatenate(([0], np.cumsum(kind == 1)))
        lines = (text or "").split("\n")
        out[11:23] = (
            np.log1p(length.mean()),
            np.log1p(length.mean()) ** 2,
            (length > 20).mean(),
            # a share of distinct words falls with length by itself, so it is measured against a root
            np.log(len(counts)) / np.log(n) if n > 1 else 1,
            (codes[1:] == codes[:-1]).mean() if n > 1 else 0,
            counts.max() / n if n > 1 else 0,
            ((shouted[ends] - shouted[starts]) * 2 > length).mean(),
            (marks[ends] > marks[starts]).mean(),
            np.log1p(len(data) / len(lines)),
            len(set(lines)) / len(lines),
            np.log1p(n),
            0,
        )
        return out


@dataclass(frozen=True)
class Ranker:
    """A linear strength, shifted so that 0 is the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        at = self.strength(features) - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(at, -700, 700)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def learn(good: np.ndarray, bad: np.ndarray, penalty: float = 1e-3, rounds: int = 25) -> Ranker:
    """Newton's method on the logistic loss of feature differences over random pairs."""
    n = len(FEATURES)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(n), np.ones(n), np.zeros(n), float(np.log(THRESHOLD / (1 - THRESHOLD))))
    every = np.concatenate((good, bad))
    mean, scale = every.mean(0), every.std(0) + 1e-6
    one, other = (np.clip((x - mean) / scale, -6, 6) for x in (good, bad))
    draw = np.random.default_rng(0)
    difference = one[draw.integers(len(one), size=PAIRS)] - other[draw.integers(len(other), size=PAIRS)]
    weights = np.zeros(n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(difference @ weights, -700, 700)))
        slope = difference.T @ p / PAIRS - penalty * weights
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / PAIRS + penalty * np.eye(n)
        step = np.linalg.solve(curve, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return Ranker(mean, scale, weights, 0.0)


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): labels that may be learnt from."""
    return labels.select("doc_id", "quality").where("quality in (0, 1)").where(~held_out())


def training_rows(docs: DataFrame, labels: DataFrame, trained: int = TRAINED) -> DataFrame:
    """(doc_id, quality, text) of the bounded sample."""
    known = learnable(labels)
    one = lambda q: known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(trained)
    chosen = one(0).union(one(1))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    # At most 2 * TRAINED ids: a bound, so they are sent to where the texts are.
    met = texts.join(F.broadcast(chosen), F.col("id") == F.col("doc_id"))
    # Rows that repeat a doc_id count once, or they would not be bounded.
    return met.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def described(df: DataFrame) -> DataFrame:
    """Features of ``text`` in place of it."""
    others = [c for c in df.columns if c != "text"]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_in_worker()
        describe = Describer()
        for part in parts:
            out = part[others].copy()
            out["features"] = [describe(t) for t in part["text"]]
            yield out

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "text") + ", features array<double>"
    return df.mapInPandas(work, schema)


def nth_smallest(numbers: DataFrame, column: str, n: int) -> tuple[float, float]:
    """The n-th smallest number, n from 1 to their count, and the one after it (the same, if there is none).

    Each pass counts what falls into BINS bins of the range that holds the number, and goes on in one bin. A bin's range
    shrinks to its own least and greatest number, so a few passes come down to a single one; only bins reach the driver.
    """
    value = F.col(column)
    low, high = numbers.agg(F.min(value), F.max(value)).first()
    below = 0
    while low < high:
        at = F.least(F.floor((value - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = numbers.where(value.between(low, high)).groupBy(at.alias("bin"))
        for found in sorted(bins.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()):
            if below + found["n"] >= n:
                low, high = found["low"], found["high"]
                break
            below += found["n"]
    up_to, following = numbers.agg(F.count_if(value <= low), F.min(F.when(value > low, value))).first()
    return low, low if up_to > n or following is None else following


def threshold(docs: DataFrame, labels: DataFrame, ranker: Ranker) -> float:
    """Halfway between the strengths that the share of bad labels divides, over all rows that have labels to learn from."""
    strengths = docs.where(~held_out()).select("doc_id", strength_of(ranker)("text").alias("strength"))
    met = materialised(strengths.join(learnable(labels), "doc_id").select("strength", "quality"), "strengths")
    low, high = nth_smallest(met, "strength", met.where("quality = 0").count())
    return (low + high) / 2


def strength_of(ranker: Ranker):
    @F.pandas_udf("double")
    def strength(text: pd.Series) -> pd.Series:
        describe = Describer()
        return pd.Series(ranker.strength(np.array([describe(t) for t in text]).reshape(-1, len(FEATURES))))

    return strength


def train(docs: DataFrame, labels: DataFrame, trained: int = TRAINED) -> Ranker:
    rows = described(training_rows(docs, labels, trained)).orderBy("quality", "doc_id").toPandas()
    by = {q: np.array(rows.loc[rows["quality"] == q, "features"].tolist()).reshape(-1, len(FEATURES)) for q in (0, 1)}
    ranker = learn(by[1], by[0])
    if not len(by[0]) or not len(by[1]):
        return ranker
    return replace(ranker, threshold=threshold(docs, labels, ranker))


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describe = Describer()
        for part in parts:
            features = np.array([describe(t) for t in part["text"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": ranker.score(features)})

    # ids go as text: a null among numbers would make pandas round all of them
    wanted = docs.select(F.col("doc_id").cast("bigint").cast("string"), held_out().alias("held_out"), "text")
    result = wanted.mapInPandas(work, "doc_id string, held_out boolean, score double")
    result = result.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return result.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score THRESHOLD or more, with all their columns."""
    ranker = train(docs, labels)
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        describe = Describer()
        return pd.Series(ranker.score(np.array([describe(t) for t in text]).reshape(-1, len(FEATURES))))

    return docs.where(score("text") >= THRESHOLD)
