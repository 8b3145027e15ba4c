"""Ids too large for doubles beside nulls, repeated ids, and columns of the operators' own names."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuspack.llm import common, exact, extraction, jaccard, mixing, neighbours, quality, warc

BIG = 1 << 60
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, _digest string, _id string, _words int, "
    "_kept_id int, mixed_row string, mixed_cut string, copy_digest string, COPY_KEEPER string, copy_nth string, near_row string"
)
OTHERS = ("d", "i", 3, 4, "r", "c", "g", "k", "n", "w")


def table(spark, rows):
    full = [(k, t, "en", s, len(t or ""), *OTHERS) for k, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(2)


def found(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_warc_ids(spark, tmp_path):
    rows = [(None, "u0", "null"), (BIG + 1, "u1", "same"), (BIG + 3, "u2", "same"), (BIG + 5, "u3", "other")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    got = {r["url"]: (r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived(pages, str(tmp_path / "w")).collect()}
    assert got == {
        "u0": (None, "response", None), "u1": (BIG + 1, "response", None),
        "u2": (BIG + 3, "revisit", BIG + 1), "u3": (BIG + 5, "response", None),
    }


def test_quality_ids(spark):
    docs = table(spark, [(None, "a", "s"), (BIG + 1, "b", "s"), (BIG + 3, None, "s")]).coalesce(1)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality.scored(docs, quality.train(docs, labels)).collect()
    assert {r["doc_id"] for r in rows} == {None, BIG + 1, BIG + 3}


def test_repeated_labelled_rows_are_bounded(spark):
    docs = table(spark, [(7, f"text {k}", "s") for k in range(50)] + [(8, "other", "s")])
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id bigint, quality int")
    rows = quality.training_rows(docs, labels)
    assert sorted((r["doc_id"], r["text"]) for r in rows.collect()) == [(7, "text 0"), (8, "other")]


def words(text):
    return text.split()


def test_mixture_with_repeated_and_null_ids(spark):
    rows = [(1, "a b c d", "x"), (1, "e f g h", "x"), (None, "i j k", "x"), (None, None, "x"), (2, "", None), (3, "l m", None), (3, "l m", None)]
    docs = table(spark, rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    budget = {r["source"]: int(r["target"]) for r in mixing.mix(docs).collect()}
    taken = Counter()
    for r in got:
        taken[r["source"]] += len(words(r["text"]))
    assert dict(taken) == budget
    # each row gives its words at most twice, cut at a word's end
    for source in ("x", None):
        texts = Counter(w for r in got if r["source"] == source for w in words(r["text"]))
        own = Counter(w for _, t, s in rows if s == source for w in words(t or ""))
        assert all(texts[w] <= 2 * own[w] for w in texts)
    assert all(r["_words"] == 3 and r["n_chars"] == len(r["text"]) for r in got)


def test_copies_with_clashing_columns(spark):
    rows = [(1, "a b", "x"), (2, "ab", "x"), (1, "a b", "x"), (None, "c", "x"), (None, "c  ", "x"), (4, None, "x"), (5, "", "x")]
    docs = table(spark, rows)
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    assert found(kept) == Counter([(1, "a b"), (None, "c  "), (4, None)])
    assert {r["_digest"] for r in kept.collect()} == {"d"} and {r["copy_digest"] for r in kept.collect()} == {"g"}
    assert exact.without_copies(docs.where("false")).count() == 0


def near(k):
    return " ".join(f"w{j}" if j != 7 * k else f"changed{k}" for j in range(100))


def test_near_copies_go_row_by_row(spark):
    """A clean row stays, whatever other rows have its id; near copies go, with an id or without."""
    clean = [f"entirely other text number {k} with words {' '.join(f'o{k}x{j}' for j in range(20))}" for k in range(3)]
    rows = [(5, near(1), "x"), (5, clean[0], "x"), (5, near(2), "x"), (None, near(3), "x"), (3, near(4), "x"), (None, clean[1], "x"), (9, "", "x"), (9, None, "x"), (BIG + 1, clean[2], "x")]
    docs = table(spark, rows)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    expected = [(3, near(4)), (5, clean[0]), (None, clean[1]), (9, ""), (9, None), (BIG + 1, clean[2])]
    assert found(kept) == Counter(expected)
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), "").count() == 0


def test_near_copies_equal_brute_force(spark):
    rows = [(k, near(k % 9), "x") for k in range(12)] + [(20 + k, near(30) + f" tail{k} " * k, "x") for k in range(5)] + [(40, "a b c", "x"), (41, "a b c", "x"), (42, "a b d", "x")]
    sets = {}
    for k, t, _ in rows:
        w = t.split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    least = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    kept = corpus_pipeline.drop_near_copies(spark, table(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*least.values()})


@pytest.mark.parametrize("kind", ["double", "float"])
def test_scores_are_taken_on_the_vectors_as_they_are(spark, kind):
    draw = np.random.default_rng(1)
    rows = [(k, [float(x) for x in draw.normal(size=8)]) for k in range(60)] + [(100, [1e200] + [0.0] * 7)] * (kind == "double")
    vectors = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    x = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in vectors.collect()}
    got = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, 3).collect()
    assert len(got) == 3 * len([k for k in x if k % 20 == 0])
    for r in got:
        score = sum(a * b for a, b in zip(x[r["query_id"]], x[r["vec_id"]]))
        assert r["score"] == pytest.approx(score, rel=1e-12)


def test_no_rows(spark):
    docs = table(spark, []).where("true")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.good_documents(docs, labels).count() == mixing.mixed_documents(docs).count() == 0
    assert jaccard.jaccard_components(docs).count() == 0
    assert extraction.texts_of(extraction.learn([(extraction.Forest.of([extraction.Page("<p>x")]), np.array([0, 0, 1]))]), [""]) == [""]
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert neighbours.nearest(vectors, F.col("vec_id") % 20 == 0).count() == 0


def test_threshold_lies_at_the_share_of_bad_labels_of_all_rows(spark):
    draw = random.Random(8)
    words = lambda n, low: " ".join(draw.choice(["ab", "cd", "$#", "##"] if low else ["word", "text", "rows"]) for _ in range(n))
    table = [(i, words(20 + i % 7, i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id bigint, quality int")
    ranker = quality.train(docs, labels, trained=20)  # the sample is much smaller than what the threshold covers
    learnt = quality.learnable(labels).collect()
    of = dict(table)
    describe = quality.Describer()
    strengths = sorted(float(ranker.strength(describe(of[r["doc_id"]])[None])[0]) for r in learnt)
    bad = sum(r["quality"] == 0 for r in learnt)
    assert ranker.threshold == pytest.approx((strengths[bad - 1] + strengths[bad]) / 2, rel=1e-9)


def test_nth_smallest(spark):
    draw = random.Random(4)
    values = [draw.choice([0.0, -1.5, 1e6, -1e6, 1e-12, draw.gauss(0, 1), draw.gauss(0, 1e-9)]) for _ in range(300)]
    numbers = spark.createDataFrame([(v,) for v in values], "v double")
    values.sort()
    for n in (1, 120, 300):
        assert quality.nth_smallest(numbers, "v", n) == (values[n - 1], values[min(n, 299)])
    assert quality.nth_smallest(numbers.where("v = 0"), "v", 3) == (0.0, 0.0)


def test_forgetting_gives_memory_back():
    """Also what lies below memory that is still in use."""
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    held = [np.ones(60_000, np.uint8) for _ in range(3000)]
    del held[:-1]
    before = resident()
    common.forget_in_worker()
    assert before - resident() > 100


@pytest.mark.parametrize("asked, kept", [("10000", "1024"), ("0", "1024"), ("500", "500")])
def test_pipeline_keeps_batches_small(spark, asked, kept):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, asked)
        docs = spark.range(3000).selectExpr("id doc_id", "concat('text ', id) text")
        assert corpus_pipeline.encode(spark, docs, "").count() == 3000
        assert spark.conf.get(name) == kept
    finally:
        spark.conf.set(name, before)
