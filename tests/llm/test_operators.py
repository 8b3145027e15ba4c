"""Every operator against brute force, on rows with nulls, empty and repeated texts, ties and extra columns."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from corpuspack.llm import bpe, chains, exact, jaccard, mixing, neighbours, quality, repeats, sharding, suffixes, warc
from corpuspack.llm.components import connected_components
from corpuspack.llm.queries import ORACLE, QUERIES, VOCABULARY

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, node string, row string"
FOLDER = os.environ.get("CORPUSPACK_TEST_DATA", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefgé") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    base, passage = some(150), some(70)
    out = [None, "", " \n\t ", "one", "one", "ONE two", "a b c d", "A b C d", base, base, base.replace(" ", "  ") + "\n"]
    for k in range(14):  # near copies, more than a short list holds
        parts = base.split()
        parts[(k * 11) % 150] = "changed%d" % k
        out.append(" ".join(parts))
    out += [some(60) + " " + passage + " " + some(40 + k) for k in range(12)]
    out += [some(n) for n in (3, 4, 5, 6, 7, 20, 300)] + ["ab" * 400, "ab" * 400 + "c", "x" * 1000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", ("a", "b", None)[k % 3], len(t or ""), 7, "n", "r") for k, t in enumerate(texts())]
    rows.append((5, rows[5][1], "en", "a", 7, 7, "n", "r"))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 40), (40, 45)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert found == {**{k: 0 for k in range(31)}, 40: 40, 45: 40, 50: 40}


def test_suffix_sort_equals_sorting():
    draw = random.Random(1)
    for _ in range(40):
        strings = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 30))) for _ in range(draw.randint(1, 40))]
        group = np.sort(np.array([draw.randint(0, 3) for _ in strings]))
        length = np.array([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings) or b"-", np.uint8)
        order, common = suffixes.Suffixes(data, np.cumsum(length) - length, length).sort(group)
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings))
        for at in range(1, len(strings)):
            if group[order[at]] == group[order[at - 1]]:
                assert common[at] == len(os.path.commonprefix([strings[order[at]], strings[order[at - 1]]]))


def repeated(rows, length):
    count = Counter(t[s : s + length] for _, t in rows for s in range(len(t) - length + 1))
    for key, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        yield key, len(t), sum(gone), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize("group", [16_384, 3])
def test_repeats(docs, group):
    found = repeats.without_repeats(docs, group=group).collect()
    got = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in found]
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    assert sorted(got) == sorted(repeated(rows, 200))


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("small_list", [8, 2])
def test_jaccard(docs, monkeypatch, small_list):
    monkeypatch.setattr(jaccard, "SMALL_LIST", small_list)
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
    least = {k: k for k, _ in rows}

    def top(k):
        while least[k] != k:
            k = least[k]
        return k

    for a, s in rows:
        for b, t in rows:
            if s and t and 100 * len(s & t) >= 75 * len(s | t) and top(a) != top(b):
                least[max(top(a), top(b))] = min(top(a), top(b))
    n_links = [sum(alike(s, t) for _, t in rows) - bool(s) for _, s in rows]
    got = [tuple(r) for r in jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert sorted(got) == sorted((k, len(s), top(k), n) for (k, s), n in zip(rows, n_links))


def alike(s, t):
    return bool(s and t) and 100 * len(s & t) >= 75 * len(s | t)


@pytest.mark.parametrize("count_nodes, list_part", [(2048, 4096), (64, 32)])
def test_jaccard_counts_all_links_of_a_large_group(spark, monkeypatch, count_nodes, list_part):
    monkeypatch.setattr(jaccard, "COUNT_NODES", count_nodes)
    monkeypatch.setattr(jaccard, "LIST_PART", list_part)
    draw = random.Random(8)
    base = ["w%d" % k for k in range(120)]
    rows = []
    for k in range(500):
        words = list(base)
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(120)] = "x%d" % draw.randrange(10**6)
        rows.append((k, " ".join(words)))
    rows += [(k, t) for k, t in rows[:40]] + [(None, rows[7][1]), (None, rows[9][1] + " end")]
    sets = [shingles(t) for _, t in rows]
    want = [sum(alike(s, t) for t in sets) - 1 for s in sets]
    assert min(want) < max(want)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_links"]) for r in found) == sorted(
        (-1 if k is None else k, n) for (k, _), n in zip(rows, want)
    )


def test_a_row_without_an_id_links_others(spark):
    words = ["w%d" % k for k in range(100)]
    rows = [(9, " ".join(words[:90])), (None, " ".join(words[8:98])), (None, " ".join(words[8:98])), (5, " ".join(words[14:] + ["x", "y"]))]
    rows += [(6, "nothing like it"), (None, None)]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sets = {k: shingles(t) for k, t in rows if k is not None}
    assert not alike(sets[5], sets[9])
    got = sorted((r["doc_id"] or 0, r["component_id"], r["n_links"]) for r in found if r["n_shingles"])
    assert got == [(0, 5, 3), (0, 5, 3), (5, 5, 2), (6, 6, 0), (9, 5, 2)]


def test_overlaps_of_many_and_of_few():
    draw = np.random.default_rng(5)
    for spread, count in ((60, 40), (400, 70), (10**6, 30), (3, 300)):
        sides = [[np.unique(draw.integers(0, spread, draw.integers(1, 60))).astype(np.uint64) for _ in range(count + k)] for k in (0, 9)]
        want = [[100 * len(set(a) & set(b)) >= 40 * len(set(a) | set(b)) for b in sides[1]] for a in sides[0]]
        assert (jaccard.alike(*sides, 40) == np.array(want)).all()


def test_two_visitors_of_a_list_meet_in_its_parts(spark, monkeypatch):
    """Nodes of one list in components of their own, some in a larger one: each plausible pair once."""
    draw = random.Random(4)
    sets = [np.array(sorted(draw.sample(range(1000, 1200), draw.randint(150, 190))), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(90)]
    nodes = spark.createDataFrame([(k, len(s), jaccard.parity(s)) for k, s in enumerate(sets)], "node bigint, size bigint, bitmap binary")
    placed = spark.createDataFrame([(1, k, 0 if k < 20 else k) for k in range(90)], "list bigint, node bigint, component bigint")
    want = set()
    for a in range(90):
        for b in range(max(a + 1, 20), 90):
            m, n = len(sets[a]), len(sets[b])
            overlap = (m + n - jaccard.least_difference(jaccard.parity(sets[a]), jaccard.parity(sets[b]))) // 2
            if overlap * 100 >= 75 * (m + n - overlap) and min(m, n) * 100 >= max(m, n) * 75:
                want.add((a, b))
    for part in (4096, 16):
        monkeypatch.setattr(jaccard, "LIST_PART", part)
        found = [tuple(r) for r in jaccard.across(placed, nodes, 75).collect()]
        assert len(found) == len(set(found)) and set(found) == want and want


def test_chains_find_shared_passages(docs):
    found = chains.shared_passages(docs).collect()
    assert all(r["similarity"] >= 0.75 and min(r["words"], r["other_words"]) >= 50 for r in found)
    named = {r[c] for r in found for c in ("doc_id", "other_id")}
    # 10 differs from 8 in every blank, so they share no seed
    assert named >= set(range(8, 37)) - {10} and not named & {0, 1, 2, 3, 4, 5, 6, 7}


def test_fenwick_chain_prefers_the_diagonal():
    assert chains.chained([0, 40, 80, 120], [10, 50, 5000, 130])[0] == [0, 1, 3]


def test_exact(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), key))
    want = sorted((key, min(g)[1], len(g)) for g in groups.values() for _, key in g)
    for incoming in (None, F.lit(True), F.lit(False)):
        found = exact.exact_duplicates(docs, incoming)
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in found.collect()) == want
        assert found.where("kept").count() == len(groups)
    left = exact.without_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_binary_fuse_has_no_false_negatives():
    keys = np.random.default_rng(0).integers(0, 1 << 62, 5000).astype(np.uint64)
    for n in (1, 2, 10, 5000):
        fuse = exact.BinaryFuse.build(keys[:n])
        assert fuse.may_hold(keys[:n]).all()
    assert fuse.may_hold(keys + np.uint64(1)).mean() < 0.02


def test_digests_that_clash_are_grouped_by_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id bigint, text string")
    clashing = exact.digests(docs).select("digest").distinct()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact.by_text(docs, clashing).collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        by[r["source"]] = [by[r["source"]][0] + r["taken"], r["target"], r["source_size"]]
    assert all(t == int(target) and target <= 2 * size for t, target, size in by.values())
    assert abs(sum(x[1] for x in by.values()) - 1.5 * sum(x[2] for x in by.values())) < 1e-6
    mixed = mixing.mixed_documents(docs.where("doc_id <> 5"))
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.where("doc_id <> 5")).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == Counter({k: n for k, n in again.items() if n})


def test_shards(docs):
    rows = sharding.sharded(docs, shards=4).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert len(rows) == docs.count()


def test_shards_when_every_row_has_a_copy(spark):
    rows = [(k, "text %d" % (k % 60)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)

    def apart(placed):
        held = defaultdict(Counter)
        for r in placed:
            held[rows[r["doc_id"]][1]][r["shard"]] += 1
        return sum(sum(c.values()) ** 2 - sum(n * n for n in c.values()) for c in held.values()) // 2

    found = sharding.sharded(docs, shards=4).collect()
    assert Counter(Counter(r["shard"] for r in found).values()) == {38: 2, 37: 2}
    assert 5 * apart(found) < apart(sharding.placed(docs, 4).collect())


def test_flows_take_swaps_cycles_and_free_rows():
    assert sharding.flows({(0, 1): 5, (1, 0): 3}, {}, 2) == {(0, 1): 3, (1, 0): 3}
    assert sharding.flows({(0, 1): 2, (1, 2): 4, (2, 0): 3}, {}, 3) == {(0, 1): 2, (1, 2): 2, (2, 0): 2}
    assert sharding.flows({(0, 1): 5, (1, 0): 3}, {1: 1}, 2) == {(0, 1): 4, (1, 0): 3}
    assert sharding.flows({(0, 1): 5}, {0: 9}, 2) == {}
    draw = random.Random(4)
    for _ in range(60):
        wanted = {(s, t): draw.randint(0, 2) for s in range(3) for t in range(3) if s != t and draw.random() < 0.7}
        free = {s: draw.randint(0, 1) for s in range(3)}
        fits = lambda f: all(sum(n * ((t == x) - (s == x)) for (s, t), n in f.items()) <= free[x] for x in range(3))
        every = (dict(zip(wanted, f)) for f in itertools.product(*[range(n + 1) for n in wanted.values()]))
        got = sharding.flows(wanted, free, 3)
        assert fits(got) and all(n <= wanted[k] for k, n in got.items())
        assert sum(got.values()) == max(sum(f.values()) for f in every if fits(f))


@pytest.fixture(scope="module")
def vocabulary():
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaves", [(bpe.TEXT_LEAF, bpe.MATCH_LEAF), (1 << 16, 64), (7, 4), (5, 1)])
def test_bpe_joins(vocabulary, leaves):
    ranks, peer = vocabulary
    own = bpe.Bpe(ranks, public_tokenizers.PATTERN, *leaves)
    draw = random.Random(5)
    for _ in range(300):
        text = "".join(draw.choice("aab eé \n\t thein'sx12…!日\x1c\r") for _ in range(draw.randint(0, 60)))
        assert own.encode(text) == peer.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_bpe_goes_through_the_tree(spark, vocabulary):
    ranks, peer = vocabulary
    own = bpe.Bpe(ranks, public_tokenizers.PATTERN)
    counts = {"joined": 0, "combined": 0}

    def counting(name):
        method = getattr(own, name)

        def call(*args):
            counts[name] += 1
            return method(*args)

        return call

    for name in counts:
        setattr(own, name, counting(name))
    texts = [r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    halved = sum(len(text) > bpe.TEXT_LEAF for text in texts)
    for text in texts:
        assert own.encode(text) == peer.encode_ordinary(text)
    # every text over a leaf is joined from halves, and so are long matches
    assert halved and counts["combined"] >= halved and counts["joined"] > 0


def test_bpe_documents(docs, vocabulary):
    ranks, peer = vocabulary
    found = bpe.decode_ids(bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    got = sorted((r["doc_id"], r["ids"], bytes(r["data"])) for r in found)
    assert got == sorted((r["doc_id"], peer.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in docs.collect())


def test_bpe_round_trip_equals_its_steps(docs):
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    rows = lambda df: sorted(map(str, df.collect()))
    steps = bpe.decode_ids(bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN), ranks)
    assert rows(bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)) == rows(steps)


def test_warc(spark, tmp_path):
    rows = [(1, "u", "<p>é</p>", 1), (2, None, None, 1), (3, "v", "", 1), (4, "a\r\nb", "<p>é</p>", 1), (4, "a\r\nb", "<p>é</p>", 1), (None, "w", "z", 1)]
    rows += [(k, "u", "page %d " % k * 50, 1) for k in range(10, 60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int")
    read = warc.archived(pages, f"file://{tmp_path}/warc").collect()
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in read)
    first = {}
    for key, _, html, _ in sorted(rows, key=lambda r: r[0] or 0):
        first.setdefault(html or "", key)
    want = sorted((k or 0, len((h or "").encode()), "response" if first[h or ""] == k else "revisit", 0 if first[h or ""] == k else first[h or ""]) for k, _, h, _ in rows)
    assert got == want
    data = (tmp_path / "warc").glob("*.zst").__next__().read_bytes()
    assert data[:4] == bytes.fromhex("5d2a4d18")


@pytest.mark.parametrize("group", [None, 400])
def test_nearest(spark, monkeypatch, group):
    if group:  # many cells, many blocks in each
        monkeypatch.setattr(neighbours, "QUERY_GROUP", 50)
        monkeypatch.setattr(neighbours, "CANDIDATE_GROUP", group)
        monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 5)
    draw = np.random.default_rng(2)
    rows = [(k, draw.normal(size=9).astype(np.float32).tolist(), k) for k in range(300)]
    rows[7] = (7, rows[8][1], 7)  # a tie
    rows += [(400, None, 0), (401, [0.0] * 9, 0), (402, [float("nan")] * 9, 0), (403, [None] * 9, 0), (404, [1.0] * 3, 0)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, dims int"), F.col("vec_id") % 20 == 0)
    x = np.array([r[1] for r in rows[:300]], np.float32).astype(float)
    want = []
    for q in range(0, 300, 20):
        score = np.zeros(300)
        for d in range(9):
            score += x[q, d] * x[:, d]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-score[i], i))[:20]
        want += [(q, n + 1, i, score[i]) for n, i in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == want


def test_quality(spark, docs):
    good = [(k, " ".join("word%d" % (k * 7 + j) for j in range(50)) + ".") for k in range(40)]
    bad = [(100 + k, " ".join("spam%d!!&&&" % j for j in range(30 + k))) for k in range(20)]
    table = spark.createDataFrame(good + bad + [(200, None), (201, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1) for k, _ in good] + [(k, 0) for k, _ in bad] + [(None, None)], "doc_id bigint, quality int")
    rows = quality.scored(table, quality.train(table, labels)).collect()
    assert len(rows) == 62 and all(0 <= r["score"] <= 1 for r in rows)
    right = [r["predicted"] == int(r["doc_id"] < 100) for r in rows if r["doc_id"] < 200]
    assert sum(right) / len(right) > 0.95
    none = quality.train(table, labels.where("quality = 1"))
    assert {r["score"] for r in quality.scored(table, none).collect()} == {0.5}


@pytest.mark.parametrize(
    "operator",
    [exact.exact_duplicates, jaccard.jaccard_components, mixing.mix, repeats.without_repeats, chains.shared_passages, sharding.sharded],
)
def test_empty_tables(nothing, operator):
    assert operator(nothing).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", ORACLE)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    df = QUERIES[name](spark, FOLDER)
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, result.fetchall()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_pipeline_stages(spark):
    before = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = before
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == before.columns
        assert after.exceptAll(docs).count() == 0, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert exact.exact_duplicates(docs).where("not kept").count() == 0
    assert jaccard.jaccard_components(docs).where("component_id <> doc_id").count() == 0


def test_chains_connect_texts_whatever_the_first_one_holds(spark):
    rng = np.random.default_rng(5)
    words = lambda n: ["w" + "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]
    line = words(22)
    shared = [words(60) for _ in range(2)]
    texts = []
    for k in range(24):
        # a line that all have, and after it one of two passages, or neither; every fifth word differs, so only the line has seeds
        after = [words(1)[0] if n % 5 == 4 else w for n, w in enumerate(shared[k % 4])] if k % 4 < 2 else words(60)
        texts.append(" ".join(words(150) + line + after + words(150)))
    for order in (texts, texts[::-1]):
        docs = spark.createDataFrame([*enumerate(order)], "doc_id bigint, text string")
        found = chains.shared_passages(docs).collect()
        assert all(r["similarity"] >= 0.75 and min(r["words"], r["other_words"]) >= 50 for r in found)
        near = {k: k for k in range(24)}
        for r in found:
            old, new = near[r["doc_id"]], near[r["other_id"]]
            near = {k: new if v == old else v for k, v in near.items()}
        kind = lambda k: (23 - k if order is not texts else k) % 4
        for k in range(24):
            for m in range(24):
                assert (near[k] == near[m]) == (k == m or kind(k) == kind(m) and kind(k) < 2), (k, m)


def test_bounds_of_texts_of_a_seed():
    rng = np.random.default_rng(6)
    pieces = []
    words = chains.Words()
    base = rng.integers(0, 400, 120)
    for _ in range(60):
        own = rng.integers(0, 400, 150)
        size, at = rng.integers(20, 90), rng.integers(0, 30)
        own[at : at + size] = np.where(rng.random(size) < 0.12, rng.integers(0, 400, size), base[at : at + size])
        pieces.append(chains.Piece(words, " ".join(f"w{x}" for x in own).encode(), 0))
    codes = [x.codes for x in pieces]
    owner, tokens, kinds = chains.pairs_of_words(codes)
    counts = np.concatenate([m for _, m in chains.shared_counts(owner, tokens, 60, 7)])
    found = 0
    for x in range(60):
        want = [Counter(zip(codes[x], codes[x][1:])) & Counter(zip(c, c[1:])) for c in codes]
        assert all(counts[x, y] == sum(c.values()) for y, c in enumerate(want) if y != x)
        may = chains.dense(codes, kinds, np.full(60, x), np.arange(60))
        for y in range(60):
            if x != y and chains.passages(pieces[x], pieces[y]):
                found += 1
                assert counts[x, y] >= chains.MIN_PAIRS and may[y]
    assert found > 100


def test_runs_of_matched_words_equal_matches_word_by_word():
    def plain(one, other):
        """Matched words: pairs of words that occur once on either side, rising, grown over equal neighbours."""
        sides = [list(zip(x, x[1:])) for x in (one, other)]
        once = [{g: k for k, g in enumerate(side) if side.count(g) == 1} for side in sides]
        met = sorted((once[0][g], once[1][g]) for g in once[0].keys() & once[1].keys())
        anchors = [met[k] for k in chains.longest_rising([j for _, j in met])]
        out = []
        for number, (x, y) in enumerate(anchors):
            done_x, done_y = out[-1] if out else (-1, -1)
            if x <= done_x or y <= done_y:
                x, y = x + 1, y + 1
                if x <= done_x or y <= done_y:
                    continue
            p, q, left = x - 1, y - 1, []
            while p > done_x and q > done_y and one[p] == other[q]:
                left.append((p, q))
                p, q = p - 1, q - 1
            out += left[::-1]
            stop_x, stop_y = anchors[number + 1] if number + 1 < len(anchors) else (len(one), len(other))
            while x < len(one) and y < len(other) and one[x] == other[y] and x <= stop_x and y <= stop_y:
                out.append((x, y))
                x, y = x + 1, y + 1
        return out

    def best(pairs, words):
        """Stretches of matched words, word by word."""
        out, start, score = [], None, 0
        for k, (i, j) in enumerate(pairs):
            if start is not None:
                score -= chains.UNMATCHED * (max(i - pairs[k - 1][0], j - pairs[k - 1][1]) - 1)
            if start is None or score <= 0 or top - score > words:
                out += [] if start is None else [(start, end)]
                start, end, score, top = k, k, 0, 0
            score += 1
            if score >= top:
                end, top = k, score
        out += [] if start is None else [(start, end)]
        spans = [(*(z for side in zip(pairs[x], pairs[y]) for z in side), y - x + 1) for x, y in out]
        return [s for s in spans if min(s[1] - s[0], s[3] - s[2]) + 1 >= words]

    draw, words, seen = random.Random(8), chains.Words(), 0
    for turn in range(400):
        kinds, size = draw.choice([(4, 30), (12, 40), (60, 80), (400, 120)])
        one = [draw.randrange(kinds) for _ in range(draw.randrange(size))]
        other = [draw.randrange(kinds) if draw.random() < 0.15 else w for w in one if draw.random() < 0.97]
        if turn % 3 == 0:
            other = other[len(other) // 2 :] + other[: len(other) // 2]
        a, b = (chains.Piece(words, " ".join(f"w{x}" for x in side).encode(), 0) for side in (one, other))
        runs = chains.aligned(a, b)
        assert [(x + k, y + k) for x, y, n in runs for k in range(n)] == (pairs := plain(one, other))
        assert chains.stretches(runs, 8) == best(pairs, 8)
        seen += len(pairs) > 10
        grams = [Counter(zip(x, x[1:])) for x in (one, other)]
        assert a.shared(b) == sum((grams[0] & grams[1]).values())
    assert seen > 100


def test_texts_of_seeds_that_share_no_passage_are_not_aligned(monkeypatch):
    """Seeds are compared many at a time, and like one by one; only texts that may share a passage are aligned."""
    draw, calls = random.Random(9), []
    new = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    line, shared = new(20), new(60)
    aligned = chains.aligned
    monkeypatch.setattr(chains, "aligned", lambda *x: calls.append(1) or aligned(*x))

    def group(seed, sharing, of):
        texts = [f"{new(70)} {line} {shared if k < sharing else new(60)} {new(20)}" for k in range(of)]
        return [(seed, 0, 0, 1000 * seed + k, t.index(line), k, 0, 0, t.encode()) for k, t in enumerate(texts)]

    alone = [group(seed, 0, 12) for seed in range(6)] + [group(6, 0, chains.FEW + 9)]
    assert not list(chains.connecting(chains.Words(), alone[:6])) and not list(chains.connecting(chains.Words(), alone[6:])) and not calls
    some = [group(seed, 4, 12) for seed in range(6)]
    found = list(chains.connecting(chains.Words(), some))
    assert sorted(found) == sorted(row for x in some for row in chains.connecting(chains.Words(), [x]))
    # components of a seed are those of that seed alone
    assert len(found) == 6 * 3 and len(calls) == 2 * 6 * 3
    large = group(9, 4, chains.FEW + 9)
    monkeypatch.setattr(chains, "ROWS", 7)
    apart = list(chains.connecting(chains.Words(), [large]))
    monkeypatch.setattr(chains, "FEW", 1000)
    assert len(apart) == 3 and {x for row in apart for x in row[:2]} == {x for row in chains.connecting(chains.Words(), [large]) for x in row[:2]}


def test_shared_counts_with_those_that_follow():
    draw = np.random.default_rng(3)
    cells = np.unique(draw.integers(0, 90 * 400, 9000))
    owner, tokens = cells // 400, np.where(cells % 400 < 40, 0, cells % 400)
    keep = np.unique(owner * 400 + tokens)
    owner, tokens = keep // 400, keep % 400
    whole = np.concatenate([m for _, m in chains.shared_counts(owner, tokens, 90, 7)])
    for first, counts in chains.shared_counts(owner, tokens, 90, 7, after=True):
        for k, row in enumerate(counts):
            assert (row[k + 1 :] == whole[first + k, first + k + 1 :]).all()


def test_words_of_texts(spark):
    texts = ["", "a", " a", "a ", " \t\n\x0b\x0c\r", "a  b\nc", " ", "ä ö ü", "x\x1cy", "w " * 70, " ", "b"] * 20
    table = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    got = {r[0]: r[1] for r in table.select("doc_id", chains.word_counts("text")).collect()}
    assert got == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in enumerate(texts)}


def test_components_of_a_path_take_few_rounds(spark, monkeypatch):
    from corpuspack.llm import components

    draw, written = random.Random(2), []
    nodes = draw.sample(range(10**6), 120)
    write = components.materialised
    monkeypatch.setattr(components, "materialised", lambda df, label: written.append(label) or write(df, label))
    links = spark.createDataFrame([*zip(nodes, nodes[1:]), (7, 7)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert found == {x: min(nodes) for x in nodes} and len(written) <= 14
