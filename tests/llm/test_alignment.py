"""Aligned tokens against the tokenizers' own libraries and a walk over both sides."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuspack.llm import alignment
from corpuspack.llm.queries import QUERIES, aligned_vocabularies

SCHEMA = "doc_id bigint, text string, batch string, pairs int, links string, n_a string"
BIG = (1 << 60) + 1


def texts():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgé漢ß'’🙂") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    return [
        None, "", " ", "  ", "\n", "a", "a ", " a", "a  ", " ".join("ab" for _ in range(900)) + " ", "ab " * 700 + "  \n c",
        "x" * 5000, " " * 3000, "\n\n \t" * 400 + "end", "▁", "a▁b", "<|endoftext|> and <s> </s> <unk>", "\0\x01\x7f\r\n", "don't we'll I'd",
        "12345 67 8,9.0", "漢字かな" * 500, "🙂🙂 é é", some(2000), some(50), some(50), "same text here", "same text here",
        "a b  c", "tab\t x\x0b y\x1c z \x85 q",
    ]


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(texts()), (BIG, "one"), (BIG + 2, "two words"), (None, "without an id"), (4, "\n")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, "y", "z") for k, t in rows], SCHEMA).repartition(3)


def sides():
    first, second = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    a, b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
    a.encode_special_tokens = True
    back = {v: k for k, v in alignment.byte_alphabet().items()}
    alphabet = {c: v for v, c in back.items()}
    a_bytes = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        left, right = [(i, a_bytes(i)) for i in x], [(i, b_bytes(i)) for i in y]
        spelled = b"".join(t for _, t in left) == whole == b"".join(t for _, t in right)
        return (left, right) if spelled else ([], [])

    return encode


def walked(left, right):
    """Groups and links by walking over both sides byte by byte."""
    at_a = [k for k, (_, t) in enumerate(left) for _ in t]
    at_b = [k for k, (_, t) in enumerate(right) for _ in t]
    links = list(dict.fromkeys(zip(at_a, at_b)))
    groups, mine = [], ([], [])
    for n, (i, j) in enumerate(zip(at_a, at_b)):
        for seen, k, tokens in ((mine[0], i, left), (mine[1], j, right)):
            if not seen or seen[-1][0] != k:
                seen.append((k, tokens[k][0]))
        if n + 1 == len(at_a) or (at_a[n + 1] != i and at_b[n + 1] != j):
            groups.append("|".join(",".join(str(t) for _, t in x) for x in mine))
            mine = ([], [])
    return groups, [(left[i][0], right[j][0]) for i, j in links]


def brute(rows):
    encode = sides()
    found = [(k, *encode(t)) for k, t in rows]
    aligned = [(k, len(x), len(y), *walked(x, y)) for k, x, y in found]
    count = Counter(pair for *_, links in aligned for pair in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for k, n_a, n_b, groups, links in aligned:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        best = sum(count[p] == most[p[1]] for p in links)
        yield k, n_a, n_b, len(groups), len(links), digest, best, sum(count[p] for p in links)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, *(x or 0 for x in r[:5]), r[5]))


@pytest.mark.parametrize("size", [None, 40])
def test_statistics(docs, rows, monkeypatch, size):
    if size:  # many slices and batches
        monkeypatch.setattr(alignment, "SLICE_CHARS", size)
        monkeypatch.setattr(alignment, "BATCH_CHARS", 8 * size)
        monkeypatch.setattr(alignment, "PIECE", size)
    got = alignment.alignment_statistics(docs, *aligned_vocabularies())
    assert order(tuple(r[c] for c in COLUMNS) for r in got.collect()) == order(brute(rows))


def test_groups(docs, rows):
    got = {r["doc_id"]: r["groups"] for r in alignment.token_groups(docs, *aligned_vocabularies()).where("doc_id < 100").collect()}
    encode = sides()
    for k, text in rows:
        if k is not None and k < 100:
            spelled = ["|".join(",".join(map(str, side)) for side in group) for group in got[k]]
            assert spelled == walked(*encode(text))[0], text


@pytest.mark.parametrize("near", [0, 1, 6])
def test_halving_finds_all_common_ends(monkeypatch, near):
    monkeypatch.setattr(alignment, "NEAR", near)
    draw = random.Random(2)
    for _ in range(200):
        n = draw.randint(1, 60)
        a, b = (np.array(sorted({n, *draw.sample(range(1, n + 1), draw.randint(0, n))})) for _ in range(2))
        groups = alignment.leaf_groups(a, b, *(np.array([x]) for x in (0, len(a), 0, len(b))))
        common = sorted({*a.tolist()} & {*b.tolist()})
        assert a[groups[1] - 1].tolist() == b[groups[3] - 1].tolist() == common
        assert groups[0].tolist() == [0, *groups[1][:-1]] and groups[2].tolist() == [0, *groups[3][:-1]]


def test_nothing(docs):
    empty = docs.where("false")
    assert alignment.alignment_statistics(empty, *aligned_vocabularies()).collect() == []
    assert alignment.token_groups(empty, *aligned_vocabularies()).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op12_align_tokens"](spark, folder)
    assert order(tuple(r[c] for c in COLUMNS) for r in got.collect()) == order(brute(rows))
    assert got.agg(F.sum("n_links")).first()[0] > 0
