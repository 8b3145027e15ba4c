"""The manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import duckdb
import pytest

from corpuspack.llm import merkle
from corpuspack.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, place int, start int"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def tree(nodes):
    """The top, and for each node its siblings, level by level, as (before, after)."""
    n = merkle.ARITY
    paths, at, level = [[] for _ in nodes], [*range(len(nodes))], nodes
    while len(level) > 1:
        for path, k in zip(paths, at):
            first = k - k % n
            path.append((level[first:k], level[k + 1 : first + n]))
        at = [k // n for k in at]
        level = [H(*level[k : k + n]) for k in range(0, len(level), n)]
    return level[0], paths


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append((row, leaf(row, row[1])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for one in by.values():
        one.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = [tree([d for _, d in by[s]]) for s in names]
    if not trees:
        return
    root, ways = tree([top for top, _ in trees])
    for name, (subroot, paths), way in zip(names, trees, ways):
        for (row, own), path in zip(by[name], paths):
            whole = [*path, *way]
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(row, text)
            for before, after in whole:
                node = H(*before, node, *after)
            proof = H(*(x for before, after in whole for x in (*before, *after)))
            yield row[0], own, subroot, root, proof, node, node == root


def rows_of(ids, sources, seed=0):
    draw = random.Random(seed)
    return [(k, draw.choice(["Some Text", "é", "", None, "plain %d" % draw.randint(0, 9)]), draw.choice(["en", None]), s, draw.choice([None, 5]), "x", 1, 2)
            for k, s in zip(ids, sources)]


def same(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = merkle.manifest(docs)
    path, H2 = made["path"], merkle.F
    beside = H2.transform(path, lambda s: H2.concat(s["before"], s["after"]))
    got = made.select("doc_id", "leaf", "subroot", "root", H2.sha2(H2.array_join(beside, ""), 256).alias("proof_sha256"),
                      merkle.folded(H2.coalesce("changed", "leaf"), path).alias("folded_root"))
    key = lambda r: tuple(str(x) for x in r)
    found = [(*r, r["folded_root"] == r["root"]) for r in got.collect()]
    assert sorted(found, key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("count", [1, 2, 16, 17, 256, 257])
def test_one_source(spark, count):
    same(spark, rows_of(range(count), ["s"] * count))


def test_rounds(spark, monkeypatch):
    """Arrays of four nodes, so that many rounds are needed; ids far apart, negative and large."""
    monkeypatch.setattr(merkle, "ARITY", 2)
    monkeypatch.setattr(merkle, "SPAN", 4)
    draw = random.Random(1)
    ids = draw.sample(range(-5000, 5000), 300) + [(1 << 62) + k for k in range(40)] + [-(1 << 63), (1 << 63) - 1]
    same(spark, rows_of(ids, [draw.choice(["a", "A", "é", None, "zz"]) for _ in ids]))


def test_many_sources(spark):
    ids = [*range(700)]
    same(spark, rows_of(ids, [f"s{k % 300}" for k in ids]))


def test_nulls_and_repeated_ids(spark):
    ids = [None] * 30 + [7] * 40 + [8, 9, 4096, 4096, 4097, -1, -1, 1 << 61, 1 << 61]
    rows = rows_of(ids, (["a", None, "b"] * len(ids))[: len(ids)])
    same(spark, rows + rows[3:50])


def test_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_manifest"](spark, folder).collect())
    read = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert got == sorted(brute([tuple(r) for r in read.collect()]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    told = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_manifest']})").fetchall()
    assert got == sorted(told) and {r[-1] for r in got} == {True, False}


def test_rows_of_nodes_leave_their_run_behind(spark):
    """A row for each node must not carry the digests of all nodes of its array."""
    made = merkle.manifest(spark.createDataFrame(rows_of(range(300), ["s", "t"] * 150), SCHEMA))

    def generated(node):
        own = [node.output().mkString(" ")] if node.nodeName() == "Generate" else []
        below = node.children()
        return own + [x for k in range(below.size()) for x in generated(below.apply(k))]

    found = generated(made._jdf.queryExecution().optimizedPlan())
    assert found and not any(name in x for x in found for name in ("slots", "digests", "level"))
