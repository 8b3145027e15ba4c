import random

from corpuspack.operators.names import split_names, with_anchors
from corpuspack.operators.ordered import rank_within


def test_rank_within(spark):
    rng = random.Random(5)
    keys = ["hot"] * 500 + [f"k{i % 40}" for i in range(200)]
    rows = [(k, f"{i:05d}") for i, k in enumerate(keys)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v string")
    expected = {}
    for k, v in sorted(rows):
        expected[k, v] = expected.get(k, 0)
    seen = {}
    for k, v in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        expected[k, v] = seen[k]
    got = {(r.k, r.v): r.n for r in rank_within(df, ["k"], ["v"], "n").collect()}
    assert got == expected


def placed(spark, paths, output="o"):
    return spark.createDataFrame([("r", output, p) for p in paths], "repo string, output string, path string")


def test_anchor_repeats_are_numbered_in_path_order(spark):
    got = {r.path: r.anchor for r in with_anchors(placed(spark, ["a/b.md", "a-b.md", "A_b.md", "c.md"])).collect()}
    assert got == {"A_b.md": "a-b-md", "a-b.md": "a-b-md-2", "a/b.md": "a-b-md-3", "c.md": "c-md"}


def test_numbered_anchor_may_equal_another_slug(spark):
    got = {r.path: r.anchor for r in with_anchors(placed(spark, ["X.java", "x.java", "x/java-2"])).collect()}
    assert got == {"X.java": "x-java", "x.java": "x-java-2", "x/java-2": "x-java-2"}


def test_anchors_are_scoped_to_their_document(spark):
    both = placed(spark, ["A.md"], "one").union(placed(spark, ["a.md"], "two"))
    assert {r.anchor for r in with_anchors(both).collect()} == {"a-md"}


def test_skewed_slugs_rank_without_one_task(spark):
    paths = [f"dir{'/' * 1}x" + "-" * i for i in range(60)]
    got = {r.path: r.anchor for r in with_anchors(placed(spark, paths)).collect()}
    slug = got[min(paths)]
    assert [got[p] for p in sorted(paths)] == [slug] + [f"{slug}-{n}" for n in range(2, 61)]


def serial_names(dirs):
    used, names = set(), {}
    for d in sorted(dirs):
        stem = d.replace("/", ".") if d else "_root"
        name, i = stem, 2
        while name in used:
            name, i = f"{stem}-{i}", i + 1
        used.add(name)
        names[d] = name + ".md"
    return names


def named(spark, repos):
    df = spark.createDataFrame([(r, d) for r, ds in repos.items() for d in ds], "repo string, dir_key string")
    got = {}
    for row in split_names(df).collect():
        got.setdefault(row.repo, {})[row.dir_key] = row.output
    return got


def test_split_names(spark):
    repos = {
        "plain": ["", "a", "a/b", "c"],
        "collide": ["a.b", "a/b", "a.b.c", "a/b.c", "a.b/c", "a/b/c"],
        "taken": ["a.b", "a.b-2", "a/b", "a/b-2", "a.b-3"],
        "root": ["", "_root"],
    }
    expected = {r: serial_names(ds) for r, ds in repos.items()}
    assert named(spark, repos) == expected


def test_split_names_on_random_directories(spark):
    rng = random.Random(11)
    repos = {}
    for i in range(40):
        pool = ["".join(rng.choice(["a", "b", "-2", "-3", ".", "/"]) for _ in range(rng.randint(1, 6))) for _ in range(30)]
        repos[f"r{i}"] = sorted({p.strip("/") for p in pool if "//" not in p and p.strip("/")})
    expected = {r: serial_names(ds) for r, ds in repos.items()}
    assert named(spark, repos) == expected


def test_split_names_on_nested_numbers(spark):
    rng = random.Random(23)
    repos = {}
    for i in range(60):
        pool = set()
        for _ in range(rng.randint(5, 40)):
            stem = "a" + "".join(f"-{rng.choice([2, 2, 3, 4, 10])}" for _ in range(rng.randint(0, 4)))
            # equal stems at any place of the order
            pool.add(rng.choice(["x/y/z/", "x.y/z/", "x/y.z/", "x.y.z/", "x/y/z.", "x.y.z."]) + stem)
        repos[f"r{i}"] = sorted(pool)
    assert named(spark, repos) == {r: serial_names(ds) for r, ds in repos.items()}


def test_numbers_that_are_no_plain_numbers_are_names(spark):
    repos = {"r": ["a.b", "a/b", "a/b-02", "a/b-1", "a/b-0", "a/b-2x", "a/b-99999999999999999999", "-2", "a/b-2\n", "a\n.b", "a\n/b", "a\n/b-2"]}
    assert named(spark, repos) == {r: serial_names(ds) for r, ds in repos.items()}


def test_a_long_chain_of_displaced_names(spark):
    # each stem takes the plain name of the next one
    chain = ["p.a", "p/a"] + ["p/a" + "-2" * n for n in range(1, 40)]
    taken_far = ["q.a", "q/a"] + [f"q.a-{n}" for n in range(2, 3000)]
    repos = {"chain": chain, "far": taken_far}
    got = named(spark, repos)
    assert got == {r: serial_names(ds) for r, ds in repos.items()}
    assert got["chain"][chain[-1]] == "p.a" + "-2" * 40 + ".md"
    assert got["far"]["q/a"] == "q.a-3000.md"


def test_many_equal_names_in_bounded_rounds(spark):
    # 2^15 directories of one base, every third number taken before or after
    wide = ["".join(f"{'./'[(n >> bit) & 1]}d" for bit in range(15)) for n in range(1 << 15)]
    wide = ["r" + d for d in wide]
    base = "r" + ".d" * 15
    dirs = wide + [f"{base}-{n}" for n in range(3, 40_000, 3)]
    got = named(spark, {"r": dirs})["r"]
    assert len(set(got.values())) == len(dirs)
    used, reached, expected = set(), 2, {}
    for d in sorted(dirs):
        stem = d.replace("/", ".")
        if stem not in used:
            expected[d] = stem
        elif stem == base:
            while f"{base}-{reached}" in used:
                reached += 1
            expected[d] = f"{base}-{reached}"
        else:
            expected[d] = f"{stem}-2"
        used.add(expected[d])
    assert got == {d: name + ".md" for d, name in expected.items()}
