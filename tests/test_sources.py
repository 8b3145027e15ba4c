import os
from dataclasses import replace

import pytest

from corpuspack import PackConfig, pack_files
from corpuspack.plans.pack import pack_listed, pack_listing, pack_trees
from corpuspack.sources import frontier as frontier_source
from corpuspack.sources import references, remote
from corpuspack.sources.tree_scan import scan_trees, scan_visible

REFERENCES = [
    ("https://github.com/owner/repo", "owner", "repo"),
    ("http://github.com/owner/repo", "owner", "repo"),
    ("github.com/owner/repo", "owner", "repo"),
    ("GitHub.COM/owner/repo", "owner", "repo"),
    ("https://github.com/owner/my-repo.git", "owner", "my-repo"),
    ("https://github.com/owner/repo/", "owner", "repo"),
    ("https://github.com/owner/repo.git/", "owner", "repo"),
    ("  owner/repo\t\n", "owner", "repo"),
    ("my-org/my_repo.x", "my-org", "my_repo.x"),
    ("src/main", "src", "main"),
    ("see github.com/owner/repo", "owner", "repo"),
    ("https://github.com/owner/repo/tree/main", None, None),
    ("https://github.com/owner/a.b", None, None),
    ("owner/r", None, None),
    ("owner/repo/more", None, None),
    ("/home/user/repo", None, None),
    ("C:\\Dev\\repo", None, None),
    ("./repo", None, None),
    ("repo", None, None),
    ("-x/repo", None, None),
    ("", None, None),
    (None, None, None),
]


def test_references(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REFERENCES)], "i int, ref string")
    rows = references.parse_references(df).orderBy("i").collect()
    assert [(r.ref, r.owner, r.name) for r in rows] == REFERENCES
    assert [r.kind == "remote" for r in rows] == [r[1] is not None for r in REFERENCES]


def test_reference_labels(spark):
    df = spark.createDataFrame([("o/repo", None), ("o/repo", "feature/x")], "ref string, branch string")
    rows = references.label_references(references.parse_references(df)).collect()
    assert sorted((r.branch_or_default, r.label) for r in rows) == [("HEAD", "o/repo"), ("feature/x", "o/repo@feature/x")]


LISTINGS = [
    ("r", '{"tree": [{"extra": 1}, {"path": "a", "type": "blob", "size": 3, "sha": "s"}]}'),
    ("q", "{}"),
    ("t", '{"truncated": 1, "tree": [{"path": "b", "type": "blob", "size": "12", "sha": "s"}]}'),
    ("u", '{"truncated": "TRUE", "tree": [{"path": "c", "type": "blob", "size": 2.0, "sha": 7}]}'),
    ("v", '{"truncated": 0, "tree": []}'),
    ("bad", '{"tree": [{"path": "a", "type": "blob", "size": 3, "sh'),
    ("bad", '{"tree": [{"path": "d", "type": "blob", "size": 3, "sha": "s"}]}'),
    ("none", None),
    ("text", "rate limit exceeded"),
]


def test_listing_defaults(spark):
    parsed = remote.parsed_listings(spark.createDataFrame(LISTINGS, "repo string, tree_json string"))
    rows = {(r.repo, r.path): (r.type, r.size_bytes, r.sha, r.truncated) for r in remote.tree_entries(parsed).collect()}
    assert rows == {
        ("r", ""): ("", 0, "", False),
        ("r", "a"): ("blob", 3, "s", False),
        ("t", "b"): ("blob", 12, "s", True),
        ("u", "c"): ("blob", 2, "7", True),
        ("bad", "d"): ("blob", 3, "s", False),
    }
    cut = {r.repo: r.truncated for r in remote.truncated_listings(parsed).collect()}
    assert {repo for repo, said in cut.items() if said} == {"t", "u"} and len(cut) == 8
    errors = sorted((r.repo, r.error) for r in remote.listing_errors(parsed).collect())
    assert errors == [("bad", "listing is not JSON"), ("none", "no listing"), ("text", "listing is not JSON")]


def test_failed_listings_end_with_status_1(spark):
    listings = spark.createDataFrame([(r, r, t) for r, t in LISTINGS], "repo string, label string, tree_json string")
    blobs = spark.createDataFrame([(r, s, "x") for r in "rtu" for s in "s7"] + [("bad", "s", "x")], "repo string, sha string, content string")
    asked = spark.createDataFrame([("unknown",), ("r",)], "repo string")
    run = pack_listing(listings, blobs, PackConfig(include=["**/*"], mode="remote"), asked)
    assert {r.repo: (r.included, r.status) for r in run.summary().collect()} == {
        **dict.fromkeys(("bad", "none", "text", "q", "v", "unknown"), (0, 1)), "r": (1, 0), "t": (1, 0), "u": (1, 0),
    }
    assert {r.repo for r in run.errors().collect()} == {"bad", "none", "text"}
    assert {r.repo for r in run.outputs().collect()} == {"r", "t", "u"}
    assert {r.repo: r.n_files for r in run.dry_run().collect()} == {**dict.fromkeys(("bad", "none", "text", "q", "v", "unknown"), 0), "r": 1, "t": 1, "u": 1}


@pytest.fixture
def repos(tmp_path):
    contents = {
        "one/src/A.java": b"class A {}",
        "one/.github/ci.yml": b"on: push",
        "one/_x.md": b"under",
        "one/README.md": b"# one\n",
        "one/bin.md": b"\xff\x00",
        "one/big.md": b"x" * 2049,
        "two/a b/ü.md": b"umlaut",
        "two/deep/er/z.md": b"z",
    }
    for path, data in contents.items():
        target = tmp_path / "repos" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    os.symlink(tmp_path / "repos" / "two", tmp_path / "repos" / "one" / "link.md")
    (tmp_path / "repos" / "empty").mkdir()
    (tmp_path / "repos" / "loose.md").write_bytes(b"of no repository")
    return tmp_path / "repos"


def test_scan_trees(spark, repos):
    rows = {(r.repo, r.path): (r.size_bytes, r.raw) for r in scan_trees(spark, str(repos), max_file_kb=2).collect()}
    assert rows["one", ".github/ci.yml"] == (8, bytearray(b"on: push"))
    assert rows["one", "big.md"] == (2049, None)
    assert rows["two", "a b/ü.md"][1] == bytearray(b"umlaut")
    assert rows["one", "link.md"][1] is None
    assert len(rows) == 9


def test_scanned_trees_pack(spark, repos):
    config = PackConfig(include=["**/*.md", "*.yml"], max_file_kb=2)
    run = pack_files(scan_trees(spark, str(repos), max_file_kb=2), config)
    decisions = {(r.repo, r.path): r.decision for r in run.decisions.collect()}
    assert decisions["one", "bin.md"] == decisions["one", "link.md"] == "skip_unreadable"
    assert decisions["one", "big.md"] == "skip_size"
    assert {(r.repo, r.n_files) for r in run.outputs().collect()} == {("one", 3), ("two", 2)}


def _tree(root, files):
    for path, data in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)


def test_listed_trees_pack_like_a_table_of_files(spark, repos):
    _tree(repos, {"one/.packignore": b"docs/**\n*.tmp.md\n", "one/docs/d.md": b"d", "one/a.tmp.md": b"t", "one/src/test/t.md": b"t"})
    _tree(repos, {"two/node_modules/p/q.md": b"q", "two/a/build/b.md": b"b", "two/docs/kept.md": b"k"})
    config = PackConfig(include=["**/*.md", "*.yml"], exclude=["**/test/**"], max_file_kb=2)
    listed, table = pack_trees(spark, str(repos), config), pack_files(scan_trees(spark, str(repos), max_file_kb=2), config)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(listed.outputs(), table.outputs()) and same(listed.fragments(), table.fragments())
    # the tree has a row for each directory that is not entered, the table one for each file below
    kept = "decision <> 'skip_dir'"
    assert same(listed.decisions.where(kept), table.decisions.where(kept))
    hidden = {(r.repo, r.path, r.pruned_dir) for r in listed.decisions.where("decision = 'skip_dir'").collect()}
    assert hidden == {("one", "docs", "docs"), ("one", "src/test", "src/test"), ("two", "node_modules", "node_modules"), ("two", "a/build", "a/build")}
    told = {r.repo: (r.included, r.excluded, r.status) for r in listed.summary().collect()}
    assert told == {**{r.repo: (r.included, r.excluded, r.status) for r in table.summary().collect()}, "empty": (0, 0, 1)}
    totals = {r.repo: (r.n_files, r.total_bytes, r.total_kb, r.over_budget) for r in listed.dry_run().collect()}
    assert totals["empty"] == (0, 0, "0.0", False) and totals["two"][0] == 3


def test_excluded_directories_are_never_opened(spark, repos, monkeypatch):
    _tree(repos, {"one/.git/objects/ab/c": b"x", "one/node_modules/a/b.md": b"x", "two/.packignore": b"deep/**", "two/kept/k.md": b"k"})
    opened = []

    def here(frontier, root):
        """The same listing in this process, so that what it opens can be seen."""
        store, rows = frontier_source.Store(root), []
        for row in frontier.collect():
            opened.append((row.repo, row.path))
            rows += frontier_source.listed(store, row.repo, row.path, bytes(row.location))
        return spark.createDataFrame(rows, frontier_source._ENTRIES)

    monkeypatch.setattr(frontier_source, "_listing", here)
    listing = frontier_source.list_trees(spark, str(repos), PackConfig(include=["**/*.md"]))
    assert sorted(opened) == sorted(
        [("", ""), ("empty", ""), ("one", ""), ("two", ""), ("one", "src"), ("one", ".github"), ("two", "a b"), ("two", "kept")]
    )
    assert {(r.repo, r.path) for r in listing.pruned.collect()} == {("one", ".git"), ("one", "node_modules"), ("two", "deep")}


@pytest.mark.parametrize("form", ["{}", "file://{}"])
def test_hidden_names_on_any_file_system(spark, repos, form):
    os.unlink(repos / "one" / "link.md")  # other file systems have no links
    _tree(repos, {"two/.packignore": b"deep/**"})
    listing = frontier_source.list_trees(spark, form.format(repos), PackConfig(include=["**/*"]))
    found = {(r.repo, r.path): r.size_bytes for r in listing.files.collect()}
    assert found["one", ".github/ci.yml"] == 8 and ("one", "_x.md") in found and ("two", ".packignore") in found
    assert ("two", "deep/er/z.md") not in found and found["two", "a b/ü.md"] == 6
    read = frontier_source.read_files(listing.files, listing.root)
    assert {(r.repo, r.path): bytes(r.raw) for r in read.collect()}["two", "a b/ü.md"] == b"umlaut"
    assert {r.repo for r in listing.repos.collect()} == {"one", "two", "empty"}


def test_a_huge_repository_among_many_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frontier_source, "DIRECTORIES_PER_TASK", 8)
    for k in range(249):
        (tmp_path / f"r{k}").mkdir()
    for k in range(400):
        (tmp_path / "mono" / f"d{k % 20}" / f"e{k}").mkdir(parents=True)
        (tmp_path / "mono" / f"d{k % 20}" / f"e{k}" / "f.md").write_bytes(b"x")
    deals = []
    dealt = frontier_source._dealt
    monkeypatch.setattr(frontier_source, "_dealt", lambda rows, tasks: deals.append(dealt(rows, tasks)) or deals[-1])
    listing = frontier_source.list_trees(spark, str(tmp_path), PackConfig(include=["**/*.md"]))
    assert listing.files.count() == 400 and listing.repos.count() == 250
    last = deals[-2 if not deals[-1].count() else -1]
    sizes = [r["count"] for r in last.groupBy(frontier_source.F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and len(sizes) >= 40 and max(sizes) <= 24


def test_closed_directories_show_in_the_decisions(spark, repos, monkeypatch):
    store = frontier_source.Store(str(repos))

    def entries(location):
        raise PermissionError(location)

    monkeypatch.setattr(store, "entries", entries)
    closed = list(frontier_source.listed(store, "two", "a b", b"two/a b"))
    assert [row[:3] for row in closed] == [("two", "a b", "closed")]
    monkeypatch.setattr(store, "entries", lambda location: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError, match="disk"):
        list(frontier_source.listed(store, "two", "a b", b"two/a b"))
    assert list(frontier_source.listed(frontier_source.Store(str(repos)), "gone", "", b"gone")) == []
    listing = frontier_source.list_trees(spark, str(repos), PackConfig(include=["**/*.md"]))
    shut = spark.createDataFrame([("two", "locked")], "repo string, path string")
    run = pack_listed(replace(listing, closed=shut), PackConfig(include=["**/*.md"]))
    assert {(r.repo, r.path) for r in run.decisions.where("decision = 'skip_unreadable'").collect()} >= {("two", "locked")}
    assert {r.repo: r.excluded for r in run.summary().collect()}["two"] == 1


def test_names_that_are_not_text_are_read_all_the_same(spark, tmp_path):
    os.makedirs(os.path.join(os.fsencode(str(tmp_path)), b"r", b"d\xff"))
    with open(os.path.join(os.fsencode(str(tmp_path)), b"r", b"d\xff", b"f\xfe.md"), "wb") as file:
        file.write(b"text")
    run = pack_trees(spark, str(tmp_path), PackConfig(include=["**/*.md"]))
    assert [(r.path, r.decision) for r in run.decisions.collect()] == [("d�/f�.md", "include")]
    assert "text" in "".join(r.fragment for r in run.fragments().collect())


def test_no_repositories(spark, tmp_path):
    run = pack_trees(spark, str(tmp_path), PackConfig(include=["**/*.md"]))
    assert run.decisions.collect() == run.summary().collect() == run.outputs().collect() == []


def test_scan_visible_leaves_out_hidden_names(spark, repos):
    os.unlink(repos / "one" / "link.md")
    rows = {(r.repo, r.path): r.size_bytes for r in scan_visible(spark, str(repos)).collect()}
    assert ("one", "src/A.java") in rows and ("one", ".github/ci.yml") not in rows and ("one", "_x.md") not in rows
    assert rows["two", "deep/er/z.md"] == 1
    plan = scan_visible(spark, str(repos)).where("size_bytes <= 100").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "length" in plan.split("PushedFilters")[1].split("\n")[0]
