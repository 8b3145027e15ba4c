import pytest
from pyspark.sql import functions as F

from corpuspack import PackConfig, pack_files
from corpuspack.functions.globs import glob_regex
from corpuspack.operators.select import (
    decision_counts,
    exclude_globs,
    exclude_sources,
    selected_files,
    with_decisions,
)
from corpuspack.sources.ignore import ignore_patterns, ignore_regexes, without_ignored


def decided(df, regexes=None, **config):
    config = PackConfig(**{"include": ["**/*.java"], **config})
    return {r.path: (r.decision, r.pruned_dir) for r in with_decisions(df, config, regexes).collect()}


def sized(spark, *paths, size=10):
    return spark.createDataFrame([("r", p, size) for p in paths], "repo string, path string, size_bytes bigint")


def test_precedence(spark):
    df = sized(spark, "src/A.java", "src/A.md", "build/A.java").union(sized(spark, "src/Big.java", size=513_000))
    df = df.withColumn("readable", F.col("path") != "src/B.java").union(
        sized(spark, "src/B.java").withColumn("readable", F.lit(False))
    )
    assert decided(df) == {
        "src/A.java": ("include", None),
        "src/A.md": ("exclude", None),
        "build/A.java": ("skip_dir", "build"),
        "src/Big.java": ("skip_size", None),
        "src/B.java": ("skip_unreadable", None),
    }


def test_size_limit_is_inclusive(spark):
    df = sized(spark, "a.java", size=2048).union(sized(spark, "b.java", size=2049))
    assert decided(df, max_file_kb=2) == {"a.java": ("include", None), "b.java": ("skip_size", None)}


def test_pruning_reports_the_outermost_directory(spark):
    df = sized(spark, "a/foo/bar/foo/B.java", "foobar/A.java", "A.java")
    assert decided(df, exclude=["foo/**"]) == {
        "a/foo/bar/foo/B.java": ("skip_dir", "a/foo"),
        "foobar/A.java": ("include", None),
        "A.java": ("include", None),
    }


def test_pruning_goes_beyond_the_file_pattern(spark):
    df = sized(spark, "foo/bar/B.java", "foo/A.java")
    assert decided(df, exclude=["foo/*"]) == {"foo/bar/B.java": ("skip_dir", "foo"), "foo/A.java": ("skip_dir", "foo")}
    flat = decided(df, exclude=["foo/*"], mode="remote")
    assert flat == {"foo/bar/B.java": ("include", None), "foo/A.java": ("exclude", None)}


def test_a_bare_x_prunes_every_directory(spark):
    df = sized(spark, "d/A.java", "A.java")
    assert decided(df, exclude=["x"]) == {"d/A.java": ("skip_dir", "d"), "A.java": ("include", None)}


WALK_CASES = [
    ["foo/*"], ["x"], ["x**"], ["*x"], ["d?r/**", "q"], ["{foo,dir}/*"], ["foo/[x]"], ["**/foo/**"], ["a/**"],
    ["**"], ["*"], ["foo/x"], ["src/*", "*.md"], ["[!x]*"], ["FOO/?"],
]


def test_selection_equals_the_walk(spark):
    """Looking at every directory above every file gives the same answer as the shortcuts."""
    dirs = ["", "foo/", "a/foo/", "foo/bar/", "dir/", "src/x/", "xy/", "a/b/c/", "build/q/"]
    paths = [d + n for d in dirs for n in ("x", "B.java", "r.md")]
    df = sized(spark, *paths)
    for globs in WALK_CASES:
        config = PackConfig(include=["**/*"], exclude=globs)
        regex = glob_regex(exclude_globs(config))
        rows = spark.createDataFrame(
            [(p, t, d) for p in paths for d, t in [(None, p), *((p[:i], p[:i] + "/x") for i, c in enumerate(p) if c == "/")]],
            "path string, tested string, dir string",
        )
        hits = rows.where(F.col("tested").rlike(regex)).collect()
        pruned = {}
        for r in hits:
            if r.dir is not None:
                pruned[r.path] = min(pruned.get(r.path, r.dir), r.dir, key=len)
        excluded = {r.path for r in hits if r.dir is None}
        got = {r.path: (r.decision, r.pruned_dir) for r in with_decisions(df, config).collect()}
        assert got == {
            p: ("skip_dir", pruned[p]) if p in pruned else ("exclude" if p in excluded else "include", None)
            for p in paths
        }, globs
        kept = {r.path for r in selected_files(df, config).collect()}
        assert kept == {p for p, (decision, _) in got.items() if decision == "include"}, globs


def test_counts(spark):
    df = sized(spark, "A.java", "A.md", "build/A.java", "build/x/B.java", "out/C.java")
    row = decision_counts(with_decisions(df, PackConfig(include=["*.java"]))).first()
    assert (row.included, row.excluded_walk, row.excluded_flat) == (1, 3, 4)


def test_ignore_lines(spark, files):
    text = "# c\n\n  **/*.bak  \r\n\t# x\n *.log \r!keep\n"
    got = ignore_patterns(files({".packignore": text, "sub/.packignore": "no\n"}), ".packignore")
    assert [(r.line_no, r.pattern) for r in got.orderBy("line_no").collect()] == [(2, "**/*.bak"), (4, "*.log"), (5, "!keep")]


def test_empty_ignore_file_has_no_patterns(spark, files):
    assert ignore_patterns(files({".packignore": ""}), ".packignore").count() == 0


def test_ignore_rules_apply_to_their_own_repository(spark, files):
    df = files({"one": {".packignore": "*.log\nsub/**\n", "a.log": "", "sub/b.md": "", "c.md": ""}, "two": {"a.log": ""}})
    kept = without_ignored(df.select("repo", "path"), ignore_regexes(df, ".packignore"))
    assert sorted(map(tuple, kept.collect())) == [("one", ".packignore"), ("one", "c.md"), ("two", "a.log")]


def test_ignored_files_are_not_packed(spark, files):
    df = files({".packignore": "**/*.bak\n**/*.log\ngen/*\n", "src/App.java": "class App {}", "src/App.java.bak": "old",
                "src/debug.log": "x", "gen/deep/X.java": "y"})
    run = pack_files(df, PackConfig(include=["**/*"]))
    assert sorted(r.path for r in run.meta.collect()) == [".packignore", "src/App.java"]
    assert sorted(r.path for r in run.selected().collect()) == [".packignore", "src/App.java"]
    decisions = {r.path: (r.decision, r.pruned_dir) for r in run.decisions.collect()}
    assert decisions["gen/deep/X.java"] == ("skip_dir", "gen")


def test_exclude_sources_keep_order_and_duplicates(spark, files):
    config = PackConfig(include=["*"], exclude=["**/test/**", "build/**"])
    assert exclude_globs(config)[-2:] == ("**/test/**", "build/**")
    df = files({".packignore": "build/**\n"})
    rows = exclude_sources(config, df, ignore_patterns(df, ".packignore")).where("pattern = 'build/**'")
    assert sorted(r.source for r in rows.collect()) == ["config", "default", "ignore_file"]


def test_invalid_text_is_dropped(spark):
    rows = [("r", "a.md", bytearray(b"ok"), 2), ("r", "b.md", bytearray(b"\xff\xfe"), 2), ("r", "c.md", bytearray(b"\xed\xa0\x80"), 3), ("r", "d.md", None, 4)]
    df = spark.createDataFrame(rows, "repo string, path string, raw binary, size_bytes bigint")
    run = pack_files(df, PackConfig(include=["**/*"]))
    assert {r.path: r.decision for r in run.decisions.collect()} == {
        "a.md": "include", "b.md": "skip_unreadable", "c.md": "skip_unreadable", "d.md": "skip_unreadable"}
    assert [r.path for r in run.meta.collect()] == ["a.md"]


def test_size_limit_reaches_the_scan(spark, tmp_path, files):
    files({"a.java": "x"}).write.parquet(str(tmp_path / "t"))
    run = pack_files(spark.read.parquet(str(tmp_path / "t")), PackConfig(include=["*.java"], ignore_name=None))
    plan = run.candidates._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(size_bytes,512000)" in plan
    listing = run.dry_run()._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listing.split("ReadSchema")[1]


@pytest.mark.parametrize("bad", [{"include": []}, {"include": ["*"], "mode": "zip"}, {"include": ["*"], "mode": "split", "output_name": "x.md"}])
def test_configuration_is_checked(bad):
    with pytest.raises(ValueError):
        PackConfig(**bad)
