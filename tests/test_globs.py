import pytest
from pyspark.sql import functions as F

from corpuspack.functions.globs import (
    DEFAULT_EXCLUDES,
    glob_regex,
    matches_globs,
    matches_regex_column,
    walk_globs,
)

CASES = [
    # globs, path, matches
    (["**/*.java"], "src/main/deep/down/App.java", True),
    (["**/*.java"], "src/App.java", True),
    (["**/*.java"], "App.java", True),
    (["**/*.java"], "src/App.java.bak", False),
    (["**/*.java"], "src/App.kt", False),
    (["*.java"], "src/main/App.java", True),
    (["*.java"], "App.JAVA", True),
    (["src/**/*.java"], "src/App.java", True),
    (["src/**/*.java"], "src/a/b/App.java", True),
    (["src/**/*.java"], "lib/src/a/App.java", True),
    (["src/**/*.java"], "other/App.java", False),
    (["**/*.java", "*.gradle", "**/*.yml"], ".github/workflows/ci.yml", True),
    (["**/*.java", "*.gradle", "**/*.yml"], "README.md", False),
    (["foo/**"], "foo/Bar.java", True),
    (["foo/**"], "x/foo/bar/Baz.java", True),
    (["foo/**"], "foobar/A.java", False),
    (["foo/**"], "barfoo/A.java", False),
    (["a?c.txt"], "abc.txt", True),
    (["a?c.txt"], "a/c.txt", False),
    (["src\\*.java"], "src/A.java", True),
    (["**foo"], "x/y/afoo", True),
    (["***.md"], "x/y.md", True),
    (["a+b(1).txt"], "d/a+b(1).txt", True),
    (["a.b"], "axb", False),
    ([], "anything", False),
    # brackets and braces
    (["*.{java,kt}"], "src/A.kt", True),
    (["*.{java,kt}"], "A.kt", True),
    (["*.{java,kt}"], "A.KT", False),
    (["**/*.{java,kt}"], "src/A.kt", True),
    (["**/*.{java,kt}"], "A.kt", False),
    (["src/*.{java,kt}"], "src/A.java", True),
    (["[A-C]*.java"], "x/Beta.java", True),
    (["[A-C]*.java"], "x/beta.java", False),
    (["[!A-C]*.java"], "x/Delta.java", True),
    (["[!A-C]*.java"], "x/Alpha.java", False),
    (["[-a]*.md"], "-x.md", True),
    (["[a^]x"], "^x", True),
    (["a[b"], "a[b", True),
    (["a[b"], "ab", False),
    (["{a,{b,c}}.md"], "a.md", False),
    (["{a,{b,c}}.md"], "{a,{b,c}}.md", True),
    (["a}.md"], "a}.md", True),
    (["[c-a]x"], "bx", False),
    (["{*.md,doc}/x"], "q/y.md/x", True),
    (["a[/]b"], "a/b", False),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    """All cases in one query: each path against its own globs."""
    rows = [(i, path, glob_regex(patterns)) for i, (patterns, path, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, path string, regex string")
    return {r.i: r.hit for r in df.select("i", matches_regex_column(F.col("path"), F.col("regex")).alias("hit")).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_glob(verdicts, case):
    assert verdicts[case] == CASES[case][2], CASES[case]


def test_literal_form_agrees_with_column_form(spark, verdicts):
    for i in (0, 8, 25, 28, 32):
        patterns, path, expected = CASES[i]
        row = spark.createDataFrame([(path,)], "path string").select(matches_globs(F.col("path"), patterns)).first()
        assert row[0] == expected == verdicts[i]


def test_null_expression_matches_nothing(spark):
    df = spark.createDataFrame([("a", None)], "path string, regex string")
    assert df.select(matches_regex_column(F.col("path"), F.col("regex"))).first()[0] is False


@pytest.mark.parametrize(
    "path",
    ["build/x/A.java", ".git/config", "deep/.idea/w.xml", "a/node_modules/b/c.js", "out/A", "target/B", ".DS_Store", "x/Thumbs.db"],
)
def test_default_excludes(spark, path):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(matches_globs(F.col("path"), DEFAULT_EXCLUDES)).first()[0]


def test_default_excludes_leave_lookalikes(spark):
    df = spark.createDataFrame([("builds/A",), ("src/outer/B",), ("gitlike/C",)], "path string")
    assert df.where(matches_globs(F.col("path"), DEFAULT_EXCLUDES)).count() == 0


def test_globs_that_need_the_directories_above_a_file():
    assert walk_globs(["foo/**", "**", "*.log", "a/b.md", ""]) == []
    hiding = ["foo/*", "x", "?", "a/[x]", "{x,y}", "x**", "dir/X"]
    assert walk_globs([*DEFAULT_EXCLUDES, *hiding]) == hiding
