import random

import pytest
from pyspark.sql import functions as F

from corpuspack.functions import text, tokens
from corpuspack.functions.comments import STRIPPABLE, strip_comments
from corpuspack.functions.language import LANGUAGE_BY_NAME, language_tag


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_language_tags(spark):
    names = {
        "App.java": "java",
        "Build.KTS": "kotlin",
        "src/x/index.mjs": "javascript",
        "Dockerfile": "dockerfile",
        "sub/Makefile": "makefile",
        ".env": "dotenv",
        ".gitignore": "text",
        "a.b.TS": "typescript",
        "java": "java",
        "notes.txt": "",
        "x.unknown": "text",
        "noext": "text",
        "dir.py/noext": "text",
        "trailing.": "text",
        "build.gradle": "groovy",
        "main.tf": "hcl",
    }
    assert column(spark, list(names), language_tag) == list(names.values())


def test_language_table_size():
    assert len(LANGUAGE_BY_NAME) == 69
    assert set(STRIPPABLE) <= set(LANGUAGE_BY_NAME.values())


def scan(source):
    """Character-by-character model of comment stripping."""
    out, i = [], 0
    while i < len(source):
        c, pair = source[i], source[i : i + 2]
        if c in "\"'":
            end = i + 1
            while end < len(source) and source[end] != c:
                end += 2 if source[end] == "\\" else 1
            out.append(source[i : end + 1])
            i = end + 1
        elif pair == "//":
            end = source.find("\n", i)
            i = len(source) if end < 0 else end
        elif pair == "/*":
            end = source.find("*/", i + 2)
            i = end + 2 if end >= 0 else max(i + 2, len(source) - 1)
        else:
            out.append(c)
            i += 1
    collapsed = "".join(out)
    while "\n\n\n" in collapsed:
        collapsed = collapsed.replace("\n\n\n", "\n\n")
    return collapsed


def test_strip_equals_scanner_on_random_texts(spark):
    rng = random.Random(7)
    samples = ["".join(rng.choices("\"'\\/*\nab ", k=rng.randint(0, 40))) for _ in range(8000)]
    stripped = column(spark, samples, lambda c: strip_comments(c, F.lit("java")))
    for source, result in zip(samples, stripped):
        assert result == scan(source), repr(source)


@pytest.mark.parametrize(
    "source, expected",
    [
        ("int x = 1; // note\nint y;\n", "int x = 1; \nint y;\n"),
        ("/* block */\nclass A {}\n", "\nclass A {}\n"),
        ('String s = "http://e.org"; // url\n', 'String s = "http://e.org"; \n'),
        ("/**\n * Doc\n */\nvoid f() {}\n", "\nvoid f() {}\n"),
        ("a /* never closed", "a d"),
        ("a /*", "a "),
        ("a /* \N{GRINNING FACE}", "a \N{GRINNING FACE}"),
        ("'//' x // y", "'//' x "),
        ('"open // to the end\n', '"open // to the end\n'),
        ("a\n\n\n\n\nb", "a\n\nb"),
        ("a\r\n\r\n\r\nb // c\r\n", "a\r\n\r\n\r\nb \n"),
    ],
)
def test_strip_cases(spark, source, expected):
    assert column(spark, [source], lambda c: strip_comments(c, F.lit("c"))) == [expected]


def test_other_languages_are_left_alone(spark):
    source = "# x\n\n\n\n// y /* z */\n"
    for language in ("python", "yaml", "", "text"):
        assert column(spark, [source], lambda c: strip_comments(c, F.lit(language))) == [source]


def test_long_literals_and_comments_do_not_overflow(spark):
    samples = ['"' + "\\a" * 200_000 + '"', "/*" + "x" * 3_000_000 + "*/end"]
    stripped = column(spark, samples, lambda c: strip_comments(c, F.lit("java")))
    assert stripped == [samples[0], "end"]


def test_token_estimates(spark):
    texts = [None, "", "a", "abc", "x" * 100, "a\N{GRINNING FACE}", "é" * 37]
    assert column(spark, texts, tokens.tokens_from_text) == [0, 0, 0, 1, 27, 1, 10]
    assert column(spark, [0, 1, 2, 37, 10**12], tokens.tokens_from_count, "bigint") == [0, 0, 1, 10, 270270270270]


def test_utf16_length(spark):
    assert column(spark, ["abc", "a\N{GRINNING FACE}", "éé", ""], tokens.utf16_length) == [3, 3, 2, 0]


def test_rendered_tokens(spark):
    row = spark.range(1).select(tokens.rendered_tokens(F.lit(10), F.lit(100))).first()
    assert row[0] == int((68 + 20 + 100) / 3.7 + 0.5)


def test_anchor_slugs(spark):
    cases = {
        "src/main/App.java": "src-main-app-java",
        "A__b--C.md": "a-b-c-md",
        ".env": "env",
        "dir/": "dir",
        "été.md": "t-md",
        "...": "",
    }
    assert column(spark, list(cases), text.anchor_slug) == list(cases.values())


def test_path_keys_and_names(spark):
    assert column(spark, ["a/b/c.md", "c.md", "a/c"], text.parent_dir) == ["a/b", "", "a"]
    assert column(spark, ["", "a", "a/b.c"], text.split_name) == ["_root.md", "a.md", "a.b.c.md"]
    assert column(spark, ["", "a", "a/b"], lambda d: text.leaf_label(d, F.lit("home/repo"))) == ["repo", "a", "b"]
    assert column(spark, ["r-context.md", "plain"], lambda d: text.chunk_name(d, F.lit(3))) == [
        "r-context-3.md",
        "plain-3.md",
    ]


def test_display_forms(spark):
    assert column(spark, [0, 256, 1024, 1536, 52], text.kilobytes, "bigint") == ["0.0", "0.3", "1.0", "1.5", "0.1"]
    assert column(spark, [12, 1234567], text.grouped_digits, "bigint") == ["12", "1,234,567"]
