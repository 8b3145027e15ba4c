"""Whole runs against a small model that renders documents file by file."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuspack import PackConfig, pack_files, pack_listing
from corpuspack.operators.tree import tree_bytes, tree_families, tree_lines
from corpuspack.plans import render, sink
from corpuspack.schema import FRAGMENT_ORDER

STAMP = "2026-02-03 04:05:06 UTC"


def model_tree(paths, root):
    top = {}
    for path in paths:
        node = top
        *dirs, name = path.split("/")
        for d in dirs:
            node = node.setdefault(d, {})
        node[name] = None

    def draw(node, prefix):
        children = sorted(node.items(), key=lambda kv: (kv[1] is None, kv[0]))
        for i, (name, below) in enumerate(children):
            last = i == len(children) - 1
            yield prefix + ("└── " if last else "├── ") + name + ("/" if below is not None else "") + "\n"
            if below is not None:
                yield from draw(below, prefix + ("    " if last else "│   "))

    return f"```\n{root}/\n" + "".join(draw(top, "")) + "```\n"


def model_document(config, repo, files, context, root, language):
    """``files``: sorted (path, content, size)."""
    anchors, seen = {}, {}
    for path, _, _ in files:
        slug = re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", path.lower()))
        seen[slug] = seen.get(slug, 0) + 1
        anchors[path] = slug if seen[slug] == 1 else f"{slug}-{seen[slug]}"
    out = [f"# Repository Context: `{repo}`" + (f" — `{context}`" if context else "") + "\n\n"]
    out.append(f"> **Generated by corpuspack** · {STAMP}\n>\n> | Property | Value |\n> |---|---|\n> | Repo path | `{repo}` |\n")
    if context is not None:
        out.append(f"> | Directory | `{context}` |\n")
    out.append("> | Include patterns | `" + "`, `".join(config.include) + "` |\n")
    if config.exclude:
        out.append("> | Exclude patterns | `" + "`, `".join(config.exclude) + "` |\n")
    out.append(f"> | Files included | {len(files)} |\n> | Comment stripping | disabled |\n\n---\n\n")
    if config.toc:
        out.append("## Table of Contents\n\n" + "".join(f"- [`{p}`](#{anchors[p]})\n" for p, _, _ in files) + "\n---\n\n")
    if config.tree:
        out.append("## Repository Structure\n\n" + model_tree([p for p, _, _ in files], root) + "\n---\n\n")
    out.append("## Source Files\n\n")
    for path, content, size in files:
        tag = language(path)
        out.append(f'### <a id="{anchors[path]}"></a>`{path}`\n\n> **Language:** {tag or "text"} · **Size:** {int(size * 10 / 1024 + 0.5) / 10:.1f} KB\n\n')
        out.append(f"```{tag}\n" + content + ("" if content.endswith("\n") else "\n") + "```\n\n---\n\n")
    total = sum(size for _, _, size in files)
    out.append(f"<!-- corpuspack: {len(files)} files, {int(total * 10 / 1024 + 0.5) / 10:.1f} KB total -->\n")
    return "".join(out)


def tag(path):
    return {"java": "java", "md": "markdown", "txt": ""}.get(path.rsplit(".", 1)[-1], "text")


def assembled(fragments):
    text = {}
    for r in fragments.orderBy(*FRAGMENT_ORDER).collect():
        text[r.repo, r.output] = text.get((r.repo, r.output), "") + r.fragment
    return text


def random_repo(rng, n):
    names = ["a", "b", "A", "a.b", "x-y", "Z z", "ü", "long_name"]
    paths = set()
    for _ in range(n):
        dirs = [rng.choice(names) for _ in range(rng.randint(0, 4))]
        paths.add("/".join([*(d + ".d" for d in dirs), rng.choice(names) + rng.choice([".java", ".md", ".txt", ".q"])]))
    return {p: rng.choice(["", "x", "line\n", "é\n", "text " * rng.randint(1, 400)]) for p in paths}


def check_sizes(run, documents):
    sizes = {(r.repo, r.output): (r.size_bytes, r.tokens) for r in run.outputs().collect()}
    assert sizes == {
        key: (len(text.encode()), int(len(text.encode()) / 3.7 + 0.5)) for key, text in documents.items()
    }


def test_single_documents(files):
    rng = random.Random(2)
    tree = {f"repo{i}": random_repo(rng, 40) for i in range(4)}
    config = PackConfig(include=["**/*"], generated_at=STAMP)
    run = pack_files(files(tree), config)
    documents = assembled(run.fragments())
    for repo, paths in tree.items():
        rows = [(p, paths[p], len(paths[p].encode())) for p in sorted(paths)]
        assert documents[repo, f"{repo}-context.md"] == model_document(config, repo, rows, None, repo, tag)
    check_sizes(run, documents)


def test_split_documents(files):
    paths = random_repo(random.Random(4), 50)
    config = PackConfig(include=["**/*"], exclude=["nothing"], mode="split", generated_at=STAMP)
    run = pack_files(files({"repo": paths}), config)
    documents = assembled(run.fragments())
    groups = {}
    for p in sorted(paths):
        groups.setdefault(p.rpartition("/")[0], []).append((p, paths[p], len(paths[p].encode())))
    expected = {}
    for d, rows in groups.items():
        name = d.replace("/", ".") + ".md" if d else "_root.md"
        root = d.rpartition("/")[2] if d else "repo"
        expected["repo", name] = model_document(config, "repo", rows, d, root, tag)
    assert documents == expected
    check_sizes(run, documents)


def test_chunk_documents(files):
    paths = random_repo(random.Random(6), 60)
    config = PackConfig(include=["**/*"], mode="chunk", chunk_tokens=1500, toc=False, generated_at=STAMP)
    run = pack_files(files({"repo": paths}), config)
    documents = {(r.repo, r.output): r.document for r in run.documents().collect()}
    groups, running = [], None
    for p in sorted(paths):
        cost = int((68 + 2 * len(p) + len(paths[p])) / 3.7 + 0.5)
        if running is None or running + cost > 1500:
            groups.append([])
            running = 1000
        groups[-1].append((p, paths[p], len(paths[p].encode())))
        running += cost
    expected = {
        ("repo", f"repo-context-{i}.md"): model_document(config, "repo", g, f"Part {i} of {len(groups)}", "repo", tag)
        for i, g in enumerate(groups, 1)
    }
    assert documents == expected == assembled(run.fragments())
    check_sizes(run, documents)
    assert sum(r.n_files for r in run.outputs().collect()) == len(paths)


def test_sections_can_be_left_out(files):
    config = PackConfig(include=["**/*"], toc=False, tree=False, generated_at=STAMP)
    run = pack_files(files({"a.md": "x"}), config)
    assert assembled(run.fragments())["demo", "demo-context.md"] == model_document(
        config, "demo", [("a.md", "x", 1)], None, "demo", tag
    )
    check_sizes(run, assembled(run.fragments()))


def test_only_chunk_mode_gives_whole_documents(files):
    with pytest.raises(ValueError):
        pack_files(files({"a.md": "x"}), PackConfig(include=["*"])).documents()


def test_stripping_changes_text_but_not_size(files):
    config = PackConfig(include=["*.java"], strip_comments=True, generated_at=STAMP)
    run = pack_files(files({"A.java": "int a; // " + "n" * 2038 + "\n"}), config)
    document = assembled(run.fragments())["demo", "demo-context.md"]
    assert "int a; \n```" in document and "**Size:** 2.0 KB" in document and "stripping | enabled" in document


def test_fence_in_a_body_is_kept(files):
    run = pack_files(files({"a.md": "```\nx\n```"}), PackConfig(include=["*"], generated_at=STAMP))
    assert "```markdown\n```\nx\n```\n```\n" in assembled(run.fragments())["demo", "demo-context.md"]


def test_contents_and_body_agree_on_anchors(files):
    run = pack_files(files({"Doc-1.md": "", "doc_1.md": "", "DOC.1.md": ""}), PackConfig(include=["*"]))
    document = assembled(run.fragments())["demo", "demo-context.md"]
    listed = re.findall(r"\(#([^)]+)\)", document)
    assert listed == re.findall(r'<a id="([^"]+)">', document) == ["doc-1-md", "doc-1-md-2", "doc-1-md-3"]


def test_drawn_tree(spark):
    paths = ["README.md", "src/main/App.java", "src/main/util/Z.java", "src/test/T.java", "src/A.java", "docs/x.md", "a.b/c.d/e"]
    df = spark.createDataFrame([("r", "o", p) for p in paths], "repo string, output string, path string")
    families = tree_families(df)
    lines = [r.line for r in tree_lines(df, families).orderBy("sort_key").collect()]
    assert "```\nr/\n" + "".join(lines) + "```\n" == model_tree(paths, "r")
    assert tree_bytes(families).first()["bytes"] == len("".join(lines).encode())


def read_back(spark, folder):
    """Documents from the manifest's files, and with the helper."""
    rows = sink.read_manifest(spark, str(folder)).orderBy("repo", "output", "ordinal").collect()
    joined = {}
    for r in rows:
        data = (folder / r.file).read_bytes()
        assert len(data) == r.bytes
        joined[r.repo, r.output] = joined.get((r.repo, r.output), b"") + data
    names = {}
    for part in sorted(folder.glob("repo=*/output=*/part=*/*.txt")):
        names.setdefault(part.parts[-4:-2], []).append(part.parts[-2])
    assert all(len(set(parts)) == len(parts) for parts in names.values())  # one file a part
    key = next(iter(joined))
    assert b"".join(sink.stream_document(spark, str(folder), *key)) == joined[key]
    return {k: v.decode() for k, v in joined.items()}, rows


@pytest.mark.parametrize("mode", ["single", "split", "chunk"])
@pytest.mark.parametrize("block", [64 << 20, 700])
def test_written_documents(spark, files, tmp_path, monkeypatch, mode, block):
    """Byte by byte, in one block and in many."""
    monkeypatch.setattr(sink, "BLOCK_BYTES", block)
    rng = random.Random(8)
    tree = {f"team/repo{i} [x]": random_repo(rng, 30) for i in range(3)}
    run = pack_files(files(tree), PackConfig(include=["**/*"], generated_at=STAMP, mode=mode, chunk_tokens=1500))
    documents = assembled(run.fragments())
    run.write(str(tmp_path / "out"))
    written, rows = read_back(spark, tmp_path / "out")
    assert written == documents
    assert {(r.repo, r.output): r.size_bytes for r in run.outputs().collect()} == {k: len(t.encode()) for k, t in written.items()}
    assert (len({r.part for r in rows if r.part[0] == "1"}) > 5) == (block == 700)


def test_written_remote_documents(spark, remote, tmp_path):
    remote.write(str(tmp_path / "out"))
    assert read_back(spark, tmp_path / "out")[0] == assembled(remote.fragments())


def test_ignored_files_are_not_written(spark, files, tmp_path):
    run = pack_files(files({"a.md": "a", "b.md": "b", ".packignore": "b.md"}), PackConfig(include=["*.md"], generated_at=STAMP))
    run.write(str(tmp_path / "out"))
    assert read_back(spark, tmp_path / "out")[0] == assembled(run.fragments())


def test_nothing_to_write(spark, files, tmp_path):
    run = pack_files(files({"a.md": "a"}), PackConfig(include=["*.java"], generated_at=STAMP))
    run.write(str(tmp_path / "out"))
    assert sink.read_manifest(spark, str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("first", [0, 99_990])
def test_a_huge_document_is_written_in_several_parts(spark, tmp_path, monkeypatch, first):
    """Parts stay in order past any number of digits."""
    monkeypatch.setattr(sink, "FIRST_BLOCK", first)
    monkeypatch.setattr(sink, "BLOCK_BYTES", 4000)
    df = spark.range(1500).select(
        F.lit("r").alias("repo"),
        F.format_string("d%d/f%05d.md", F.col("id") % 7, "id").alias("path"),
        F.lit("text\n").alias("content"),
        F.lit(5).cast("bigint").alias("size_bytes"),
    )
    run = pack_files(df, PackConfig(include=["**/*"], generated_at=STAMP))
    expected = assembled(run.fragments())["r", "r-context.md"]
    run.write(str(tmp_path / "out"))
    written, rows = read_back(spark, tmp_path / "out")
    assert written == {("r", "r-context.md"): expected}
    numbers = [int(r.part[2:]) for r in rows if r.part[0] == "1"]
    assert numbers == sorted(numbers) and numbers[0] == first and len(numbers) > 20


def test_texts_move_once(spark, files, monkeypatch):
    """One exchange has the text in it, also where no side is small enough to broadcast."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = pack_files(files({"a.md": "x", "b/c.md": "y"}), PackConfig(include=["**/*"], ignore_name=None))
        rows = sink.section_rows(run.anchored, run.texts)
        plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = re.findall(r"\) (\w*Exchange)\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert sum("content#" in columns for _, columns in moved) == 1 and len(moved) > 1


# Reports


def test_warnings_and_status(files):
    big = "word " * 400
    df = files({"fine": {"a.md": "x"}, "long": {"a.md": big}, "none": {"a.q": "x"}})
    run = pack_files(df, PackConfig(include=["*.md"], max_tokens=400))
    assert {r.repo: (r.status, r.included, r.excluded, r.n_warnings, r.is_split) for r in run.summary().collect()} == {
        "fine": (0, 1, 0, 0, False),
        "long": (2, 1, 0, 1, False),
        "none": (1, 0, 1, 0, False),
    }
    warning = run.warnings().first()
    tokens = {r.repo: r.tokens for r in run.outputs().collect()}["long"]
    assert warning.warning.startswith(f"Estimated token count (~{tokens}) exceeds --max-tokens limit (400).")


def test_more_than_500_files_warn(spark):
    for n, expected in ((500, 0), (501, 1)):
        df = spark.range(n).select(
            F.lit("r").alias("repo"), F.format_string("f%d.md", "id").alias("path"),
            F.lit("x").alias("content"), F.lit(1).cast("bigint").alias("size_bytes"))
        rows = pack_files(df, PackConfig(include=["*"])).warnings().collect()
        assert [r.warning for r in rows] == [f"{n} files included — consider using --split for large repos."] * expected


def test_split_warnings(files):
    df = files({"a/x.md": "word " * 400, "b/x.md": "word " * 4000, "c/x.md": ""})
    run = pack_files(df, PackConfig(include=["**/*"], mode="split", max_tokens=1500))
    tokens = {r.output: r.tokens for r in run.outputs().collect()}
    rows = run.warnings().orderBy("ord").collect()
    assert [r.output for r in rows] == [None, "b.md"]
    assert rows[0].warning == f"Total estimated tokens (~{sum(tokens.values()):,} across 3 files) is very large."
    assert rows[1].warning.startswith(f"b.md: ~{tokens['b.md']:,} tokens exceeds --max-tokens (1,500).")


def test_chunk_mode_notes_but_never_warns(files):
    df = files({"a.md": "word " * 2000, "b.md": "x"})
    run = pack_files(df, PackConfig(include=["*"], mode="chunk", chunk_tokens=1200, max_tokens=10))
    assert run.warnings().count() == 0
    assert [r.path for r in run.notes().collect()] == ["a.md"]
    assert [(r.status, r.is_split) for r in run.summary().collect()] == [(0, True)]


def test_dry_run(files):
    run = pack_files(files({"a.md": "x" * 1536, "b.q": "y"}), PackConfig(include=["*.md"], max_tokens=100))
    assert run.dry_run().collect()[0].asDict() == {
        "repo": "demo", "n_files": 1, "total_bytes": 1536, "total_kb": "1.5", "tokens": 415, "over_budget": True}
    assert [tuple(r) for r in run.dry_run_listing().collect()] == [("demo", "a.md", "markdown", "1.5")]


# Remote listings


LISTING = (
    '{"sha": "top", "truncated": true, "tree": ['
    '{"path": "src", "type": "tree", "sha": "t"}, '
    '{"path": "src/A.java", "type": "blob", "size": 9, "sha": "1", "mode": "100644"}, '
    '{"path": "src/B.java", "type": "blob", "size": 9, "sha": "2"}, '
    '{"path": "foo/bar/C.java", "type": "blob", "sha": "1"}, '
    '{"path": "foo/D.java", "type": "blob", "size": 9, "sha": "1"}, '
    '{"path": "Big.java", "type": "blob", "size": 600000, "sha": "1"}, '
    '{"path": "x.md", "type": "blob", "size": 1, "sha": "1"}]}'
)


@pytest.fixture
def remote(spark):
    listings = spark.createDataFrame([("own/proj", "own/proj@dev", LISTING), ("own/none", "own/none", '{"tree": []}')],
                                     "repo string, label string, tree_json string")
    blobs = spark.createDataFrame([("own/proj", "1", "class A{}"), ("own/other", "2", "no")], "repo string, sha string, content string")
    config = PackConfig(include=["*.java"], exclude=["foo/*"], mode="remote", generated_at=STAMP)
    return pack_listing(listings, blobs, config)


def test_remote_decisions_are_flat(remote):
    assert {r.path: r.decision for r in remote.decisions.collect()} == {
        "src/A.java": "include", "src/B.java": "skip_unreadable", "foo/bar/C.java": "include",
        "foo/D.java": "exclude", "Big.java": "skip_size", "x.md": "exclude"}


def test_remote_document(remote):
    (key, document), = assembled(remote.fragments()).items()
    rows = [("foo/bar/C.java", "class A{}", 0), ("src/A.java", "class A{}", 9)]
    expected = model_document(remote.config, "proj", rows, "own/proj@dev", "proj", tag)
    assert key == ("own/proj", "proj-context.md") and document == expected
    assert [r.label for r in remote.outputs().collect()] == ["own/proj@dev"]
    check_sizes(remote, {key: document})


def test_remote_notes_and_summary(remote):
    assert [(r.repo, r.ord) for r in remote.notes().collect()] == [("own/proj", 0)]
    rows = remote.summary().orderBy("repo").collect()
    assert [(r.repo, r.included, r.excluded, r.status) for r in rows] == [("own/none", 0, 0, 1), ("own/proj", 2, 4, 0)]


def test_modes_match_their_entry_points(files, spark):
    with pytest.raises(ValueError):
        pack_files(files({"a": "x"}), PackConfig(include=["*"], mode="remote"))
    empty = spark.createDataFrame([], "repo string, label string, tree_json string")
    with pytest.raises(ValueError):
        pack_listing(empty, empty, PackConfig(include=["*"]))


def test_header_and_footer_are_single_columns(files):
    run = pack_files(files({"a.md": "x"}), PackConfig(include=["*"], generated_at=STAMP))
    row = run.layout.documents.select(render.header_text(run.config), render.footer_text(run.config)).first()
    assert row[0].endswith("\n---\n\n") and row[1] == "<!-- corpuspack: 1 files, 0.0 KB total -->\n"
