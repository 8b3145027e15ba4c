"""Tables of files derived from the ``documents`` and ``pages`` tables.

Each view is written twice, for Spark and for DuckDB, so that a query and its check
start from the same rows. Paths cover default-excluded, hidden, test and root
directories, colliding document names (``a.b/`` and ``a/b/``), colliding anchors
(``Doc-1`` and ``doc_1``), an upper-case and an unknown extension.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from corpuspack.config import PackConfig

CONFIG = PackConfig(
    include=("**/*.java", "*.{js,c}", "*.KT", "**/*.md"),
    exclude=("**/test/**",),
    max_file_kb=8,
    chunk_tokens=3_000,
    max_tokens=5_000,
    strip_comments=True,
    ignore_name=None,
    generated_at="2026-01-01 00:00:00 UTC",
)

#: Nothing in the whole views is left out: every text is packed, whatever its extension and size.
WHOLE = replace(CONFIG, include=("**/*",), exclude=("**/none/**",), max_file_kb=500)

_DIRS = (
    "'src/main/','src/test/','docs/','build/','','src/main/util/','.github/workflows/',"
    "'node_modules/pkg/','a.b/','a/b/'"
)
_EXTENSIONS = "'java','py','md','js','c','txt','xyz','yml','KT'"
_NAMES = "'Dockerfile','Makefile','.env','.gitignore','a.b.TS','java','notes.txt','x.unknown','noext','pkg/x.GQL'"

# {list(items, index)} and the operators differ between the dialects; the rest is shared.
_SPARK = {
    "pick": lambda items, index: f"element_at(array({items}), cast({index} as int))",
    "div": "div",
    "newline": "\\n",
    "quote": "'",
    "bytes": "octet_length",
}
_DUCK = {
    "pick": lambda items, index: f"([{items}])[cast({index} as int)]",
    "div": "//",
    "newline": "\\n",
    "quote": "E'",
    "bytes": "strlen",
}


def _views(d: dict) -> dict[str, str]:
    pick, div, n, q, size = d["pick"], d["div"], d["newline"], d["quote"], d["bytes"]
    number = "cast(substr(source, 4) as int)"
    path = (
        f"concat({pick(_DIRS, f'doc_id {div} 40 % 10 + 1')}, "
        f"case when doc_id {div} 20 % 2 = 0 then 'Doc-' else 'doc_' end, "
        f"cast(doc_id {div} 40 as varchar(20)), '.', {pick(_EXTENSIONS, f'doc_id {div} 40 % 9 + 1')})"
    )
    content = (
        f"concat({q}/* license */{n}', replace(text, '. ', {q}; // note{n}'), "
        f"{q}{n}{n}{n}{n}String s = \"http://x/*y*/\"; // url{n}')"
    )
    team = f"concat(source, '-', cast(doc_id {div} 200 as varchar(20)))"
    rules = (
        f"case {number} % 3 when 0 then {q}# rules{n}{n}**/*.md{n} docs/** {n}' "
        f"when 1 then {q}  {n}*.xyz{n}src/main/*{n}' else '' end"
    )
    ref = pick(
        "concat('https://github.com/', owner, '/', name), concat('http://github.com/', owner, '/', name), "
        "concat('GitHub.com/', owner, '/', name), concat('https://github.com/', owner, '/', name, '.git'), "
        "concat('https://github.com/', owner, '/', name, '/'), concat(owner, '/', name), "
        "concat('/home/', name), concat('./', name), name, 'src/main', null, "
        "concat('  ', owner, '/', name, ' '), url, concat('https://github.com/', owner, '/', name, '/tree/main')",
        "page_id % 14 + 1",
    )
    whole = "replace(replace(path, 'build/', 'built/'), 'node_modules/', 'modules/')"
    branch = pick("null, 'main', 'feature/x'", f"page_id {div} 14 % 3 + 1")
    return {
        "v_docs": f"select doc_id, source, {number} as n, {path} as path, {content} as content from documents",
        "v_files": (
            f"select source as repo, path, content, cast({size}(content) as bigint) as size_bytes from v_docs"
        ),
        # The same without directories that are excluded by default.
        "v_whole": (
            f"select repo, {whole} as path, content, size_bytes from v_files"
        ),
        # Three quarters of all rows in one repository.
        "v_mono": (
            "select case when doc_id % 4 = 0 then source else 'mono' end as repo, "
            "case when doc_id % 4 = 0 then path else concat(source, '/', path) end as path, "
            f"content, cast({size}(content) as bigint) as size_bytes from v_docs"
        ),
        # Many small repositories, each with an ignore file.
        "v_teams": (
            f"select {team} as repo, path, content, cast({size}(content) as bigint) as size_bytes from v_docs "
            f"union all select repo, '.packignore', content, cast({size}(content) as bigint) from "
            f"(select distinct {team} as repo, {rules} as content from documents)"
        ),
        "v_teams_whole": f"select repo, {whole} as path, content, size_bytes from v_teams",
        # Repositories that were asked for, some of them without a file.
        "v_asked": (
            "select distinct repo from v_teams union all "
            "select distinct concat('absent-', cast(n % 3 as varchar(20))) from v_docs"
        ),
        "v_names": (
            f"select doc_id, {pick(_NAMES, 'doc_id % 10 + 1')} as name from documents "
            "union all select doc_id, path from v_docs"
        ),
        "v_refs": (
            f"select page_id, {ref} as ref, {branch} as branch from "
            "(select page_id, url, concat('org', cast(page_id % 7 as varchar(20))) as owner, "
            "concat('proj-', cast(page_id as varchar(20))) as name from pages)"
        ),
        "v_blob_files": (
            "select doc_id, concat('org', cast(n % 3 as varchar(20)), '/', source) as repo, "
            "concat('org', cast(n % 3 as varchar(20)), '/', source, case when n % 2 = 0 then '@main' else '' end) "
            "as label, n, path, content, md5(content) as sha, "
            f"cast({size}(content) as bigint) as size_bytes from v_docs"
        ),
        "v_blob_files_whole": (
            f"select doc_id, repo, label, n, {whole} as path, content, sha, size_bytes from v_blob_files"
        ),
        "v_all_blobs": "select distinct repo, sha, content from v_blob_files",
        "v_blobs": "select distinct repo, sha, content from v_blob_files where substr(sha, 1, 1) <> '0'",
    }


SPARK_VIEWS = _views(_SPARK)
DUCK_VIEWS = _views(_DUCK)

# Spark only: listings of at most 1000 entries each, as a remote host pages them. Some carry
# a truncation flag, some none; directories have no size.
_LISTINGS = """
select repo, label, to_json(named_struct(
         'truncated', case when n % 5 = 0 then page = 0 when n % 5 = 1 then null else false end,
         'tree', concat(collect_list(named_struct('path', path, 'type', 'blob', 'size', size_bytes, 'sha', sha)),
                        transform(collect_set(regexp_extract(path, '^(.*)/[^/]*$', 1)),
                                  d -> named_struct('path', d, 'type', 'tree', 'size', cast(null as bigint),
                                                    'sha', md5(d)))))) as tree_json
from (select *, doc_id div 1000 as page from v_blob_files)
group by repo, label, n, page
"""

_RAW = """
select source as repo, path,
       case when doc_id % 50 = 0 then concat(cast(content as binary), X'FF') else cast(content as binary) end as raw,
       cast(octet_length(content) as bigint) + if(doc_id % 50 = 0, 1, 0) as size_bytes
from v_docs
"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the parquet tables in ``sf_dir``."""
    listings = {"v_listings": _LISTINGS, "v_listings_whole": _LISTINGS.replace("v_blob_files", "v_blob_files_whole")}
    wanted, steps = {**listings, "v_raw": _RAW}.get(name, f"select * from {name}"), []
    for other, sql in reversed(SPARK_VIEWS.items()):
        if any(re.search(rf"\b{other}\b", text) for text in [wanted, *(s for _, s in steps)]):
            steps.insert(0, (other, sql))
    for table in ("documents", "pages"):
        if any(re.search(rf"\b{table}\b", text) for text in [wanted, *(s for _, s in steps)]):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    common = ", ".join(f"{other} as ({sql})" for other, sql in steps)
    return spark.sql(f"with {common} {wanted}" if steps else wanted)
