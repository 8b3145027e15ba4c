"""The same queries in DuckDB SQL, over the same fixture views."""

from __future__ import annotations

from corpuspack.plans.fixtures import DUCK_VIEWS

FIXTURE_INCLUDE = (
    r"(regexp_full_match(path, '(.+/)?[^/]*\.(java|kt|md)', 'i') "
    r"or regexp_full_match(path, '(.*/)?[^/]*\.(js|c)'))"
)
DEFAULT_EXCLUDE = (
    r"(.+/)?(\.git|\.gradle|\.idea|\.vscode|build|out|target|\.mvn|node_modules)/.*"
    r"|(.+/)?(\.DS_Store|Thumbs\.db)"
)
FIXTURE_EXCLUDE = DEFAULT_EXCLUDE + "|(.+/)?test/.*"
SECTIONS = "'```' || chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def _matches(path: str, regex: str) -> str:
    return f"regexp_full_match({path}, '{regex}', 'i')"


def _tokens(count: str) -> str:
    return f"cast(floor(({count}) / 3.7::double + 0.5) as bigint)"


def _kb(size: str) -> str:
    return f"printf('%.1f', floor(({size}) * 10 / 1024.0::double + 0.5) / 10)"


def _digits(number: str) -> str:
    return f"format('{{:,}}', {number})"


def _parent(path: str) -> str:
    return f"regexp_extract({path}, '^(.*)/[^/]*$', 1)"


def _leaf(dir_key: str, repo: str) -> str:
    return f"case when {dir_key} = '' then {repo} else string_split({dir_key}, '/')[-1] end"


SLUG = "regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
STRIPPED = (
    "case when language in ('java', 'javascript', 'c', 'kotlin') then regexp_replace(regexp_replace(content, "
    r"""'("[^"\\]*(?:\\[\s\S][^"\\]*)*(?:"|\\?\z)|''[^''\\]*(?:\\[\s\S][^''\\]*)*(?:''|\\?\z))"""
    r"|//[^\n]*|/\*[\s\S]*?\*/', '\1', 'g'), '\n{3,}', E'\n\n', 'g') else content end"
)
LANGUAGE = (
    r"case lower(regexp_extract(path, '\.([^./]*)$', 1)) when 'java' then 'java' when 'py' then 'python' "
    "when 'md' then 'markdown' when 'js' then 'javascript' when 'c' then 'c' when 'txt' then '' "
    "when 'yml' then 'yaml' when 'kt' then 'kotlin' else 'text' end"
)


def _with(*steps: tuple[str, str], final: str, views: str = "") -> str:
    """A query: fixture views, then named steps, then the final select."""
    parts = [f"{name} as ({sql})" for name, sql in [*DUCK_VIEWS.items(), *steps]]
    return f"with recursive {', '.join(parts)} {final}"


def _decided(
    source: str,
    include: str = FIXTURE_INCLUDE,
    exclude=lambda path: _matches(path, FIXTURE_EXCLUDE),
    max_kb: int = 8,
    prune: bool = True,
    readable: str = "true",
) -> list[tuple[str, str]]:
    above = (
        "list_transform(range(1, len(string_split(path, '/'))), "
        "lambda k: array_to_string(string_split(path, '/')[1:k], '/'))"
    )
    pruned = f"list_filter({above}, lambda d: {exclude(chr(100) + ' || ' + chr(39) + '/x' + chr(39))})[1]"
    return [
        ("pruned", f"select *, {pruned if prune else 'null::varchar'} as pruned_dir from {source}"),
        (
            "decided",
            "select *, case when pruned_dir is not null then 'skip_dir' "
            f"when not {include} or {exclude('path')} then 'exclude' "
            f"when size_bytes > {max_kb} * 1024 then 'skip_size' "
            f"when not ({readable}) then 'skip_unreadable' else 'include' end as decision from pruned",
        ),
    ]


def _meta(source: str, strip: bool = True, extra: str = "") -> list[tuple[str, str]]:
    text = STRIPPED if strip else "content"
    return [
        ("tagged", f"select *, {LANGUAGE} as language from {source}"),
        (
            "prepared",
            f"select repo, path, language, size_bytes, {text} as content {extra} from tagged",
        ),
        (
            "meta",
            "select *, content || case when content like E'%\\n' then '' else E'\\n' end as body, "
            f"{_tokens('68 + 2 * length(path) + length(content)')} as tokens from prepared",
        ),
    ]


def _chunks(budget: int, source: str = "meta") -> list[tuple[str, str]]:
    fresh = f"(f.running = 1000 or f.running + o.tokens > {budget})"
    return [
        (
            "ordered",
            f"select repo, path, tokens, row_number() over (partition by repo order by path) as rn from {source}",
        ),
        (
            "folded",
            f"select repo, path, tokens, rn, 1::bigint as chunk, "
            f"case when tokens > {budget} then 1000 else 1000 + tokens end::bigint as running "
            "from ordered where rn = 1 union all "
            f"select o.repo, o.path, o.tokens, o.rn, case when {fresh} then f.chunk + 1 else f.chunk end, "
            f"case when o.tokens > {budget} then 1000 when {fresh} then 1000 + o.tokens "
            "else f.running + o.tokens end from folded f join ordered o on o.repo = f.repo and o.rn = f.rn + 1",
        ),
    ]


SINGLE_PLACED = [
    (
        "placed",
        "select *, string_split(repo, '/')[-1] || '-context.md' as output from meta",
    )
]
SPLIT_PLACED = [
    ("dirs", f"select *, {_parent('path')} as dir_key from meta"),
    (
        "dir_names",
        "select repo, dir_key, stem || case when nth = 1 then '' else '-' || nth end || '.md' as output from "
        "(select repo, dir_key, stem, row_number() over (partition by repo, stem order by dir_key) as nth from "
        "(select distinct repo, dir_key, case when dir_key = '' then '_root' else replace(dir_key, '/', '.') end "
        "as stem from dirs))",
    ),
    ("placed", "select * from dirs join dir_names using (repo, dir_key)"),
]
CHUNK_PLACED = [
    (
        "placed",
        "select *, repo || '-context-' || chunk || '.md' as output from meta "
        "join (select repo, path, chunk from folded) using (repo, path)",
    )
]


def _anchored() -> list[tuple[str, str]]:
    return [
        (
            "anchored",
            "select *, slug || case when nth = 1 then '' else '-' || nth end as anchor from "
            "(select *, row_number() over (partition by repo, output, slug order by path) as nth from "
            f"(select *, {SLUG} as slug from placed))",
        )
    ]


def _documents(mode: str) -> list[tuple[str, str]]:
    by = {"single": "", "remote": "", "split": ", dir_key", "chunk": ", chunk"}[mode]
    label, context, root = {
        "single": ("output", "null::varchar", "repo"),
        "remote": ("label", "label", "string_split(repo, '/')[-1]"),
        "split": (_leaf("dir_key", "repo"), "dir_key", _leaf("dir_key", "repo")),
        "chunk": (
            "'Part ' || chunk || ' of ' || max(chunk) over (partition by repo)",
            "'Part ' || chunk || ' of ' || max(chunk) over (partition by repo)",
            "repo",
        ),
    }[mode]
    picked = ", max(label) as label" if mode == "remote" else ""
    return [
        (
            "documents_of",
            f"select repo, output{by}, count(*) as n_files, sum(size_bytes)::bigint as raw_bytes{picked} "
            f"from placed group by repo, output{by}",
        ),
        (
            "docs_of",
            f"select repo, output, n_files, raw_bytes, {label} as label, {context} as context, {root} as root "
            "from documents_of",
        ),
    ]


def _tree(source: str) -> list[tuple[str, str]]:
    key = (
        "array_to_string(list_transform(range(1, depth + 1), lambda k: "
        "case when k < depth or is_dir then '0' else '1' end || string_split(node_path, '/')[k] || chr(0)), '')"
    )
    return [
        ("tree_parts", f"select repo, output, string_split(path, '/') as p from {source}"),
        (
            "nodes",
            "select distinct repo, output, array_to_string(p[1:k], '/') as node_path, k as depth, p[k] as name, "
            "k < len(p) as is_dir, array_to_string(p[1:k - 1], '/') as parent "
            "from tree_parts, unnest(range(1, len(p) + 1)) as u(k)",
        ),
        (
            "ranked_nodes",
            "select *, row_number() over (partition by repo, output, parent "
            "order by case when is_dir then 0 else 1 end desc, name desc) = 1 as is_last from nodes",
        ),
        (
            "bars",
            "select n.repo, n.output, n.node_path, "
            "string_agg(case when a.is_last then '    ' else '│   ' end, '' order by a.depth) as prefix "
            "from ranked_nodes n join ranked_nodes a on a.repo = n.repo and a.output = n.output and a.is_dir "
            "and starts_with(n.node_path, a.node_path || '/') group by all",
        ),
        (
            "lines",
            f"select repo, output, node_path, {key} as sort_key, coalesce(prefix, '') || "
            "case when is_last then '└── ' else '├── ' end || name || case when is_dir then '/' else '' end "
            "|| chr(10) as line from ranked_nodes left join bars using (repo, output, node_path)",
        ),
    ]


def _header(stripping: str, excludes: bool = True, repo_path: str = "repo") -> str:
    excluded = "> | Exclude patterns | `**/none/**` |\\n" if excludes else ""
    return (
        "E'# Repository Context: `' || string_split(repo, '/')[-1] || case when coalesce(context, '') <> '' "
        "then '` — `' || context else '' end || E'`\\n\\n> **Generated by corpuspack** · "
        "2026-01-01 00:00:00 UTC\\n>\\n> | Property | Value |\\n> |---|---|\\n> | Repo path | `' || "
        f"{repo_path} || E'` |\\n' || coalesce('> | Directory | `' || context || E'` |\\n', '') || "
        "E'> | Include patterns | `**/*` |\\n"
        f"{excluded}> | Files included | ' || n_files || E' |\\n> | Comment stripping | {stripping} |\\n\\n---\\n\\n'"
    )


FOOTER = f"'<!-- corpuspack: ' || n_files || ' files, ' || {_kb('raw_bytes')} || E' KB total -->\\n'"
SECTION = (
    "'### <a id=\"' || anchor || '\"></a>`' || path || E'`\\n\\n> **Language:** ' || "
    "case when language = '' then 'text' else language end || ' · **Size:** ' || "
    f"{_kb('size_bytes')} || E' KB\\n\\n```' || language || E'\\n' || body || E'```\\n\\n---\\n\\n'"
)
TOC_LINE = "'- [`' || path || '`](#' || anchor || E')\\n'"


def _fragments(header: str, toc: bool = True, tree: bool = True) -> list[tuple[str, str]]:
    rows = [
        f"select repo, output, 0::bigint as section, 1::bigint as part, '' as sort_key, {header} as fragment from docs_of",
        "select repo, output, 3, 0, '', E'## Source Files\\n\\n' from docs_of",
        f"select repo, output, 3, 1, path, {SECTION} from anchored",
        f"select repo, output, 4, 1, '', {FOOTER} from docs_of",
    ]
    if toc:
        rows += [
            "select repo, output, 1, 0, '', E'## Table of Contents\\n\\n' from docs_of",
            f"select repo, output, 1, 1, path, {TOC_LINE} from anchored",
            "select repo, output, 1, 2, '', E'\\n---\\n\\n' from docs_of",
        ]
    steps = []
    if tree:
        steps = _tree("placed")
        rows += _tree_rows()
    return [*steps, ("fragments", " union all ".join(rows))]


def _tree_rows() -> list[str]:
    return [
        "select repo, output, 2::bigint as section, 0::bigint as part, '' as sort_key, "
        "E'## Repository Structure\\n\\n```\\n' || root || E'/\\n' as fragment from docs_of",
        "select repo, output, 2, 1, sort_key, line from lines",
        "select repo, output, 2, 2, '', E'```\\n\\n---\\n\\n' from docs_of",
    ]


OUTPUTS = (
    "outs",
    "select repo, output, label, n_files, size_bytes, "
    f"{_tokens('size_bytes')} as tokens from docs_of join "
    "(select repo, output, sum(strlen(fragment))::bigint as size_bytes from fragments group by all) "
    "using (repo, output)",
)

_SELECTED = ("chosen", "select * from decided where decision = 'include'")
_SINGLE = [*_meta("v_whole"), *SINGLE_PLACED]
_SPLIT = [*_meta("v_whole"), *SPLIT_PLACED]
_CHUNK = [*_meta("v_whole"), *_chunks(3000), *CHUNK_PLACED]
_ALL = "true"


def _default_exclude(path: str) -> str:
    return _matches(path, DEFAULT_EXCLUDE)


def _rules(path: str) -> str:
    """Default excludes and the rules written into each team's ignore file."""
    number = "cast(regexp_extract(repo, '[0-9]+') as int) % 3"
    return (
        f"({_default_exclude(path)} "
        rf"or ({number} = 0 and {_matches(path, '(.+/)?[^/]*' + chr(92) + '.md|(.+/)?docs/.*')}) "
        rf"or ({number} = 1 and {_matches(path, '(.+/)?[^/]*' + chr(92) + '.xyz|(.+/)?src/main/[^/]*')}))"
    )


_RAW = (
    "raw_files",
    "select source as repo, path, content, strlen(content) + case when doc_id % 50 = 0 then 1 else 0 end as size_bytes, "
    "doc_id % 50 <> 0 as readable from v_docs",
)
_RAW_DECIDED = [_RAW, *_decided("raw_files", readable="readable")]
_REMOTE_FILES = [
    (
        "remote_files",
        "select f.repo, f.label, f.path, f.size_bytes, f.sha, b.content from v_blob_files f "
        "left join v_blobs b on b.repo = f.repo and b.sha = f.sha",
    )
]
_REMOTE_DECIDED = [*_REMOTE_FILES, *_decided("remote_files", prune=False, readable="content is not null")]
_REMOTE = [
    *_meta("v_blob_files_whole", strip=False, extra=", label"),
    *SINGLE_PLACED,
    *_anchored(),
    *_documents("remote"),
    *_fragments(_header("disabled", repo_path="string_split(repo, '/')[-1]")),
    OUTPUTS,
]


def _everything(source: str, placed: list[tuple[str, str]], mode: str) -> list[tuple[str, str]]:
    header = _header("disabled", excludes=False)
    return [
        *_decided(source, _ALL, _default_exclude, 500),
        _SELECTED,
        *_meta("chosen", strip=False),
        *placed,
        *_anchored(),
        *_documents(mode),
        *_fragments(header),
        OUTPUTS,
    ]


_SPLIT_TOTALS = (
    "totals",
    "select repo, sum(tokens)::bigint as tokens, count(*) as documents from outs group by repo",
)


def _split_warnings(limit: int) -> tuple[str, str]:
    return (
        "warned",
        "select repo, null::varchar as output, 0::bigint as ord, 'Total estimated tokens (~' || "
        f"{_digits('tokens')} || ' across ' || documents || ' files) is very large.' as warning "
        f"from totals where tokens > {limit} * documents union all "
        f"select repo, output, 1, output || ': ~' || {_digits('tokens')} || "
        f"' tokens exceeds --max-tokens ({limit:,}). Consider narrowing patterns.' from outs where tokens > {limit}",
    )


_STATUS = [
    *_meta("v_teams_whole"),
    *SPLIT_PLACED,
    *_anchored(),
    *_documents("split"),
    *_fragments(_header("enabled")),
    OUTPUTS,
    _SPLIT_TOTALS,
    _split_warnings(1500),
    (
        "counted",
        "select repo, count(path) as included, 0::bigint as excluded "
        "from v_asked left join v_teams_whole using (repo) group by repo",
    ),
    (
        "summed",
        "select repo, count(*) as documents, sum(size_bytes)::bigint as size_bytes, sum(tokens)::bigint as tokens "
        "from outs group by repo",
    ),
    ("warn_counts", "select repo, count(*) as n_warnings from warned group by repo"),
    (
        "summary",
        "select repo, included, excluded, coalesce(documents, 0) as documents, "
        "coalesce(size_bytes, 0) as size_bytes, coalesce(tokens, 0) as tokens, "
        "coalesce(n_warnings, 0) as n_warnings, coalesce(documents, 0) > 1 as is_split, "
        "(case when included = 0 then 1 when coalesce(n_warnings, 0) > 0 then 2 else 0 end)::bigint as status "
        "from counted left join summed using (repo) left join warn_counts using (repo)",
    ),
]

_URL = r"(?i)(?:https?://)?github\.com/([^/]+)/([^/\.]+?)(?:\.git)?/?$"
_SHORT = r"^([a-zA-Z0-9][a-zA-Z0-9_.-]*)/([a-zA-Z0-9][a-zA-Z0-9_.-]+)$"
_PARSED = (
    "parsed",
    "select page_id, ref, branch, "
    f"coalesce(nullif(regexp_extract(trim(ref), '{_URL}', 1), ''), "
    f"nullif(regexp_extract(trim(ref), '{_SHORT}', 1), '')) as owner, "
    f"coalesce(nullif(regexp_extract(trim(ref), '{_URL}', 2), ''), "
    f"nullif(regexp_extract(trim(ref), '{_SHORT}', 2), '')) as name from v_refs",
)
_IGNORE_LINES = (
    "ignore_lines",
    r"select repo, i - 1 as line_no, regexp_replace(lines[i], '^\s+|\s+$', '', 'g') as pattern from "
    r"(select repo, regexp_split_to_array(content, '\r\n|\r|\n') as lines from v_teams where path = '.packignore'), "
    "unnest(range(1, len(lines) + 1)) as u(i)",
)
_PATTERNS = (
    "patterns",
    "select repo, line_no, pattern from ignore_lines where pattern <> '' and not starts_with(pattern, '#')",
)

ORACLE: dict[str, str] = {
    "scan_files": _with(final="select repo, path, size_bytes, md5(content) as digest from v_files"),
    "tree_listing_explode": _with(
        final="select repo, path, size_bytes, sha, n % 5 = 0 and doc_id // 1000 = 0 as truncated from v_blob_files"
    ),
    "tree_listing_truncated": _with(
        final="select repo, bool_or(n % 5 = 0 and doc_id // 1000 = 0) as truncated from v_blob_files group by repo"
    ),
    "blob_join": _with(
        *_REMOTE_FILES,
        final="select repo, path, sha, content is not null as found, md5(content) as digest from remote_files",
    ),
    "ignore_patterns": _with(_IGNORE_LINES, _PATTERNS, final="select * from patterns"),
    "repo_ref_parse": _with(
        _PARSED,
        final="select page_id, ref, owner, name, "
        "case when owner is null then 'unrecognised' else 'remote' end as kind from parsed",
    ),
    "repo_ref_kind": _with(_PARSED, final="select page_id, owner is not null as is_remote from parsed"),
    "repo_ref_label": _with(
        _PARSED,
        final="select page_id, coalesce(branch, 'HEAD') as branch_or_default, "
        "owner || '/' || name || coalesce('@' || branch, '') as label from parsed where owner is not null",
    ),
    "glob_include": _with(
        final="select repo, path from v_files where "
        + _matches("path", r"(.+/)?[^/]*\.java|(.+/)?src/(.+/)?[^/]*\.kt|(.+/)?docs/[^/]oc[^/]*")
    ),
    "glob_exclude": _with(
        final="select repo, path from v_files where "
        + _matches("path", r"(.+/)?[^/]*\.(java|md)")
        + " and not "
        + _matches("path", "(.+/)?test/.*|(.+/)?docs/.*")
    ),
    "default_excludes": _with(final=f"select repo, path, {_default_exclude('path')} as excluded from v_files"),
    "glob_braces": _with(
        final=r"select repo, path, regexp_full_match(path, '(.*/)?[^/]*\.(js|kt)') as braces, "
        r"regexp_full_match(path, '.*/[^/]*\.(java|md)') as anchored_braces, "
        r"regexp_full_match(path, '(.*/)?[Dd]oc[^_/][^/]*\.[jm][^/]*') as brackets from v_files"
    ),
    "prune_dirs": _with(
        *_decided(
            "v_files",
            _ALL,
            lambda p: _matches(p, DEFAULT_EXCLUDE + "|(.+/)?src/main/[^/]*|(.+/)?a[^/]b/.*"),
            500,
        ),
        final="select repo, path, pruned_dir, decision from decided",
    ),
    "ignore_anti_join": _with(
        final="select repo, path from v_teams where not "
        + _rules("path").replace(_default_exclude("path"), "false")
    ),
    "ignore_decisions": _with(
        *_decided("v_teams", _ALL, _rules, 500), final="select repo, path, pruned_dir, decision from decided"
    ),
    "size_guard": _with(final="select repo, path, size_bytes from v_files where size_bytes <= 8192"),
    "utf8_guard": _with(_RAW, final="select repo, path, size_bytes from raw_files where readable"),
    "file_decisions": _with(
        *_RAW_DECIDED, final="select repo, path, size_bytes, pruned_dir, decision from decided"
    ),
    "exclude_sources": _with(
        _IGNORE_LINES,
        _PATTERNS,
        final="select repo, 'default' as source, i - 1 as position, g[i] as pattern from "
        "(select distinct repo from v_teams), (select ['.git/**', '.gradle/**', '.idea/**', '.vscode/**', "
        "'build/**', 'out/**', 'target/**', '.mvn/**', 'node_modules/**', '**/.DS_Store', '**/Thumbs.db'] as g), "
        "unnest(range(1, 12)) as u(i) union all "
        "select distinct repo, 'config', 0, '**/test/**' from v_teams union all "
        "select repo, 'ignore_file', line_no, pattern from patterns",
    ),
    "language_tag": _with(
        final="select doc_id, name, case name when 'Dockerfile' then 'dockerfile' when 'Makefile' then 'makefile' "
        "when '.env' then 'dotenv' when '.gitignore' then 'text' when 'a.b.TS' then 'typescript' "
        "when 'java' then 'java' when 'notes.txt' then '' when 'x.unknown' then 'text' when 'noext' then 'text' "
        f"when 'pkg/x.GQL' then 'graphql' else {LANGUAGE.replace('(path', '(name')} end as language from v_names"
    ),
    "strip_comments": _with(
        *_meta("v_files"), final="select repo, path, language, content from prepared"
    ),
    "tokens_text": f"select doc_id, coalesce({_tokens('length(text)')}, 0) as tokens from documents",
    "tokens_bytes": _with(
        final=f"select repo, size_bytes, {_tokens('size_bytes')} as tokens from "
        "(select repo, sum(size_bytes)::bigint as size_bytes from v_files group by repo)"
    ),
    "tokens_rendered": _with(*_meta("v_files", strip=False), final="select repo, path, tokens from meta"),
    "anchor_slug": _with(final=f"select repo, path, {SLUG} as slug from v_files"),
    "run_counts": _with(
        *_RAW_DECIDED,
        final="select repo, count(*) filter (decision = 'include') as included from decided group by repo",
    ),
    "excluded_walk": _with(
        *_RAW_DECIDED,
        final="select repo, count(*) filter (decision not in ('include', 'skip_dir')) "
        "+ count(distinct pruned_dir) as excluded_walk from decided group by repo",
    ),
    "excluded_flat": _with(
        *_REMOTE_DECIDED,
        final="select repo, count(*) filter (decision = 'include') as included, "
        "count(*) filter (decision <> 'include') as excluded_flat from decided group by repo",
    ),
    "dry_run": _with(
        final=f"select repo, n_files, total_bytes, {_kb('total_bytes')} as total_kb, "
        f"{_tokens('total_bytes')} as tokens, {_tokens('total_bytes')} > 5000 as over_budget from "
        "(select repo, count(path) as n_files, coalesce(sum(size_bytes), 0)::bigint as total_bytes "
        "from v_asked left join v_teams_whole using (repo) group by repo)",
    ),
    "dry_run_listing": _with(
        final=f"select repo, path, {LANGUAGE} as language, {_kb('size_bytes')} as kb from v_whole",
    ),
    "split_groups": _with(
        final=f"select repo, dir_key, {_leaf('dir_key', 'repo')} as label, "
        "case when dir_key = '' then '_root.md' else replace(dir_key, '/', '.') || '.md' end as base, "
        "n_files, raw_bytes from (select repo, "
        f"{_parent('path')} as dir_key, count(*) as n_files, sum(size_bytes)::bigint as raw_bytes "
        "from v_files group by all)"
    ),
    "split_names": _with(
        ("meta", "select * from v_files"), *SPLIT_PLACED, final="select repo, dir_key, output from dir_names"
    ),
    "anchor_dedup": _with(
        ("meta", "select * from v_files"),
        *SINGLE_PLACED,
        *_anchored(),
        final="select repo, output, path, anchor from anchored",
    ),
    "chunk_assign": _with(
        *_meta("v_files", strip=False), *_chunks(3000), final="select repo, path, tokens, chunk from folded"
    ),
    "chunk_assign_one_repo": _with(
        *_meta("v_mono", strip=False), *_chunks(4000), final="select repo, path, tokens, chunk from folded"
    ),
    "chunk_oversize": _with(
        *_meta("v_whole"),
        final=f"select repo, path, tokens, path || ' (~' || {_digits('tokens')} || "
        "' tokens) exceeds chunk budget (1,000). Placing in its own chunk.' as note from meta where tokens > 1000",
    ),
    "tree_nodes": _with(
        ("meta", "select * from v_files"),
        *SINGLE_PLACED,
        *_tree("placed"),
        final="select repo, node_path, depth, name, is_dir from nodes",
    ),
    "tree_lines": _with(
        ("meta", "select * from v_mono"),
        *SINGLE_PLACED,
        *_tree("placed"),
        final="select repo, node_path, sort_key, line from lines",
    ),
    "tree_document": _with(
        *_SPLIT, *_documents("split"), *_tree("placed"), final=" union all ".join(_tree_rows())
    ),
    "toc": _with(
        *_SINGLE,
        *_anchored(),
        final=f"select repo, output, path as sort_key, {TOC_LINE} as fragment from anchored",
    ),
    "header_render": _with(
        *_CHUNK, *_documents("chunk"), final=f"select repo, output, {_header('enabled')} as header from docs_of"
    ),
    "footer_render": _with(
        *_SINGLE, *_documents("single"), final=f"select repo, output, {FOOTER} as footer from docs_of"
    ),
    "file_section_render": _with(
        *_SINGLE, *_anchored(), final=f"select repo, path, {SECTION} as fragment from anchored"
    ),
    "document_fragments": _with(
        *_SINGLE,
        *_anchored(),
        *_documents("single"),
        *_fragments(_header("enabled")),
        final="select * from fragments",
    ),
    "document_fragments_plain": _with(
        *_SINGLE,
        *_anchored(),
        *_documents("single"),
        *_fragments(_header("enabled"), toc=False, tree=False),
        final="select * from fragments",
    ),
    "chunk_documents": _with(
        *_CHUNK,
        *_anchored(),
        *_documents("chunk"),
        *_fragments(_header("enabled")),
        final="select repo, output, string_agg(fragment, '' order by section, part, sort_key) as document "
        "from fragments group by repo, output",
    ),
    "single_outputs": _with(
        *_SINGLE,
        *_anchored(),
        *_documents("single"),
        *_fragments(_header("enabled")),
        OUTPUTS,
        final="select * from outs",
    ),
    "split_outputs": _with(
        *_SPLIT,
        *_anchored(),
        *_documents("split"),
        *_fragments(_header("enabled")),
        OUTPUTS,
        final="select * from outs",
    ),
    "chunk_outputs": _with(
        *_CHUNK,
        *_anchored(),
        *_documents("chunk"),
        *_fragments(_header("enabled")),
        OUTPUTS,
        final="select * from outs",
    ),
    "remote_outputs": _with(*_REMOTE, final="select * from outs"),
    "warnings_single": _with(
        *_everything("v_mono", SINGLE_PLACED, "single"),
        final="select repo, output, 0::bigint as ord, 'Estimated token count (~' || "
        f"{_digits('tokens')} || ') exceeds --max-tokens limit (5,000). Consider narrowing your include patterns "
        "or using --split.' as warning from outs where tokens > 5000 union all "
        "select repo, output, 1, n_files || ' files included — consider using --split for large repos.' "
        "from outs where n_files > 500",
    ),
    "warnings_split": _with(
        *_everything("v_files", SPLIT_PLACED, "split"),
        _SPLIT_TOTALS,
        _split_warnings(1500),
        final="select * from warned",
    ),
    "warnings_remote": _with(
        *_REMOTE,
        final="select repo, output, 0::bigint as ord, 'Estimated token count (~' || "
        f"{_digits('tokens')} || ') exceeds --max-tokens limit (5,000).' as warning from outs where tokens > 5000",
    ),
    "listing_notes": _with(
        ("matched", "select repo, count(*) as matched from v_blob_files_whole group by repo"),
        final="select repo, 0::bigint as ord, 'Truncated tree listing: some files may be missing. Consider narrowing "
        "your include patterns.' as note from v_blob_files where n % 5 = 0 group by repo union all "
        "select repo, 1, 'Fetching ' || matched || ' files. Unauthenticated access allows 60 requests/hour (1 used "
        "for tree). Consider adding a token for a 5,000/hour limit.' from matched where matched > 50",
    ),
    "run_summary": _with(*_STATUS, final="select * exclude (status) from summary"),
    "run_status": _with(*_STATUS, final="select repo, status from summary"),
}
