"""Queries that apply the operators to whole tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.llm import alignment, bpe, chains, exact, extraction, jaccard, merkle, mixing, neighbours, quality, repeats, sharding, warc
from corpuspack.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The vocabulary that the contract names.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_collinear_chains(spark, sf_dir):
    return chains.shared_passages(table(spark, sf_dir, "documents"))


@query
def op2_suffix_sort(spark, sf_dir):
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op3_bradley_terry(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.scored(docs, quality.train(docs, labels))


@query
def op4_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@query
def op5_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE["op5_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight,
         (2 * source_size)::DOUBLE AS cap
  FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 3 / 2
            - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM w),
f AS (
  SELECT place AS at, left_over AS lo, weights AS ws FROM l
  WHERE weight * left_over <= cap * weights ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN f.at IS NULL OR place < f.at THEN cap ELSE weight * f.lo / f.ws END AS target
  FROM l LEFT JOIN f ON true),
p AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - before))
        + greatest(0, least(size, floor(target)::BIGINT - before - source_size)))::BIGINT AS taken
FROM p
"""


def encoded_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, from the operator's ids and decoded bytes."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    decoded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


@query
def op7_bpe(spark, sf_dir):
    return encoded_digests(table(spark, sf_dir, "documents"))


@query
def op9_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op6_label_propagation(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"))


@query
def op8_warc(spark, sf_dir):
    read = warc.archived(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op8_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(range(40), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
           '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(sha1(html), i + 1, 1))]), '') AS bits
  FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
         + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


@query
def op10_block_matrix_join(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op10_block_matrix_join"] = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op11_manifest(spark, sf_dir):
    made = merkle.manifest(table(spark, sf_dir, "documents"))
    beside = F.transform("path", lambda step: F.concat(step["before"], step["after"]))
    checked = merkle.folded(F.coalesce("changed", "leaf"), F.col("path"))
    proof = F.sha2(F.array_join(beside, ""), 256)
    result = made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), checked.alias("folded_root"))
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


def _manifest_sql(levels: int = 7, forest_levels: int = 4) -> str:
    """Trees of up to 16 ** levels documents and 16 ** forest_levels sources, level by level."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        """bytes AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
          lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t)""",
        """crcs AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
          lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, bytes)""",
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(lower)} END AS changed FROM crcs)",
        """names AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves GROUP BY source)""",
        """placed AS (SELECT l.*, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
          FROM leaves l JOIN names ON l.source IS NOT DISTINCT FROM names.source)""",
        "t0 AS (SELECT tree, n, place, leaf AS digest FROM placed)",
    ]

    def rise(name: str, count: int) -> None:
        for k in range(count):
            parts.append(
                f"""{name}{k + 1} AS (SELECT tree, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n, place // 16 AS place,
          CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE any_value(digest) END AS digest
          FROM {name}{k} GROUP BY tree, n, place // 16)"""
            )
            parts.append(
                f"""{name}s{k} AS (SELECT tree, n, place,
          coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
          coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
          FROM {name}{k} WINDOW w AS (PARTITION BY tree, place // 16 ORDER BY place))"""
            )

    rise("t", levels)
    parts.append(f"f0 AS (SELECT 0 AS tree, count(*) OVER () AS n, tree AS place, digest FROM t{levels})")
    rise("f", forest_levels)
    parts.append("d0 AS (SELECT *, coalesce(changed, leaf) AS folded, '' AS proof FROM placed)")
    steps = [(f"ts{k}", "d.tree", f"d.place // {16**k}") for k in range(levels)]
    steps += [(f"fs{k}", "0", f"d.tree // {16**k}") for k in range(forest_levels)]
    for k, (side, tree, place) in enumerate(steps):
        parts.append(
            f"""d{k + 1} AS (SELECT d.doc_id, d.leaf, d.tree, d.place, d.proof || s.before || s.after AS proof,
          CASE WHEN s.n > 1 THEN sha256(s.before || d.folded || s.after) ELSE d.folded END AS folded
          FROM d{k} d JOIN {side} s ON s.tree = {tree} AND s.place = {place})"""
        )
    return f"""WITH {", ".join(parts)}
SELECT d.doc_id, d.leaf, s.digest AS subroot, r.digest AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root, d.folded = r.digest AS verified
FROM d{len(steps)} d JOIN t{levels} s ON s.tree = d.tree CROSS JOIN f{forest_levels} r"""


ORACLE["op11_manifest"] = _manifest_sql()


def aligned_vocabularies() -> tuple[dict[bytes, int], str, bytes]:
    first, second = map(public_tokenizers.path, ALIGNED)
    with open(second, "rb") as model:
        return alignment.read_byte_level(first), public_tokenizers.PATTERN, model.read()


@query
def op12_align_tokens(spark, sf_dir):
    return alignment.alignment_statistics(table(spark, sf_dir, "documents"), *aligned_vocabularies())


@query
def op13_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = extraction.extracted(pages, extraction.train(pages))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


#: For pages whose main text is an <article> of headings and paragraphs, as in the given tables.
ORACLE["op13_extract"] = r"""
WITH blocks AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(h1|p)>') AS parts FROM pages),
plain AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(
           regexp_replace(x, '<[^>]*>', ' ', 'g'), '&amp;?', chr(1), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), chr(1), '&'), '\s+', ' ', 'g'))) AS parts
  FROM blocks),
joined AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""
