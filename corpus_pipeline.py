"""From raw documents to tokens: quality, copies, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of ``documents``. Null ids, repeated ids and rows, null and empty texts and columns of any name are kept apart row by
row; what each stage does with them its operator's docstring says. No rows in, no rows out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.llm import exact, jaccard, mixing, quality
from corpuspack.llm.common import table, unused
from corpuspack.llm.queries import encoded_digests
from corpuspack.session import checkpoint_dir, materialised

#: Rows of an Arrow batch. A batch takes its texts' bytes in the executor, up to three times while it grows, and once more
#: in the worker; batches don't change what rows become.
BATCH_ROWS = 1024
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The classifier has no SQL counterpart. Tests compare copies, near copies, mixture and encoding with brute force, and
#: the classifier with held-out labels.
ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    """The session's batches are at most BATCH_ROWS long from here on; 0 or less stands for no bound. It is set for the
    session because a stage's rows are asked for after it has returned."""
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    _small_batches(spark)
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies stays."""
    return exact.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest doc_id (null last). Documents without words
    are no copies of anything.

    Rows are numbered and written, and the join takes the numbers for ids: what doc_ids rows have, or share, decides
    nothing but which of a group stays.
    """
    _small_batches(spark)
    row = unused(docs.columns, "near_row")
    rows = materialised(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    found = jaccard.jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), count_links=False)
    placed = found.select(F.col("doc_id").alias("number"), "component_id")
    ids = rows.select(F.col(row).alias("number"), F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("rank"))
    first = placed.join(ids, "number").groupBy("component_id").agg(F.min("rank").alias("rank"))
    stays = first.select(F.col(f"rank.{row}").alias(row))
    return rows.join(stays, row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, the last one of a source cut at its budget."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, as counts and digests."""
    _small_batches(spark)
    return encoded_digests(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
