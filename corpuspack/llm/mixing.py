"""Mixing sources to target weights: random order within a source, cut where its budget of words ends.

Every document gets a hash as its place in a random order. Rows are range-sorted by source and place, running sums of
words come from sums of blocks, and a source's documents are taken up to its budget exactly: the document in which
the budget ends gives only the words that are left. A budget beyond a source's size begins a second epoch. Budgets share a total
by weight; none exceeds EPOCHS times the source's size, and what that leaves over goes to the others by weight.

Sources are ordered by code point, null last, and weigh 3, 1, 2, repeating. Null and blank texts have no words; their
documents are part of the mix with nothing taken, and a source of such documents has a target of 0. Rows that repeat
doc_id and size are interchangeable. Other columns aren't used. The hash makes reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.llm.common import WORD, text_or_empty, unused
from corpuspack.llm.prefix import running
from corpuspack.session import materialised

#: Weights of sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has this share of all words; no source gives more than EPOCHS times its own.
SHARE_NUMERATOR, SHARE_DENOMINATOR, EPOCHS = 3, 2, 2


def sized(docs: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, source, size): words of each document, and columns ``kept``."""
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint")
    return docs.select("doc_id", "source", words.alias("size"), *kept)


def targets(documents: DataFrame) -> DataFrame:
    """(source, source_size, target). Windows run over one row per source.

    With sources by rising cap per weight, the first whose share of what is left fits under its cap sets the level
    for itself and all later ones; earlier ones are at their caps.
    """
    per_source = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((nth - 1) % len(WEIGHTS) + 1).cast("int"))
    cap = EPOCHS * F.col("source_size")
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    weighed = per_source.withColumn("weight", weight.cast("double")).withColumn("cap", cap.cast("double"))
    weighed = weighed.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * SHARE_NUMERATOR / SHARE_DENOMINATOR
    levels = weighed.select(
        "*",
        (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(after).alias("weights"),
        F.row_number().over(by_ratio).alias("place"),
    )
    fits = F.col("weight") * F.col("left") <= F.col("cap") * F.col("weights")
    first = F.min(F.when(fits, F.struct("place", "left", "weights"))).over(everything)
    shared = levels.withColumn("first", first)
    target = F.when(
        F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap")
    ).otherwise(F.col("weight") * F.col("first.left") / F.col("first.weights"))
    return shared.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every document, and columns ``kept``."""
    documents = materialised(
        sized(docs, *kept).withColumn("place", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))),
        "mix-sizes",
    )
    shares = targets(documents)
    summed = running(documents, ["source"], ["place", "doc_id", "size"], "size", "before", "mix-blocks")
    shares = shares.withColumnRenamed("source", "of")
    met = summed.join(shares, summed["source"].eqNullSafe(shares["of"]))
    budget = F.floor("target")

    def share(epoch: int):
        start = F.col("before") + epoch * F.col("source_size")
        return F.greatest(F.lit(0), F.least(F.col("size"), budget - start))

    taken = sum((share(e) for e in range(1, EPOCHS)), share(0))
    return met.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"), "source", *kept)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: a row for each epoch in which a document gives words, with the columns of ``docs``.

    Where a budget ends inside a document, that row's text ends with the last word taken and n_chars follows it.
    """
    # Rows are numbered and written, as neither ids nor texts need tell them apart.
    row, cut = unused(docs.columns, "mixed_row"), unused(docs.columns, "mixed_cut")
    rows = materialised(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    taken = mix(rows, row).where("taken > 0")
    # A document of several epochs has as many rows; the last may be cut.
    epochs = F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int")))
    parts = taken.select(row, "size", "taken", epochs.alias("epoch"))
    words = F.least("size", F.col("taken") - F.col("epoch") * F.col("size"))
    met = rows.join(parts.select(row, F.struct("size", words.alias("words")).alias(cut)), row)
    whole = F.col(f"{cut}.words") >= F.col(f"{cut}.size")
    ends = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(ends, F.lit(1), F.col(f"{cut}.words").cast("int")), ""))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast("bigint"))
    return met.withColumns(changed).select(*docs.columns)
