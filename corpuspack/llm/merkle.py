"""A Merkle manifest of a dataset: every document is a leaf, with a proof that leads to one root.

Leaves of a source follow their doc_id. Nothing is sorted for that: ids of a source are gathered as bitmaps, of which
only words that aren't zero are kept. Words are merged into containers of CONTAINER ids, each with a directory
of the ones before each of its words; running sums over containers say where each begins. A leaf's place is then
a rank query: the container's start, the directory's count, and the ones below its bit. A bitmap can't tell rows that
share an id apart, so containers that hold such rows, and rows without an id, are ranked by doc_id and digest in a distributed sort.

With places known, levels are built from slot arrays: the key is a run's number, the slot a node's place in it. An array
holds SPAN nodes, two levels, so a round needs one shuffle and leaves a SPANth of the nodes. Paths go
back down the same arrays, and each leaf folds its own. A source's size never shows in an array's.

``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text`` make up a leaf; null ones count as '-'. Sources sort by UTF-8
bytes, null first, and so do null doc_ids within a source. Rows that repeat a doc_id are ordered by their leaf's
digest; rows equal in all five columns are interchangeable. Texts of any length are hashed whole. Other columns
aren't used. An empty table gives an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.prefix import ranked, running
from corpuspack.session import materialised

#: Children of a node, and nodes of a slot array: two levels.
ARITY = 16
SPAN = ARITY * ARITY
#: Ids of a container, as a power of two; a word has 64.
CONTAINER_BITS, WORD_BITS = 12, 6
#: One document in so many is tampered with.
TAMPERED = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(text: Column) -> Column:
    fields = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*fields, _field(text)), 256)


def tampered_with() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, changed, bucket, word, bit). ``changed``: the leaf of the tampered text, else null."""
    changed = F.when(tampered_with(), leaf_digest(F.translate("text", _UPPER, _LOWER)))
    number = F.col("doc_id").cast("bigint")
    low = number.bitwiseAND(F.lit((1 << CONTAINER_BITS) - 1))
    return docs.select(
        number.alias("doc_id"),
        "source",
        leaf_digest(F.col("text")).alias("leaf"),
        changed.alias("changed"),
        F.shiftright(number, CONTAINER_BITS).alias("bucket"),
        F.shiftright(low, WORD_BITS).cast("int").alias("word"),
        number.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int").alias("bit"),
    )


# Places


def containers(rows: DataFrame) -> DataFrame:
    """(source, bucket, numbers, bits, until, n_rows, n_ids): the words of each container that aren't zero, in order,
    and how many ids come before each."""
    word = F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    words = rows.groupBy("source", "bucket", "word").agg(word, F.count("*").alias("n"))
    merged = words.groupBy("source", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"),
        F.sum("n").alias("n_rows"),
        F.sum(F.bit_count("bits").cast("bigint")).alias("n_ids"),
    )
    none = F.array(F.lit(0).cast("bigint"))
    until = F.aggregate("words", none, lambda sums, w: F.concat(sums, F.array(F.element_at(sums, -1) + F.bit_count(w["bits"]))))
    return merged.select(
        "source", "bucket", F.col("words.word").alias("numbers"), F.col("words.bits").alias("bits"), until.alias("until"), "n_rows", "n_ids"
    )


def numbered_sources(directory: DataFrame) -> DataFrame:
    """(name, total, tree): each source's rows and its place among sources."""
    totals = directory.groupBy("source").agg(F.sum("n_rows").alias("total"))
    return ranked(totals, [], ["source"], "tree", "manifest-sources").withColumnRenamed("source", "name")


def placed(rows: DataFrame, directory: DataFrame, sources: DataFrame) -> DataFrame:
    """(tree, total, place, doc_id, leaf, changed): each leaf's place among those of its source."""
    known = directory.join(sources, directory["source"].eqNullSafe(sources["name"]))
    known = known.select(
        F.col("source").alias("name"), F.col("bucket").alias("home"), "tree", "total", "start", "numbers", "bits", "until",
        (F.col("n_rows") != F.coalesce("n_ids", F.lit(0))).alias("crowded"),
    )
    met = rows["source"].eqNullSafe(known["name"]) & rows["bucket"].eqNullSafe(known["home"])
    at = F.array_position("numbers", F.col("word")).cast("int")
    ones = F.element_at("bits", at).bitwiseAND(F.expr("~shiftleft(-1L, bit)"))
    rank = F.col("start") + F.element_at("until", at) + F.bit_count(ones)
    kept = ("tree", "total", "place", "doc_id", "leaf", "changed")
    found = rows.join(known.where("NOT crowded"), met).withColumn("place", rank).select(*kept)
    crowded = known.where("crowded").drop("numbers", "bits", "until")
    if crowded.isEmpty():
        return found
    sorted_rows = ranked(rows.join(crowded, met), ["tree", "bucket"], ["doc_id", "leaf"], "nth", "manifest-crowded")
    return found.union(sorted_rows.withColumn("place", F.col("start") + F.col("nth")).select(*kept))


# Levels


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def arrays(nodes: DataFrame, label: str, *kept: str) -> DataFrame:
    """(tree, total, run, slots, level, top) of nodes (tree, total, place, leaf): ``slots`` holds the nodes of a run of
    SPAN in order, ``level`` the nodes above them, ``top`` the node that the run becomes."""
    slot = F.struct(F.pmod("place", F.lit(SPAN)).cast("int").alias("slot"), F.col("leaf"), *kept)
    run = F.floor(F.col("place") / SPAN).alias("run")
    grouped = nodes.groupBy("tree", "total", run).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    runs = F.sequence(F.lit(0), F.floor((F.size("slots") - 1) / ARITY).cast("int"))
    digests = F.col("slots.leaf")
    level = F.transform(runs, lambda r: F.sha2(_joined(F.slice(digests, r * ARITY + 1, ARITY)), 256))
    above = grouped.withColumn("level", F.when(F.col("total") > 1, level))
    top = F.when(F.col("total") == 1, F.col("slots")[0]["leaf"]).when(F.col("total") <= ARITY, F.col("level")[0])
    return materialised(above.withColumn("top", top.otherwise(F.sha2(_joined(F.col("level")), 256))), label)


def risen(nodes: DataFrame, largest: int, *kept: str) -> list[DataFrame]:
    """Slot arrays of all rounds. ``largest``: nodes of the largest tree."""
    rounds = []
    while True:
        rounds.append(arrays(nodes, f"manifest-{len(rounds)}", *(() if rounds else kept)))
        if largest <= SPAN:
            return rounds
        largest = -(-largest // SPAN)
        total = F.ceil(F.col("total") / SPAN).alias("total")
        nodes = rounds[-1].select("tree", total, F.col("run").alias("place"), F.col("top").alias("leaf"))


def _beside(nodes: Column, at: Column, digests=lambda found: found) -> Column:
    """What lies before and after a node among the ARITY children of its parent. ``digests`` of the nodes found."""
    first = at - F.pmod(at, F.lit(ARITY))
    before = F.slice(nodes, first + 1, at - first)
    after = F.slice(nodes, at + 2, F.lit(ARITY - 1) - (at - first))
    return F.struct(_joined(digests(before)).alias("before"), _joined(digests(after)).alias("after"))


def _way(own: Column) -> Column:
    """A node of a slot array, and what lies beside it and beside its parent."""
    at = own["slot"]
    low = _beside(F.col("slots"), at, lambda found: found["leaf"])
    return F.struct(own.alias("own"), low.alias("low"), _beside(F.col("level"), F.floor(at / ARITY).cast("int")).alias("high"))


def descended(rounds: list[DataFrame], paths: DataFrame, *kept: str) -> DataFrame:
    """(tree, place, path, leaf, kept) of the lowest nodes. ``paths`` (tree, path) has what lies beyond each tree's top;
    a path lists, level by level, what lies before and after the way to the root."""
    paths = paths.withColumn("place", F.lit(0).cast("bigint"))
    for number, one in reversed([*enumerate(rounds)]):
        above = paths.select(F.col("tree").alias("of"), F.col("place").alias("node"), F.col("path").alias("beyond"))
        met = one.join(above, (F.col("tree") == F.col("of")) & (F.col("run") == F.col("node")))
        # what lies beside a node is cut out first: a row for each must not take its whole run along
        met = met.select("tree", "total", "run", "beyond", F.explode(F.transform("slots", _way)).alias("way"))
        low, high, at = F.col("way.low"), F.col("way.high"), F.col("way.own.slot")
        steps = F.when(F.col("total") == 1, F.col("beyond")).when(F.col("total") <= ARITY, F.concat(F.array(low), "beyond"))
        place = (F.col("run") * SPAN + at).alias("place")
        paths = met.select("tree", place, steps.otherwise(F.concat(F.array(low, high), "beyond")).alias("path"), F.col("way.own").alias("own"))
    return paths.select("tree", "place", "path", "own.leaf", *(f"own.{c}" for c in kept))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's path leads to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, changed) for every row."""
    spark = docs.sparkSession
    rows = materialised(leaves(docs), "manifest-leaves")
    directory = running(containers(rows), ["source"], ["bucket"], "n_rows", "start", "manifest-directory")
    directory = materialised(directory, "manifest-directory")
    sources = materialised(numbered_sources(directory), "manifest-trees")
    n_trees, largest = sources.agg(F.count("*"), F.max("total")).first()
    trees = risen(placed(rows, directory, sources), largest or 0, "doc_id", "changed")
    subroots = materialised(trees[-1].select("tree", F.col("top").alias("subroot")), "manifest-subroots")
    # The subroots are the leaves of one more tree.
    one = F.lit(0).cast("bigint")
    forest = risen(subroots.select(one.alias("tree"), F.lit(n_trees).alias("total"), F.col("tree").alias("place"), F.col("subroot").alias("leaf")), n_trees)
    root = forest[-1].select(F.col("top").alias("root"))
    start = spark.createDataFrame([(0, [])], "tree bigint, path array<struct<before:string,after:string>>")
    ways = descended(forest, start).select(F.col("place").alias("tree"), "path")
    found = descended(trees, ways, "doc_id", "changed")
    known = subroots.withColumnRenamed("tree", "of")
    found = found.join(known, F.col("tree") == F.col("of")).select("doc_id", "leaf", "subroot", "path", "changed")
    return found.crossJoin(F.broadcast(root)).select("doc_id", "leaf", "subroot", "root", "path", "changed")  # root: one row
