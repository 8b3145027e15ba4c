"""Balanced label propagation: linked documents move towards their neighbours' shard, two-way and within quotas.

Documents are linked if their texts are equal; a group's documents are all neighbours, so what a document sees of its
neighbours is how many of the group each shard has. Every document starts in a shard by its position in a random order, so counts differ by one at
most. In each round, documents of a group move towards the shard that has most of it. The accepted moves are the most that
keep every shard's number of rows: swaps and longer cycles of movers, and documents without links that make room in
return. The law is ``rows``: counts at most one apart. Where none can move, documents move towards the shard with the
second most of their group, and so on, but never to one with less of it than their own, so every move lowers the number
of neighbours apart. Rounds end when no choice, under any of SALTS orders of tied shards, lets a document move.

Groups larger than a shard fill shards as far as quotas allow. All of it is joins, aggregates and range sorts: a
position in a queue comes from blocks of a global order and sums over blocks, never from one task with a whole queue.

Null texts count as empty and have size 1; empty texts are a group like any other. Rows that repeat a doc_id are
separate rows. A null doc_id is placed like any other. Texts of any length count as a whole. Other columns aren't used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import text_or_empty
from corpuspack.llm.prefix import ranked
from corpuspack.session import materialised

SHARDS = 8
#: Orders of tied shards that are tried before a round counts as one in which nothing can move.
SALTS = 8


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, link, row, shard): link is null for a text that no other row has."""
    text = text_or_empty()
    rows = materialised(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    shared = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", "n")
    positions = ranked(rows.withColumn("order", F.xxhash64("row")), [], ["order", "row"], "position", "shard-order")
    positions = positions.join(shared, "digest", "left")
    return positions.select(
        "doc_id",
        "size",
        "text_crc32",
        F.when(F.col("n").isNotNull(), F.col("digest")).alias("link"),
        "row",
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """(link, seen): how many rows of a group each shard has, as an array of (n, shard)."""
    seen = rows.where("link is not null").groupBy("link", "shard").agg(F.count("*").alias("n"))
    return seen.groupBy("link").agg(F.collect_list(F.struct("n", "shard")).alias("seen"))


def preferences(found: DataFrame, salt: int) -> DataFrame:
    """(link, seen): shards by what they have of the group, most first. Ties fall by a hash of group, shard and salt."""
    with_tie = F.transform(
        "seen", lambda x: F.struct(x["n"].alias("n"), F.xxhash64("link", x["shard"], F.lit(salt)).alias("tie"), x["shard"].alias("shard"))
    )
    return found.select("link", F.sort_array(with_tie, asc=False).alias("seen"))


def wanted(seen: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """For each choice, how many rows could go from where to where: at most shards ** 3 numbers."""
    ranked_shards = seen.select("seen", F.posexplode("seen").alias("rank", "at")).where("rank > 0")
    steps = ranked_shards.select("seen", "at", F.explode(F.sequence(F.lit(0), F.col("rank") - 1)).alias("choice"))
    to = F.element_at("seen", F.col("choice") + 1)["shard"]
    counts = steps.groupBy("choice", F.col("at.shard").alias("shard"), to.alias("wish")).agg(F.sum("at.n").alias("n")).collect()
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in counts:
        out.setdefault(r["choice"], {})[r["shard"], r["wish"]] = r["n"]
    return out


def propagate(rows: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, int]:
    """One round: the rows with their new shards, and how many moved towards their neighbours."""
    found = materialised(groups(rows), "shard-groups")
    free = {r["shard"]: r["count"] for r in rows.where("link is null").groupBy("shard").count().collect()}
    for salt in range(SALTS):
        seen = preferences(found, salt)
        for choice, counts in sorted(wanted(seen).items()):
            accepted = flows(counts, free, shards)
            if accepted:
                return moved(rows, seen, choice, accepted, shards), sum(accepted.values())
    return rows, 0


def moved(rows: DataFrame, seen: DataFrame, choice: int, accepted: dict[tuple[int, int], int], shards: int) -> DataFrame:
    """The rows after the accepted numbers of them went from where to where, free rows making room."""
    # rows without a link stay out of the join: they would all meet at its null key
    own = F.array_position(F.transform("seen", lambda x: x["shard"]), F.col("shard"))
    wish = F.when(own > choice + 1, F.get("seen", F.lit(choice))["shard"])
    linked = rows.where("link is not null").join(seen, "link").select(*rows.columns, wish.alias("wish"))
    with_wish = linked.unionByName(rows.where("link is null").withColumn("wish", F.lit(None).cast("int")))
    movers = F.col("wish").isNotNull()
    state = F.when(movers, F.lit("mover")).when(F.col("link").isNull(), F.lit("free")).otherwise(F.lit("settled"))
    # queues: movers by where they are and wish to go, groups together; free rows by the shard they are in
    queue = F.when(movers, F.col("shard") * shards + F.col("wish")).otherwise(F.col("shard"))
    queued = with_wish.withColumn("state", state).withColumn("queue", queue)
    queued = queued.withColumn("order", F.when(movers, F.xxhash64("link")).otherwise(F.xxhash64("row")))
    lined_up = ranked(queued, ["state", "queue"], ["order", "row"], "nth", "shard-queues")

    change = {s: 0 for s in range(shards)}
    for (s, t), n in accepted.items():
        change[s] -= n
        change[t] += n
    # Shards with a surplus give their first free rows, shards with a deficit take them, both in order of shard.
    give = [(s, change[s]) for s in range(shards) if change[s] > 0]
    take = [(s, -change[s]) for s in range(shards) if change[s] < 0]
    target = F.lit(None).cast("int")
    offset = 0
    ends, end = [], 0
    for s, n in take:
        end += n
        ends.append((s, end))
    for s, n in give:
        place = F.col("nth") + offset
        lands = F.lit(None).cast("int")
        for t, stop in reversed(ends):
            lands = F.when(place < stop, F.lit(t)).otherwise(lands)
        target = F.when((F.col("state") == "free") & (F.col("shard") == s) & (F.col("nth") < n), lands).otherwise(target)
        offset += n
    quota_of = F.create_map(*[F.lit(x) for (s, t), n in accepted.items() for x in (s * shards + t, n)])
    goes = (F.col("state") == "mover") & (F.col("nth") < F.coalesce(quota_of[F.col("queue")], F.lit(0)))
    new = F.when(goes, F.col("wish")).otherwise(F.coalesce(target, F.col("shard")))
    return materialised(lined_up.withColumn("shard", new.cast("int")).select(*rows.columns), "shard-round")


def flows(wanted: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> dict[tuple[int, int], int]:
    """The most moves that leave every shard's number of rows as it is, with free rows making room.

    A circulation: moves are arcs between shards, and free rows go through one more node. Cycles that gain
    are taken until none is left, so swaps, longer cycles and free rows all count, whatever arcs they share.
    """
    pool, n = shards, shards + 1
    # (from, to, gain) and what is left of it; the reverse of arc i is i ^ 1
    arcs: list[tuple[int, int, int]] = []
    left: list[int] = []
    for s, t, count, gain in (
        [(s, t, count, 1) for (s, t), count in sorted(wanted.items())]
        + [(t, pool, count, 0) for t, count in sorted(free.items())]
        + [(pool, s, sum(free.values()), 0) for s in range(shards)]
    ):
        arcs += [(s, t, gain), (t, s, -gain)]
        left += [count, 0]
    while True:
        best, by, last = [0] * n, [-1] * n, -1
        for _ in range(n):
            last = -1
            for i, (s, t, gain) in enumerate(arcs):
                if left[i] and best[s] + gain > best[t]:
                    best[t], by[t], last = best[s] + gain, i, t
            if last < 0:
                return {(s, t): left[2 * k + 1] for k, (s, t) in enumerate(sorted(wanted)) if left[2 * k + 1]}
        for _ in range(n):
            last = arcs[by[last]][0]
        cycle, at = [], last
        while not cycle or at != last:
            cycle.append(by[at])
            at = arcs[by[at]][0]
        most = min(left[i] for i in cycle)
        for i in cycle:
            left[i] -= most
            left[i ^ 1] += most


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    rows = materialised(placed(docs, shards), "shard-start")
    count = 1
    while count:
        rows, count = propagate(rows, shards)
    slots = ranked(rows, ["shard"], ["row"], "slot", "shard-slots")
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
