"""Sharding by a minimum-cost flow: from old shard sizes and new capacities to the fewest bytes moved.

What moves are blocks of equal texts (units): all copies of a text, or, where they hold more than a
share UNIT of all bytes or rows, parts of them. The flow is solved over shards (a handful of numbers). What moves
is then chosen by position: the units of an old shard are put in an order, large ones first, and cut where
the flow says, so that a cut is off by half a small unit at most: a shard misses its capacity by less than
a share UNIT of all bytes for each cut, plus its largest row. Positions come from sums over
blocks of units: a window within a block, and one over the far fewer blocks.

A null text has no bytes and counts as size 1; null or repeated ids are placed like any others, equal rows
in any order among themselves; an empty table gives an empty table; texts of any length are measured whole;
other columns, whatever their names, aren't read. Equal texts lie in one shard unless they are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted

#: Rows or units of a block (about), within which they are sorted.
BLOCK_ROWS = 20_000
#: The largest share of all bytes, or of all rows, that equal texts keep together.
UNIT = 1 / 4096


def transfers(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes that move from shard to shard so that each gets its capacity and the fewest bytes move.

    Successive shortest paths on source -> old shard -> new shard -> sink; staying costs 0, moving 1 a byte.
    """
    if sum(sizes) != sum(capacities):
        raise ValueError("capacities must add up to the sizes")
    n = len(sizes)
    m = len(capacities)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # from, to, room, cost; an edge's reverse follows it
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, cost: int) -> None:
        for edge in ([a, b, room, cost], [b, a, 0, -cost]):
            out[edge[0]].append(len(edges))
            edges.append(edge)

    for i, x in enumerate(sizes):
        add(source, i, x, 0)
        for j in range(m):
            add(i, n + j, x, int(i != j))
    for j, x in enumerate(capacities):
        add(n + j, sink, x, 0)
    while True:
        cost, via = {source: 0}, {}
        waiting = [source]
        while waiting:
            a = waiting.pop(0)
            for e in out[a]:
                _, b, room, c = edges[e]
                if room > 0 and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b], via[b] = cost[a] + c, e
                    waiting.append(b)
        if sink not in cost:
            break
        path, b = [], sink
        while b != source:
            path.append(via[b])
            b = edges[via[b]][0]
        room = min(edges[e][2] for e in path)
        for e in path:
            edges[e][2] -= room
            edges[e ^ 1][2] += room
    return {(a, b - n): edges[k ^ 1][2] for k, (a, b, _, _) in enumerate(edges) if k % 2 == 0 and a < n and edges[k ^ 1][2]}


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def units(rows: DataFrame, share: float = UNIT) -> DataFrame:
    """``rows(.., size, text_hash)`` with ``unit``: equal texts, in parts where they hold more than ``share`` of all bytes or rows.

    At most 2 / share texts hold that much, so those are broadcast.
    """
    key = ["text_hash", "size"]
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    parts = F.ceil(F.greatest(F.sum("size") / max(1.0, share * (total["size"] or 0)), F.count("*") / max(1.0, share * total["n"])))
    large = rows.groupBy(*key).agg(parts.alias("parts")).where("parts > 1")
    dealt = rows.join(F.broadcast(large), key, "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts"))).otherwise(0)
    return dealt.withColumn("unit", F.xxhash64(*key, part)).drop("parts")


def plan(rows: DataFrame, old_shard: Column, shards: int, capacities: list[int] | None = None) -> DataFrame:
    """``rows`` (with ``doc_id``, ``size`` and ``unit``) plus ``old_shard``, ``shard`` and ``slot``; capacities are equal bytes unless given."""
    placed = cut(rows.withColumn("old_shard", old_shard.cast("int")))
    whole = cut(placed.groupBy("old_shard", "unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    sums = {r["old_shard"]: r for r in whole.groupBy("old_shard").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("rows"), F.count("*").alias("units")).collect()}
    n_old = max([shards, *(k + 1 for k in sums)])
    sizes = [sums[k]["bytes"] if k in sums else 0 for k in range(n_old)]
    moved = transfers(sizes, capacities or even(sum(sizes), shards))

    blocks = max(1, sum(r["units"] for r in sums.values()) // (BLOCK_ROWS * shards))
    block = ["old_shard", "band", "block"]
    blocked = whole.withColumn("band", -F.floor(F.log2("bytes")).cast("int")).withColumn("block", F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int"))
    before = F.sum("all").over(Window.partitionBy("old_shard").orderBy("band", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    offsets = blocked.groupBy(*block).agg(F.sum("bytes").alias("all")).select(*block, F.coalesce(before, F.lit(0)).alias("offset"))
    ahead = F.sum("bytes").over(Window.partitionBy(*block).orderBy(F.desc("bytes"), "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = blocked.withColumn("ahead", ahead - F.col("bytes")).join(offsets, block).withColumn("middle", F.col("offset") + F.col("ahead") + F.col("bytes") / 2)

    shard = F.lit(None).cast("int")
    for i in range(n_old):
        upto, own = 0, F.lit(i if i < shards else 0)
        cuts = []
        for j in sorted((j for a, j in moved if a == i), key=lambda j: (j != i, j)):  # what stays comes first: the large units
            upto += moved[i, j]
            cuts.append((upto, j))
        for upto, j in reversed(cuts):
            own = F.lit(j) if (upto, j) == cuts[-1] else F.when(F.col("middle") < upto, j).otherwise(own)
        shard = F.when(F.col("old_shard") == i, own).otherwise(shard)
    homes = at.select("old_shard", "unit", shard.cast("int").alias("shard"))

    parts = max(1, sum(r["rows"] for r in sums.values()) // (BLOCK_ROWS * shards))
    done = cut(placed.join(homes, ["old_shard", "unit"]).withColumn("part", F.pmod(F.xxhash64("unit", "doc_id"), F.lit(parts)).cast("int")))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    firsts = done.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("unit", "doc_id"))
    return done.withColumn("rank", rank).join(firsts, ["shard", "part"]).select(*rows.columns, "old_shard", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32`` and ``text_hash`` of each document."""
    t = F.coalesce(quoted(text), F.lit(""))
    return docs.select(quoted(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("text_hash"))


def reshard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", old_shard: Column | None = None, share: float = UNIT) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``old_shard``, ``shard`` and ``slot``.

    Documents without a known old shard are taken to lie by a hash of their unit.
    """
    old = F.pmod(F.col("unit"), F.lit(shards)) if old_shard is None else old_shard
    return plan(units(measured(docs, doc_id, text), share), old, shards)


def rewrite(docs: DataFrame, planned: DataFrame, target: str, doc_id: str = "doc_id", shard: str = "shard", slot: str = "slot") -> list[int]:
    """Write the shards whose rows change, as folders ``<shard>=<n>`` under ``target``; returns their numbers.

    Only these folders are replaced, once all of them are written; a shard that ends without rows loses its folder. Others
    aren't read for writing and stay as they are, so ``docs`` may lie in ``target`` itself. ``docs`` must have one row per id. Its
    columns by the names ``shard`` and ``slot``, if any, are older placements and give way to the new ones.
    """
    spark = docs.sparkSession
    change = planned.where("old_shard != shard")
    affected = sorted({r[0] for r in change.select("old_shard").union(change.select("shard")).distinct().collect()})
    mine = planned.where(F.col("shard").isin(affected)).select(F.struct("doc_id", "shard", "slot").alias("x"))
    full = {r[0] for r in mine.select("x.shard").distinct().collect()}
    kept = [c for c in docs.columns if c.casefold() not in (shard.casefold(), slot.casefold())]
    rows = docs.select(F.struct(*(quoted(c) for c in kept)).alias("d")).join(mine, F.col("d")[doc_id] == F.col("x.doc_id"))
    placed = rows.repartition("x.shard", F.floor(F.col("x.slot") / BLOCK_ROWS)).sortWithinPartitions("x.shard", "x.slot")
    out = placed.select(*(F.col("d")[c].alias(c) for c in kept), F.col("x.shard").alias(shard), F.col("x.slot").alias(slot))
    out.write.partitionBy(shard).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)
    for number in (n for n in affected if n not in full):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{shard}={number}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return affected


def report(planned: DataFrame) -> DataFrame:
    return planned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
