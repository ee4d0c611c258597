"""Resharding by minimum-cost flow.

Old shard sizes supply bytes, new capacities take them; leaving a byte where it
is costs nothing, moving it costs one. The flow is solved over shards. Documents
of a shard are ordered by a hash, cut into blocks by its leading bits, and each
flow takes a contiguous run of blocks, the block at either end being split at the
document where the flow's bytes are reached. Only what a transfer touches is
rewritten; other blocks stay as they are.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamops.llm.common import stored
from streamops.session import new_folder

SHARDS, BLOCK_BITS, ROW_BYTES = 24, 12, 8


def size_of(text: str = "text") -> Column:
    """Bytes a document takes: its text in UTF-8 and a fixed part."""
    return F.coalesce(F.octet_length(F.encode(text, "UTF-8")), F.lit(0)).cast("long") + ROW_BYTES


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard at the least cost, by successive
    shortest paths over residual arcs. The network has a node per shard."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    cap: dict[tuple[int, int], int] = {}
    cost: dict[tuple[int, int], int] = {}
    near: dict[int, list[int]] = {i: [] for i in range(n + m + 2)}

    def arc(a, b, size, price):
        for x, y, s, p in ((a, b, size, price), (b, a, 0, -price)):
            cap[x, y] = cap.get((x, y), 0) + s
            cost[x, y] = p
            near[x].append(y)

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, int(i != j))
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    while True:
        far = {source: 0}
        before: dict[int, int] = {}
        queue, queued = deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for b in near[a]:
                if cap[a, b] > 0 and far[a] + cost[a, b] < far.get(b, 1 << 60):
                    far[b], before[b] = far[a] + cost[a, b], a
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if sink not in far:
            break
        path, node = [], sink
        while node != source:
            path.append((before[node], node))
            node = before[node]
        push = min(cap[step] for step in path)
        for a, b in path:
            cap[a, b] -= push
            cap[b, a] += push
    return {(i, j): cap[n + j, i] for i in range(n) for j in range(m) if cap[n + j, i] > 0}


@dataclass
class Plan:
    """``runs``: (old, first place, end place, new) over the hash order of each old
    shard; ``transfers``: (old, new, bytes); ``sizes``: bytes of the old shards."""
    runs: list[tuple[int, int, int, int]]
    transfers: list[tuple[int, int, int]]
    sizes: list[int]


TOP = 1 << 62  # places are 0 .. TOP - 1


def place(*columns: str) -> Column:
    """A document's place in its shard's order: a hash, so old files need no sort."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def place_block(column: str = "place") -> Column:
    return F.shiftright(column, 62 - BLOCK_BITS).cast("int")


def solve(rows: DataFrame, shards: int, capacities: list[int] | None = None) -> Plan:
    """The plan for ``rows`` (old int, place long, size long), one per document.

    Sizes are summed by block first; only blocks in which a run ends are looked
    into, and there a running sum finds the document where the cut comes nearest.
    """
    blocks = stored(rows.groupBy("old", place_block().alias("block"))
                    .agg(F.sum("size").alias("bytes")), "reshard-blocks")
    sizes = {r.old: r.bytes for r in blocks.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}
    n_old = max([shards, *(o + 1 for o in sizes)])
    supply = [sizes.get(i, 0) for i in range(n_old)]
    capacity = capacities or even_capacities(sum(supply), shards)
    flow = min_cost_flow(supply, capacity)
    # A shard keeps the head of its order; transfers follow by target.
    cuts: list[tuple[int, int, int]] = []  # old, bytes before the cut, target after it
    runs_of: dict[int, list[int]] = {}
    for i in range(n_old):
        targets = sorted((j for (a, j) in flow if a == i), key=lambda j: (j != i, j))
        done = 0
        for k, j in enumerate(targets):
            if k:
                cuts.append((i, done, j))
            runs_of.setdefault(i, []).append(j)
            done += flow[i, j]
    found = _cut_places(rows, blocks, [(i, at) for i, at, _ in cuts])
    runs = []
    for i, targets in runs_of.items():
        edges = [0] + [found[i, at] for o, at, _ in cuts if o == i] + [TOP]
        runs += [(i, a, b, j) for a, b, j in zip(edges, edges[1:], targets) if a < b]
    return Plan(runs, sorted((i, j, b) for (i, j), b in flow.items() if i != j), supply)


def _cut_places(rows: DataFrame, blocks: DataFrame, cuts: list[tuple[int, int]]) -> dict:
    """For each (old, bytes) the place such that what lies before it comes nearest."""
    if not cuts:
        return {}
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame(cuts, "old int, cut long"))  # below two per shard
    before = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    at = summed.join(wanted, "old").where("before < cut and cut <= before + bytes") \
        .select("old", "block", "before", "cut")
    at = F.broadcast(spark.createDataFrame(at.collect(), at.schema))
    # Rows at one place move together: equal documents of equal ids.
    inside = rows.withColumn("block", place_block()).join(
        F.broadcast(at.select("old", "block").distinct()), ["old", "block"], "left_semi") \
        .groupBy("old", "block", "place").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("old", "block").orderBy("place")
    run = inside.withColumn("upto", F.sum("size").over(order)) \
        .join(at, ["old", "block"]) \
        .select("old", "cut", "place", (F.col("before") + F.col("upto") - F.col("size")).alias("a"),
                (F.col("before") + F.col("upto")).alias("b"))
    options = run.select("old", "cut", F.explode(F.array(
        F.struct(F.abs(F.col("a") - F.col("cut")).alias("off"), F.col("place").alias("place")),
        F.struct(F.abs(F.col("b") - F.col("cut")).alias("off"), (F.col("place") + 1).alias("place"))))
        .alias("o"))
    best = options.groupBy("old", "cut").agg(F.min("o").alias("o")).collect()
    return {(r.old, r.cut): r.o.place for r in best}


def assign(rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` with shard, and touched: whether its block is rewritten (it moves,
    or some of its block does)."""
    spark = rows.sparkSession
    step = 1 << (62 - BLOCK_BITS)
    runs = spark.createDataFrame(
        plan.runs or [(0, 0, TOP, 0)], "old int, first long, end long, shard int")
    split = sorted({(i, a // step) for i, a, _, _ in plan.runs if a % step})
    split_rows = spark.createDataFrame(split or [(-1, -1)], "old int, block int") \
        .withColumn("split", F.lit(True))
    # Runs and split blocks are fewer than three per shard.
    return rows.withColumn("block", place_block()) \
        .join(F.broadcast(runs), "old") \
        .where("place >= first and place < end").drop("first", "end") \
        .join(F.broadcast(split_rows), ["old", "block"], "left") \
        .withColumn("touched", (F.col("shard") != F.col("old")) | F.coalesce("split", F.lit(False))) \
        .drop("split")


def reshard(docs: DataFrame, old: Column, shards: int = SHARDS,
            capacities: list[int] | None = None) -> tuple[DataFrame, Plan, str]:
    """Move ``docs`` from the shards ``old`` names to ``shards`` of near-equal bytes.

    Returns (all documents as they then lie, the plan, the folder of the rewritten
    files). Only documents of touched blocks are written, below
    ``folder/shard=N``; the others are read where they were. Null texts take
    ROW_BYTES; documents of one id and text share a place and move together;
    a null ``old`` counts as shard 0; clashing columns are replaced.
    """
    fresh = ("old", "place", "block", "size", "shard", "touched")
    names = [c for c in docs.columns if c.lower() not in fresh]
    rows = docs.withColumns({
        "__old": F.coalesce(old, F.lit(0)).cast("int"), "__place": place("doc_id", "text"),
        "__size": size_of()}).select(
            *[F.col(f"`{c}`") for c in names], F.col("__old").alias("old"),
            F.col("__place").alias("place"), F.col("__size").alias("size"))
    narrow = stored(rows.select("old", "place", "size"), "reshard-sizes")
    plan = solve(narrow, shards, capacities)
    placed = assign(rows, plan)
    folder = new_folder(docs.sparkSession, "resharded")
    # Rows of a new shard's block meet in one file; a hot shard has many blocks.
    placed.where("touched").repartition("shard", F.floor(F.col("block") / 64)) \
        .write.partitionBy("shard").parquet(folder)
    moved = docs.sparkSession.read.schema(placed.schema).parquet(folder)
    stay = placed.where("not touched")
    return stay.unionByName(moved.select(*stay.columns)), plan, folder


def with_slots(rows: DataFrame, shard: str = "shard", order: tuple[str, ...] = ("place", "doc_id")) -> DataFrame:
    """Gapless slots from 0 in every shard, in the order of places: block counts
    are summed over blocks, and rows numbered within their block."""
    counts = rows.groupBy(shard, "block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(shard, "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(shard, "block").orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(inside) - 1).join(base, [shard, "block"]) \
        .withColumn("slot", F.col("_base") + F.col("_at")).drop("_at", "_base")

