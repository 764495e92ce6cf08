"""Resharding by minimum-cost flow.

Rows are hashed to blocks. The driver sees the blocks' sizes only, a bounded number of them; it
solves which bytes go from the old shards to the new capacities so that the fewest bytes move,
then picks blocks for those amounts. Rows follow their block.
"""
import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Blocks that the hash makes in each old shard. Driver and broadcast tables hold
#: old shards * BLOCKS rows and the groups that exceed a block, never more.
BLOCKS = 256
ROWS_A_SLOT_GROUP = 20_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Integer amounts by (old, new) of the cheapest way to place all supply; cost(i, j) >= 0 a unit.

    Successive shortest paths with potentials over a bipartite network, a few dozen nodes a side.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are too small")
    flow: dict = {}
    left, room = list(supply), list(capacity)
    high = [0] * (n + m)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    while any(left):
        far = [float("inf")] * (n + m)
        back = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                far[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            edges = ((n + j, price[u][j]) for j in range(m)) if u < n else ((i, -price[i][u - n]) for i in range(n) if flow.get((i, u - n)))
            for v, c in edges:
                now = d + c + high[u] - high[v]
                if now < far[v]:
                    far[v], back[v] = now, u
                    heapq.heappush(heap, (now, v))
        end = min((n + j for j in range(m) if room[j]), key=lambda v: far[v] + high[v])
        most = max(x for x in far if x < float("inf"))
        high = [h + min(x, most) for h, x in zip(high, far)]
        path, v = [], end
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        amount = min(left[v], room[end - n], *(flow[b, a - n] for a, b in path if a >= n))
        left[v] -= amount
        room[end - n] -= amount
        for a, b in path:
            if a < n:
                flow[a, b - n] = flow.get((a, b - n), 0) + amount
            else:
                flow[b, a - n] -= amount
    return {k: f for k, f in flow.items() if f}


def assign_blocks(blocks: list[tuple[int, int, int]], capacities: list[int]) -> dict[int, int]:
    """New shard of each (block, old shard, size): flow first, then whole blocks for its amounts,
    the largest first; last, blocks too many for their shard go where most room is."""
    olds = sorted({o for _, o, _ in blocks})
    at = {o: i for i, o in enumerate(olds)}
    supply = [0] * len(olds)
    for _, o, s in blocks:
        supply[at[o]] += s
    flow = min_cost_flow(supply, capacities, lambda i, j: int(olds[i] != j))
    room = list(capacities)
    placed: dict = {}
    for b, o, s in sorted(blocks, key=lambda x: (-x[2], x[0])):
        want = [j for j in range(len(capacities)) if flow.get((at[o], j), 0) >= s and room[j] >= s]
        # stay at home when the flow allows it, else fill the largest amount that is left
        j = max(want, key=lambda j: (j == o, flow[at[o], j]), default=None)
        if j is None:
            j = max(range(len(capacities)), key=lambda j: (room[j], -j))
        if (at[o], j) in flow:
            flow[at[o], j] -= s
        room[j] -= s
        placed[b] = j
    return placed


def with_blocks(rows: DataFrame, old_shards: int, shards: int, key: str = "text_hash") -> DataFrame:
    """Adds old_shard and block. Rows of equal key share a block, but a key with more bytes than a
    quarter of a shard is dealt out over blocks by row hash."""
    n = old_shards * BLOCKS
    home = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    sizes = rows.groupBy(key).agg(F.sum("size").alias("s"))
    total = F.sum("size").alias("total")
    bound = rows.agg(total).collect()[0][0] or 0
    hot = F.broadcast(sizes.where(F.col("s") > bound / (4 * shards)).select(key, F.lit(True).alias("hot")))  # fewer than 4 * shards rows
    spread = F.pmod(F.xxhash64("row_hash", F.lit(7)), F.lit(n)).cast("int")
    out = rows.join(hot, key, "left").withColumn("block", F.when(F.col("hot"), spread).otherwise(home)).drop("hot")
    return out.withColumn("old_shard", (F.col("block") % old_shards).cast("int"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard. Numbers are given in small groups of rows, and each
    group starts where the counts of those before it end, so no task orders a whole shard."""
    n = rows.count()
    groups = max(1, n // (40 * ROWS_A_SLOT_GROUP))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row_hash", F.lit(13)), F.lit(64 * groups)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "row_hash")
    numbered = rows.withColumn("i", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "part"]).withColumn("slot", (F.col("start") + F.col("i")).cast("bigint")).drop("part", "i", "start")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16, a null text 16), text_crc32, and the hashes that place a row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.xxhash64("doc_id", text).alias("row_hash"))


def reshard(docs: DataFrame, shards: int = 40, old_shards: int = 32) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard for every row of docs.

    The law is `bytes`. Old shards are what the row hash gives over old_shards; new capacities are
    equal shares. Null texts have size 16; null doc_ids and repeated rows are placed like others;
    an empty table gives an empty result. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    rows = stored(with_blocks(measured(docs), old_shards, shards), "reshard")
    sizes = [(r["block"], r["old_shard"], r["s"]) for r in rows.groupBy("block", "old_shard").agg(F.sum("size").alias("s")).collect()]  # at most old_shards * BLOCKS rows
    total = sum(s for _, _, s in sizes)
    placed = assign_blocks(sizes, [-(-total // shards)] * shards) if sizes else {}
    plan = spark.createDataFrame(list(placed.items()) or [(0, 0)], "block int, shard int")
    out = with_slots(rows.join(F.broadcast(plan), "block"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def _numbered(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """rows with _n, which counts the rows of equal keys from 0; written with their part, so that a
    key's rows are numbered a part at a time and no task orders all of them."""
    rows = stored(rows.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), tag)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_k")).withColumn("_start", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    starts = starts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), "_start")
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_id")
    found = rows.withColumn("_i", F.row_number().over(inside) - 1).join(starts, same)
    return found.withColumn("_n", F.col("_start") + F.col("_i")).drop("_part", "_id", "_i", "_p", "_start", *[f"_{k}" for k in keys])


def rewrite_affected(docs: DataFrame, plan: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Writes the shards that gain or lose rows, each in a folder of its own below path, and
    returns their numbers. plan has keys, old_shard and shard; shards that only keep rows stay.

    Keys may be null or repeat: the k-th row of a key goes where the plan's k-th row of it goes. With
    size and text_crc32 in the plan, as reshard() gives them, these tell texts of one key apart.
    """
    moved = plan.where("old_shard <> shard")
    touched = moved.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    text = F.coalesce("text", F.lit("")) if "text" in docs.columns else None
    extra = {"size": "_size", "text_crc32": "_crc"} if text is not None and {"size", "text_crc32"} <= set(plan.columns) else {}
    rows = docs
    if extra:
        rows = docs.withColumn("_size", (F.octet_length(text) + 16).cast("bigint")).withColumn("_crc", F.crc32(text.cast("binary")))
    by = [*keys, *extra.values()]
    rows = _numbered(rows, by, "rewrite-rows")
    places = _numbered(plan.select(*keys, *[F.col(k).alias(v) for k, v in extra.items()], "shard"), by, "rewrite-plan")
    places = places.select(*[F.col(k).alias(f"_of_{k}") for k in [*by, "_n"]], "shard")
    same = F.lit(True)
    for k in [*by, "_n"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    whole = rows.join(places, same).select(*docs.columns, "shard")
    whole.join(F.broadcast(touched), "shard", "left_semi").repartition("shard", F.pmod(F.xxhash64(*keys), F.lit(8))).write.mode("overwrite").partitionBy("shard").parquet(path)
    return touched


__all__ = ["assign_blocks", "measured", "min_cost_flow", "reshard", "rewrite_affected", "shared_dir", "with_blocks", "with_slots"]
