"""Windows, samples and top-N by group."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str, order: list, keep: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def hash_order(seed: str, key: str) -> Column:
    """A repeatable shuffle's order: md5 of seed and key, the same in any engine."""
    return F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))


def sample_by_bucket(df: DataFrame, bucket: str, key: str, n: Column, seed: str) -> DataFrame:
    """n rows (a column or literal) of each bucket in hash order."""
    w = Window.partitionBy(bucket).orderBy(hash_order(seed, key), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def allocate_with_floor(sizes: dict, total: int, floor: int, min_bucket: int) -> dict:
    """Integer shares of total: buckets of at least min_bucket rows get floor (or all they have), the
    rest follows size by largest remainder, never beyond a bucket's size."""
    names = sorted(sizes)
    out = {k: min(sizes[k], floor) if sizes[k] >= min_bucket else 0 for k in names}
    left = min(total, sum(sizes.values())) - sum(out.values())
    while left > 0:
        room = {k: sizes[k] - out[k] for k in names if sizes[k] > out[k]}
        if not room:
            break
        whole = sum(room.values())
        exact = {k: left * room[k] / whole for k in room}
        add = {k: min(room[k], int(exact[k])) for k in room}
        short = left - sum(add.values())
        for k in sorted(room, key=lambda k: (-(exact[k] - int(exact[k])), k))[:short]:
            if add[k] < room[k]:
                add[k] += 1
        if not any(add.values()):
            break
        for k, x in add.items():
            out[k] += x
        left = min(total, sum(sizes.values())) - sum(out.values())
    return out


def batches(df: DataFrame, order: list, size: int, by: list[str]) -> DataFrame:
    """Adds batch: runs of `size` rows within each `by` group."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("int"))


def trailing_runs(df: DataFrame, by: list[str], order: str, productive: Column) -> DataFrame:
    """Adds dry: how many rows since (and without) the last productive one."""
    w = Window.partitionBy(*by).orderBy(order)
    island = F.sum(F.when(productive, 1).otherwise(0)).over(w)
    marked = df.withColumn("_i", island).withColumn("_p", productive)
    inner = Window.partitionBy(*by, "_i").orderBy(order)
    return marked.withColumn("dry", F.sum(F.when(F.col("_p"), 0).otherwise(1)).over(inner)).drop("_i", "_p")
