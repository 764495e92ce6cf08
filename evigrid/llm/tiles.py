"""Groups compared all against all in tiles of bounded size.

A group of m rows is cut to chunks of at most CHUNK rows; a row goes to the tiles of its chunk
with every chunk, itself included, so each pair of rows meets in exactly one tile.
"""
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 256


def tile_rows(rows: DataFrame, group: list[str], sizes: DataFrame, by, chunk: int = CHUNK) -> DataFrame:
    """Adds tile (a hash), i, j and own (this row's chunk) to each row, once for each tile that it
    is in. sizes has the group columns and m, the group's row count; by deals rows to chunks."""
    n = F.ceil(F.col("m") / chunk).cast("int")
    cut = rows.join(sizes, group).withColumn("n_chunks", n).withColumn("own", F.pmod(F.xxhash64(by), F.col("n_chunks")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    pair = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return pair.withColumn("tile", F.xxhash64(*group, "i", "j")).drop("other", "m", "n_chunks")


def by_tile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a tile side by side in one partition. Ranges hold equal shares of the rows."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def groups(batches, n_keys: int):
    """Arrow tables of equal leading key columns out of sorted batches."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys))))
        start = 0
        for at in range(1, len(keys) + 1):
            if at == len(keys) or keys[at] != keys[start]:
                if key is not None and keys[start] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = keys[start]
                held.append(batch.slice(start, at - start))
                start = at
    if held:
        yield key, pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1; join() tells whether two trees met."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def spanning(rows_at, cols_at) -> list[tuple[int, int]]:
    """Of the pairs given by two index arrays, as many as tie together what they tie together."""
    ends = {}
    forest = Forest(int(max(rows_at.max(), cols_at.max())) + 1) if len(rows_at) else None
    for x, y in zip(rows_at.tolist(), cols_at.tolist()):
        if forest.join(x, y):
            ends[x, y] = True
    return list(ends)
