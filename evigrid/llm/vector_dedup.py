"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors of a label lexicographically by the concatenated signs of random
projections. The leading bits cut that order into stretches of WIDTH vectors on average; a stretch
and the one behind it form a window, so neighbours across a border meet as well. The number of bits
follows the label's size, the number of passes the bits, such that a pair at the threshold shares no
stretch with probability MISS. A window is compared in tiles of at most CHUNK by CHUNK, however many
vectors it holds, so none is cut off. Ids go through the passes; vectors join them for the tiles.
Pairs are verified in double precision, counted in the first pass that brings them together, and
united across passes.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components
from .tiles import CHUNK, by_tile, groups, spanning

WIDTH = 256
MISS = 1e-4
MOST_BITS = 48
KEYS = ["label", "dim", "pass", "code"]


def passes(bits: int, cosine: float) -> int:
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if bits == 0 else math.ceil(math.log(MISS) / math.log(1 - same))


def _signs(n_pass: int, bits: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng([20_170_107, n_pass, dim])
    return rng.standard_normal((dim, MOST_BITS))[:, :bits]


class Orders:
    """The places of vectors in the order of each pass, cut to the leading bits."""

    def __init__(self, cosine: float):
        self.cosine, self.made = cosine, {}

    def of(self, x: np.ndarray, bits: int, n: int | None = None) -> np.ndarray:
        """rows x passes (the first n of them), for unit vectors of one length."""
        n = passes(bits, self.cosine) if n is None else n
        if not bits or not n:
            return np.zeros((len(x), n), np.int64)
        if (bits, x.shape[1]) not in self.made:
            self.made[bits, x.shape[1]] = np.concatenate([_signs(p, bits, x.shape[1]) for p in range(passes(bits, self.cosine))], axis=1)
        on = (x @ self.made[bits, x.shape[1]][:, :n * bits] > 0).reshape(len(x), n, bits)
        return on @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def unit(column) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps very large and very small ones in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(cosine: float):
    """Rows of one label and length come in runs, since bits and dim are made per run of equal ones."""

    def run(batches):
        orders = Orders(cosine)
        for batch in batches:
            bits, dims = (np.array(batch.column(k).to_pylist(), np.int64) for k in ("bits", "dim"))
            codes: list = [None] * batch.num_rows
            for k, d in {*zip(bits.tolist(), dims.tolist())}:
                at = np.flatnonzero((bits == k) & (dims == d))
                found = orders.of(unit(batch.column("v").take(pa.array(at))), k)
                for i, row in zip(at.tolist(), found.tolist()):
                    codes[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("label", "dim", "bits", "cls")] + [pa.array(codes, pa.list_(pa.int64()))], ["label", "dim", "bits", "cls", "codes"])

    return run


def tiles_of(runs: DataFrame) -> DataFrame:
    """The tiles of each row of runs(label, dim, pass, code, ...): i, j, and own, the row's chunk.

    The window of a code holds that code's rows and those of the next one. The first make nl chunks,
    the second nr further ones; tiles are all pairs of chunks but for those of the second among themselves.
    """
    m = runs.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("nl"), F.count(F.lit(1)).alias("m"))
    behind = m.select("label", "dim", "pass", (F.col("code") - 1).alias("code"), F.col("nl").alias("nr"))
    sizes = m.join(behind, KEYS, "left").withColumn("nr", F.coalesce("nr", F.lit(0))).where("m > 1 or nr > 0").select(*KEYS, "nl", "nr")
    deal = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    left = runs.join(sizes, KEYS).withColumn("own", deal(F.col("nl"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nl") + F.col("nr") - 1)))
    right = runs.withColumn("code", F.col("code") - 1).join(sizes.where("nr > 0"), KEYS).withColumn("own", F.col("nl") + deal(F.col("nr"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)))
    return left.unionByName(right).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "nl", "nr")


def _tile_links(cosine: float):
    def run(batches):
        orders = Orders(cosine)
        for key, rows in groups(batches, 6):
            p, i, j = key[2], key[4], key[5]
            cls, mult = np.array(rows.column("cls").to_pylist()), np.array(rows.column("mult").to_pylist())
            own = np.array(rows.column("own").to_pylist())
            x = unit(rows.column("v"))
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            near = x[left] @ x[right].T >= cosine
            if i == j:
                near &= left[:, None] < right[None, :]
            a, b = np.nonzero(near)
            a, b = left[a], right[b]
            if len(a):
                codes = orders.of(x, rows.column("bits")[0].as_py(), p)
                first = ~(np.abs(codes[a] - codes[b]) <= 1).any(axis=1)  # no window of an earlier pass has had this pair
                a, b = a[first], b[first]
            links = np.bincount(a, mult[b], len(cls)) + np.bincount(b, mult[a], len(cls))
            has = np.flatnonzero(links)
            ends = spanning(a, b)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([cls[has], cls[[u for u, _ in ends]]]) if len(has) else np.empty(0, np.int64), pa.int64()),
                pa.array([None] * len(has) + [int(cls[v]) for _, v in ends], pa.int64()),
                pa.array(links[has].astype(np.int64).tolist() + [0] * len(ends), pa.int64())], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label).

    Vectors are compared when labels and lengths are equal. Vectors that are null, empty or zero,
    hold null or non-finite components, or have a null label link with nothing and stand alone.
    Equal vectors of a label are one class that is compared once; its members link with each other.
    Rows that repeat a vec_id are rows of their own, each with its own links and component; a null
    vec_id stays null and alone. Other columns are not looked at, and an empty table gives none.
    """
    item = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = f"array<{'float' if item == 'float' else 'double'}>"  # single precision becomes double exactly
    whole = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    marked = whole.withColumn("fine", F.coalesce(fine, F.lit(False)))
    classes = marked.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")).withColumn("dim", F.size("v"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / WIDTH))).cast("int")
    sizes = classes.groupBy("label", "dim").agg(F.least(bits, F.lit(MOST_BITS)).alias("bits"))
    coded = classes.join(sizes, ["label", "dim"]).select("label", "dim", "bits", "cls", "v").mapInArrow(_codes(cosine), "label string, dim int, bits int, cls bigint, codes array<bigint>")
    runs = stored(coded.select("label", "dim", "bits", "cls", F.posexplode("codes").alias("pass", "code")), "passes")
    keys = [*KEYS, "i", "j"]
    tiles = by_tile(tiles_of(runs).join(classes.select("cls", "mult", "v"), "cls").select(*keys, "own", "bits", "cls", "mult", "v"), keys)
    found = stored(tiles.mapInArrow(_tile_links(cosine), "a bigint, b bigint, n bigint"), "vector-links")
    links = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    comps = connected_components(found.where("b is not null").select("a", "b"))
    named = comps.join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("root"))
    roots = named.join(least, "component").select(F.col("node").alias("cls"), "root")
    full = classes.select("label", "v", "rep", "mult", "cls").join(links, "cls", "left").join(roots, "cls", "left")
    known = full.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    good = marked.where("fine").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
