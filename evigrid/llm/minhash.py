"""MinHash near-dedup: universal hash minima, banding, signature and full-set verification, components.

Documents of equal shingle sets form a class and only its least doc_id goes on. Bands tie classes
that may be alike; what they tie together is compared in bounded tiles, first by signature, then on
the full sets. Verified links go to connected components.
"""
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WordHash, mix64, small_batches, stored
from .components import connected_components
from .tiles import CHUNK, by_tile, groups, spanning, tile_rows

ROWS = 6
MISS = 1e-4
MARGIN = 0.14  # of the signature's estimate below the threshold: over four standard deviations
BUCKETS = 1 << 16
_WORD = re.compile(BLANK)
_SEED = np.random.default_rng(20_140_314)
_TURN = [np.uint64(int(x) | 1) for x in _SEED.integers(0, 2**63, 64)]


def bands(threshold: float) -> int:
    """Bands of ROWS minima by which a pair at the threshold is missed with probability MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word hashes' runs of `size`; a shorter text is one run."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix64(out + words[i:i + n] * _TURN[i])
    return np.unique(out + np.uint64(k))


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each multiply-shift hash over the set."""
    least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), 4096):
        part = ((found[at:at + 4096][:, None] * a[None, :] + b[None, :]) >> np.uint64(32)).astype(np.uint32)
        least = np.minimum(least, part.min(axis=0))
    return least


def _family(threshold: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1_997)
    n = ROWS * bands(threshold)
    return rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n).astype(np.uint64)


def _features(size: int, threshold: float):
    def run(batches):
        hashes, (a, b) = WordHash(), _family(threshold)
        turn = np.array(_TURN[:ROWS], np.uint64)
        salt = mix64(np.arange(1, len(a) // ROWS + 1, dtype=np.uint64))
        for batch in batches:
            n, keys, codes = [], [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                found = shingles(hashes.of(_WORD.findall(raw.lower())), size) if raw else np.empty(0, np.uint64)
                n.append(len(found))
                if not len(found):
                    keys.append(None)
                    codes.append([])
                    continue
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                low = signature(found, a, b).astype(np.uint64).reshape(-1, ROWS)
                codes.append(mix64((low * turn).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "bands"])

    return run


def _sets(size: int, threshold: float):
    """Full sets and signatures of the few documents that go to tiles."""

    def run(batches):
        hashes, (a, b) = WordHash(), _family(threshold)
        for batch in batches:
            got, sigs = [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                found = shingles(hashes.of(_WORD.findall((raw or b"").lower())), size)
                got.append(found.tobytes())
                sigs.append(signature(found, a, b).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grp"), pa.array(got, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "grp", "found", "sig"])

    return run


def overlaps(sets: list, left: np.ndarray, right: np.ndarray, width: int = 16_384) -> np.ndarray:
    """Exact intersection sizes of sets[left] x sets[right], by products over slices of the shared values."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    owner, column = owner[keep], shared[at[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[i:j], column[i:j] - lo] = 1
        out += grid[left] @ grid[right].T
    return out.astype(np.int64)


def tile_links(sets: list, sigs: np.ndarray, left: np.ndarray, right: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) with whole * intersection >= part * union, signatures first."""
    alike = np.zeros((len(left), len(right)), bool)
    least = (part / whole - MARGIN) * sigs.shape[1]
    for x in range(len(left)):
        alike[x] = (sigs[left[x]][None, :] == sigs[right]).sum(axis=1) >= least
    alike &= left[:, None] < right[None, :]
    if not alike.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows, cols = np.flatnonzero(alike.any(axis=1)), np.flatnonzero(alike.any(axis=0))
    used = np.unique(np.concatenate([left[rows], right[cols]]))
    spot = np.zeros(len(sets), np.int64)
    spot[used] = np.arange(len(used))
    both = overlaps([sets[u] for u in used], spot[left[rows]], spot[right[cols]])
    size = np.array([len(s) for s in sets], np.int64)
    union = size[left[rows]][:, None] + size[right[cols]][None, :] - both
    x, y = np.nonzero((whole * both >= part * union) & alike[np.ix_(rows, cols)])
    return left[rows[x]], right[cols[y]]


def _tile_edges(part: int, whole: int):
    def run(batches):
        for _, rows in groups(batches, 4):
            ids, own = rows.column("doc_id").to_pylist(), np.array(rows.column("own").to_pylist())
            sets = [np.frombuffer(f, np.uint64) for f in rows.column("found").to_pylist()]
            sigs = np.stack([np.frombuffer(s, "<u2") for s in rows.column("sig").to_pylist()])
            i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
            every = np.arange(len(ids))
            if i == j:
                x, y = tile_links(sets, sigs, every, every, part, whole)
            else:
                order = np.argsort(own, kind="stable")  # so that the first chunk's places are below the second's
                sets, sigs, ids = [sets[o] for o in order], sigs[order], [ids[o] for o in order]
                cut = int((own == i).sum())
                x, y = tile_links(sets, sigs, every[:cut], every[cut:], part, whole)
            ends = spanning(x, y)
            yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in ends], pa.int64()), pa.array([ids[b] for _, b in ends], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Links hold where whole * intersection >= part * union of the sets of `size`-word shingles.
    Null texts and texts without words have an empty set and no links; a shorter text is one
    shingle. Rows that repeat a doc_id are each returned and share its component, whatever their texts
    (but for those without words, which stand alone); rows with a null
    doc_id are returned with a null component and are not linked. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    threshold = part / whole
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    feats = stored(base.mapInArrow(_features(size, threshold), "doc_id bigint, n_shingles bigint, key binary, bands array<bigint>"), "features")
    full = feats.where("key is not null and doc_id is not null")
    classes = full.groupBy("key").agg(F.min("doc_id").alias("rep"))
    heads = stored(full.groupBy("key").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("doc_id")).select("doc_id", F.posexplode("bands").alias("band", "code")), "bands")
    buckets = heads.groupBy("band", "code").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    maybe = heads.join(buckets.hint("merge"), ["band", "code"]).where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    cand = stored(connected_components(maybe).select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "candidates")
    sizes = cand.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    near = F.broadcast(cand.select(spot.alias("spot")).distinct())  # at most BUCKETS rows; it only thins the scan
    thin = base.where("doc_id is not null").withColumn("spot", spot).join(near, "spot", "left_semi").drop("spot")
    texts = thin.join(cand.hint("merge"), "doc_id").mapInArrow(_sets(size, threshold), "doc_id bigint, grp bigint, found binary, sig binary")
    tiles = by_tile(tile_rows(texts, ["grp"], sizes, F.col("doc_id")).select("tile", "grp", "i", "j", "own", "doc_id", "found", "sig"), ["tile", "grp", "i", "j"])
    links = stored(tiles.mapInArrow(_tile_edges(part, whole), "a bigint, b bigint"), "links")
    # classes that have a doc_id in common are one
    twice = full.groupBy("doc_id").agg((F.min("key") != F.max("key")).alias("twice")).where("twice").select("doc_id")
    ties = full.join(twice, "doc_id").join(classes, "key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comps = connected_components(links.unionAll(ties))
    roots = classes.join(comps, classes["rep"] == comps["node"], "left").select("key", F.coalesce("component", "rep").alias("root"))
    out = feats.where("key is not null").join(roots, "key", "left")
    empty = feats.where("key is null").withColumn("root", F.lit(None).cast("bigint"))
    both = out.select("doc_id", "n_shingles", "root").unionAll(empty.select("doc_id", "n_shingles", "root"))
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return both.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


__all__ = ["CHUNK", "bands", "near_duplicates", "overlaps", "shingles", "signature"]
