"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least node of u and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, are tied to the least of them. Edges hold a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    kept = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (its least node) for every node of edges(a, b) that has a neighbour.

    Rows with a null or with a = b are passed over; repeated and reversed rows count once. Each
    round is written to the shared folder, so a lost executor costs one round at most.
    """
    ordered = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = stored(ordered, "edges"), None
    for _ in range(most):
        now = stored(_small(_large(now)), "stars")
        # a star forest maps every node to one root; the sums stop changing when it is reached
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if tuple(found) == mark:
            break
        mark = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionAll(roots.select(F.col("component").alias("node"), "component").distinct())
