"""Duplicate records: by DOI, by DOI or title in arrival order, by external id."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_key
from ..sources.tables import settled


def best_by_doi(records: DataFrame, doi: str = "doi", cites: str = "citation_count", pos: str = "pos") -> DataFrame:
    """One record for each lower-case DOI: the most cited, the first on ties. Records without a DOI
    all stay and come last. `rank` gives the order: a DOI's first sighting, then the rest."""
    has = F.coalesce(F.length(doi) > 0, F.lit(False))
    best = F.struct(F.coalesce(F.col(cites), F.lit(0)).alias("c"), (-F.col(pos)).alias("p"))
    whole = F.struct(*[F.col(c) for c in records.columns])
    # aggregation, not a window: a hot DOI is combined before the shuffle
    kept = records.where(has).groupBy(F.lower(doi).alias("_k")).agg(F.max_by(whole, best).alias("_r"), F.min(pos).alias("first_pos")).select("_r.*", "first_pos", F.lit(0).alias("tier"))
    return kept.unionByName(records.where(~has).withColumn("first_pos", F.col(pos)).withColumn("tier", F.lit(1)))


def first_by(records: DataFrame, key, pos: str = "pos") -> DataFrame:
    """The earliest record of every key."""
    whole = F.struct(*[F.col(c) for c in records.columns])
    return records.groupBy(key.alias("_k")).agg(F.min_by(whole, F.col(pos)).alias("_r")).select("_r.*")


def merged_by_id(records: DataFrame, key: str, label: str, firsts: list[str], pos: str) -> DataFrame:
    """One row for each external id: greatest label, first known value of `firsts`; null ids go."""
    known = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(c)
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias(label), *[known(c) for c in firsts], F.count(F.lit(1)).alias("n_rows"))


def least_first(pairs: DataFrame) -> DataFrame:
    """pos of the rows that a pass in order of pos keeps, where pairs(pos, key) has a row for each key
    of a row and a kept row shuts out all later ones that share a key.

    In a round the rows that are least under all their keys are kept and their neighbours go; the
    least row of all is one of these, so the rounds end with nothing left. Each is checkpointed.
    """
    left, kept = settled(pairs), []
    while not left.isEmpty():
        least = left.groupBy("key").agg(F.min("pos").alias("least"))
        now = settled(left.join(least, "key").groupBy("pos").agg(F.bool_and(F.col("pos") == F.col("least")).alias("first")).where("first").select("pos"))
        shut = left.join(now, "pos", "left_semi").select("key").distinct()
        gone = left.join(shut, "key", "left_semi").select("pos").distinct()
        left = settled(left.join(gone, "pos", "left_anti"))
        kept.append(now)
    out = pairs.select("pos").limit(0)
    for now in kept:
        out = out.unionAll(now)
    return out


def sequential(records: DataFrame, register_dropped_doi: bool = False) -> DataFrame:
    """Records kept by a pass in order of pos that drops what has a seen DOI or title key.

    A dropped record registers nothing, unless register_dropped_doi: then its DOI counts as seen, so
    the first record of each DOI alone can be kept, and of those the first of each title. A missing
    DOI or title is no key. Otherwise records of equal keys collapse to their first before the rounds.
    """
    keyed = records.withColumn("_d", F.lower(F.nullif(F.trim("doi"), F.lit("")))).withColumn("_t", title_key("title"))
    if register_dropped_doi:
        firsts = keyed.where("_d is not null").groupBy("_d").agg(F.min_by("_t", "pos").alias("_t"), F.min("pos").alias("pos")).select("_t", "pos")
        firsts = firsts.unionAll(keyed.where("_d is null").select("_t", "pos"))
        kept = firsts.where("_t is not null").groupBy("_t").agg(F.min("pos").alias("pos")).select("pos").unionAll(firsts.where("_t is null").select("pos"))
    else:
        rows = keyed.where("_d is not null or _t is not null").groupBy("_d", "_t").agg(F.min("pos").alias("pos"))
        pairs = rows.select("pos", F.explode(F.array_compact(F.array(F.concat(F.lit("d:"), "_d"), F.concat(F.lit("t:"), "_t")))).alias("key"))
        kept = least_first(pairs).unionAll(keyed.where("_d is null and _t is null").select("pos"))
    return records.join(kept, "pos", "left_semi")


def distinct_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.where(F.col(src) != F.col(dst)).select(src, dst).distinct()


def numbered_keys(cites: DataFrame, doc: str, key: str, pos: str) -> DataFrame:
    """doc, key, number: cited keys numbered by first appearance in their document."""
    first = cites.groupBy(doc, key).agg(F.min(pos).alias("at"))
    return first.select(doc, key, F.row_number().over(Window.partitionBy(doc).orderBy("at", key)).alias("number"))
