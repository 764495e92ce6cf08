"""Screening and agreement metrics. What is undefined is null, never 0 or 1."""
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import div, wilson
from ..sources.tables import settled


def counts(label: str, pred: str) -> list[Column]:
    """tp, fp, tn, fn and n_skipped (null predictions) as aggregates."""
    y, p = F.col(label), F.col(pred)
    return [F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if(p.isNull()).alias("n_skipped")]


def binary(df: DataFrame) -> DataFrame:
    """The headline row from tp, fp, tn, fn (other columns stay in front)."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    r, p = div(tp, tp + fn), div(tp, tp + fp)
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r)))
    saved = div(tn + fn, n)
    out = {"n": n.cast("bigint"), "prevalence": div(tp + fn, n), "recall": r, "precision": p, "specificity": div(tn, tn + fp), "f1": f1, "inclusion_rate": div(tp + fp, n), "wss_at_achieved_recall": saved - (1 - r), "wss_at_95": F.when(r >= 0.95, saved - (1.0 - 0.95))}
    return df.withColumns(out)


def ranked(df: DataFrame, score: str, pos: str, parts: int = 64) -> DataFrame:
    """Adds rank from 1 by score descending, pos ascending, over the whole frame without one task
    ordering all of it: ranges of the order are numbered apart and shifted by the counts before."""
    cut = settled(df.repartitionByRange(parts, F.desc(score), F.asc(pos)).sortWithinPartitions(F.desc(score), F.asc(pos)).withColumn("_part", F.spark_partition_id()))
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start")
    inner = Window.partitionBy("_part").orderBy(F.desc(score), F.asc(pos))
    return cut.withColumn("_i", F.row_number().over(inner)).join(F.broadcast(start), "_part").withColumn("rank", F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")


def wss_of_ranking(df: DataFrame, score: str, label: str, pos: str, level: float = 0.95) -> DataFrame:
    """n, n_pos, screened, wss: rows above and at the place where `level` of the positives are found.

    The k-th positive of the ranking is the one sought, so only positives are numbered among each other.
    """
    placed = ranked(df, score, pos)
    total = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"))
    hit = placed.where(F.col(label) == 1).select("rank")
    numbered = ranked(hit.withColumnRenamed("rank", "at").withColumn("_s", -F.col("at")), "_s", "at")
    n, n_pos = total.collect()[0]
    target = math.ceil(level * n_pos - 1e-9)
    at = numbered.where(F.col("rank") == target).select(F.col("at").alias("screened"))
    return at.select(F.lit(n).cast("bigint").alias("n"), F.lit(n_pos).cast("bigint").alias("n_pos"), "screened", ((F.lit(n) - F.col("screened")) / F.lit(float(max(n, 1))) - (1.0 - level)).alias("wss"))


def top_k(df: DataFrame, score: str, pos: str, k: int) -> DataFrame:
    """Adds predicted: 1 for exactly the k highest scores, ties by pos."""
    return ranked(df, score, pos).withColumn("predicted", (F.col("rank") <= k).cast("int")).drop("rank")


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """n, po, pe, kappa of two raters over rows that both rated; from the contingency table, so the
    data is read once and only label pairs are kept."""
    by = by or []
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).agg(F.count(F.lit(1)).alias("k"))
    total = cells.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("k")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(*by, F.col("_a").alias("v")).agg(F.sum("k").alias("x")), cells.groupBy(*by, F.col("_b").alias("v")).agg(F.sum("k").alias("y"))
    chance = left.join(right, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    both = total.join(chance, by, "left") if by else total.join(F.broadcast(chance), F.lit(True), "left")
    n = F.col("n").cast("double")
    po, pe = div("same", n), F.coalesce(F.try_divide(F.col("xy"), n * n), F.lit(0.0))
    return both.where("n > 0").select(*by, "n", po.alias("po"), pe.alias("pe"), F.when(F.abs(pe - 1) > 1e-9, F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def per_code_kappa(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """code, kappa, agreement_pct for every row of codes(code); null where neither coder used it.

    pairs(a, b): the primary codes of the segments both have coded. Uses counts only.
    """
    n = pairs.agg(F.count(F.lit(1)).alias("n"))
    use = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("code"), F.lit(1).alias("x"), F.lit(0).alias("y"), (F.col("a") == F.col("b")).cast("int").alias("z")), F.struct(F.col("b").alias("code"), F.lit(0).alias("x"), F.lit(1).alias("y"), F.lit(0).alias("z")))).alias("s")).groupBy("s.code").agg(F.sum("s.x").cast("double").alias("x"), F.sum("s.y").cast("double").alias("y"), F.sum("s.z").cast("double").alias("z"))
    t = codes.join(use, "code", "left").join(F.broadcast(n)).na.fill(0.0, ["x", "y", "z"])
    m = F.col("n").cast("double")
    po = F.try_divide(m - F.col("x") - F.col("y") + 2 * F.col("z"), m)
    pe = F.try_divide(F.col("x") * F.col("y") + (m - F.col("x")) * (m - F.col("y")), m * m)
    used = (F.col("x") > 0) | (F.col("y") > 0)
    return t.select("code", F.when(used & (F.abs(pe - 1) > 1e-9), F.try_divide(po - pe, 1 - pe)).alias("kappa"), (100 * po).alias("agreement_pct"))


def per_class(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """label, support, n_pred, precision, recall, f1 of every gold class; f1 is 0 if it is never predicted."""
    spread = df.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(pred)).cast("int").alias("t")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("s")).select("s.*").where("label is not null")
    agg = spread.groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("n_pred"), F.sum(F.coalesce("t", F.lit(0))).alias("tp"))
    p, r = div("tp", "n_pred"), div("tp", "support")
    f1 = F.when(p.isNull() | (p + r == 0), 0.0).otherwise(F.try_divide(2 * p * r, p + r))
    return agg.where("support > 0").select("label", "support", "n_pred", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def with_wilson(df: DataFrame, count: str, n: str) -> DataFrame:
    lo, hi = wilson(count, n)
    return df.withColumn("lo", lo).withColumn("hi", hi)


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, median, nearest-rank p90, mean and total of the known values."""
    x = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.median(x).alias("median"), F.expr(f"percentile_disc(0.9) within group (order by cast({value} as double))").alias("p90"), F.avg(x).alias("mean"), F.sum(x).alias("total"))


def fleiss(df: DataFrame, item: str, label: str) -> DataFrame:
    """n_items, p_bar, p_e, kappa; every item has the same number of ratings."""
    cells = df.groupBy(item, label).agg(F.count(F.lit(1)).cast("double").alias("k"))
    items = cells.groupBy(item).agg(F.sum("k").alias("r"), F.sum(F.col("k") * F.col("k")).alias("q")).where("r > 1")
    agree = items.agg(F.count(F.lit(1)).alias("n_items"), F.avg((F.col("q") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("p_bar"), F.sum("r").alias("all"))
    share = cells.groupBy(label).agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    both = agree.join(F.broadcast(share))
    pe = F.try_divide(F.col("kk"), F.col("all") * F.col("all"))
    return both.select("n_items", "p_bar", pe.alias("p_e"), F.when(F.abs(pe - 1) > 1e-9, F.try_divide(F.col("p_bar") - pe, 1 - pe)).alias("kappa"))


def majority(df: DataFrame, item: str, label: str, least: int = 2) -> DataFrame:
    """item, label of items where one label has at least `least` votes and more than any other."""
    votes = df.groupBy(item, label).agg(F.count(F.lit(1)).alias("k"))
    best = votes.groupBy(item).agg(F.max("k").alias("m"))
    top = votes.join(best, item).where((F.col("k") == F.col("m")) & (F.col("m") >= least))
    return top.groupBy(item).agg(F.min(label).alias(label), F.count(F.lit(1)).alias("_t")).where("_t = 1").drop("_t")
