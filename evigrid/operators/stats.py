"""Descriptive statistics of whole columns in single aggregations."""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import div
from ..sources.tables import settled

TEXT_LENGTH = 50
SHAPIRO_MOST = 5000


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, x: non-null values of numeric columns, read once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("x is not null")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def counted_before(cells: DataFrame, group: str, value: str, k: str, parts: int = 64) -> DataFrame:
    """Adds before: how many rows of the group stand below each value, of cells (group, value, k rows of
    it). Ranges of the order are summed apart and shifted by the sums before them, so no task orders a group."""
    cut = settled(cells.repartitionByRange(parts, group, value).sortWithinPartitions(group, value).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(group, "_part").agg(F.sum(k).alias("_k")).select(group, "_part", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(F.broadcast(starts), [group, "_part"]).withColumn("before", F.col("_start") + F.coalesce(F.sum(k).over(inside), F.lit(0))).drop("_part", "_start")


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, median of the known values, exact: a sketch brackets the middle to some thousandths of the
    rows, those below are counted, and only the bracket's values are counted one by one and ordered."""
    spark = df.sparkSession
    x = {c: F.col(c).cast("double") for c in columns}
    sketch = df.agg(*[F.struct(F.count(x[c]).alias("n"), F.percentile_approx(x[c], [0.498, 0.502], 10_000).alias("q")).alias(f"_{i}") for i, c in enumerate(columns)]).collect()[0]
    known = {c: (sketch[i]["n"], *sketch[i]["q"]) for i, c in enumerate(columns) if sketch[i]["n"]}
    if not known:
        return spark.createDataFrame([], "column string, median double")
    below = df.agg(*[F.count_if(x[c] < lo).alias(f"_{i}") for i, (c, (_, lo, _)) in enumerate(known.items())]).collect()[0]
    middle = df.select([F.when(x[c].between(lo, hi), x[c]).alias(c) for c, (_, lo, hi) in known.items()])
    cells = long_form(middle, list(known)).groupBy("column", "x").agg(F.count(F.lit(1)).alias("k"))
    start = spark.createDataFrame([(c, n, below[i]) for i, (c, (n, _, _)) in enumerate(known.items())], "column string, n bigint, below bigint")
    placed = counted_before(cells, "column", "x", "k", 8).join(F.broadcast(start), "column").withColumn("first", F.col("below") + F.col("before"))
    at = lambda place: (F.col("first") < place) & (place <= F.col("first") + F.col("k"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    found = placed.groupBy("column").agg(F.max(F.when(at(low), F.col("x"))).alias("lo"), F.max(F.when(at(high), F.col("x"))).alias("hi"))
    # the sketch's error is far below the bracket's width; a miss would be an error, not a wrong number
    middle_of = F.when(F.col("lo").isNull() | F.col("hi").isNull(), F.raise_error(F.lit("the bracket missed the median")).cast("double")).otherwise((F.col("lo") + F.col("hi")) / 2)
    return found.select("column", middle_of.alias("median"))


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, mean, std, median, min, max, skewness, kurtosis; the last two bias-corrected, 0 for a
    constant column, null below 3 and 4 values. Moments come from one aggregation of the rows as they are."""
    columns = columns or numeric_columns(df)
    moments = lambda c, x: F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    one = df.agg(*[moments(c, F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(columns)])
    agg = one.select(F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("m")).select("m.*").where("n > 0").join(F.broadcast(medians(df, columns)), "column")
    n = F.col("n").cast("double")
    flat = F.col("min") == F.col("max")
    skew = F.when(n < 3, None).when(flat, 0.0).otherwise(F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.col("g1"))
    kurt = F.when(n < 4, None).when(flat, 0.0).otherwise(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return agg.select("column", "n", "mean", "std", "median", "min", "max", skew.alias("skewness"), kurt.alias("kurtosis"))


def categorical_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n, percent, is_mode; of equally frequent values the least is the mode."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("_m"), F.sum("n").alias("_t"))
    return counts.join(mode, "column").select("column", "value", "n", (F.col("n") * 100.0 / F.col("_t")).alias("percent"), (F.col("value") == F.col("_m")).alias("is_mode"))


def column_types(df: DataFrame) -> DataFrame:
    """name, dtype (numeric, text above an average length of 50, else categorical), missing_count,
    unique_count. Counts are exact: distinct values are grouped by column, long ones by their SHA-256."""
    numbers = set(numeric_columns(df))
    whole = df.agg(*[F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNull()).alias("missing_count"), F.avg(F.length(F.col(c).cast("string"))).alias("avg_len"), F.lit(c in numbers).alias("num")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    one = whole.select(F.explode(F.array(*[f"_{i}" for i in range(len(df.columns))])).alias("s")).select("s.*")
    value = lambda c: F.when(F.length(F.col(c).cast("string")) > 64, F.concat(F.lit("#"), F.sha2(F.col(c).cast("string"), 256))).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    seen = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), value(c).alias("v")) for c in df.columns])).alias("s")).select("s.*").where("v is not null").groupBy("name", "v").agg(F.lit(1).alias("one"))
    unique = seen.groupBy("name").agg(F.count(F.lit(1)).alias("unique_count"))
    kind = F.when(F.col("num"), "numeric").when(F.col("avg_len") > TEXT_LENGTH, "text").otherwise("categorical")
    return one.join(F.broadcast(unique), "name", "left").select("name", kind.alias("dtype"), "missing_count", F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"))


def data_type(types: DataFrame) -> DataFrame:
    """quantitative, qualitative or mixed, of column_types' rows."""
    has = lambda k: F.coalesce(F.bool_or(F.col("dtype") == k), F.lit(False))
    agg = types.agg(has("numeric").alias("n"), has("text").alias("t"), has("categorical").alias("c"))
    return agg.select(F.when(F.col("t") & F.col("n"), "mixed").when(F.col("t"), "qualitative").when(F.col("n") & F.col("c"), "mixed").when(F.col("n"), "quantitative").otherwise("qualitative").alias("data_type"))


def _corr(x, y):
    """Pearson r of pairs, null without variance; sums about nothing would lose digits, so moments are Spark's own."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / F.when(F.stddev_pop(x) * F.stddev_pop(y) > 0, F.stddev_pop(x) * F.stddev_pop(y)))


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """a, b, r for every pair of columns, over the rows where both are known. One pass for pearson."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    if method == "spearman":
        return _spearman(df, pairs)
    both = lambda a, b, c: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double"))
    one = df.agg(*[_corr(both(a, b, a), both(a, b, b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def _spearman(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson of average ranks. Ranks come from counts by value: values are few to order, rows many,
    so the running sum is over distinct values of a pair, and joined back by value."""
    spread = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*").where("x is not null and y is not null")
    cells = spread.groupBy("p", "x", "y").agg(F.count(F.lit(1)).alias("k"))

    def ranks(c):
        by = cells.groupBy("p", c).agg(F.sum("k").alias("m"))
        return counted_before(by, "p", c, "m").select("p", c, (F.col("before") + (F.col("m") + 1) / 2.0).alias(f"r{c}"))

    ranked = cells.join(ranks("x"), ["p", "x"]).join(ranks("y"), ["p", "y"])
    k, x, y = F.col("k").cast("double"), F.col("rx"), F.col("ry")
    agg = ranked.groupBy("p").agg(F.sum(k).alias("n"), F.sum(k * x).alias("sx"), F.sum(k * y).alias("sy"), F.sum(k * x * y).alias("sxy"), F.sum(k * x * x).alias("sxx"), F.sum(k * y * y).alias("syy"))
    cov, vx, vy = (F.col("n") * F.col(s) - F.col(a) * F.col(b) for s, a, b in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return agg.select(F.element_at(names, F.col("p") + 1).alias("n"), F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy))).alias("r")).select("n.*", "r")


def k_squared(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, statistic, p_value: D'Agostino's test from skewness and kurtosis, in closed form."""
    x = F.col("x")
    agg = long_form(df, columns).groupBy("column").agg(F.count(x).cast("double").alias("n"), F.skewness(x).alias("g1"), (F.kurtosis(x) + 3).alias("b2")).where("n >= 20")
    n = F.col("n")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    alpha = F.sqrt(2.0 / (w2 - 1))
    z1 = 1 / F.sqrt(0.5 * F.log(w2)) * F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    s = (F.col("b2") - e) / F.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + F.sqrt(1 + 4.0 / (root * root)))
    d = 1 + s * F.sqrt(2.0 / (a - 4))
    z2 = (1 - 2.0 / (9.0 * a) - F.signum(d) * F.pow((1 - 2.0 / a) / F.abs(d), F.lit(1.0 / 3))) / F.sqrt(2.0 / (9.0 * a))
    k2 = z1 * z1 + z2 * z2
    return agg.select("column", k2.alias("statistic"), F.exp(-k2 / 2).alias("p_value"))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and its p-value by Royston's approximation (1995), for 3 to 5000 values."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return float("nan"), float("nan")
    from statistics import NormalDist

    inv, cdf = NormalDist().inv_cdf, NormalDist().cdf
    m = np.array([inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    c = m / math.sqrt(mm)
    a = c.copy()
    if n > 3:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[-1], a[0] = last, -last
    else:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        z = (-math.log(g - math.log(1 - w)) - mu) / sigma if w < 1 else -8
    else:
        ln = math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
        z = (math.log(1 - w) - mu) / sigma if w < 1 else -8
    return w, 1 - cdf(z)


def normality(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, test, statistic, p_value, is_normal: Shapiro-Wilk up to 5000 values, else K squared.

    Only columns of at most 5000 values are brought together, each in a task of its own.
    """
    long = long_form(df, columns)
    few = long.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 3) & (F.col("n") <= SHAPIRO_MOST)).select("column")

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        w, p = shapiro_wilk(rows.column("x").to_numpy())
        return pa.table({"column": [key[0].as_py()], "statistic": [w], "p_value": [p]})

    shapiro = long.join(few, "column", "left_semi").groupBy("column").applyInArrow(run, "column string, statistic double, p_value double").withColumn("test", F.lit("shapiro"))
    k2 = k_squared(df, columns).join(few, "column", "left_anti").withColumn("test", F.lit("k_squared"))
    return shapiro.unionByName(k2).select("column", "test", "statistic", "p_value", (F.col("p_value") > 0.05).alias("is_normal"))


def missing_share(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[div(F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias(c) for c in columns])
