"""Descriptive statistics of numeric and categorical columns."""
from pyspark.sql import functions as F

from ..operators import stats
from ..registry import query
from ..sources.tables import table

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = " union all ".join(f"select '{c}' as \"column\", cast({c} as double) as x from lineitem" for c in _COLS)


def _rounded(df, names, places=6):
    return df.withColumns({c: F.round(c, places) for c in names})


@query(f"""with l as ({_LONG}) select "column", count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, round(median(x), 6) as median, min(x) as min, max(x) as max, round(skewness(x), 6) as skewness, round(kurtosis(x), 6) as kurtosis from l group by 1""")
def numeric_stats(spark, d):
    return _rounded(stats.numeric_stats(table(spark, d, "lineitem"), _COLS), ["mean", "std", "median", "skewness", "kurtosis"])


@query("""with l as (select 'l_returnflag' as "column", l_returnflag as value from lineitem union all select 'l_linestatus', l_linestatus from lineitem), c as (select "column", value, count(*) as n from l group by 1, 2) select "column", value, n, round(n * 100.0 / sum(n) over (partition by "column"), 6) as percent, row_number() over (partition by "column" order by n desc, value) = 1 as is_mode from c""")
def categorical_stats(spark, d):
    return _rounded(stats.categorical_stats(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]), ["percent"])


@query("""select * from (values ('p_partkey', 'numeric'), ('p_name', 'categorical'), ('p_brand', 'categorical'), ('p_type', 'categorical'), ('p_size', 'numeric'), ('p_retailprice', 'numeric')) as v(name, dtype) join (select 'p_partkey' as name, count(*) - count(p_partkey) as missing_count, count(distinct p_partkey) as unique_count from part union all select 'p_name', count(*) - count(p_name), count(distinct p_name) from part union all select 'p_brand', count(*) - count(p_brand), count(distinct p_brand) from part union all select 'p_type', count(*) - count(p_type), count(distinct p_type) from part union all select 'p_size', count(*) - count(p_size), count(distinct p_size) from part union all select 'p_retailprice', count(*) - count(p_retailprice), count(distinct p_retailprice) from part) u using (name)""")
def column_types(spark, d):
    return stats.column_types(table(spark, d, "part"))


@query("select 'mixed' as data_type from part limit 1")
def dataset_type(spark, d):
    return stats.data_type(stats.column_types(table(spark, d, "part")))


_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i:]]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for a, b in _PAIRS))
def pearson(spark, d):
    return _rounded(stats.correlations(table(spark, d, "lineitem"), _COLS), ["r"])


_RANK = "(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0)"


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, (select round(corr(x, y), 6) from (select {_RANK.format(c=a)} as x, {_RANK.format(c=b)} as y from part)) as r" for a, b in [("p_size", "p_size"), ("p_size", "p_retailprice"), ("p_retailprice", "p_retailprice")]))
def spearman(spark, d):
    return _rounded(stats.correlations(table(spark, d, "part"), ["p_size", "p_retailprice"], "spearman"), ["r"])


@query()
def normality(spark, d):
    """Shapiro-Wilk where it applies, else K squared; tests compare with tabled values."""
    return stats.normality(table(spark, d, "part"), ["p_size", "p_retailprice"]).unionByName(stats.normality(table(spark, d, "lineitem"), ["l_quantity"]))


@query("""with l as (select 'l_quantity' as "column", cast(l_quantity as double) as x from lineitem union all select 'l_extendedprice', l_extendedprice from lineitem), m as (select "column", avg(x) as mu from l group by 1), a as (select "column", cast(count(*) as double) as n, avg(power(x - mu, 2)) as m2, avg(power(x - mu, 3)) as m3, avg(power(x - mu, 4)) as m4 from l join m using ("column") group by 1),
g as (select *, m3 / power(m2, 1.5) as g1, m4 / (m2 * m2) as b2 from a), h as (select *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) as beta from g), i as (select *, sqrt(2 * (beta - 1)) - 1 as w2 from h), j as (select *, sqrt(2 / (w2 - 1)) as al from i),
k as (select *, 1 / sqrt(0.5 * ln(w2)) * ln(y / al + sqrt(y / al * y / al + 1)) as z1, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) as s, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as rt from j), l2 as (select *, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / (rt * rt))) as aa from k), q as (select *, 1 + s * sqrt(2 / (aa - 4)) as dd from l2)
select "column", round(z1 * z1 + power((1 - 2 / (9 * aa) - sign(dd) * power((1 - 2 / aa) / abs(dd), 1.0 / 3)) / sqrt(2 / (9 * aa)), 2), 3) as statistic from q""")
def k_squared(spark, d):
    return stats.k_squared(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("column", F.round("statistic", 3).alias("statistic"))
