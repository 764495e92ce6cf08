"""Screening quality, agreement and ranking metrics."""
from pyspark.sql import functions as F

from ..operators import metrics
from ..registry import query
from ..sources.tables import table
from .views import SCREENED_SQL, screened

_C = "count(*) filter (where label = 1 and predicted = 1) as tp, count(*) filter (where label = 0 and predicted = 1) as fp, count(*) filter (where label = 0 and predicted = 0) as tn, count(*) filter (where label = 1 and predicted = 0) as fn, count(*) filter (where predicted is null) as n_skipped"
_M = """tp, fp, tn, fn, n_skipped, tp + fp + tn + fn as n, round((tp + fn) / nullif(cast(tp + fp + tn + fn as double), 0), 9) as prevalence, round(tp / nullif(cast(tp + fn as double), 0), 9) as recall, round(tp / nullif(cast(tp + fp as double), 0), 9) as precision, round(tn / nullif(cast(tn + fp as double), 0), 9) as specificity,
round(case when tp + fn > 0 and tp + fp > 0 then case when tp = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end end, 9) as f1, round((tp + fp) / nullif(cast(tp + fp + tn + fn as double), 0), 9) as inclusion_rate, round((tn + fn) / nullif(cast(tp + fp + tn + fn as double), 0) - (1 - tp / nullif(cast(tp + fn as double), 0)), 9) as wss_at_achieved_recall, round(case when tp / nullif(cast(tp + fn as double), 0) >= 0.95 then (tn + fn) / cast(tp + fp + tn + fn as double) - 0.05 end, 9) as wss_at_95"""
_NAMES = ["prevalence", "recall", "precision", "specificity", "f1", "inclusion_rate", "wss_at_achieved_recall", "wss_at_95"]


def _round(df, names, places=9):
    return df.withColumns({c: F.round(c, places) for c in names})


@query(f"with {SCREENED_SQL}, c as (select {_C} from screened) select {_M} from c")
def screening_metrics(spark, d):
    return _round(metrics.binary(screened(spark, d).agg(*metrics.counts("label", "predicted"))), _NAMES)


@query(f"with {SCREENED_SQL}, c as (select lang, {_C} from screened group by lang) select lang, {_M} from c")
def screening_metrics_by_language(spark, d):
    return _round(metrics.binary(screened(spark, d).groupBy("lang").agg(*metrics.counts("label", "predicted"))), _NAMES)


@query(f"with {SCREENED_SQL}, c as (select {_C} from (select label, coalesce(predicted, 1) as predicted from screened)) select {_M} from c")
def screening_metrics_none_as_included(spark, d):
    filled = screened(spark, d).withColumn("predicted", F.coalesce("predicted", F.lit(1)))
    return _round(metrics.binary(filled.agg(*metrics.counts("label", "predicted"))), _NAMES)


@query(f"""with {SCREENED_SQL}, r as (select label, row_number() over (order by score desc, doc_id) as rk from screened), c as (select *, sum(label) over (order by rk) as cum from r), t as (select count(*) as n, sum(label) as n_pos from screened)
select n, cast(n_pos as bigint) as n_pos, min(rk) as screened, round((n - min(rk)) / cast(n as double) - 0.05, 9) as wss from c, t where cum >= ceil(0.95 * n_pos - 1e-9) group by n, n_pos""")
def wss_of_ranking(spark, d):
    return _round(metrics.wss_of_ranking(screened(spark, d).select("doc_id", "score", "label"), "score", "label", "doc_id"), ["wss"])


@query(f"""with {SCREENED_SQL}, r as (select doc_id, score, row_number() over (order by score desc, doc_id) as rk from screened) select doc_id, cast(rk <= 120 as integer) as predicted from r""")
def matched_count_baseline(spark, d):
    return metrics.top_k(screened(spark, d).select("doc_id", "score"), "score", "doc_id", 120).select("doc_id", "predicted")


_KAPPA = """cells as (select {g} cast(a as varchar) as a, cast(b as varchar) as b, count(*) as k from x where a is not null and b is not null group by all), t as (select {g} sum(k) as n, sum(case when a = b then k else 0 end) as same from cells {gb}), l as (select {g} a as v, sum(k) as x from cells group by {g} a), r as (select {g} b as v, sum(k) as y from cells group by {g} b)"""


@query(f"""with {SCREENED_SQL}, x as (select label as a, predicted as b from screened), {_KAPPA.format(g='', gb='')}, pe as (select coalesce(sum(x * y), 0) as xy from l join r using (v)) select cast(n as bigint) as n, round(same / cast(n as double), 9) as po, round(xy / (cast(n as double) * n), 9) as pe, round((same / cast(n as double) - xy / (cast(n as double) * n)) / (1 - xy / (cast(n as double) * n)), 9) as kappa from t, pe""")
def rater_agreement(spark, d):
    return _round(metrics.kappa(screened(spark, d), "label", "predicted"), ["po", "pe", "kappa"])


@query("""with p as (select l_returnflag as a, case when l_orderkey % 5 = 0 then 'A' else l_returnflag end as b from lineitem), t as (select cast(count(*) as double) as m from p), c as (select code, (select count(*) from p where a = code) as x, (select count(*) from p where b = code) as y, (select count(*) from p where a = code and b = code) as z from (values ('A'), ('N'), ('R'), ('Q')) v(code))
select code, round(case when x + y > 0 then ((m - x - y + 2 * z) / m - (x * y + (m - x) * (m - y)) / (m * m)) / (1 - (x * y + (m - x) * (m - y)) / (m * m)) end, 9) as kappa, round(100 * (m - x - y + 2 * z) / m, 6) as agreement_pct from c, t""")
def inter_coder_by_code(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_orderkey") % 5 == 0, "A").otherwise(F.col("l_returnflag")).alias("b"))
    codes = spark.createDataFrame([(c,) for c in "ANRQ"], "code string")
    return _round(_round(metrics.per_code_kappa(pairs, codes), ["kappa"]), ["agreement_pct"], 6)


@query("""with x as (select o_orderpriority as gold, case when o_custkey % 4 = 0 then '1-URGENT' else o_orderpriority end as pred from orders), g as (select gold as label, count(*) as support, count(*) filter (where gold = pred) as tp from x group by 1), p as (select pred as label, count(*) as n_pred from x group by 1)
select label, support, coalesce(n_pred, 0) as n_pred, round(tp / cast(nullif(n_pred, 0) as double), 9) as precision, round(tp / cast(support as double), 9) as recall, round(coalesce(2.0 * tp / (support + n_pred), 0), 9) as f1 from g left join p using (label)""")
def per_class_scores(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("gold"), F.when(F.col("o_custkey") % 4 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("pred"))
    return _round(metrics.per_class(x, "gold", "pred"), ["precision", "recall", "f1"]).select("label", F.col("support").cast("bigint"), F.col("n_pred").cast("bigint"), "precision", "recall", "f1")


_Z = 1.959963984540054


@query(f"""with {SCREENED_SQL}, c as (select source, count(*) filter (where label = 1) as k, cast(count(*) as double) as n from screened group by 1) select source, k, cast(n as bigint) as n, round((k / n + {_Z * _Z} / (2 * n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n), 9) as lo, round(least(1.0, (k / n + {_Z * _Z} / (2 * n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n)), 9) as hi from c""")
def wilson_intervals(spark, d):
    c = screened(spark, d).groupBy("source").agg(F.count_if(F.col("label") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    return _round(metrics.with_wilson(c, "k", "n"), ["lo", "hi"])


@query("""select event_type, count(value) as n, median(value) as median, quantile_disc(value, 0.9) as p90, round(avg(value), 6) as mean, round(sum(value), 4) as total from events group by 1""")
def latency_stats(spark, d):
    return _round(_round(metrics.latency(table(spark, d, "events"), "value", ["event_type"]), ["mean"], 6), ["total"], 4)


@query("""with x as (select o_custkey as item, o_orderpriority as label from orders), s as (select item from x group by 1 having count(*) > 1), c as (select item, label, cast(count(*) as double) as k from x group by 1, 2), i as (select item, sum(k) as r, sum(k * k) as q from c group by 1 having sum(k) > 1), a as (select count(*) as n_items, avg((q - r) / (r * (r - 1))) as p_bar, sum(r) as al from i), e as (select sum(kk * kk) as z from (select label, sum(k) as kk from c where item in (select item from i) group by 1))
select n_items, round(p_bar, 9) as p_bar, round(z / (al * al), 9) as p_e, round((p_bar - z / (al * al)) / (1 - z / (al * al)), 9) as kappa from a, e""")
def fleiss_kappa(spark, d):
    from pyspark.sql import functions as F

    x = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("label"))
    many = x.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item")
    return _round(metrics.fleiss(x.join(many, "item", "left_semi"), "item", "label"), ["p_bar", "p_e", "kappa"])


@query("""with v as (select o_custkey as item, o_orderstatus as label, count(*) as k from orders group by 1, 2), m as (select item, max(k) as m from v group by 1) select item, min(label) as label from v join m using (item) where k = m and m >= 2 group by item having count(*) = 1""")
def reviewer_majority(spark, d):
    return metrics.majority(table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("label")), "item", "label")


@query("""select o_orderpriority as gold, count(*) filter (where o_orderstatus = 'F') as "F", count(*) filter (where o_orderstatus = 'O') as "O", count(*) filter (where o_orderstatus = 'P') as "P" from orders group by 1""")
def confusion_matrix(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("gold")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return t.na.fill(0)
