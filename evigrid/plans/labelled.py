"""Labels of record, runs scored against them, spot checks and sets' faults."""
from pyspark.sql import functions as F

from ..operators import labelled
from ..registry import query
from ..sources.tables import table

_LABELS = """verdicts as (select o_orderkey as opaque, unnest([1, 2, 3]) as reviewer, case when o_orderkey % 13 = 0 then 'no_full_text' else unnest([case when o_custkey % 3 = 0 then 'verified' else 'unsupported' end, case when o_orderkey % 4 < 3 then 'verified' else 'needs_nuance' end, case o_orderstatus when 'F' then 'verified' when 'O' then 'unsupported' else 'needs_nuance' end]) end as verdict from orders),
key as (select o_orderkey as opaque, 'i' || o_orderkey as item, case when o_orderkey % 2 = 0 then 'constructed' else 'real' end as set, case when o_orderkey % 13 = 0 then 'no_full_text' else 'verified' end as expected from orders), votes as (select opaque, verdict, count(*) as k from verdicts group by 1, 2),
lead as (select opaque, sum(k) as n, count(*) as kinds, max(k) as top, count(*) filter (where k = (select max(k) from votes v2 where v2.opaque = votes.opaque)) as leaders, arg_max(verdict, k) as verdict from votes group by 1),
labels as (select item, set, case when leaders = 1 then verdict end as label, kinds = 1 as unanimous, kinds = 1 and expected = 'no_full_text' and verdict = 'no_full_text' as fixed, n::bigint as n from key join lead using (opaque))"""


def labels(spark, d):
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    three = F.array(F.when(F.col("o_custkey") % 3 == 0, "verified").otherwise("unsupported"), F.when(n % 4 < 3, "verified").otherwise("needs_nuance"), F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "unsupported").otherwise("needs_nuance"))
    verdicts = o.select(n.alias("opaque"), F.posexplode(three).alias("reviewer", "verdict")).withColumn("verdict", F.when(F.col("opaque") % 13 == 0, "no_full_text").otherwise(F.col("verdict")))
    key = o.select(n.alias("opaque"), F.concat(F.lit("i"), n.cast("string")).alias("item"), F.when(n % 2 == 0, "constructed").otherwise("real").alias("set"), F.when(n % 13 == 0, "no_full_text").otherwise("verified").alias("expected"))
    return labelled.human_labels(verdicts, key)


@query(f"with {_LABELS} select * from labels")
def human_labels(spark, d):
    """Three reviewers' verdicts on every order, as labels of record."""
    return labels(spark, d)


_RUNS = "runs as (select r as run, 'i' || o_orderkey as item, case when o_orderkey % 2 = 0 then 'constructed' else 'real' end as set, case when (o_orderkey + r * o_custkey) % 3 = 0 then 'unsupported' else case o_orderstatus when 'F' then 'verified' else 'needs_nuance' end end as predicted from orders, (select unnest([1, 2]) as r))"


def runs(spark, d):
    n = F.col("o_orderkey")
    r = table(spark, d, "orders").withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    return r.select("run", F.concat(F.lit("i"), n.cast("string")).alias("item"), F.when(n % 2 == 0, "constructed").otherwise("real").alias("set"), F.when((n + F.col("run") * F.col("o_custkey")) % 3 == 0, "unsupported").when(F.col("o_orderstatus") == "F", "verified").otherwise("needs_nuance").alias("predicted"))


@query(f"""with {_LABELS}, {_RUNS}, m as (select r.*, label from runs r left join labels l on r.item = l.item), a as (select set, run, count(label) as n, count(*) filter (where label is null) as n_missing, count(*) filter (where label = predicted) as n_correct, count(*) filter (where predicted = 'verified' and label is not null) as said, count(*) filter (where label = 'verified') as real_, count(*) filter (where predicted = 'verified' and label = 'verified') as both_ from m group by 1, 2),
g as (select set, run, label as v, count(*) as x from m where label is not null group by 1, 2, 3), p as (select set, run, predicted as v, count(*) as y from m where label is not null group by 1, 2, 3), pe as (select set, run, sum(x::double * y) as xy from g join p using (set, run, v) group by 1, 2)
select set, run, n, n_missing, n_correct, n_correct / n::double as accuracy, (n_correct / n::double + 1.959963984540054 ** 2 / (2 * n) - 1.959963984540054 * sqrt((n_correct / n::double * (1 - n_correct / n::double) + 1.959963984540054 ** 2 / (4 * n)) / n)) / (1 + 1.959963984540054 ** 2 / n) as lo, (n_correct / n::double + 1.959963984540054 ** 2 / (2 * n) + 1.959963984540054 * sqrt((n_correct / n::double * (1 - n_correct / n::double) + 1.959963984540054 ** 2 / (4 * n)) / n)) / (1 + 1.959963984540054 ** 2 / n) as hi,
(n_correct / n::double - xy / (n::double * n)) / (1 - xy / (n::double * n)) as kappa, both_ / said::double as verified_precision, both_ / real_::double as verified_recall, said - both_ as falsely_verified from a join pe using (set, run)""")
def runs_scored(spark, d):
    """Two runs against the labels of record, by set."""
    return labelled.scored_runs(runs(spark, d), labels(spark, d).where("label is not null"))


_ANNOTATED = f"{_LABELS}, {_RUNS}, ann as (select item, label as final, case when length(item) % 2 = 0 then 'verified|needs_nuance' else 'unsupported' end as expected from labels where label is not null)"


@query(f"with {_ANNOTATED} select count(*) as n, count(*) filter (where list_contains(string_split(expected, '|'), final)) as agree, count(*) filter (where list_contains(string_split(expected, '|'), final)) / count(*)::double as accuracy, count(*) filter (where contains(expected, '|')) as n_disjunctive from ann")
def construction_agreement(spark, d):
    """How often the label of record is one that the item was built for."""
    return labelled.construction_agreement(_annotated(spark, d))


def _annotated(spark, d):
    return labels(spark, d).where("label is not null").select("item", F.col("label").alias("final"), F.when(F.length("item") % 2 == 0, "verified|needs_nuance").otherwise("unsupported").alias("expected"))


@query(f"""with {_ANNOTATED}, m as (select run, final, case predicted when 'verified' then 'verified' when 'needs_nuance' then 'needs_nuance' else 'unsupported' end as said, expected from runs join ann using (item)), g as (select run, final as v, count(*) as x from m group by 1, 2), p as (select run, said as v, count(*) as y from m group by 1, 2), pe as (select run, sum(x::double * y) as xy from g join p using (run, v) group by 1),
w as (select run, final || '->' || said as pair, count(*) as k from m where final <> said group by 1, 2), t as (select distinct on (run) run, pair, k from w order by run, k desc, pair), a as (select run, count(*) as n, count(*) filter (where final = said) as h, count(*) filter (where list_contains(string_split(expected, '|'), said)) as f from m group by 1)
select run, n, h / n::double as accuracy, f / n::double as tolerant, (h / n::double - xy / (n::double * n)) / (1 - xy / (n::double * n)) as kappa, pair as miss, k as n_miss from a join pe using (run) join t using (run)""")
def runs_annotated(spark, d):
    """Two runs against annotators' labels: strict, tolerant of what the items were built for, and their commonest miss."""
    return labelled.annotated_runs(runs(spark, d).select("run", "item", "predicted"), _annotated(spark, d), {"verified": "verified", "needs_nuance": "needs_nuance"}, "unsupported")


@query("""with r as (select c_custkey as record, case c_custkey % 4 when 0 then 'doi' when 1 then 'title_exact' else 'title_exact_year' end as match from customer), s as (select * from r where match like 'title_exact%' order by md5('7:' || record), record limit 40)
select record, match, case record % 5 when 0 then 'correct' when 1 then 'incorrect' when 2 then 'unsure' end as judgement, case when record % 5 < 3 then 'me' end as judged_by, record % 5 = 3 as invalid from s""")
def spot_checks(spark, d):
    """Forty title matches drawn for a look, with the judgements there are."""
    n = F.col("c_custkey")
    r = table(spark, d, "customer").select(n.alias("record"), F.when(n % 4 == 0, "doi").when(n % 4 == 1, "title_exact").otherwise("title_exact_year").alias("match"))
    j = table(spark, d, "customer").where(n % 5 < 4).select(n.alias("record"), F.when(n % 5 == 0, "correct").when(n % 5 == 1, "incorrect").when(n % 5 == 2, "unsure").otherwise("maybe").alias("judgement"), F.lit("me").alias("judged_by"))
    return labelled.judged(labelled.spot_check(r, 40, 7), j).select("record", "match", "judgement", "judged_by", "invalid")


@query("""with i as (select o_orderkey, o_orderpriority as kind, case o_orderkey % 4 when 0 then null when 1 then '' else '10.1/' || o_custkey end as doi from orders), c as (select distinct '10.1/' || c_custkey as doi from customer where c_custkey % 3 = 0) select kind, count(*) as n_items, count(*) filter (where doi <> '') as n_named, count(*) filter (where doi in (select doi from c)) as n_found from i group by 1""")
def items_with_chunks(spark, d):
    """Items whose paper is named, and whose paper is in the cache, by kind."""
    n = F.col("o_orderkey")
    i = table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.when(n % 4 == 0, None).when(n % 4 == 1, "").otherwise(F.concat(F.lit("10.1/"), F.col("o_custkey").cast("string"))).alias("doi"))
    c = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("10.1/"), F.col("c_custkey").cast("string")).alias("doi"))
    return labelled.chunk_coverage(i, c.unionAll(c), ["kind"])


@query("""select l_returnflag as section, l_orderkey * 10 + l_linenumber as row, k as kind from (select *, unnest([case when l_returnflag = 'R' or l_quantity > 40 or l_linestatus = 'F' and l_linenumber = 2 then 'fidelity' end, case when l_discount > 0.05 then 'location' end]) as k from lineitem) where k is not null""")
def rows_off(spark, d):
    """Delivered rows that are no full reading, or whose passage is from another section."""
    x = table(spark, d, "lineitem")
    rows = x.select(F.col("l_returnflag").alias("section"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.when(F.col("l_returnflag") == "R", " No ").otherwise("yes").alias("source_located"), F.lit(None).cast("string").alias("passage_located"), F.when(F.col("l_quantity") > 40, 2).alias("unlocated_quotes"),
                    (~((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 2))).alias("sentence_in_draft"), F.when(F.col("l_discount") > 0.05, "YES").otherwise("no").alias("location_section_mismatch"))
    return labelled.off_rows(rows)
