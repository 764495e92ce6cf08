"""Reviewer sheets, run summaries, prerequisites of jobs."""
from pyspark.sql import functions as F

from ..operators import evaluation, metrics, reviewers
from ..registry import query
from ..sources.tables import table
from .views import SCREENED_SQL, screened


@query("""with r as (select p_brand || ':' || p_type as alteration, p_size % 3 <> 0 as correct from part) select string_split(alteration, ':')[1] as operator, count(*) as n, count(*) filter (where correct) as n_correct, round(count(*) filter (where correct) / cast(count(*) as double), 9) as accuracy from r group by 1""")
def accuracy_by_alteration(spark, d):
    r = table(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("alteration"), (F.col("p_size") % 3 != 0).alias("correct"))
    return reviewers.by_alteration(r).withColumn("accuracy", F.round("accuracy", 9))


@query("""with r as (select l_shipdate is not null as x, l_linestatus as section, l_orderkey as sentence, case when l_quantity > 10 then 'verified' else 'unsupported' end as status, case when l_returnflag = 'R' then 'no' else 'yes' end as answer from lineitem), s as (select section, sentence, bool_and(status = 'verified' and answer = 'yes') as a, count(*) as k, count(*) filter (where status = 'verified' and answer = 'yes') as g from r group by 1, 2)
select section, cast(sum(k) as bigint) as n_rows, cast(sum(g) as bigint) as n_ok, count(*) as n_sentences, count(*) filter (where a) as n_sentences_ok, round(sum(g) / cast(sum(k) as double), 9) as rate, round(count(*) filter (where a) / cast(count(*) as double), 9) as sentence_rate from s group by 1""")
def delivered_rates(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("section"), F.col("l_orderkey").alias("sentence"), F.when(F.col("l_quantity") > 10, "verified").otherwise("unsupported").alias("status"), F.when(F.col("l_returnflag") == "R", "no").otherwise("yes").alias("answer"))
    v = reviewers.verified_rates(r, ["section"])
    return v.withColumns({c: F.round(c, 9) for c in ("rate", "sentence_rate")})


@query("""with e as (select event_type, user_id, case when event_id % 997 = 0 then null else value end as cost, event_id % 3 <> 0 as answered from events) select event_type, user_id, case when bool_or(cost is null) then null else round(sum(cost), 4) end as total_cost, count(*) as calls from e where answered group by 1, 2""")
def total_costs(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", F.when(F.col("event_id") % 997 == 0, None).otherwise(F.col("value")).alias("cost"), (F.col("event_id") % 3 != 0).alias("answered"))
    return reviewers.total_cost(e, "cost", "answered", ["event_type", "user_id"]).withColumn("total_cost", F.round("total_cost", 4))


@query(f"""with {SCREENED_SQL} select doc_id, case when doc_id % 4 = 0 then null else doc_id % 2 end as other_predicted from screened where label = 1 and predicted = 0""")
def false_negative_list(spark, d):
    s = screened(spark, d)
    other = s.where("doc_id % 4 <> 0").select("doc_id", (F.col("doc_id") % 2).alias("predicted"))
    return reviewers.false_negatives(s, other, "doc_id").select("doc_id", "other_predicted")


@query("""with s as (select l_orderkey as g, case l_returnflag when 'A' then 'verified' when 'N' then 'needs_nuance' else 'unsupported' end as st, l_linestatus = 'F' as yes from lineitem), x as (select case when yes then 'SUPPORT' else 'NOT_SUPPORTED' end as gold, case when st = 'verified' then 'SUPPORT' else 'NOT_SUPPORTED' end as strict, case when st in ('verified', 'needs_nuance') then 'SUPPORT' else 'NOT_SUPPORTED' end as lenient from s)
select 'strict' as mapping, round(avg(case when gold = strict then 1.0 else 0.0 end), 9) as accuracy from x union all select 'lenient', round(avg(case when gold = lenient then 1.0 else 0.0 end), 9) from x""")
def label_mappings(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "N", "needs_nuance").otherwise("unsupported")
    x = table(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "F", "SUPPORT").otherwise("NOT_SUPPORTED").alias("gold"), status.alias("st"))
    both = x.select("gold", F.explode(F.array(*[F.struct(F.lit(m).alias("mapping"), evaluation.mapped_status("st", m).alias("pred")) for m in ("strict", "lenient")])).alias("m")).select("gold", "m.*")
    return both.groupBy("mapping").agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 9).alias("accuracy"))


@query("""select c_custkey, 'c_mktsegment' as "column", 'not allowed' as problem from customer where c_mktsegment not in ('BUILDING', 'MACHINERY') union all select c_custkey, 'note', 'blank' from customer where c_acctbal < 0""")
def sheet_problems(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") < 0, " ").otherwise("ok").alias("note"))
    return reviewers.blanks(c, "c_custkey", ["c_mktsegment", "note"], {"c_mktsegment": ["BUILDING", "MACHINERY"]})


@query("""select coalesce(a.k, b.k) as k, case when a.k is null then 'missing' else 'unknown' end as problem from (select distinct o_custkey as k from orders) a full join (select c_custkey as k from customer where c_acctbal > 0) b on a.k = b.k where a.k is null or b.k is null""")
def sheet_key_mismatches(spark, d):
    return reviewers.key_mismatches(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("""with s as (select o_custkey as dataset_id, o_orderkey as session_id, case when o_orderkey % 2 = 0 then 'ai' else 'human' end as coder, o_orderdate as t from orders where o_orderstatus <> 'O'), n as (select dataset_id, coder, arg_max(session_id, (t, session_id)) as s from s group by 1, 2) select dataset_id, max(s) filter (where coder = 'ai') as ai_session, max(s) filter (where coder = 'human') as human_session, count(*) = 2 as ready from n group by 1""")
def coder_sessions(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderkey") % 2 == 0, "ai").otherwise("human").alias("coder"), F.when(F.col("o_orderstatus") != "O", "completed").otherwise("running").alias("status"), F.col("o_orderdate").alias("created_at"))
    return reviewers.confirmed_pair(s, "dataset_id")


@query("""with p as (select o_custkey as project, o_orderkey as paper_id, cast(o_totalprice as integer) as c from orders), n as (select project from p group by 1 having count(*) >= 5), r as (select project, paper_id, row_number() over (partition by project order by c desc, paper_id) as k from p where project in (select project from n)) select project, paper_id from r where k <= 8""")
def gap_analysis_inputs(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("paper_id"), F.round("o_totalprice").cast("int").alias("c"))
    return reviewers.gap_inputs(p, "project", "c", 5, 8).select("project", "paper_id")


@query("""with b as (select doc_id // 10 as batch, least(n_chars, 1500) as c from documents), a as (select batch, sum(ceil(c / 4.0)) + 900 as i, count(*) * 120 as o from b group by 1) select cast(sum(i) as bigint) as input_tokens, cast(sum(o) as bigint) as output_tokens, round((sum(i) * 0.44 + sum(o) * 1.32) / 1e6, 9) as cost from a""")
def run_cost_bound(spark, d):
    b = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("batch"), F.col("n_chars").alias("chars"))
    c = reviewers.cost_bound(b, 0.44, 1.32, 1500)
    return c.withColumn("cost", F.round("cost", 9))


@query("""select p_partkey, case when p_size % 4 = 0 then 'population' when p_size % 4 = 1 then 'outcome' when p_size % 4 = 2 then 'none' else 'other' end as reason from part""")
def reason_classes(spark, d):
    s = F.when(F.col("p_size") % 4 == 0, "wrong Population and outcome").when(F.col("p_size") % 4 == 1, F.concat(F.lit("no outcome for "), "p_partkey")).when(F.col("p_size") % 4 == 3, "hard to say")
    return table(spark, d, "part").select("p_partkey", reviewers.reason_class(s).alias("reason"))


@query()
def draft_violations(spark, d):
    """Rules on delivered text over all documents as drafts."""
    v = reviewers.text_violations(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("drafts"))


@query(f"""with {SCREENED_SQL}, x as (select lang, cast(label as varchar) as a, cast(predicted as varchar) as b from screened where label is not null and predicted is not null), t as (select lang, cast(count(*) as double) as n, count(*) filter (where a = b) as s from x group by 1), l as (select lang, a as v, count(*) as p from x group by 1, 2), r as (select lang, b as v, count(*) as q from x group by 1, 2), e as (select l.lang, sum(cast(p as double) * q) as pq from l join r on l.lang = r.lang and l.v = r.v group by 1)
select t.lang, cast(n as bigint) as n, round(s / n, 9) as po, round(coalesce(pq, 0) / (n * n), 9) as pe, round(case when abs(coalesce(pq, 0) / (n * n) - 1) > 1e-9 then (s / n - coalesce(pq, 0) / (n * n)) / (1 - coalesce(pq, 0) / (n * n)) end, 9) as kappa from t left join e on t.lang = e.lang""")
def agreement_by_language(spark, d):
    k = metrics.kappa(screened(spark, d), "label", "predicted", ["lang"])
    return k.withColumns({c: F.round(c, 9) for c in ("po", "pe", "kappa")})
