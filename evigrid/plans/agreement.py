"""Agreement, second passes, criteria, seeds and run summaries."""
from pyspark.sql import functions as F

from ..operators import agreement, evaluation, graph, screening
from ..registry import query
from ..sources.tables import table
from ..streaming import jobs
from .scalars import S
from .views import SCREENED_SQL, screened

_Z = "1.959963984540054"


def _r(df, *names):
    return df.withColumns({c: F.round(c, 9) for c in names})


_VERDICTS = """v as (select o_orderkey as item_id, case o_orderstatus when 'O' then 'verified' when 'F' then 'unsupported' else 'no_full_text' end as verifier_status, case when o_orderkey % 4 = 0 then 'verified' when o_orderkey % 4 = 1 then 'unsupported' else case o_orderstatus when 'O' then 'verified' when 'F' then 'unsupported' else 'no_full_text' end end as human_verdict, o_orderpriority as part, case o_orderkey % 3 when 0 then ' scope ' when 1 then '' end as axis from orders)"""


def _verdicts(spark, d):
    n = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "verified").when(F.col("o_orderstatus") == "F", "unsupported").otherwise("no_full_text")
    human = F.when(n % 4 == 0, "verified").when(n % 4 == 1, "unsupported").otherwise(status)
    return table(spark, d, "orders").select(n.alias("item_id"), status.alias("verifier_status"), human.alias("human_verdict"), F.col("o_orderpriority").alias("part"), F.when(n % 3 == 0, " scope ").when(n % 3 == 1, "").alias("disagreement_axis"))


@query(f"""with {_VERDICTS}, a as (select part, count(*) as n_items, count(*) filter (where verifier_status <> 'no_full_text') as n_judged, count(*) filter (where verifier_status = 'no_full_text') as n_withheld, count(*) filter (where verifier_status <> 'no_full_text' and verifier_status = human_verdict) as n_agree from v group by 1), b as (select *, n_agree / cast(n_judged as double) as accuracy, {_Z} * {_Z} as z2, cast(n_judged as double) as m from a)
select part, n_items, n_judged, n_withheld, n_agree, round(accuracy, 9) as accuracy, round(greatest(0.0, (accuracy + z2 / (2 * m) - {_Z} * sqrt(accuracy * (1 - accuracy) / m + z2 / (4 * m * m))) / (1 + z2 / m)), 9) as lo, round(least(1.0, (accuracy + z2 / (2 * m) + {_Z} * sqrt(accuracy * (1 - accuracy) / m + z2 / (4 * m * m))) / (1 + z2 / m)), 9) as hi from b""")
def verifier_agreement(spark, d):
    """Reviewers against the verifier by part; what was withheld by instruction is not judged."""
    return _r(agreement.judged(_verdicts(spark, d), "verifier_status", "human_verdict", ["part"]), "accuracy", "lo", "hi")


@query(f"""with {_VERDICTS} select trim(axis) as axis, count(*) as n from v where verifier_status <> human_verdict and trim(coalesce(axis, '')) <> '' group by 1""")
def disagreement_axes(spark, d):
    v = _verdicts(spark, d).withColumn("agrees", F.when(F.col("verifier_status") == F.col("human_verdict"), "yes").otherwise("no"))
    return agreement.axis_counts(v)


@query(f"""with {_VERDICTS} select item_id, verifier_status, human_verdict, coalesce(axis, '') as disagreement_axis from v where verifier_status <> human_verdict""")
def overridden_rows(spark, d):
    v = _verdicts(spark, d).withColumn("agrees", F.when(F.col("verifier_status") == F.col("human_verdict"), "yes").otherwise("no"))
    return agreement.overridden(v)


_RATED = "r as (select l_orderkey, l_linenumber, l_returnflag as a, case when l_partkey % 3 = 0 then 'N' else l_returnflag end as b, case when l_suppkey % 4 = 0 then 'A' else l_returnflag end as c from lineitem)"
_PAIR = "p as (select 'a_b' as pair, a as x, b as y from r union all select 'a_c', a, c from r union all select 'b_c', b, c from r), n as (select pair, count(*) as n, count(*) filter (where x = y) / cast(count(*) as double) as po from p group by 1), ex as (select px.pair, sum(px.k * py.k / cast(n.n as double) / n.n) as pe from (select pair, x, count(*) as k from p group by 1, 2) px join (select pair, y, count(*) as k from p group by 1, 2) py on px.pair = py.pair and x = y join n on n.pair = px.pair group by 1), k as (select n.pair, n.n, po, (po - pe) / (1 - pe) as kappa from n join ex on n.pair = ex.pair)"


def _rated(spark, d):
    f = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(f.alias("a"), F.when(F.col("l_partkey") % 3 == 0, "N").otherwise(f).alias("b"), F.when(F.col("l_suppkey") % 4 == 0, "A").otherwise(f).alias("c"))


@query(f"""with {_RATED}, {_PAIR} select pair, n, round(po, 9) as percent, round(kappa, 9) as kappa from k""")
def reviewer_pair_kappas(spark, d):
    return _r(agreement.pairwise(_rated(spark, d), ["a", "b", "c"]), "percent", "kappa")


@query(f"""with {_RATED}, {_PAIR} select round(avg(po), 9) as mean_percent, round(avg(kappa), 9) as mean_kappa from k""")
def mean_pairwise_agreement(spark, d):
    return _r(agreement.mean_pairwise(_rated(spark, d), ["a", "b", "c"]), "mean_percent", "mean_kappa")


@query("""select o_orderkey, case when (case when o_orderkey % 2 = 0 then 1 else 0 end + case when o_custkey % 2 = 0 then 1 else 0 end + case when o_orderstatus = 'F' then 1 else 0 end) >= 2 then 'yes' else 'no' end as majority from orders""")
def delivered_majority(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, " Yes ").otherwise("no").alias("x"), F.when(F.col("o_custkey") % 2 == 0, "yes").alias("y"), F.when(F.col("o_orderstatus") == "F", "YES").otherwise("?").alias("z"))
    return agreement.majority_answers(o, ["x", "y", "z"]).select("o_orderkey", "majority")


_RUNS = """a as (select o_orderkey as k, case when o_orderkey % 3 = 0 then 'verified' when o_orderkey % 3 = 1 then 'needs_nuance' else 'unsupported' end as sa, case when o_custkey % 3 = 0 then 'verified' when o_custkey % 3 = 1 then 'needs_nuance' when o_orderkey % 3 = 0 then 'verified' when o_orderkey % 3 = 1 then 'needs_nuance' else 'unsupported' end as sb, o_orderkey % 7 = 0 as det, o_custkey % 11 = 0 as err from orders where o_orderkey % 5 <> 0),
ok as (select sa, sb, case when sa = 'verified' then 1 else 0 end as ba, case when sb = 'verified' then 1 else 0 end as bb from a where not det and not err), c as (select count(*) as n, count(*) filter (where not det and not err) as n_compared, count(*) filter (where det) as n_deterministic, count(*) filter (where not det and err) as n_error from a), m as (select cast(count(*) as double) as m, count(*) filter (where sa = sb) / cast(count(*) as double) as po, count(*) filter (where ba = bb) / cast(count(*) as double) as qo from ok),
pe as (select sum(x.k * y.k / m / m) as pe from (select sa as s, count(*) as k from ok group by 1) x join (select sb as s, count(*) as k from ok group by 1) y using (s), m), qe as (select sum(x.k * y.k / m / m) as qe from (select ba as s, count(*) as k from ok group by 1) x join (select bb as s, count(*) as k from ok group by 1) y using (s), m)"""


@query(f"""with {_RUNS} select n, n_compared, n_deterministic, n_error, round(po, 9) as percent_status, round((po - pe) / (1 - pe), 9) as kappa_status, round(qo, 9) as percent_binary, round((qo - qe) / (1 - qe), 9) as kappa_binary from c, m, pe, qe""")
def run_agreement(spark, d):
    """Two runs over the items that both have; what no model decided and failed calls are left out."""
    o, n, k = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    name = lambda c: F.when(c % 3 == 0, "verified").when(c % 3 == 1, "needs_nuance").otherwise("unsupported")
    a = o.select("o_orderkey", name(n).alias("status"), (n % 7 == 0).alias("deterministic"), F.lit(False).alias("error"))
    b = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(k % 3 == 2, name(n)).otherwise(name(k)).alias("status"), F.lit(False).alias("deterministic"), (k % 11 == 0).alias("error"))
    return _r(agreement.runs_compared(a, b, "o_orderkey"), "percent_status", "kappa_status", "percent_binary", "kappa_binary")


@query("""with i as (select l_orderkey, list_sort(list_filter(list_transform(list(l_returnflag order by l_linenumber, l_partkey, l_suppkey), lambda f, i: case when f = 'A' then 'I' || i end), lambda x: x is not null)) as ids, list(l_linestatus order by l_linenumber, l_partkey, l_suppkey) as st from lineitem group by 1)
select l_orderkey, array_to_string(ids, ',') as full_text_ids, case when st[1] <> 'F' then '' when list_contains(ids, 'I1') then 'I1' else array_to_string(ids, ',') end as confirm from i""")
def criteria_by_stage(spark, d):
    """Criteria that only a full text settles, and those to be confirmed on an include."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))).alias("r"))
    stages = F.transform("r", lambda x: F.when(x["l_returnflag"] == "A", "full_text").when(x["l_returnflag"] == "N", "abstract"))
    ids = agreement.stage_ids(F.col("r"), stages, "I", "full_text")
    p = rows.select("l_orderkey", ids.alias("ids"), F.when(F.col("r")[0]["l_linestatus"] == "F", "INCLUDE").otherwise("EXCLUDE").alias("decision"))
    return p.select("l_orderkey", F.array_join(F.array_sort("ids"), ",").alias("full_text_ids"), F.array_join(agreement.to_confirm("decision", F.array(F.lit("I1"), F.lit("I99")), "ids"), ",").alias("confirm"))


@query("""with c as (select o_orderkey, o_custkey, o_orderstatus = 'F' as inc, row_number() over (partition by o_custkey, o_orderstatus = 'F' order by o_orderkey) - 1 as p from orders)
select o_custkey as run, o_orderkey as id, case when inc then cast(p // 5 as integer) end as batch, case when not inc then 'EXCLUDE' when p < 10 and o_orderkey % 4 = 0 then 'INCLUDE' else 'NEEDS_REVIEW' end as status, case when not inc then null when p >= 10 then 'budget' when o_orderkey % 4 = 3 then 'unavailable' when o_orderkey % 4 <> 0 then 'not_confirmed' end as reason from c""")
def second_pass_stage(spark, d):
    """Includes seen a second time in batches of five, ten a run; confirmed with a quote, or not, or unanswered."""
    n = F.col("o_orderkey")
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), n.alias("id"), n.alias("pos"), F.when(F.col("o_orderstatus") == "F", "INCLUDE").otherwise("EXCLUDE").alias("status"), F.concat(F.lit("Shown text of "), S("o_orderkey")).alias("shown"))
    answers = table(spark, d, "orders").where("o_orderkey % 4 <> 3").select(n.alias("id"), F.when(n % 4 == 1, "DOUBT").otherwise("CONFIRM").alias("verdict"), F.when(n % 4 == 2, "not there").otherwise("shown TEXT of").alias("quote"))
    return agreement.second_stage(c, answers, 5, 10)


@query("""with s as (select p_partkey as w from part where p_partkey % 10 = 0), f as (select l_partkey as a, l_suppkey as b from lineitem), x as (select b as w, 0 as r, a as s from f where a in (select w from s) union all select a, 1, b from f where b in (select w from s)), o as (select w, min(r) as r, count(distinct s) as n_seeds from x group by 1) select w as work, case when r = 0 then 'reference' else 'citing' end as role, n_seeds from o where w not in (select w from s) and w % 7 <> 0 and w in (select p_partkey from part)""")
def seed_expansion(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("work"))
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return agreement.seeds_expanded(e, p.where("work % 10 = 0"), p, p.where("work % 7 = 0"))


@query("""select event_type, count(distinct user_id) as n_calls, count(*) as n_rows, case when event_type = 'error' then null else sum(event_id % 100) end as input_tokens, sum(event_id % 7) as output_tokens, min(ts) as first_at, max(ts) as last_at, case when event_type = 'click' then 'm1' else 'm1,m2' end as models from events group by 1""".replace("sum(event_id % 100)", "cast(sum(event_id % 100) as bigint)").replace("sum(event_id % 7)", "cast(sum(event_id % 7) as bigint)"))
def run_summaries(spark, d):
    n = F.col("event_id")
    e = table(spark, d, "events").select("event_type", F.col("user_id").alias("call_id"), F.when((F.col("event_type") != "error") | (n % 2 == 0), n % 100).alias("input_tokens"), (n % 7).alias("output_tokens"), F.col("ts").alias("called_at"), F.when((F.col("event_type") == "click") | (n % 2 == 0), "m1").otherwise("m2").alias("model"))
    return agreement.run_totals(e, ["event_type"])


@query("""select p_partkey as work from part where p_partkey % 3 <> 0 and p_partkey % 4 not in (1, 2)""")
def usable_works(spark, d):
    n = F.col("p_partkey")
    title = F.when(n % 4 == 1, F.concat(F.lit("Editorial: "), "p_name")).when(n % 4 == 2, F.concat("p_name", F.lit(": a Scoping Review"))).otherwise(F.col("p_name"))
    w = table(spark, d, "part").select(n.alias("work"), title.alias("title"), F.lit("article").alias("type"), F.when(n % 3 != 0, "http://x/y.pdf").alias("pdf_url"))
    return agreement.usable_works(w).select("work")


@query("""with c as (select lang, count(*) as n from documents group by 1) select lang, n, least(n, 10) as n_drawn from c""")
def strata_census(spark, d):
    """Ten of each language, as the total is the sum of the floors."""
    doc = table(spark, d, "documents").select("lang")
    k = doc.distinct().count()  # languages are few
    return agreement.strata(doc, ["lang"], 10 * k, 10)


@query(f"""with {SCREENED_SQL}, s as (select *, doc_id % 6 = 0 as padded, doc_id % 5 <> 0 as has_abstract from screened), a as (select lang, count(*) as n, count(*) filter (where padded) as n_padded, count(*) filter (where not has_abstract) as n_no_abstract, count(*) filter (where label = 1 and predicted = 1) as h, count(*) filter (where label = 1) as p, count(*) filter (where predicted = 1) as s, count(*) filter (where label = 1 and predicted = 1 and not padded) as hr, count(*) filter (where label = 1 and not padded) as pr, count(*) filter (where predicted = 1 and not padded) as sr from s group by 1)
select lang, n, n_padded, n_no_abstract, round(h / cast(nullif(p, 0) as double), 9) as recall, round(h / cast(nullif(s, 0) as double), 9) as precision, round(hr / cast(nullif(pr, 0) as double), 9) as recall_answered, round(hr / cast(nullif(sr, 0) as double), 9) as precision_answered from a""")
def answered_screening(spark, d):
    s = screened(spark, d).withColumn("padded", F.col("doc_id") % 6 == 0).withColumn("has_abstract", F.col("doc_id") % 5 != 0)
    return _r(agreement.answered_only(s, ["lang"]), "recall", "precision", "recall_answered", "precision_answered")


@query("""select c_custkey, case when c_custkey % 4 = 0 then null when c_custkey % 3 = 0 then 'not_indexed' end as auto, case when c_custkey % 4 = 0 then 'no_issn' when c_custkey % 3 = 0 then 'not_indexed' end as strict, null as off from customer""".replace("null as off", "cast(null as varchar) as off"))
def gate_modes(spark, d):
    n = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.when(n % 4 != 0, "1234-5678").alias("issn"), (n % 3 != 0).alias("indexed"))
    return c.select("c_custkey", screening.gate_outcome("auto", "indexed", "issn").alias("auto"), screening.gate_outcome("on", "indexed", "issn").alias("strict"), screening.gate_outcome("off", "indexed", "issn").alias("off"))


@query("""select s_suppkey, case when s_suppkey % 5 = 0 then 'no_doi' when s_suppkey % 3 = 0 then 'fail' when s_suppkey % 2 = 0 then 'warning' else 'pass' end as verification, s_suppkey % 7 <> 0 and s_suppkey % 4 >= 2 as may_replace from supplier""")
def verification_and_health(spark, d):
    """Overall status of a record's verification; whether a graph build may take the old one's place."""
    n = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.when(n % 5 != 0, "10.1/x").alias("doi"), (n % 3 != 0).alias("found"), (n % 2 == 0).alias("warn"), (n % 7 == 0).alias("breaker_open"), F.lit(False).alias("deadline_hit"), F.lit(3).alias("failed"), F.when(n % 4 >= 2, 6).otherwise(5).alias("processed"))
    return s.select("s_suppkey", screening.verification_status("doi", "found", "warn").alias("verification"), graph.may_replace(s).alias("may_replace"))


@query("""select p_partkey, case when p_partkey % 3 = 0 then 'low=3000,high=4000,a_low=150,a_high=300' when p_partkey % 3 = 1 then 'low=5000,high=8000,a_low=50,a_high=140' else 'low=1000,high=1500,a_low=200,a_high=300' end as limits from part""")
def merged_limits(spark, d):
    """A journal's limits over those of the paper type, resolved at the driver and looked up by row."""
    said = [evaluation.merged_standards(5000, 8000, *x) for x in ((4000, None), (None, 90), (1500, 250))]
    lines = F.array(*[F.lit(",".join(f"{k}={v}" for k, v in s.items())) for s in said])
    return table(spark, d, "part").select("p_partkey", F.get(lines, (F.col("p_partkey") % 3).cast("int")).alias("limits"))


@query("""with j as (select user_id, ts, event_id, event_type from events) select user_id as job_id, bool_or(event_type = 'error') as was_cancelled, count(*) as n from j group by 1""")
def job_states_streamed(spark, d):
    """The state machine over a stream of events, each job's last word: cancelled stays cancelled."""
    from .streams import drained, event_source

    status = F.when(F.col("event_type") == "error", "cancelled").otherwise("running")
    out = drained(spark, jobs.job_states(event_source(spark, d).select(F.col("user_id").alias("job_id"), status.alias("status"), "ts")), "job-states", "update")
    return out.groupBy("job_id").agg(F.bool_or(F.col("status") == "cancelled").alias("was_cancelled"), F.max("n").alias("n"))
