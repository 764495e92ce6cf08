"""Counts and sums by month, source, status and person."""
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import ranking
from ..registry import query
from ..sources.tables import table
from .views import RECORDS_SQL, VENUES_SQL, records, venues


@query("""select strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders group by 1""")
def papers_by_month(spark, d):
    return table(spark, d, "orders").groupBy(scalars.month_bucket("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("""select source, count(*) as n from documents group by 1""")
def papers_by_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'users' as what, count(*) as n from customer union all select 'papers', count(*) from part union all select 'library', count(*) from orders union all select 'links', count(*) from lineitem union all select 'jobs', count(*) from events""")
def system_totals(spark, d):
    of = lambda t, what: table(spark, d, t).agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    out = of("customer", "users")
    for t, what in (("part", "papers"), ("orders", "library"), ("lineitem", "links"), ("events", "jobs")):
        out = out.unionAll(of(t, what))
    return out


@query("""select event_type, count(*) as n, count(distinct user_id) as users from events group by 1""")
def jobs_by_type(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("""select c_custkey, count(o_orderkey) as projects from customer left join orders on c_custkey = o_custkey group by 1""")
def users_with_projects(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("projects"))
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("projects", F.lit(0).cast("bigint")).alias("projects"))


@query("""select n_nationkey, count(*) as members from nation join customer on c_nationkey = n_nationkey where n_nationkey in (select s_nationkey from supplier where s_acctbal > 0) group by 1""")
def teams_with_members(spark, d):
    mine = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    per = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("members"))
    return table(spark, d, "nation").select("n_nationkey").join(mine, "n_nationkey", "left_semi").join(per, "n_nationkey")


@query("""select r_name, o_orderpriority, count(distinct o_orderkey) as papers from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def library_by_region(spark, d):
    nation = F.broadcast(table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "o_orderpriority").agg(F.count_distinct("o_orderkey").alias("papers"))


@query(f"""with {VENUES_SQL} select collection, count(*) as venues, count(eissn) as with_eissn from venues group by 1""")
def venue_counts(spark, d):
    return venues(spark, d).groupBy("collection").agg(F.count(F.lit(1)).alias("venues"), F.count("eissn").alias("with_eissn"))


@query("""select event_type, case when count(v) = 0 then null else round(sum(v), 4) end as total, max(v) as most from (select event_type, case when event_id % 7 = 0 then null else value end as v from events) group by 1""")
def token_totals(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("v"))
    return e.groupBy("event_type").agg(F.round(F.sum("v"), 4).alias("total"), F.max("v").alias("most"))


@query("""select event_type, list(distinct user_id % 5 order by user_id % 5) as kinds, round(sum(coalesce(case when event_id % 7 = 0 then null else value end, 0)), 4) as total from events group by 1""")
def screener_provenance(spark, d):
    e = table(spark, d, "events")
    v = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value"))
    return e.groupBy("event_type").agg(F.array_sort(F.collect_set(F.col("user_id") % 5)).alias("kinds"), F.round(F.sum(F.coalesce(v, F.lit(0.0))), 4).alias("total"))


@query("""select event_id, (isodow(ts) < 6 and hour(ts) in (1, 2, 3, 6, 7, 8, 9)) as peak from events""")
def peak_hours(spark, d):
    return table(spark, d, "events").select("event_id", scalars.is_peak("ts").alias("peak"))


_COST = """((i - h) * (case when p then 0.44 else 0.22 end) + h * (case when p then 0.014 else 0.007 end) + o * (case when p then 1.32 else 0.66 end)) / 1e6"""


@query(f"""with c as (select event_type, (isodow(ts) < 6 and hour(ts) in (1, 2, 3, 6, 7, 8, 9)) as p, cast(value * 100 as bigint) as i, user_id as o, greatest(0, least(event_id % 5000, cast(value * 100 as bigint))) as h from events) select event_type, count(*) as calls, round(sum({_COST}), 6) as cost from c group by 1""")
def call_costs(spark, d):
    e = table(spark, d, "events").select("event_type", "ts", F.round(F.col("value") * 100).cast("bigint").alias("i"), F.col("user_id").alias("o"), (F.col("event_id") % 5000).alias("c"))
    return e.withColumn("cost", scalars.call_cost("ts", "i", "o", "c", (0.44, 0.014, 1.32), (0.22, 0.007, 0.66))).groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


@query(f"""with {RECORDS_SQL}, b as (select source, count(*) as n, count(distinct doi) as d from records group by 1) select source, n, d, case when n >= 30 then 'high' when n >= 10 then 'medium' else 'low' end as band from b""")
def coverage_by_source(spark, d):
    b = records(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doi").alias("d"))
    return b.withColumn("band", F.when(F.col("n") >= 30, "high").when(F.col("n") >= 10, "medium").otherwise("low"))


@query("""with r as (select user_id, event_id, event_type = 'purchase' as hit, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as i from events) select user_id, event_id, cast(sum(case when hit then 0 else 1 end) over (partition by user_id, i order by event_id) as bigint) as dry from r""")
def dry_rounds(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return ranking.trailing_runs(e, ["user_id"], "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "dry")


@query("""select doc_id, case when year is null then 'skipped' when 2025 - year <= 10 then 'info' else 'note' end as recency, case when n_chars % 50 >= 10 then 'info' else 'note' end as cited from (select doc_id, n_chars, case when doc_id % 9 = 0 then null else 1985 + doc_id % 40 end as year from documents)""")
def record_indicators(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, None).otherwise(1985 + F.col("doc_id") % 40).alias("year"), (F.col("n_chars") % 50).alias("c"))
    return doc.select("doc_id", scalars.recency("year", 2025).alias("recency"), scalars.citation_indicator("c").alias("cited"))
