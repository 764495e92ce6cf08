"""Look-ups of jobs, shared rows, nested fields and expectations."""
from pyspark.sql import functions as F

from ..operators import access, edits, reviewers
from ..registry import query
from ..sources.tables import table

_JOBS = "jobs as (select o_orderkey as job, o_custkey as usr, o_orderpriority as kind, case o_orderstatus when 'O' then 'running' when 'P' then 'pending' else case when o_orderkey % 5 = 0 then 'cancelled' else 'completed' end end as status from orders)"


def jobs(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderkey") % 5 == 0, "cancelled").otherwise("completed")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("kind"), status.alias("status"))


@query(f"with {_JOBS} select job, exists (select 1 from jobs b where b.usr = a.usr and b.kind = a.kind and b.job <> a.job and b.status in ('running', 'pending')) as conflict from jobs a")
def job_conflicts(spark, d):
    """Whether each job could not be started beside the customer's other active jobs of its kind."""
    j = jobs(spark, d)
    return access.with_conflicts(j.select("job", "user", "kind"), j, ["user", "kind"]).select("job", "conflict")


@query(f"""with {_JOBS}, r as (select c_custkey as request, 1 + (c_custkey * 7) % (select max(o_orderkey) + 20 from orders) as job, c_custkey % 3 = 0 as cancel, c_custkey as c from customer), q as (select r.request, r.job, case when c % 2 = 0 then j.usr else j.usr + 1 end as usr, r.cancel, j.usr as owner, j.status from r left join jobs j on r.job = j.job),
a as (select *, coalesce(usr = owner, false) as found, case when coalesce(usr = owner, false) then case when cancel and status in ('running', 'pending') then 'cancelled' else status end end as after from q) select request, found, after as status_after, status is null or coalesce(after, status) = 'cancelled' as abort from a""")
def jobs_asked(spark, d):
    """Customers ask for jobs, half of them for another's: what they find, what they stop, who should abort."""
    j = jobs(spark, d)
    top = j.agg(F.max("job")).collect()[0][0] + 20
    c = F.col("c_custkey")
    r = table(spark, d, "customer").select(c.alias("request"), (1 + (c * 7) % top).alias("job"), (c % 3 == 0).alias("cancel"))
    r = r.join(j.select("job", F.col("user").alias("o")), "job", "left").select("request", "job", F.when(F.col("request") % 2 == 0, F.col("o")).otherwise(F.col("o") + 1).alias("user"), "cancel")
    return access.job_answers(r, j)


@query("""with m as (select s_nationkey as team, s_suppkey as usr, case when s_suppkey % 4 = 0 then 'editor' else 'viewer' end as role from supplier), r as (select c_custkey as id, 1 + c_custkey % (select count(*) from supplier) as owner, case when c_custkey % 3 > 0 then c_nationkey end as team from customer)
select owner as usr, id, 'owner' as role from r union all select m.usr, r.id, min(m.role) from r join m using (team) where m.usr <> r.owner group by 1, 2""")
def rows_visible(spark, d):
    """Suppliers as users in teams by nation, customers as rows that they own or share."""
    s, n = table(spark, d, "supplier"), F.col("c_custkey")
    many = s.count()
    members = s.select(F.col("s_nationkey").alias("team"), F.col("s_suppkey").alias("user"), F.when(F.col("s_suppkey") % 4 == 0, "editor").otherwise("viewer").alias("role"))
    rows = table(spark, d, "customer").select(n.alias("id"), (1 + n % many).alias("owner"), F.when(n % 3 > 0, F.col("c_nationkey")).alias("team"))
    return access.visible(rows, members, "id").select(F.col("user").alias("usr"), "id", "role")


@query("""select p_partkey, case when p_partkey % 5 < 3 then p_name end as finding, case when p_partkey % 5 < 2 then p_size end::bigint as n_quotes from part""")
def nested_fields(spark, d):
    """Two fields of the analysis inside a part's metadata; some have no analysis, some are no JSON."""
    n = F.col("p_partkey")
    deep = F.to_json(F.struct(F.struct(F.col("p_name").alias("finding"), F.when(n % 5 < 2, F.col("p_size").cast("bigint")).alias("n_quotes"), F.col("p_type").alias("other")).alias("deep_analysis"), F.col("p_brand").alias("brand")))
    meta = F.when(n % 5 < 3, deep).when(n % 5 == 3, F.to_json(F.struct(F.col("p_brand").alias("brand")))).otherwise("{not json")
    return access.projected(table(spark, d, "part").select("p_partkey", meta.alias("metadata")), "metadata", "$.deep_analysis", {"finding": "string", "n_quotes": "bigint"})


@query("select l_orderkey, l_linenumber from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and o.o_orderstatus = 'F')")
def links_removed(spark, d):
    """Lines whose order was taken out of the library."""
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return edits.remove(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("""with e as (select o_orderkey, case o_orderpriority when '1-URGENT' then ['F'] when '2-HIGH' then ['O', 'P'] when '3-MEDIUM' then ['F', 'O'] else ['P'] end as expected, o_orderstatus as status from orders) select o_orderkey, list_contains(expected, status) as correct from e""")
def rows_marked(spark, d):
    """Whether each order's status is one of those that its priority expects."""
    p = F.col("o_orderpriority")
    expected = F.when(p == "1-URGENT", F.array(F.lit("F"))).when(p == "2-HIGH", F.array(F.lit("O"), F.lit("P"))).when(p == "3-MEDIUM", F.array(F.lit("F"), F.lit("O"))).otherwise(F.array(F.lit("P")))
    return table(spark, d, "orders").select("o_orderkey", reviewers.marked_correct(expected, "o_orderstatus").alias("correct"))
