"""Tabular datasets: edits, previews, exports, stale jobs."""
from pyspark.sql import functions as F

from ..functions import text
from ..operators import edits
from ..registry import query
from ..sources import files
from ..sources.tables import table


@query("""select p_partkey, p_name as label, try_cast(p_brand as double) as brand_no, cast(p_size as varchar) as p_size, p_retailprice from part""")
def column_updates(spark, d):
    cols = [{"name": c, "dtype": "text"} for c in table(spark, d, "part").columns]
    plan = edits.plan_updates(cols, [{"name": "p_type", "deleted": True}, {"name": "p_name", "new_name": "label"}, {"name": "p_brand", "new_name": "brand_no", "dtype": "numeric"}, {"name": "nothing", "deleted": True}, {"name": "p_size", "dtype": "categorical"}])
    return edits.apply_plan(table(spark, d, "part"), plan)


@query("""select s_suppkey as row_index, case when s_suppkey % 10 = 3 then 'edited' else s_name end as s_name, s_acctbal from supplier""")
def cell_edits(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_index"), "s_name", "s_acctbal")
    e = s.where("row_index % 10 = 3").select("row_index", F.lit("s_name").alias("column"), F.lit("edited").alias("value"))
    return edits.apply_edits(s, e)


@query("""select o_orderkey, o_orderdate from orders order by o_orderkey limit 20""")
def preview_rows(spark, d):
    return files.preview(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", 20)


@query("""select cast(c_custkey as varchar) || ':c_name' as segment_id, c_name as text from customer union all select cast(c_custkey as varchar) || ':c_mktsegment', c_mktsegment from customer""")
def coding_segments(spark, d):
    return edits.text_segments(table(spark, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"])


@query("""select event_id, case when event_type in ('click', 'view') and ts < (select max(ts) from events) - interval 10 minute then 'failed' else event_type end as status from events""")
def stale_jobs(spark, d):
    e = table(spark, d, "events")
    cutoff = e.agg(F.max("ts").alias("m")).collect()[0][0]
    import datetime

    jobs = e.select("event_id", F.when(F.col("event_type").isin("click", "view"), "running").otherwise(F.col("event_type")).alias("status"), F.col("event_type").alias("t"), F.col("ts").alias("updated_at"), F.lit(None).cast("string").alias("error"))
    done = edits.failed_stale(jobs, F.lit(cutoff - datetime.timedelta(minutes=10)).cast("timestamp_ntz"))
    return done.select("event_id", F.when(F.col("status") == "running", F.col("t")).otherwise(F.col("status")).alias("status"))


@query("""select c_custkey, chr(39) || chr(61) || c_name as cell from customer""")
def export_cells(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.csv_cell(F.concat(F.lit("="), "c_name")).alias("cell"))


@query("""select o_orderkey, o_orderstatus from orders where o_orderkey % 4 <> 0 union all select o_orderkey, 'X' from orders where o_orderkey % 4 = 0""")
def upserted(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return edits.upsert(o, o.where("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("""select s_suppkey, '@' as k, s_name from supplier where s_suppkey % 3 <> 0""")
def bibliography_missing(spark, d):
    """Entries without a title are dropped: every third one has none."""
    n = F.col("s_suppkey")
    titled = F.when(n % 3 == 1, F.concat(F.lit(", title = {"), "s_name", F.lit("}"))).when(n % 3 == 2, F.concat(F.lit(',\n TITLE = "'), "s_name", F.lit('"'))).otherwise("")
    entry = F.concat(F.lit("@article{x, author = {"), "s_name", F.lit("}"), titled, F.lit("\n}"))
    s = table(spark, d, "supplier").select("s_suppkey", F.explode(files.parse_bibtex(entry)).alias("b"))
    return s.select("s_suppkey", F.lit("@").alias("k"), F.col("b.title").alias("s_name"))


@query("""select p_partkey, p_name as title, 'Lee, A. and Ng, B.' as authors, cast(1990 + p_size as integer) as year, '10.1/' || cast(p_partkey as varchar) as doi from part""")
def bibliography(spark, d):
    entry = F.concat(F.lit("@article{k1,\n title = {"), "p_name", F.lit("},\n author = \"Lee, A. and Ng, B.\",\n year = "), (1990 + F.col("p_size")).cast("string"), F.lit(",\n doi = {https://doi.org/10.1/"), F.col("p_partkey").cast("string"), F.lit("}\n}\n"))
    b = table(spark, d, "part").select("p_partkey", F.explode(files.parse_bibtex(entry)).alias("b"))
    return b.select("p_partkey", "b.title", F.array_join("b.authors", " and ").alias("authors"), "b.year", "b.doi")


@query("""select p_partkey, 'W' || cast(p_partkey as varchar) as external_id, p_name as title, cast(p_size as integer) as citation_count, 'two words' as abstract from part""")
def works_parsed(spark, d):
    js = F.to_json(F.struct(F.concat(F.lit("https://openalex.org/W"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("cited_by_count"), F.create_map(F.lit("words"), F.array(F.lit(1)), F.lit("two"), F.array(F.lit(0))).alias("abstract_inverted_index")))
    w = files.parse_works(table(spark, d, "part").select(js.alias("json")))
    return w.select(F.substr("external_id", F.lit(2)).cast("bigint").alias("p_partkey"), "external_id", "title", "citation_count", "abstract")
