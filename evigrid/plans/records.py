"""Records: duplicates, venues, resolution, look-ups."""
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import dedup, joins, ranking
from ..registry import query
from ..sources.tables import table
from .views import PAPERS_SQL, RECORDS_SQL, VENUES_SQL, papers, records, venues


@query(f"""with {RECORDS_SQL}, r as (select *, row_number() over (partition by lower(doi) order by citation_count desc, pos) as n, min(pos) over (partition by lower(doi)) as fp from records where doi is not null)
select pos, doi, citation_count, fp as first_pos, 0 as tier from r where n = 1 union all select pos, doi, citation_count, pos, 1 from records where doi is null""")
def dedupe_by_doi(spark, d):
    return dedup.best_by_doi(records(spark, d)).select("pos", "doi", "citation_count", "first_pos", "tier")


#: The pass as such, one record after the other; {{extra}} is what a record that is dropped for its title registers.
_PASS = f"""with recursive {RECORDS_SQL}, o as materialized (select row_number() over (order by pos) as n, pos, doi, title, 'd:' || lower(nullif(trim(doi), '')) as k, 't:' || trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g')) as t from records),
w as (select cast(0 as bigint) as n, cast([] as varchar[]) as seen, false as kept union all select o.n, case when k is not null and list_contains(seen, k) then seen when t is not null and list_contains(seen, t) then {{extra}} else list_concat(seen, list_filter([k, t], lambda x: x is not null)) end,
 not (coalesce(list_contains(seen, k), false) or coalesce(list_contains(seen, t), false)) from w join o on o.n = w.n + 1) select o.pos, o.doi, o.title from o join (select n from w where kept) using (n)"""


@query(_PASS.replace("{extra}", "seen"))
def dedupe_sequential(spark, d):
    """DOI-or-title pass in arrival order."""
    return dedup.sequential(records(spark, d).select("pos", "doi", "title")).select("pos", "doi", "title")


@query(_PASS.replace("{extra}", "list_concat(seen, list_filter([k], lambda x: x is not null))"))
def dedupe_rounds(spark, d):
    """As dedupe_sequential, a title duplicate's DOI counting as seen."""
    return dedup.sequential(records(spark, d).select("pos", "doi", "title"), register_dropped_doi=True).select("pos", "doi", "title")


@query(f"""with {RECORDS_SQL} select external_id, max(citation_count) as citation_count, arg_min(doi, pos) filter (where doi is not null) as doi, count(*) as n_rows from records where external_id is not null group by external_id""")
def dedupe_by_external_id(spark, d):
    return dedup.merged_by_id(records(spark, d), "external_id", "citation_count", ["doi"], "pos")


@query("""with s as (select doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g')) as k from documents) select min(doc_id) as pos, k as title_key from s group by k""")
def distinct_texts(spark, d):
    doc = table(spark, d, "documents").select("doc_id", text.title_key("text").alias("title_key"))
    return doc.groupBy("title_key").agg(F.min("doc_id").alias("pos"))


@query("""select distinct 'p' || cast(l_partkey as varchar) as src, 'p' || cast(l_suppkey as varchar) as dst from lineitem where l_partkey <> l_suppkey""")
def distinct_edges(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("dst"))
    return dedup.distinct_edges(li)


@query("""with f as (select l_orderkey, l_suppkey, min(l_linenumber) as at_pos from lineitem group by 1, 2) select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by at_pos, l_suppkey) as number from f""")
def citation_numbers(spark, d):
    return dedup.numbered_keys(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber")


_KEYS = """keys as (select key, {f}(struct_pack(collection := collection, categories := categories), ord) as v from (select issn as key, * from venues union all select eissn, * from venues) where key is not null group by key)"""


@query(f"""with {VENUES_SQL}, {PAPERS_SQL}, {_KEYS.format(f='arg_min')} select id, case when issn is not null then keys.key is not null end as indexed, v.collection as collection, v.categories as categories from papers left join keys on issn = key""")
def venue_gate_first_wins(spark, d):
    return joins.venue_gate(papers(spark, d), venues(spark, d)).select("id", "indexed", "collection", "categories")


@query(f"""with {VENUES_SQL}, {PAPERS_SQL}, {_KEYS.format(f='arg_max')} select id, case when keys.key is not null then true end as indexed, coalesce(v.collection, brand) as collection from papers left join keys on issn = key""")
def venue_enrich_last_wins(spark, d):
    p = papers(spark, d).withColumn("collection", F.col("brand")).withColumn("indexed", F.lit(None).cast("boolean"))
    return joins.enrich_matched(p, venues(spark, d)).select("id", "indexed", "collection")


@query(f"""with {RECORDS_SQL}, old as (select pos, case when pos % 3 = 1 then null else doi end as doi, case when pos % 3 = 0 then external_id else 'X' || cast(pos as varchar) end as external_id, 'id' || cast(pos as varchar) as id from records), byd as (select doi, min(id) as id from old where doi is not null group by doi), bye as (select external_id, min(id) as id from old group by external_id)
select pos, coalesce(byd.id, bye.id, sha256(coalesce(r.doi, '') || '|' || coalesce(r.external_id, '') || '|' || coalesce(r.title, ''))) as paper_id, byd.id is null and bye.id is null as is_new from records r left join byd on r.doi = byd.doi left join bye on r.external_id = bye.external_id""")
def resolve_records(spark, d):
    r = records(spark, d)
    p = F.col("pos")
    old = r.withColumns({"id": F.concat(F.lit("id"), p.cast("string")), "doi": F.when(p % 3 != 1, F.col("doi")), "external_id": F.when(p % 3 == 0, F.col("external_id")).otherwise(F.concat(F.lit("X"), p.cast("string")))})
    return joins.resolve_ids(r, old).select("pos", "paper_id", "is_new")


@query("""select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0) """)
def library_additions(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    have = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return joins.without_existing(rows, have, ["k"]).select("o_orderkey", F.col("k").alias("o_custkey"))


@query("""select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def analyses_of_known_papers(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.only_known(table(spark, d, "orders"), known, ["o_custkey"]).select("o_orderkey")


@query("""select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as latest from orders group by o_custkey""")
def latest_by_owner(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("""select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 50 offset 100""")
def page_of_library(spark, d):
    return joins.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 50)


@query("""with r as (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) select conv_id, turn, role from r where n <= 3""")
def newest_versions(spark, d):
    return ranking.newest(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", [F.desc("turn")], 3)


@query(f"""with {RECORDS_SQL} select pos, 'https://doi.org/' || doi as raw, lower(doi) as doi_key, coalesce(regexp_full_match(lower(doi), '10\\.[0-9]{{4,9}}/[^\\s]+'), false) as is_valid, external_id as resolved from records""")
def doi_normalisation(spark, d):
    r = records(spark, d).withColumn("raw", F.concat(F.lit("https://doi.org/"), "doi"))
    return r.select("pos", "raw", text.doi_key("raw").alias("doi_key"), text.is_doi("raw").alias("is_valid"), text.resolve_work_id("external_id", "doi").alias("resolved"))


@query("""select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as k from documents""")
def ascii_title_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", text.title_key_ascii("text").alias("k"))


@query("""with s as (select doc_id, trim(regexp_replace(regexp_replace(text, '[*?]', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as c from documents) select doc_id, case when length(c) <= 500 then c else trim(regexp_replace(left(c, 500), ' [^ ]*$', '')) end as q from s""")
def sanitized_queries(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sanitize_query("text").alias("q"))


@query("""select s_suppkey, case when s_suppkey % 2 = 0 then lpad(cast(s_suppkey as varchar), 4, '0') || '-' || lpad(cast(s_suppkey as varchar), 3, '0') || 'X' end as issn from supplier""")
def issn_normalisation(spark, d):
    pad = lambda n: F.lpad(F.col("s_suppkey").cast("string"), n, "0")
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" "), pad(4), pad(3), F.lit("x "))).otherwise("bad")
    return table(spark, d, "supplier").select("s_suppkey", text.issn_key(raw).alias("issn"))


@query("""select c_custkey, c_name || ' et al.' as shown from customer""")
def author_display(spark, d):
    names = F.array(*[F.struct(F.col("c_name").alias("name"))] + [F.struct(F.lit(n).alias("name")) for n in ("B", "C")])
    return table(spark, d, "customer").select("c_custkey", arrays.display_authors(names, 1).alias("shown"))


@query("""select p_partkey, 'The work of ' || p_name as t, list_sort(list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+'))) as toks from part""")
def token_sets(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("The work of "), "p_name").alias("t"), F.array_sort(F.array_distinct(text.tokens("p_type"))).alias("toks"))


@query(f"""with {PAPERS_SQL}, n as (select id, trim(regexp_replace(lower(title), '[^a-z0-9_ ]', '', 'g')) as k from papers) select a.id as lid, b.id as rid from n a join n b on (a.k = b.k or ((contains(a.k, b.k) or contains(b.k, a.k)) and least(length(a.k), length(b.k)) * 1.0 / greatest(length(a.k), length(b.k)) > 0.7)) where a.k <> '' and b.k <> ''""")
def fuzzy_titles(spark, d):
    p = papers(spark, d)
    return joins.fuzzy_title_join(p.select(F.col("id").alias("lid"), "title"), p.select(F.col("id").alias("rid"), "title"))


@query("""with c as (select l_orderkey as k, l_suppkey % 10 as v, l_linenumber as p from lineitem), b as (select l_orderkey as k, arg_max(l_partkey % 10, (l_linenumber, l_partkey)) as b from lineitem group by 1) select c.k, c.v as a, b.b from c join b using (k)""")
def run_pairs(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 10).alias("v"))
    b = li.select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 10).alias("v"), F.struct("l_linenumber", "l_partkey").alias("p"))
    return joins.agreement_pairs(a, b, "k", "v", "p")
