"""References, evidence, hydration, acquisition, compliance and reviewers."""
from pyspark.sql import functions as F

from ..operators import evaluation, evidence, joins, references
from ..registry import query
from ..sources.tables import table
from .views import PAPERS_SQL, RECORDS_SQL, VENUES_SQL, papers, records, venues

_P = """p as (select p_partkey, p_name as title, case when p_partkey % 4 = 0 then null else p_brand end as journal, case when p_partkey % 7 = 0 then null else cast(1990 + p_size as varchar) end as year, case when p_partkey % 3 = 0 then null else '10.1/' || cast(p_partkey as varchar) end as doi from part)"""


def _cited(spark, d):
    n = F.col("p_partkey")
    names = F.array(F.lit("van Dijk, Teun A."), F.lit("Jane Q. Smith"), F.lit("Plato"))
    return table(spark, d, "part").select("p_partkey", references.split_authors(names).alias("authors"), F.col("p_name").alias("title"), F.when(n % 4 == 0, None).otherwise(F.col("p_brand")).alias("journal"), F.when(n % 7 == 0, None).otherwise((1990 + F.col("p_size")).cast("int")).alias("year"), F.when(n % 3 == 0, None).otherwise(F.concat(F.lit("10.1/"), n.cast("string"))).alias("doi"), n.alias("number"))


@query(f"""with {_P} select p_partkey, 'van Dijk, T. A., Smith, J. Q., & Plato (' || coalesce(year, 'n.d.') || '). ' || title || '.' || coalesce(' ' || journal || '.', '') || coalesce(' https://doi.org/' || doi, '') as apa, '[' || cast(p_partkey as varchar) || '] T. A. van Dijk, J. Q. Smith and Plato, "' || title || ',"' || case when journal is null and year is null then '.' else ' ' || concat_ws(', ', journal, year) || '.' end || coalesce(' doi: ' || doi || '.', '') as ieee,
cast(p_partkey as varchar) || '. van Dijk TA, Smith JQ, Plato. ' || title || '.' || coalesce(' ' || journal || '.', '') || coalesce(' ' || year || '.', '') || coalesce(' doi:' || doi || '.', '') as vancouver, 'van Dijk, Teun A., et al. "' || title || '." ' || concat_ws(', ', journal, coalesce(year, 'n.d.'), 'https://doi.org/' || doi) || '.' as mla,
'van Dijk, Teun A., Jane Q. Smith, and Plato. ' || coalesce(year, 'n.d.') || '. "' || title || '."' || coalesce(' ' || journal || '.', '') || coalesce(' https://doi.org/' || doi, '') as chicago, 'van Dijk, T.A., Smith, J.Q. and Plato (' || coalesce(year, 'n.d.') || ') ''' || title || '''' || coalesce(', ' || journal || '.', '.') || coalesce(' Available at: https://doi.org/' || doi, '') as harvard from p""")
def reference_styles(spark, d):
    return _cited(spark, d).select("p_partkey", *[references.reference(s).alias(s) for s in references.STYLES])


@query(f"""with {RECORDS_SQL}, {VENUES_SQL}, k as (select distinct key from (select issn as key from venues union select eissn from venues) where key is not null), r as (select pos, lang, lpad(cast(pos % 60 as varchar), 4, '0') || '-' || lpad(cast(pos % 7 as varchar), 4, '0') as a, pos % 5 = 0 as bare from records), h as (select lang, not bare as has, not bare and a in (select key from k) as hit from r)
select lang, count(*) as n, count(*) filter (where has) as n_with_issn, count(*) filter (where hit) as n_listed, round(count(*) filter (where hit) / cast(count(*) as double), 9) as share, round(count(*) filter (where hit) / cast(nullif(count(*) filter (where has), 0) as double), 9) as share_of_resolved from h group by lang""")
def gate_effect(spark, d):
    pad = lambda n: F.lpad((F.col("pos") % n).cast("string"), 4, "0")
    r = records(spark, d).select(F.col("pos").alias("id"), "lang", F.when(F.col("pos") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(pad(60), F.lit("-"), pad(7)))).alias("issns"))
    g = evaluation.gate_effect(r, joins.venue_keys(venues(spark, d), True), ["lang"])
    return g.withColumns({c: F.round(c, 9) for c in ("share", "share_of_resolved")})


@query(f"""with {RECORDS_SQL}, w as (select pos as work_id, case when pos % 6 = 0 then external_id end as external_id, case when pos % 3 = 1 then doi end as doi, case when pos % 3 = 2 then title else 'another title altogether ' || cast(pos as varchar) end as title from records), byid as (select external_id as k, min(work_id) as w from w where external_id is not null group by 1), byd as (select lower(doi) as k, min(work_id) as w from w where doi is not null group by 1), byt as (select trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as k, min(work_id) as w from w group by 1 having length(k) >= 15)
select r.pos as record_id, coalesce(byid.w, byd.w, byt.w) as work_id, case when byid.w is not null then 'id' when byd.w is not null then 'doi' when byt.w is not null then 'title' end as route from records r left join byid on r.external_id = byid.k left join byd on lower(r.doi) = byd.k left join byt on trim(regexp_replace(lower(r.title), '[^a-z0-9]+', ' ', 'g')) = byt.k""")
def hydration_routes(spark, d):
    r = records(spark, d).select(F.col("pos").alias("record_id"), "external_id", "doi", "title")
    p = F.col("pos")
    w = records(spark, d).select(p.alias("work_id"), F.when(p % 6 == 0, F.col("external_id")).alias("external_id"), F.when(p % 3 == 1, F.col("doi")).alias("doi"), F.when(p % 3 == 2, F.col("title")).otherwise(F.concat(F.lit("another title altogether "), p.cast("string"))).alias("title"))
    return evaluation.hydrate(r, w).select("record_id", "work_id", "route")


@query("""with a as (select l_orderkey as paper_id, l_linenumber * 1000000 + l_partkey as rank, l_quantity > 10 as txt, l_quantity % 3 <> 0 as ok, l_quantity % 2 = 0 as inter, cast(l_partkey as varchar) as url from lineitem), g as (select paper_id, bool_or(txt and ok) as good, bool_or(txt and not ok) as wrong, bool_and(inter) as inter, arg_min(url, rank) filter (where txt and ok) as url from a group by 1)
select paper_id, case when good then 'acquired' else 'abstract_only' end as outcome, case when good then null when wrong then 'wrong_work' when inter then 'publisher_interstitial' end as reason, case when good then url end as url from g""")
def full_text_acquisition(spark, d):
    q = F.col("l_quantity")
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("rank"), F.when(q > 10, "text").alias("text"), (q % 3 != 0).alias("identity_ok"), (q % 2 == 0).alias("interstitial"), F.col("l_partkey").cast("string").alias("url"))
    return evaluation.acquired(a)


@query("""select doc_id as draft_id, 'word_count' as check_type, case when n_chars between 1000 and 3000 then 'pass' when n_chars > 3000 or n_chars >= 500 then 'warning' else 'fail' end as status from documents union all select doc_id, 'abstract_length', case when n_chars % 400 = 0 then 'fail' when n_chars % 400 between 150 and 300 then 'pass' else 'warning' end from documents union all select doc_id, 'sections_present', case doc_id % 5 when 0 then 'pass' when 1 then 'warning' when 2 then 'warning' else 'fail' end from documents""")
def compliance_checks(spark, d):
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("draft_id"), F.col("n_chars").alias("words"), (F.col("n_chars") % 400).alias("abstract_words"), F.slice(F.array(*[F.lit(x) for x in "abcd"]), F.lit(1), (F.col("doc_id") % 5).cast("int")).alias("missing"))
    return evaluation.compliance(doc, 1000, 3000)


@query()
def evidence_acceptance(spark, d):
    """Quotes of two sentences of each document, some cut short, looked for in its two halves."""
    from ..operators.chunks import sentences_of
    from ..operators.claims import computed

    docs = table(spark, d, "documents").select("doc_id", "text")
    # the filter behind computed(), so that sentences are not cut for it and again for the quotes
    doc = computed(docs.select("doc_id", F.slice(sentences_of("text"), 1, 4).alias("s"))).where("size(s) > 3")
    quote = F.concat_ws(" ", F.element_at("s", 1), F.element_at("s", 2))
    items = doc.select(F.col("doc_id").alias("paper_id"), F.explode(F.array(F.struct(F.lit(0).alias("item"), quote.alias("quote")), F.struct(F.lit(1).alias("item"), F.left(quote, F.length(quote) - 4).alias("quote")))).alias("q")).select("paper_id", "q.*", F.lit(0).alias("chunk_index"))
    chunks = docs.select(F.col("doc_id").alias("paper_id"), F.lit(0).alias("idx"), "text")
    return evidence.acceptance(evidence.located_items(items, chunks), ["item"])


@query("""with c as (select o_custkey as item, o_orderstatus as label, count(*) as k from orders group by 1, 2) select item, sum(k) as n_reviewers, cast(sum(k * (k - 1) / 2) as bigint) as agreeing, cast(sum(k) * (sum(k) - 1) / 2 as bigint) as pairs from c group by 1""")
def reviewer_pairs(spark, d):
    return evaluation.majority_agreement(table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("reviewer"), F.col("o_orderstatus").alias("label")), "item", "reviewer", "label")


@query(f"""with {RECORDS_SQL} select count(*) as n, round(count(*) filter (where length(abstract) <= 500) / cast(count(*) as double), 9) as within_500, round(count(*) filter (where length(abstract) <= 1000) / cast(count(*) as double), 9) as within_1000, round(count(*) filter (where length(abstract) <= 2000) / cast(count(*) as double), 9) as within_2000, round(count(*) filter (where length(abstract) <= 4000) / cast(count(*) as double), 9) as within_4000 from records""")
def abstract_lengths(spark, d):
    s = evaluation.length_shares(records(spark, d), "abstract")
    return s.withColumns({c: F.round(c, 9) for c in s.columns if c != "n"})


@query(f"""with {PAPERS_SQL}, c as (select id, title, year, id as cand_year from papers), j as (select id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) as a from papers) select id, round(cast(len(a) as double) / len(a), 9) as score from j where len(a) > 0""")
def best_candidates(spark, d):
    p = papers(spark, d)
    cand = p.select("id", F.lit("self").alias("cand"), "title", "year").unionByName(p.select("id", F.lit("far").alias("cand"), "title", (F.col("year") + 5).alias("year")))
    return joins.best_candidate(p.select("id", "title", "year"), cand).select("id", F.round("score", 9).alias("score"))
