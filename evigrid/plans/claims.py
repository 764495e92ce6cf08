"""Claims made of documents and benchmark items, checked by the guards; citations against a library."""
from pyspark.sql import functions as F

from ..functions import text
from ..operators import claims, joins
from ..registry import query
from ..sources.tables import table
from .views import PAPERS_SQL, papers

#: Turns as claims about their conversation, with what the guards compute from the texts.
_ROWS = r"""c as (select conv_id, turn, coalesce(text, '') as t, (conv_id * 31 + turn) as k from conversations), f as (select conv_id, list(regexp_replace(lower(t), '[^\\p{L}\\p{Nd}]', '', 'g')) as fs, regexp_replace(lower(string_agg(t, ' ')), '[^\\p{L}\\p{Nd}]', '', 'g') as hay from c group by 1),
r as (select conv_id, turn, k, case when k % 19 = 0 then 'error' when k % 17 = 0 then 'no_full_text' when k % 5 = 0 then 'needs_nuance' else 'verified' end as status, case when k % 10 = 3 then t || ' 98765.25' when k % 10 = 6 then 'Wholly other subject matter ' || t else t end as claim, translate(case when k % 6 = 1 then 'zqxj wholly invented words ' || md5(t) else t end, '"“”', '   ') as quote, fs, hay from c join f using (conv_id)),
g as (select *, case when length(trim(quote)) >= 30 then regexp_replace(lower(trim(quote)), '[^\\p{L}\\p{Nd}]', '', 'g') end as seg, list_distinct(list_transform(regexp_extract_all(lower(claim), '[A-Za-z][A-Za-z\'-]{3,}'), lambda w: regexp_replace(w, '[^\\p{L}\\p{Nd}]', '', 'g'))) as terms from r),
h as (select *, seg is not null and len(list_filter(fs, lambda x: contains(x, seg))) > 0 as located, len(terms) > 0 and len(list_filter(terms, lambda w: contains(hay, w))) / cast(nullif(len(terms), 0) as double) < 0.71 as uncovered from g),
j as (select *, case when status = 'no_full_text' then 'unsupported' else status end as s0, status <> 'error' as live, uncovered and not located as misplaced, k % 7 = 2 as contra, seg is not null and not located as loose, k % 10 = 3 as odd from h),
judged as (select *, greatest(case s0 when 'unsupported' then 2 when 'needs_nuance' then 1 else 0 end, case when misplaced or contra then 2 else 0 end) as r0 from j),
guarded as (select conv_id, turn, status, case when not live then s0 when r0 = 2 then 'unsupported' when r0 = 1 or loose or odd then 'needs_nuance' else 'verified' end as final_status, status = 'no_full_text' as had_chunks, live and misplaced as attribution, live and contra as inconsistent, live and r0 = 0 and loose as unquoted, live and odd as numeric_absent from judged)""".replace("\\\\", "\\").replace("\\'", "''")


def claim_rows(spark, d):
    """Each turn as a claim about its conversation, quoting itself; some are made to fail one guard."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"), (F.col("conv_id") * 31 + F.col("turn")).alias("k"))
    chunks = claims.folded_chunks(c.groupBy("conv_id").agg(F.collect_list("t").alias("chunks")))
    k, t = F.col("k"), F.col("t")
    status = F.when(k % 19 == 0, "error").when(k % 17 == 0, "no_full_text").when(k % 5 == 0, "needs_nuance").otherwise("verified")
    claim = F.when(k % 10 == 3, F.concat(t, F.lit(" 98765.25"))).when(k % 10 == 6, F.concat(F.lit("Wholly other subject matter "), t)).otherwise(t)
    quote = F.translate(F.when(k % 6 == 1, F.concat(F.lit("zqxj wholly invented words "), F.md5(t))).otherwise(t), '"“”', "   ")
    verdict = F.when(k % 7 == 2, "contradicted").otherwise("supported")
    return c.join(chunks, "conv_id").select("conv_id", "turn", status.alias("status"), claim.alias("claim"), quote.alias("quote"), "chunks", *claims.FOLDED, F.array(F.struct(verdict.alias("verdict"), F.lit(True).alias("central"))).alias("assertions"))


@query(f"""with {_ROWS} select conv_id, turn, final_status, had_chunks, attribution, inconsistent, unquoted, numeric_absent from guarded""")
def claim_guards(spark, d):
    g = claims.guarded(claim_rows(spark, d))
    has = lambda r: F.array_contains("machine_reasons", r)
    return g.select("conv_id", "turn", "final_status", has("no_full_text_with_chunks").alias("had_chunks"), has("attribution_mismatch").alias("attribution"), has("assertion_status_inconsistent").alias("inconsistent"), has("quote_not_verbatim").alias("unquoted"), has("numeric_value_absent").alias("numeric_absent"))


@query(f"""with {_ROWS} select count(*) filter (where final_status = 'verified') as verified, count(*) filter (where final_status = 'needs_nuance') as needs_nuance, count(*) filter (where final_status = 'unsupported') as unsupported, count(*) filter (where final_status = 'no_full_text') as no_full_text, count(*) filter (where final_status = 'error') as error, count(*) as total from guarded""")
def claim_status_counts(spark, d):
    return claims.status_counts(claims.guarded(claim_rows(spark, d)))


@query(f"""with {_ROWS}, e as (select status <> final_status as c, unnest(list_filter([case when had_chunks then 'no_full_text_with_chunks' end, case when attribution then 'attribution_mismatch' end, case when inconsistent then 'assertion_status_inconsistent' end, case when unquoted then 'quote_not_verbatim' end, case when numeric_absent then 'numeric_value_absent' end], lambda x: x is not null)) as reason from guarded) select reason, count(*) as n, count(*) filter (where c) as n_changed from e group by 1""")
def guard_reason_counts(spark, d):
    return claims.reason_counts(claims.guarded(claim_rows(spark, d)))


@query(f"""with {_ROWS} select status, 'numeric_not_in_source' as slug, count(*) filter (where odd) as n, count(*) filter (where odd) as n_flagged, count(*) as n_rows from judged group by 1 having count(*) filter (where odd) > 0 union all select status, null, null, 0, count(*) from judged group by 1 having count(*) filter (where odd) = 0""")
def diagnostics_by_status(spark, d):
    return claims.tallied(claims.guarded(claim_rows(spark, d)), "diagnostics", ["status"]).select("status", "slug", "n", "n_flagged", "n_rows")


def _without(name: str) -> str:
    """The decision in SQL, as if one of the guards were not there."""
    off = lambda n, x: "false" if n == name else x
    m, c, q, o = off("attribution_mismatch", "misplaced"), off("assertion_status_inconsistent", "contra"), off("quote_not_verbatim", "loose"), off("numeric_value_absent", "odd")
    r = f"greatest(case s0 when 'unsupported' then 2 when 'needs_nuance' then 1 else 0 end, case when {m} or {c} then 2 else 0 end)"
    return f"case when not live then s0 when {r} = 2 then 'unsupported' when {r} = 1 or {q} or {o} then 'needs_nuance' else 'verified' end"


_REPLAY = "with @rows, p as (select conv_id, turn, status, @before as before, @after as after, live and @found as found from judged)".replace("@rows", _ROWS)
_PLAYED = {"numeric_value_absent": "odd", "attribution_mismatch": "misplaced", "quote_not_verbatim": "r0 = 0 and loose", "assertion_status_inconsistent": "contra"}


def _replay(name: str) -> str:
    return _REPLAY.replace("@before", _without(name)).replace("@after", _without("")).replace("@found", "(" + _PLAYED[name] + ")")


@query(f"{_replay('quote_not_verbatim')} select conv_id, turn, before, after, found, before = 'verified' as examined, before <> after as changed, case when status = 'verified' and before <> after then after else status end as new_status, case when status = 'verified' and before <> after and found then 'quote_not_verbatim' else '' end as new_reasons from p")
def guard_replayed(spark, d):
    """Every claim decided without and with the guard of quotes, and what that makes of its frozen status."""
    r = claims.replayed(claim_rows(spark, d), "quote_not_verbatim")
    return r.select("conv_id", "turn", "before", "after", "found", "examined", "changed", "new_status", F.array_join("new_reasons", ",").alias("new_reasons"))


@query(" union all ".join(f"select * from ({_replay(g)} select '{g}' as guard, count(*) as n_rows, count(*) filter (where before = 'verified') as n_examined, count(*) filter (where found) as n_found, count(*) filter (where before <> after) as n_changed, count(*) filter (where status = 'verified' and before <> after and after <> status) as n_moved from p)" for g in _PLAYED))
def guard_reach(spark, d):
    """How many frozen claims each of four guards examines, finds at fault, and moves."""
    return claims.guard_reach(claim_rows(spark, d), tuple(_PLAYED))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'needs_nuance' else 'verified' end as final_status, o_orderkey % 3 = 0 as outside from orders""")
def numerals_outside_passage(spark, d):
    """A claim's number stands in the paper, for a third of the claims not in the chunk that is quoted."""
    n, num = F.col("o_orderkey"), F.format_string("%.2f", F.col("o_totalprice"))
    quoted = F.lit("The quoted passage speaks of costs in general terms")
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("verified").alias("status"), F.concat(F.lit("Costs in general terms of "), num).alias("claim"), quoted.alias("quote"),
        F.array(F.when(n % 3 == 0, quoted).otherwise(F.concat(quoted, F.lit(" and of "), num)), F.concat(F.lit("Elsewhere the cost is "), num)).alias("chunks"), F.array(F.struct(F.lit("supported").alias("verdict"), F.lit(True).alias("central"))).alias("assertions"))
    return claims.guarded(rows).select("o_orderkey", "final_status", F.array_contains("machine_reasons", "numeric_outside_cited_passage").alias("outside"))


@query(f"""with {PAPERS_SQL}, lib as (select distinct lower(string_split(title, ' ')[-1]) as surname, case when id % 10 = 0 then null else cast(year as varchar) end as y from papers), c as (select o_orderkey, lower(string_split(p_name, ' ')[-1]) as surname, cast(1981 + o_custkey % 50 as varchar) as year from orders join part on p_partkey = 1 + o_orderkey % (select max(p_partkey) from part))
select o_orderkey, exists (select 1 from lib where lib.surname = c.surname and lib.y = c.year) or exists (select 1 from lib where lib.surname = c.surname and lib.y is null) as found from c""")
def citation_audit(spark, d):
    p = papers(spark, d)
    last = lambda c: F.lower(F.element_at(F.split(c, " "), -1))
    lib = p.select(last("title").alias("surname"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("year").cast("string")).alias("year_key"))
    top = table(spark, d, "part").agg(F.max("p_partkey")).collect()[0][0]
    cites = table(spark, d, "orders").withColumn("k", 1 + F.col("o_orderkey") % top).join(table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name"), "k").select("o_orderkey", last("p_name").alias("surname"), (1981 + F.col("o_custkey") % 50).cast("string").alias("year"))
    return joins.audit(cites, lib).select("o_orderkey", "found")


@query("""select c_custkey, lower(regexp_extract(c_name, '([^ #]+)', 1)) as surname, cast(1990 + c_custkey % 30 as varchar) as year from customer""")
def citations_in_text(spark, d):
    """The citation in a sentence made for each customer, found again in the running text."""
    year = (1990 + F.col("c_custkey") % 30).cast("string")
    name = F.regexp_extract("c_name", "([^ #]+)", 1)
    s = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("it was shown that this holds ("), name, F.lit(" et al., "), year, F.lit(").")).alias("s")).otherwise(F.concat(F.lit("as "), name, F.lit(" ("), year, F.lit(") has argued.")))
    docs = table(spark, d, "customer").select("c_custkey", s.alias("s"))
    return claims.citation_keys(docs, "c_custkey", "s").select("c_custkey", "surname", "year")


@query("""select p_partkey, list_sort(list_distinct([1 + p_partkey % 9, 3, 4, 5])) as numbers from part""")
def bracket_citations(spark, d):
    s = F.concat(F.lit("see ["), (1 + F.col("p_partkey") % 9).cast("string"), F.lit("] and [3-5], but not [400]"))
    a = claims.numbered_citations(s, 20)
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.transform(a, lambda x: x.cast("bigint"))).alias("numbers"))


@query("""select p_partkey, p_retailprice as value, p_partkey % 2 = 0 as percent from part where not (p_partkey % 2 <> 0 and p_retailprice between 1500 and 2100 and p_retailprice = floor(p_retailprice))""")
def numerals_in_text(spark, d):
    s = F.concat(F.lit("CTLA-4 in 1999: it cost "), F.format_string("%.2f", "p_retailprice"), F.when(F.col("p_partkey") % 2 == 0, "%").otherwise(""), F.lit(" of all"))
    n = table(spark, d, "part").select("p_partkey", F.explode(claims.numerals(s)).alias("n"))
    return n.select("p_partkey", "n.value", "n.percent")


@query("""select doc_id, length(trim(translate(text, '"“”', '   '))) >= 30 and doc_id % 2 = 0 as verbatim from documents where length(regexp_replace(text, '[^\\p{L}\\p{Nd}]', '', 'g')) > 0""")
def quotes_located(spark, d):
    """Whole texts looked for in themselves; every second one has a word put before its end."""
    doc = table(spark, d, "documents").where(F.length(F.regexp_replace("text", r"[^\p{L}\p{Nd}]", "")) > 0).withColumn("t", F.translate("text", '"“”', "   "))
    quote = F.when(F.col("doc_id") % 2 == 0, F.col("t")).otherwise(F.concat(F.col("t"), F.lit(" nowhere in there at all zqxj")))
    return doc.select("doc_id", claims.located(quote, F.array(F.col("text"))).alias("verbatim"))


@query("""select c_custkey, lower(regexp_extract(c_name, '#?([0-9]+)$', 1)) as surname, 'Customer' as given from customer""")
def author_names_split(spark, d):
    n = text.family_given(F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", F.lower(n["family"]).alias("surname"), n["given"].alias("given"))
