"""Files written to the shared folder and read back: tables, venue lists, bibliographies, JSON, datasets."""
from pyspark.sql import functions as F

from ..registry import query
from ..sources import files
from ..sources.tables import scratch, table
from .scalars import S
from .views import RECORDS_SQL, records


def _part(spark, d):
    n = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "as said"')).alias("p_name"), F.when(n % 5 == 0, "N/A").otherwise(S("p_size")).alias("p_size"), F.when(n % 7 == 0, None).otherwise(F.col("p_retailprice")).alias("p_retailprice"))


_PART_SQL = """select p_partkey, p_name || ', "as said"' as p_name, case when p_partkey % 5 = 0 then null else cast(p_size as bigint) end as p_size, case when p_partkey % 7 = 0 then null else p_retailprice end as p_retailprice from part"""


@query(_PART_SQL)
def csv_table(spark, d):
    """Quotes, commas and missing marks through a CSV file; types come back by inference."""
    path = scratch(spark, "csv")
    _part(spark, d).write.option("header", True).option("escape", '"').csv(path)
    return files.read_table(spark, path, "csv")


@query(_PART_SQL.replace(', "as said"', " as said"))
def tsv_table(spark, d):
    path = scratch(spark, "tsv")
    _part(spark, d).withColumn("p_name", F.replace(F.replace("p_name", F.lit(","), F.lit("")), F.lit('"'), F.lit(""))).write.option("header", True).option("sep", "\t").csv(path)
    return files.read_table(spark, path, "tsv")


@query("select * from supplier")
def parquet_table(spark, d):
    path = scratch(spark, "parquet") + ".parquet"
    table(spark, d, "supplier").write.parquet(path)
    return files.read_table(spark, path)


@query("""select c_custkey, case c_custkey % 5 when 0 then null when 1 then 'empty file' when 2 then 'unsupported type' when 3 then 'file too large' end as problem from customer""")
def upload_problems(spark, d):
    """Uploads by name and size; the rule is the driver's, since it runs before there is a table."""
    cases = [("a.csv", 10), ("b.TSV", 0), ("c.pdf", 10), ("d.xlsx", 50 * 1024 * 1024 + 1), ("e.x.xlsx", 50 * 1024 * 1024)]
    found = F.array(*[F.lit(files.upload_problem(*c)).cast("string") for c in cases])
    return table(spark, d, "customer").select("c_custkey", F.get(found, (F.col("c_custkey") % 5).cast("int")).alias("problem"))


@query("""select s_suppkey, s_name, 'cleaned' as kind from supplier where s_suppkey % 2 = 0 union all select s_suppkey, s_name, 'raw' from supplier""")
def datasets_loaded(spark, d):
    """A dataset with a cleaned table, and one without."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    one, two = scratch(spark, "dataset"), scratch(spark, "dataset")
    for folder in (one, two):
        s.write.option("header", True).csv(f"{folder}/raw.csv")
    s.where("s_suppkey % 2 = 0").write.parquet(f"{one}/cleaned.parquet")
    return files.load_dataset(spark, one).withColumn("kind", F.lit("cleaned")).unionByName(files.load_dataset(spark, two).withColumn("kind", F.lit("raw")))


@query("""select s_name as journal_title, 'A' || lpad(cast(s_suppkey as varchar), 3, '0') || '-000X' as issn, case when s_suppkey % 2 = 0 then null else 'B' || s_suppkey end as eissn, case when s_suppkey % 3 = 0 then 'SSCI' when s_suppkey % 3 = 1 then 'AHCI' else 'WOS' end as collection from supplier""")
def venue_lists(spark, d):
    """Venue lists by collection, of which the file's folder names the code; ISSNs come in lower case with blanks."""
    n = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_name").alias("t"), F.concat(F.lit(" a"), F.lpad(S("s_suppkey"), 3, "0"), F.lit("-000x ")).alias("issn"), F.when(n % 2 == 0, " ").otherwise(F.concat(F.lit("b"), S("s_suppkey"))).alias("eissn"), F.lit("P").alias("p"), F.lit("").alias("a"), F.lit("").alias("l"), F.lit("c").alias("c"), (n % 3).alias("k"))
    root, out = scratch(spark, "venues"), None
    for k, name in enumerate(("list (SSCI) of AHCI", "old ahci list", "others")):
        s.where(F.col("k") == k).drop("k").write.option("header", True).csv(f"{root}/{k}")
        rows = files.read_venues(spark, f"{root}/{k}").withColumn("collection", files.collection_of(F.lit(name)))
        out = rows if out is None else out.unionByName(rows)
    return out.select("journal_title", "issn", "eissn", "collection")


@query("""select s_suppkey, s_name, case when s_suppkey % 2 = 0 then 'A' else 'B' end as collection from supplier where s_suppkey % 2 = 1 or s_suppkey % 4 = 0""")
def collection_replaced(spark, d):
    """Collection A is written anew with half of its rows; B stays."""
    path = scratch(spark, "collections")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("B").alias("collection"))
    files.replace_collections(s, path)
    files.replace_collections(s.where("s_suppkey % 4 = 0"), path)
    return spark.read.parquet(path).select("s_suppkey", "s_name", "collection")


@query("""select p_partkey, p_name || ' of ' || p_type as title, case when p_partkey % 3 = 0 then 'Lee, A.' else 'van Dam, B. and Lee, A.' end as authors, case when p_partkey % 4 = 0 then null else 1990 + p_size end as year, case when p_partkey % 3 = 0 then 'lee' else 'dam' end || case when p_partkey % 4 = 0 then '' else cast(1990 + p_size as varchar) end as key from part""")
def bibliography_written(spark, d):
    """Papers to BibTeX and back, with the keys of the entries."""
    n = F.col("p_partkey")
    names = F.when(n % 3 == 0, F.array(F.lit("Lee, A."))).otherwise(F.array(F.lit("van Dam, B."), F.lit("Lee, A.")))
    papers = table(spark, d, "part").select(names.alias("authors"), F.concat_ws(" of ", "p_name", "p_type").alias("title"), F.lit("J").alias("journal"), F.when(n % 4 != 0, (1990 + F.col("p_size")).cast("int")).alias("year"), F.concat(F.lit("10.1/"), S("p_partkey")).alias("doi"))
    back = files.to_bibtex(papers).select(F.regexp_extract("value", r"\{([^,]*),", 1).alias("key"), F.explode(files.parse_bibtex("value")).alias("b"))
    return back.select(F.substring_index("b.doi", "/", -1).cast("bigint").alias("p_partkey"), "b.title", F.array_join("b.authors", " and ").alias("authors"), "b.year", "key")


_WORKS = "works as (select 'W' || p_partkey as external_id, p_name || ' ' || p_type as title, cast(1980 + p_size as integer) as year, cast(p_retailprice as integer) % 90 as citation_count from part)"


def _works(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("W"), S("p_partkey")).alias("external_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), (1980 + F.col("p_size")).cast("int").alias("year"), (F.rint("p_retailprice").cast("int") % 90).alias("citation_count"))


@query(f"""with {_WORKS} select * from works where contains(lower(title), 'ring') and contains(lower(title), 'economy') and year >= 1990 and year <= 2025 and citation_count >= 5 order by citation_count desc, external_id limit 25""")
def provider_search(spark, d):
    return files.search_works(_works(spark, d), "Ring economy", 1990, 2025, 5, 25)


@query(f"""with {_WORKS}, i as (select 'W' || l_partkey as id, min(l_orderkey * 10 + l_linenumber) as place from lineitem group by 1) select place, external_id, title from works join i on id = external_id""")
def works_fetched(spark, d):
    """Works of a list of ids that repeat, each at its first place."""
    ids = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.concat(F.lit("W"), S("l_partkey")).alias("id"))
    return files.works_by_ids(_works(spark, d), ids).select(F.col("at").alias("place"), "external_id", "title")


@query("""select '10.7/' || p_partkey as doi, p_name as title, case when p_partkey % 3 = 0 then null else cast(1990 + p_size as integer) end as year, case when p_partkey % 2 = 0 then cast(p_size as integer) else 0 end as citation_count from part""")
def registry_parsed(spark, d):
    n = F.col("p_partkey")
    js = F.to_json(F.struct(F.concat(F.lit("10.7/"), S("p_partkey")).alias("DOI"), F.array("p_name", F.lit("another")).alias("title"), F.struct(F.when(n % 3 != 0, F.array(F.array((1990 + F.col("p_size")).cast("int"), F.lit(5)))).alias("date-parts")).alias("issued"), F.when(n % 2 == 0, F.col("p_size")).alias("is-referenced-by-count")))
    return files.registry_records(table(spark, d, "part").select(js.alias("json")))


@query("""select conv_id, turn, role, text from conversations union all select conv_id, turn, role, 'again' from conversations where turn = 0""")
def jsonl_appended(spark, d):
    """Records written as lines, more of them appended, and all read back."""
    path = scratch(spark, "jsonl")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    files.append_jsonl(c, path)
    files.append_jsonl(c.where("turn = 0").withColumn("text", F.lit("again")), path)
    return files.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("""select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 5)""")
def pending_items(spark, d):
    done = table(spark, d, "lineitem").where("l_quantity > 5").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.pending(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query(f"""with {RECORDS_SQL} select cast(pos as varchar) as record_id, case pos % 4 when 0 then 1 when 1 then 0 when 2 then 1 end as label, case when pos % 5 = 0 then null else 't' || pos end as title, case when trim(source) = '' then null else trim(source) end as abstract, case when pos % 6 = 0 then null else year end as year from records""")
def review_sets(spark, d):
    """Labels, blanks and years of a labelled set's text cells, through a CSV file."""
    path, p = scratch(spark, "reviews"), F.col("pos")
    label = F.when(p % 4 == 0, "1").when(p % 4 == 1, "0.0").when(p % 4 == 2, "TRUE").otherwise("unsure")
    cells = records(spark, d).select(S("pos").alias("record_id"), label.alias("label"), F.when(p % 5 == 0, " ").otherwise(F.concat(F.lit("t"), S("pos"))).alias("title"), F.col("source").alias("abstract"), F.when(p % 6 == 0, "0").otherwise(S("year")).alias("year"))
    cells.write.option("header", True).csv(path)
    return files.review_rows(spark.read.option("header", True).schema("record_id string, label string, title string, abstract string, year string").csv(path))


@query("""with l as (select distinct l_orderkey, l_partkey from lineitem where l_partkey % 5 <> 0) select l_orderkey as claim_id, l_partkey as doc_id, case when l_partkey % 3 = 0 then 'CONTRADICT' when l_partkey % 3 = 1 then 'SUPPORT' else 'NOT_ENOUGH_INFO' end as gold, cast(1 + l_partkey % 2 as integer) as n_sentences from l""")
def claim_document_pairs(spark, d):
    """Claims with their cited documents and what the evidence says of them."""
    n = F.col("l_partkey")
    labels = F.when(n % 3 == 0, F.array(F.lit("SUPPORT"), F.lit("CONTRADICT"))).when(n % 3 == 1, F.array(F.lit("SUPPORT"))).otherwise(F.array().cast("array<string>"))
    cites = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    claims = cites.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("cited"), F.map_from_entries(F.collect_list(F.struct(S("l_partkey"), labels))).alias("evidence"))
    corpus = table(spark, d, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 2 == 0, F.array("p_name")).otherwise(F.array("p_name", "p_type")).alias("abstract"))
    return files.claim_pairs(claims, corpus)


@query("""select o_orderkey as item_id, case when o_custkey % 2 = 0 then 'chunk ' || (o_orderkey % 3) || ' of ' || o_custkey end as text from orders""")
def claims_with_chunks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), S("o_custkey").alias("chunk_doi"), (F.col("o_orderkey") % 3).alias("chunk_index"))
    k = o.select("chunk_doi", "chunk_index").distinct().where("cast(chunk_doi as bigint) % 2 = 0")
    cached = k.withColumn("text", F.concat(F.lit("chunk "), S("chunk_index"), F.lit(" of "), "chunk_doi"))
    return files.claim_chunks(o, cached).select("item_id", "text")


@query("""select r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' as line from region""")
def markdown_rows(spark, d):
    """A small table as Markdown, by line."""
    text = files.markdown_table(table(spark, d, "region").select("r_regionkey", "r_name"))
    rows = spark.createDataFrame([(x,) for x in text.split("\n")[2:]], "line string")
    return rows.select(F.regexp_extract("line", r"^\| (\d+)", 1).cast("int").alias("r_regionkey"), "line")
