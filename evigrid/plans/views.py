"""The reference concepts as views of the provided tables, in Spark and as SQL text."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table

#: Retrieved records: a document's first line is its title, copies share the DOI made of their text.
RECORDS_SQL = """records as (select doc_id as pos, case when doc_id % 5 = 0 then null when doc_id % 2 = 0 then upper('10.1000/x' || substr(md5(text), 1, 8)) else '10.1000/x' || substr(md5(text), 1, 8) end as doi,
 substr(text, 1, 60) as title, (n_chars % 97) as citation_count, cast(1985 + doc_id % 40 as integer) as year, lang, source, 'W' || cast(doc_id % 400 as varchar) as external_id, text as abstract, n_chars from documents)"""


def records(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    doi = F.concat(F.lit("10.1000/x"), F.substring(F.md5("text"), 1, 8))
    return doc.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 2 == 0, F.upper(doi)).otherwise(doi).alias("doi"), F.substring("text", 1, 60).alias("title"), (F.col("n_chars") % 97).alias("citation_count"),
                      (1985 + F.col("doc_id") % 40).cast("int").alias("year"), "lang", "source", F.concat(F.lit("W"), (F.col("doc_id") % 400).cast("string")).alias("external_id"), F.col("text").alias("abstract"), "n_chars")


#: Venues: suppliers, their keys as ISSN and eISSN, the region as collection.
VENUES_SQL = """venues as (select s_suppkey as ord, lpad(cast(s_suppkey % 40 as varchar), 4, '0') || '-' || lpad(cast(s_suppkey % 7 as varchar), 4, '0') as issn, case when s_suppkey % 3 = 0 then lpad(cast(s_suppkey % 25 as varchar), 4, '0') || '-0001' end as eissn,
 r_name as collection, n_name as categories from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def venues(spark, d) -> DataFrame:
    pad = lambda c, n: F.lpad((F.col("s_suppkey") % n).cast("string"), 4, "0")
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(F.col("s_suppkey").alias("ord"), F.concat(pad(0, 40), F.lit("-"), pad(0, 7)).alias("issn"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(pad(0, 25), F.lit("-0001"))).alias("eissn"), F.col("r_name").alias("collection"), F.col("n_name").alias("categories"))


PAPERS_SQL = """papers as (select p_partkey as id, p_name as title, case when p_size % 4 = 0 then null else lpad(cast(p_partkey % 45 as varchar), 4, '0') || '-' || lpad(cast(p_partkey % 7 as varchar), 4, '0') end as issn, p_brand as brand, cast(p_retailprice as integer) % 60 as cites, cast(1980 + p_size as integer) as year from part)"""


def papers(spark, d) -> DataFrame:
    pad = lambda n: F.lpad((F.col("p_partkey") % n).cast("string"), 4, "0")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 4 == 0, None).otherwise(F.concat(pad(45), F.lit("-"), pad(7))).alias("issn"), F.col("p_brand").alias("brand"), (F.round("p_retailprice").cast("int") % 60).alias("cites"), (1980 + F.col("p_size")).cast("int").alias("year"))


#: Screening decisions: labels as gold, a length rule as the screener's.
SCREENED_SQL = """screened as (select l.doc_id, l.quality as label, case when d.n_chars % 11 = 0 then null when d.n_chars > 900 then 1 else 0 end as predicted, cast(d.n_chars % 1009 as double) as score, d.lang, d.source from labels l join documents d on l.doc_id = d.doc_id)"""


def screened(spark, d) -> DataFrame:
    doc = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    n = F.col("n_chars")
    return table(spark, d, "labels").join(doc, "doc_id").select("doc_id", F.col("quality").alias("label"), F.when(n % 11 == 0, None).when(n > 900, 1).otherwise(0).alias("predicted"), (n % 1009).cast("double").alias("score"), "lang", "source")


#: Citation edges among parts and suppliers, kept apart by a letter.
EDGES_SQL = "edges as (select distinct 'p' || cast(l_partkey as varchar) as src, 's' || cast(l_suppkey as varchar) as dst from lineitem)"


def edges(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
