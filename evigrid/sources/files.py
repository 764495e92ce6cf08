"""Files to frames and back: tables, venue lists, bibliographies, works as JSON, workbooks, records."""
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..functions.text import blank_to_null, csv_cell

#: Cells that read as missing, as the usual table readers take them.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A")
UPLOAD_TYPES, UPLOAD_BYTES = ("csv", "tsv", "xlsx"), 50 * 1024 * 1024
WORK = """id string, doi string, title string, publication_year int, type string, is_paratext boolean, cited_by_count int, authorships array<struct<author:struct<display_name:string>>>,
 primary_location struct<source:struct<display_name:string,issn_l:string,issn:array<string>>>, open_access struct<oa_url:string>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>"""


def read_table(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """CSV, TSV or Parquet with a header; missing marks become null, types are inferred from the rest."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind not in ("csv", "tsv"):
        raise ValueError(f"no reader for {kind}")
    raw = spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"')
    clean = raw.select([F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return typed(clean)


def typed(df: DataFrame) -> DataFrame:
    """String columns whose every known value is a whole or a decimal number take that type. One pass."""
    if not df.columns:
        return df
    fits = df.agg(*[F.struct(F.bool_and(F.col(f"`{c}`").try_cast("bigint").isNotNull() | F.col(f"`{c}`").isNull()).alias("i"), F.bool_and(F.col(f"`{c}`").try_cast("double").isNotNull() | F.col(f"`{c}`").isNull()).alias("d"), F.count(F.col(f"`{c}`")).alias("n")).alias(f"_{k}") for k, c in enumerate(df.columns)]).collect()[0]
    kind = lambda f: None if not f["n"] else "bigint" if f["i"] else "double" if f["d"] else None
    return df.select([F.col(f"`{c}`").try_cast(kind(fits[k])).alias(c) if kind(fits[k]) else F.col(f"`{c}`") for k, c in enumerate(df.columns)])


def upload_problem(name: str, size: int) -> str | None:
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return "unsupported type" if kind not in UPLOAD_TYPES else "empty file" if size == 0 else "file too large" if size > UPLOAD_BYTES else None


def preview(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The first n rows by an ingest number; NaN shows as null."""
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.orderBy(order).limit(n).select(clean)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A workbook's first or named sheet. Workbooks are bounded by the upload limit, so the executor that
    holds one unzips it; rows come out as (row, column, value) and are laid out by Spark."""
    import pandas as pd

    def cells(frames):
        import io
        import re
        import xml.etree.ElementTree as E
        import zipfile

        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        for frame in frames:
            for content in frame["content"]:
                z = zipfile.ZipFile(io.BytesIO(content))
                shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in E.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
                names = [s.get("name") for s in E.fromstring(z.read("xl/workbook.xml")).iter() if tag(s) == "sheet"]
                part = f"xl/worksheets/sheet{1 + (names.index(sheet) if sheet else 0)}.xml"
                out = []
                for r, row in enumerate(e for e in E.fromstring(z.read(part)).iter() if tag(e) == "row"):
                    for k, c in enumerate(e for e in row if tag(e) == "c"):
                        ref = re.match("[A-Z]+", c.get("r") or "")
                        at = k if not ref else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref[0]))) - 1
                        text_of = "".join(t.text or "" for t in c.iter() if tag(t) in ("v", "t"))
                        out.append((r, at, shared[int(text_of)] if c.get("t") == "s" and text_of else text_of))
                yield pd.DataFrame(out, columns=["r", "c", "v"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "r int, c int, v string")
    heads = {row["c"]: row["v"] for row in found.where("r = 0").collect()}  # one header line
    wide = found.where("r > 0").groupBy("r").pivot("c", sorted(heads)).agg(F.first("v"))
    return typed(wide.orderBy("r").select([F.when(~F.col(str(c)).isin(*MISSING), F.col(str(c))).alias(h) for c, h in sorted(heads.items())]))


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    import io
    import xml.etree.ElementTree as E
    import zipfile

    content = spark.read.format("binaryFile").load(path).select("content").first()[0]  # one bounded workbook
    return [s.get("name") for s in E.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("xl/workbook.xml")).iter() if s.tag.endswith("}sheet")]


def collection_of(name) -> Column:
    """Collection code of a venue list's file name: a code in brackets first, then one anywhere, else WOS."""
    n = F.upper(text.col(name))
    inside = F.regexp_extract(n, r"\((SCIE|SSCI|AHCI|ESCI)\)", 1)
    bare = F.regexp_extract(n, r"(SCIE|SSCI|AHCI|ESCI)", 1)
    return F.coalesce(F.nullif(inside, F.lit("")), F.nullif(bare, F.lit("")), F.lit("WOS"))


def read_venues(spark: SparkSession, path: str) -> DataFrame:
    """Venue lists of a folder: title, issn, eissn, publisher, categories, collection. Short rows are
    tolerated, ISSNs upper-cased, blanks null."""
    raw = spark.read.option("recursiveFileLookup", "true").csv(path, header=True, schema="journal_title string, issn string, eissn string, publisher string, address string, languages string, categories string", mode="PERMISSIVE", escape='"')
    up = lambda c: F.upper(blank_to_null(c))
    return raw.select(blank_to_null("journal_title").alias("journal_title"), up("issn").alias("issn"), up("eissn").alias("eissn"), blank_to_null("publisher").alias("publisher"), blank_to_null("categories").alias("categories"), collection_of(F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("collection")).where("journal_title is not null")


def replace_collections(venues: DataFrame, path: str) -> None:
    """Writes the collections present in venues over their old rows; the others stay."""
    venues.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def parse_bibtex(c) -> Column:
    """array<struct<title, authors, year, journal, doi, abstract>> of a bibliography's text; entries without a title go."""
    entries = F.filter(F.split(text.col(c), r"(?m)^\s*@(?=\w+\s*\{)"), lambda e: F.contains(e, F.lit("{")))
    field = lambda e, k: blank_to_null(F.regexp_replace(F.regexp_extract(e, rf'(?is)\b{k}\s*=\s*(?:\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}|"([^"]*)"|(\d+))', 0), rf'(?is)^{k}\s*=\s*[{{"]?|[}}"]$|[{{}}]', ""))
    rows = F.transform(entries, lambda e: F.struct(field(e, "title").alias("title"), F.split(field(e, "author"), r"\s+and\s+").alias("authors"), field(e, "year").try_cast("int").alias("year"), field(e, "journal").alias("journal"), text.doi_key(field(e, "doi")).alias("doi"), field(e, "abstract").alias("abstract")))
    return F.filter(rows, lambda r: r["title"].isNotNull())


def to_bibtex(papers: DataFrame) -> DataFrame:
    """One entry for each paper(authors array<string>, title, journal, year, doi); the key is the first
    author's last name and the year in lower case."""
    name = F.coalesce(text.surname_key(F.try_element_at("authors", F.lit(1))), F.lit("unknown"))
    key = F.lower(F.concat(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    line = lambda k, c: F.when(c.isNotNull(), F.concat(F.lit(f"  {k} = {{"), c.cast("string"), F.lit("},\n")))
    body = F.concat_ws("", line("title", F.col("title")), line("author", F.nullif(F.array_join("authors", " and "), F.lit(""))), line("journal", F.col("journal")), line("year", F.col("year")), line("doi", F.col("doi")))
    return papers.select(F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("}")).alias("value"))


def parse_works(raw: DataFrame, column: str = "json") -> DataFrame:
    """Works as JSON text to paper records; what the schema does not name is not read."""
    w = raw.select(F.from_json(column, WORK).alias("w")).select("w.*").where("id is not null")
    source = F.col("primary_location.source")
    authors = F.transform(F.coalesce("authorships", F.array().cast("array<struct<author:struct<display_name:string>>>")), lambda a: F.struct(a["author"]["display_name"].alias("name")))
    return w.select(text.short_work_id("id").alias("external_id"), text.doi_key("doi").alias("doi"), F.coalesce(blank_to_null("title"), F.lit("Untitled")).alias("title"), authors.alias("authors"), F.col("publication_year").alias("year"), source["display_name"].alias("journal_name"), arrays.issn_union(source["issn_l"], source["issn"]).alias("issns"),
                    F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"), F.nullif(arrays.abstract_text("abstract_inverted_index"), F.lit("")).alias("abstract"), F.col("open_access.oa_url").alias("full_text_url"), F.col("type").alias("openalex_type"), F.coalesce("is_paratext", F.lit(False)).alias("is_paratext"),
                    F.transform(F.coalesce("referenced_works", F.array().cast("array<string>")), lambda r: text.short_work_id(r)).alias("referenced_works"))


def search_works(works: DataFrame, words: str, year_from=None, year_to=None, least_cites=None, most: int = 25) -> DataFrame:
    """Works whose title holds every word, the most cited first; filters reach the scan."""
    out = works
    for w in words.lower().split():
        out = out.where(F.contains(F.lower("title"), F.lit(w)))
    for c, ok in (("year", year_from), ("citation_count", least_cites)):
        out = out if ok is None else out.where(F.col(c) >= ok)
    out = out if year_to is None else out.where(F.col("year") <= year_to)
    return out.orderBy(F.desc("citation_count"), "external_id").limit(most)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a result yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def screening_csv(record: DataFrame) -> DataFrame:
    """All columns as cells that a spreadsheet reads as text."""
    return record.select([csv_cell(F.array_join(c, "; ") if t.startswith("array") else F.col(c)).alias(c) for c, t in record.dtypes])


def numbered(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Adds the row's number from 0 in file order: per-partition numbers shifted by the partitions before."""
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_m", 33)
    sizes = marked.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_s")
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("_p", part).join(F.broadcast(start), "_p").withColumn(name, F.col("_s") + inside).drop("_m", "_p", "_s")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda v: "-" if v is None else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def load_dataset(spark: SparkSession, folder: str, kind: str = "csv") -> DataFrame:
    """The cleaned table of a dataset's folder if it is there, else the raw one."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/cleaned.parquet")
    clean = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    return spark.read.parquet(f"{folder}/cleaned.parquet") if clean else read_table(spark, f"{folder}/raw.{kind}", kind)


def works_by_ids(works: DataFrame, ids: DataFrame) -> DataFrame:
    """at, and the work, for each id of ids(at, id) that names one: a repeated id at its first place."""
    first = ids.groupBy("id").agg(F.min("at").alias("at"))
    return first.join(works, first["id"] == works["external_id"]).drop("id")


def registry_records(raw: DataFrame, column: str = "json") -> DataFrame:
    """Registry records as JSON to doi, title, year and citation_count; the first title and the first date part count."""
    r = raw.select(F.from_json(column, "DOI string, title array<string>, issued struct<`date-parts`:array<array<int>>>, `is-referenced-by-count` int").alias("r"))
    dates = F.col("r.issued.date-parts")
    return r.select(text.doi_key("r.DOI").alias("doi"), F.try_element_at("r.title", F.lit(1)).alias("title"), F.try_element_at(F.try_element_at(dates, F.lit(1)), F.lit(1)).alias("year"), F.coalesce("r.is-referenced-by-count", F.lit(0)).alias("citation_count"))


def review_rows(raw: DataFrame) -> DataFrame:
    """Labelled review sets of text cells: record_id, label (0, 1 or null), title and abstract (blank is null), year."""
    from ..functions.scalars import to_label, to_year

    return raw.select("record_id", to_label("label").alias("label"), blank_to_null("title").alias("title"), blank_to_null("abstract").alias("abstract"), to_year("year").alias("year"))


def claim_pairs(claims: DataFrame, corpus: DataFrame) -> DataFrame:
    """claim_id, doc_id, gold, n_sentences for each cited document of claims(id, cited, evidence): the
    evidence is a map of a document to its labels; documents that the corpus lacks are left out."""
    from ..operators.evaluation import gold_label

    c = claims.select(F.col("id").alias("claim_id"), "evidence", F.explode(F.array_distinct("cited")).alias("doc_id"))
    labels = F.coalesce(F.try_element_at("evidence", F.col("doc_id").cast("string")), F.array().cast("array<string>"))
    return c.join(corpus.select("doc_id", F.size("abstract").alias("n_sentences")), "doc_id").select("claim_id", "doc_id", gold_label(labels).alias("gold"), "n_sentences")


def claim_chunks(claims: DataFrame, cached: DataFrame) -> DataFrame:
    """Claims with the cached chunk they were built from, by DOI and chunk number; without it text is null."""
    return claims.join(cached.select("chunk_doi", "chunk_index", "text"), ["chunk_doi", "chunk_index"], "left")
