"""Reference lists read from texts: where a list begins and ends, entries over wrapped lines, numbers, parts.

Blocks and lines are rows in order. A list is what lies between its heading and the next one; an entry is an
island of lines that begins where a line looks like an author. Both are running sums over a document's rows,
so no document is gathered by hand.
"""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col

#: Headings of reference lists, an author's name in them, how an entry, its year and its DOI look.
LIST_HEADING = r"(?i)^\s*(?:references|bibliography|works\s+cited|参考文献)\s*[:：]?\s*$"
AUTHOR_NAME = r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?"
ENTRY_START = rf"^{AUTHOR_NAME},\s?(?:[A-Z]\.\s?){{1,3}}"
ENTRY_YEAR = r"\(((?:19|20)\d{2}[a-z]?)\)"
ENTRY_DOI = r"(?i)(10\.\d{4,9}/\S+)"
NUMBERED = r"(?s)^\s*\[?(\d{1,3})[.)\]]\s+(.*)$"
ZERO_WIDTH = "[​‌‍﻿­]"


def repaired(c) -> Column:
    """A text read from pages: words parted at a line's end joined (hyphen or soft hyphen), but not where a
    conjunction follows the hyphen, and marks without width gone. Null is an empty text."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), "([A-Za-z])­\\s?([A-Za-z])", "$1$2")
    return F.regexp_replace(F.regexp_replace(t, ZERO_WIDTH, ""), r"(?i)([A-Za-z])-\s*\n\s*(?!(?:and|or|to|but|nor)\b)([A-Za-z])", "$1$2")


def wrapped_entries(lists: DataFrame, repair: Callable[[str], Column] = repaired) -> DataFrame:
    """doc, entry, raw: the entries of lists(doc, text), from 1, each from all its lines, blanks between.
    repair joins the words that lines part.

    A line that does not begin like an entry goes on with the one before; the first line begins one
    whatever it is. Blank lines and the list's own heading are passed over.
    """
    lines = lists.select("doc", F.posexplode(F.split(repair("text"), r"\r\n|\n|\r", -1)).alias("at", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike("(?i)^references$"))
    w = Window.partitionBy("doc").orderBy("at")
    opens = F.when(F.col("line").rlike(ENTRY_START) | F.lag("line").over(w).isNull(), 1).otherwise(0)
    isles = lines.withColumn("_o", opens).withColumn("entry", F.sum("_o").over(w))
    joined = isles.groupBy("doc", "entry").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("ls"))
    return joined.select("doc", "entry", F.array_join(F.transform("ls", lambda x: x["line"]), " ").alias("raw"))


def entry_parts(raw) -> Column:
    """struct<surname, year, year_raw, title, doi> of an entry, or null if it has no leading name with a comma
    or no year in brackets. The title ends at the first full stop after the year."""
    r = col(raw)
    none = lambda c: F.nullif(c, F.lit(""))
    name, year = none(F.regexp_extract(r, rf"^({AUTHOR_NAME}),", 1)), none(F.regexp_extract(r, ENTRY_YEAR, 1))
    title = F.trim(F.regexp_extract(r, rf"(?s)^.*?{ENTRY_YEAR}[. ]*([^.]+)\.", 2))
    doi = F.regexp_replace(F.regexp_extract(r, ENTRY_DOI, 1), r"[).,;]+$", "")
    return F.when(name.isNotNull() & year.isNotNull(), F.struct(name.alias("surname"), F.left(year, F.lit(4)).alias("year"), year.alias("year_raw"), none(title).alias("title"), none(doi).alias("doi")))


def parted(blocks: DataFrame) -> DataFrame:
    """blocks(doc, block, kind, text, ...) with part: body, list, heading (of the list) or after.

    The list is that of the first heading that names one, up to the next heading of any kind; from there on
    blocks are neither body nor list. Documents without such a heading are all body.
    """
    w = Window.partitionBy("doc").orderBy("block")
    is_list = (F.col("kind") == "heading") & F.col("text").rlike(LIST_HEADING)
    named = blocks.withColumn("_n", F.sum(F.when(is_list, 1).otherwise(0)).over(w)).withColumn("_h", F.sum(F.when((F.col("kind") == "heading") & (F.col("_n") > 0), 1).otherwise(0)).over(w))
    part = F.when(F.col("_n") == 0, "body").when((F.col("_h") == 1) & (F.col("kind") == "heading"), "heading").when(F.col("_h") == 1, "list").otherwise("after")
    return named.withColumn("part", part).drop("_n", "_h")


def numbered_entries(blocks: DataFrame) -> DataFrame:
    """doc, number, raw, contiguous: the list's numbered entries of blocks(doc, block, kind, text, number).

    Items of a list carry their number, paragraphs begin with it (1. 1) or [1]). Of a repeated number the
    last block counts. contiguous: the document's numbers run from one without a gap, and only then can a
    number in the text be trusted to name an entry.
    """
    rows = parted(blocks).where("part = 'list'").withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    item = (F.col("kind") == "item") & (F.col("text") != "")
    said = F.regexp_extract("text", NUMBERED, 1)
    found = rows.select("doc", "block", F.when(item, F.col("number")).when((F.col("kind") == "paragraph") & (said != ""), said.cast("int")).alias("number"), F.when(item, F.col("text")).otherwise(F.trim(F.regexp_extract("text", NUMBERED, 2))).alias("raw")).where("number is not null")
    one = found.groupBy("doc", "number").agg(F.max_by("raw", "block").alias("raw"))
    whole = one.groupBy("doc").agg(((F.min("number") == 1) & (F.max("number") == F.count(F.lit(1)))).alias("contiguous"))
    return one.join(whole, "doc")


def resolved(entries: DataFrame, papers: DataFrame) -> DataFrame:
    """entries(doc, entry, raw, ...) with paper: the one of papers(paper, doi, surname, year) whose DOI an
    entry gives, else the last one of its surname and year; null where there is none."""
    e = entries.withColumn("_p", entry_parts("raw"))
    by_doi = papers.where("doi is not null").groupBy(F.lower("doi").alias("_doi")).agg(F.max("paper").alias("_a"))
    by_name = papers.where("surname is not null and year is not null").groupBy(F.lower("surname").alias("_s"), F.col("year").cast("string").alias("_y")).agg(F.max("paper").alias("_b"))
    met = e.join(by_doi, F.lower("_p.doi") == F.col("_doi"), "left").join(by_name, (F.lower("_p.surname") == F.col("_s")) & (F.col("_p.year") == F.col("_y")), "left")
    return met.withColumn("paper", F.coalesce("_a", "_b")).drop("_p", "_doi", "_a", "_s", "_y", "_b")
