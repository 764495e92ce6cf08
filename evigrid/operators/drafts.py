"""Drafts as trees of blocks, result trees, and records on their way out."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import finite
from ..functions.text import col, csv_cell

_LEAF = "struct<type:string,text:string>"
_INNER = f"struct<type:string,text:string,content:array<{_LEAF}>>"
#: A document's blocks, their text nodes, and one level more for lists and quotes.
TREE = f"struct<type:string,content:array<struct<type:string,text:string,attrs:struct<level:int>,content:array<{_INNER}>>>>"
#: Other names of the sections.
SECTION_ALIASES = {"intro": "introduction", "lit review": "literature review", "review of literature": "literature review", "review of the literature": "literature review", "theoretical framework": "literature review", "methodology": "methods", "method": "methods",
                   "research methodology": "methods", "research design": "methods", "findings": "results", "results and discussion": "results", "results/findings": "results", "practical implications": "implications", "theoretical implications": "implications",
                   "recommendations": "implications", "summary": "conclusion", "concluding remarks": "conclusion", "bibliography": "references", "works cited": "references"}


def tree(c) -> Column:
    return F.from_json(col(c), TREE)


def _texts(block: Column) -> Column:
    """Texts of a block's nodes in order."""
    none = F.array().cast("array<string>")
    leaf = lambda n: F.coalesce(F.transform(n["content"], lambda x: x["text"]), none)
    parts = F.transform(F.coalesce(block["content"], F.array().cast(f"array<{_INNER}>")), lambda n: F.concat(F.array(n["text"]), leaf(n)))
    return F.filter(F.concat(F.array(block["text"]), F.flatten(parts)), lambda t: t.isNotNull())


def _blocks(t: Column) -> Column:
    return F.coalesce(t["content"], F.filter(t["content"], lambda b: F.lit(False)))


def draft_text(c) -> Column:
    """All text of a draft, its nodes joined by blanks."""
    return F.array_join(F.flatten(F.transform(_blocks(tree(c)), _texts)), " ")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def _section(block: Column) -> Column:
    heading = F.lower(F.trim(F.array_join(_texts(block), " ")))
    alias = F.create_map(*[F.lit(x) for kv in SECTION_ALIASES.items() for x in kv])
    return F.coalesce(alias[heading], heading)


def draft_sections(c) -> Column:
    """Names of the draft's headings under their usual names, in order."""
    heads = F.filter(_blocks(tree(c)), lambda b: b["type"] == "heading")
    return F.filter(F.transform(heads, _section), lambda s: s != "")


def abstract_words(c) -> Column:
    """Words in the paragraphs between the abstract's heading and the next one."""
    blocks = _blocks(tree(c))
    kinds = F.transform(blocks, lambda b: F.when(b["type"] == "heading", _section(b)))
    at = F.array_position(kinds, F.lit("abstract"))
    after = F.slice(blocks, at.cast("int") + 1, F.size(blocks))
    end = F.array_position(F.transform(after, lambda b: b["type"]), F.lit("heading"))
    mine = F.when(end > 0, F.slice(after, F.lit(1), (end - 1).cast("int"))).otherwise(after)
    texts = F.flatten(F.transform(F.filter(mine, lambda b: b["type"] == "paragraph"), _texts))
    return F.when(at > 0, word_count(F.array_join(texts, " "))).otherwise(0)


def flat(df: DataFrame, key: str) -> DataFrame:
    """key, path, value: the leaves of a table of result trees, named by the way to them."""
    def leaves(schema: StructType, at: str):
        for f in schema.fields:
            path = f"{at}.{f.name}" if at else f.name
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, path)
            else:
                yield path

    paths = [p for p in leaves(df.schema, "") if p != key]
    pairs = F.array(*[F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value")) for p in paths])
    return df.select(key, F.explode(pairs).alias("x")).select(key, "x.*")


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, path, ours, theirs where two tables of result trees differ; a tree or path that one lacks is null there."""
    x, y = flat(a, key).withColumnRenamed("value", "ours"), flat(b, key).withColumnRenamed("value", "theirs")
    return x.join(y, [key, "path"], "full").where(~F.col("ours").eqNullSafe(F.col("theirs")))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text; numbers that are not finite become null, and nulls are written."""
    clean = [finite(c).alias(c) if t in ("double", "float") else F.transform(c, lambda x: finite(x)).alias(c) if t in ("array<double>", "array<float>") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def claim_record(rows: DataFrame) -> DataFrame:
    """Cells of a claim record: lists joined, the number of assertions, and the central one if it is the only one."""
    lists = {c for c, t in rows.dtypes if t == "array<string>"}
    central = F.filter("assertions", lambda a: F.coalesce(a["central"], F.lit(False)))
    cells = [csv_cell(F.coalesce(F.array_join(c, "; "), F.lit(""))).alias(c) if c in lists else csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in rows.columns if c != "assertions"]
    return rows.select(*cells, F.size(F.coalesce("assertions", F.filter("assertions", lambda a: F.lit(False)))).alias("n_assertions"), csv_cell(F.when(F.size(central) == 1, central[0]["text"]).otherwise("")).alias("central_assertion"))


def candidates(papers: DataFrame, by: str, newest: int, chosen: DataFrame, most: int) -> DataFrame:
    """Of the newest papers of each project those that were chosen, all of them if none was; at most `most`."""
    from .ranking import newest as latest

    window = latest(papers, by, [F.desc("added_at"), F.asc("id")], newest)
    marked = window.join(chosen.select(by, "id").distinct().withColumn("_c", F.lit(True)), [by, "id"], "left")
    some = marked.groupBy(by).agg(F.bool_or(F.coalesce("_c", F.lit(False))).alias("_any"))
    kept = marked.join(some, by).where(F.coalesce("_c", F.lit(False)) | ~F.col("_any"))
    return latest(kept, by, [F.desc("added_at"), F.asc("id")], most).drop("_c", "_any")
