"""Arrays, maps and nested records as Column expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import author_names, col


def expand_brackets(c, widest: int = 200) -> Column:
    """'[3, 5-7]' to the array 3, 5, 6, 7. A range wider than `widest` or turned round gives its ends."""
    part = F.regexp_extract_all(col(c), F.lit(r"\d+(?:\s*[-–]\s*\d+)?"), F.lit(0))

    def one(p):
        ends = F.transform(F.split(p, r"\s*[-–]\s*"), lambda x: x.cast("int"))
        lo, hi = ends[0], F.element_at(ends, -1)
        return F.when((hi >= lo) & (hi - lo <= widest), F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array(lo, hi))

    return F.flatten(F.transform(part, one))


def ranges_overlap(a0, a1, b0, b1) -> Column:
    return (col(a0) < col(b1)) & (col(b0) < col(a1))


def range_contains(outer0, outer1, inner0, inner1) -> Column:
    return (col(outer0) <= col(inner0)) & (col(inner1) <= col(outer1))


def abstract_text(index, keep_both: bool = False) -> Column:
    """Text of a map word -> places. Of two words at a place the later by name stays, or both do."""
    pairs = F.flatten(F.transform(F.map_entries(col(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(pairs)
    if not keep_both:
        ordered = F.filter(ordered, lambda x: ~F.exists(ordered, lambda y: (y["p"] == x["p"]) & (y["w"] > x["w"])))
    return F.array_join(F.transform(ordered, lambda x: x["w"]), " ")


def unique_concepts(c) -> Column:
    """Lower case, trimmed, first appearance kept."""
    return F.array_distinct(F.filter(F.transform(col(c), lambda x: F.lower(F.trim(x))), lambda x: F.length(x) > 0))


def display_authors(authors, most: int = 3) -> Column:
    names = author_names(authors)
    return F.when(F.size(names) > most, F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(" et al."))).otherwise(F.array_join(names, ", "))


def full_text(chunks) -> Column:
    """Chunks struct(section, text) in order, each under its section's name."""
    return F.array_join(F.transform(col(chunks), lambda c: F.concat(F.lit("## "), c["section"], F.lit("\n"), c["text"])), "\n\n")


def assertion_defaults(assertions) -> Column:
    """Assertions struct(text, kind, verdict, central) with missing fields filled."""
    return F.transform(col(assertions), lambda a: F.struct(F.coalesce(a["text"], F.lit("")).alias("text"), F.coalesce(a["kind"], F.lit("other")).alias("kind"), F.coalesce(a["verdict"], F.lit("not_found")).alias("verdict"), F.coalesce(a["central"], F.lit(False)).alias("central")))


def issn_union(issn_l, issns) -> Column:
    """The linking ISSN first, then the others, each once."""
    every = F.concat(F.array(col(issn_l)), F.coalesce(col(issns), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (F.length(x) > 0)))


def oa_ranked(locations) -> Column:
    """Open copies struct(url, version), published before accepted before submitted, in given order otherwise."""
    rank = lambda v: F.when(v == "publishedVersion", 0).when(v == "acceptedVersion", 1).when(v == "submittedVersion", 2).otherwise(3)
    keyed = F.transform(col(locations), lambda x, i: F.struct(rank(x["version"]).alias("r"), i.alias("i"), x["url"].alias("url")))
    return F.transform(F.array_sort(F.filter(keyed, lambda x: x["url"].isNotNull())), lambda x: x["url"])
