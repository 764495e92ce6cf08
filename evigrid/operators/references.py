"""Reference lists in six styles, as Column expressions over authors (array of struct(family, given))."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, family_given, initials

STYLES = ("apa", "chicago", "mla", "harvard", "ieee", "vancouver")


def split_authors(names) -> Column:
    return F.transform(col(names), lambda n: family_given(n))


def joined(names: Column, word: str, comma: bool) -> Column:
    """One name as it is; else the last after the word, with a comma before it or not."""
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(names, 1)).otherwise(F.concat(head, F.lit(f", {word} " if comma else f" {word} "), F.element_at(names, -1)))


def _after(x: Column, sep: str, y: Column) -> Column:
    """x, and sep and y if y is not empty."""
    return F.when(F.length(y) > 0, F.concat(x, F.lit(sep), y)).otherwise(x)


def _part(prefix: str, x: Column, suffix: str = ".") -> Column:
    return F.when(F.coalesce(F.length(x.cast("string")), F.lit(0)) > 0, F.concat(F.lit(prefix), x.cast("string"), F.lit(suffix))).otherwise(F.lit(""))


def reference(style: str, authors="authors", title="title", journal="journal", year="year", doi="doi", number="number") -> Column:
    """One entry; what is missing is left out. ieee and vancouver begin with the number."""
    a, t, j, d = col(authors), F.coalesce(col(title), F.lit("")), col(journal), col(doi)
    y = col(year).cast("string")
    dated = F.coalesce(y, F.lit("n.d."))
    names = lambda f: F.transform(a, f)
    full = lambda x: _after(x["family"], ", ", x["given"])
    plain = lambda x: F.when(F.length(x["given"]) > 0, F.concat(x["given"], F.lit(" "), x["family"])).otherwise(x["family"])
    first_full = F.transform(a, lambda x, i: F.when(i == 0, full(x)).otherwise(plain(x)))
    if style == "chicago":
        return F.concat(joined(first_full, "and", True), F.lit(". "), dated, F.lit('. "'), t, F.lit('."'), _part(" ", j), _part(" https://doi.org/", d, ""))
    if style == "mla":
        who = F.when(F.size(a) >= 3, F.concat(full(F.element_at(a, 1)), F.lit(", et al"))).otherwise(joined(first_full, "and", True))
        rest = F.array_join(F.filter(F.array(j, dated, F.concat(F.lit("https://doi.org/"), d)), lambda x: F.length(x) > 0), ", ")
        return F.concat(who, F.lit('. "'), t, F.lit('."'), _part(" ", rest))
    if style == "harvard":
        who = joined(names(lambda x: _after(x["family"], ", ", initials(x["given"], ""))), "and", False)
        return F.concat(who, F.lit(" ("), dated, F.lit(") '"), t, F.lit("'"), F.when(F.length(j) > 0, F.concat(F.lit(", "), j, F.lit("."))).otherwise("."), _part(" Available at: https://doi.org/", d, ""))
    if style == "ieee":
        who = joined(names(lambda x: F.when(F.length(initials(x["given"])) > 0, F.concat(initials(x["given"]), F.lit(" "), x["family"])).otherwise(x["family"])), "and", False)
        rest = F.array_join(F.filter(F.array(j, y), lambda x: F.length(x) > 0), ", ")
        return F.concat(F.lit("["), F.coalesce(col(number), F.lit(1)).cast("string"), F.lit("] "), who, F.lit(', "'), t, F.lit(',"'), F.when(F.length(rest) > 0, F.concat(F.lit(" "), rest, F.lit("."))).otherwise("."), _part(" doi: ", d))
    if style == "vancouver":
        who = F.array_join(names(lambda x: _after(x["family"], " ", initials(x["given"], "", False))), ", ")
        return F.concat(F.coalesce(col(number), F.lit(1)).cast("string"), F.lit(". "), who, F.lit(". "), t, F.lit("."), _part(" ", j), _part(" ", y), _part(" doi:", d))
    who = joined(names(lambda x: _after(x["family"], ", ", initials(x["given"]))), "&", True)
    return F.concat(who, F.lit(" ("), dated, F.lit("). "), t, F.lit("."), _part(" ", j), _part(" https://doi.org/", d, ""))


def reference_list(cited: DataFrame, by: str) -> DataFrame:
    """Adds place: entries of each document by family name, year and title."""
    family = F.lower(F.coalesce(F.try_element_at("authors", F.lit(1))["family"], F.lit("")))
    return cited.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(family, F.coalesce("year", F.lit(0)), F.lower(F.coalesce("title", F.lit(""))))))
