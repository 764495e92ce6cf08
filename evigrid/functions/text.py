"""String normalisers and keys as Column expressions.

Letters are classed by Unicode property everywhere, so accented words keep their letters. The few
that need compatibility folding (NFKC/NFKD) are Arrow UDFs; Spark has no such builtin.
"""
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that is folded to ASCII after NFKC.
DASHES = "‐‑‒–—―−"
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟″"
#: Lower-case particles that belong to a family name.
NAME_PARTICLES = ("van", "von", "de", "del", "della", "der", "den", "du", "da", "das", "dos", "di", "la", "le", "el", "al", "ter", "ten", "op", "bin", "ibn")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """body(value) with value computed once, however often body and the functions in it name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_set(words) -> Column:
    """A constant array of words without blanks, for array_contains: one literal, however many they are."""
    return F.split(F.lit(" ".join(words)), " ")


def blank_to_null(c) -> Column:
    c = F.trim(col(c))
    return F.when(F.length(c) > 0, c)


def title_key(c) -> Column:
    """Lower case, everything but letters, digits, underscores and blanks removed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_\s]", ""))


def title_key_ascii(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


def doi_key(c) -> Column:
    """Lower-case DOI without a resolver or doi: prefix; null when nothing is left."""
    return blank_to_null(F.regexp_replace(F.lower(F.trim(col(c))), r"^(https://doi\.org/|http://doi\.org/|doi:)+", ""))


def doi_key_strict(c) -> Column:
    """As doi_key, also dx.doi.org and trailing punctuation."""
    s = F.regexp_replace(F.lower(F.trim(col(c))), r"^doi:\s*", "")
    s = F.regexp_replace(s, r"^https?://(dx\.)?doi\.org/", "")
    return F.nullif(F.regexp_replace(s, r"[.,;)]+$", ""), F.lit(""))


def is_doi(c) -> Column:
    return F.coalesce(doi_key(c).rlike(r"^10\.\d{4,9}/\S+$"), F.lit(False))


def issn_key(c) -> Column:
    """NNNN-NNNX or null."""
    s = F.upper(F.regexp_replace(col(c), r"[\s-]", ""))
    return F.when(s.rlike(r"^\d{7}[\dX]$"), F.concat(F.left(s, F.lit(4)), F.lit("-"), F.right(s, F.lit(4))))


def short_work_id(c) -> Column:
    return F.nullif(F.substring_index(col(c), "/", -1), F.lit(""))


def is_work_id(c) -> Column:
    return F.coalesce(col(c).rlike(r"^W\d+"), F.lit(False))


def resolve_work_id(external_id, doi) -> Column:
    """A work id if the external id is one, else the DOI, else null."""
    return F.coalesce(F.when(is_work_id(external_id), col(external_id)), blank_to_null(doi))


def work_path_id(c) -> Column:
    """The path segment under which a work is looked up: doi:... or the bare id."""
    s = F.trim(F.coalesce(col(c), F.lit("")))
    low = F.lower(s)
    return (F.when(low.startswith("https://doi.org/"), F.concat(F.lit("doi:"), F.substr(s, F.lit(17))))
            .when(low.startswith("http://doi.org/"), F.concat(F.lit("doi:"), F.substr(s, F.lit(16))))
            .when(low.startswith("doi:"), F.concat(F.lit("doi:"), F.substr(s, F.lit(5))))
            .when(low.startswith("10."), F.concat(F.lit("doi:"), s))
            .when(low.startswith("https://openalex.org/"), F.substring_index(s, "/", -1)).otherwise(s))


def sanitize_query(c, limit: int = 500) -> Column:
    """Wildcards dropped, blanks collapsed, cut at a word end within limit characters."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[*?]", ""), r"\s+", " "))
    head = F.left(s, F.lit(limit))
    return F.when(F.length(s) <= limit, s).otherwise(F.trim(F.regexp_replace(head, r" [^ ]*$", "")))


def strip_wildcards(c) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), r"[*?]", ""), r"\s+", " "))


def collapse_blanks(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def fold_punctuation(c) -> Column:
    """Dashes, quotes and the ellipsis to ASCII; the compatibility forms are compat_fold's work."""
    s = F.translate(col(c), DASHES + SINGLE_QUOTES + DOUBLE_QUOTES, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    return F.replace(s, F.lit("…"), F.lit("..."))


def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _bare(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else t.lower() if t.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)).replace("’", "'").casefold())


def compat_fold(c) -> Column:
    """NFKC; ASCII texts pass through."""
    return F.pandas_udf(_folded, "string")(col(c))


def accent_fold(c) -> Column:
    """NFKD without combining marks, casefolded."""
    return F.pandas_udf(_bare, "string")(col(c))


def letters_digits(c) -> Column:
    """Lower-case letters and digits only, for matching over punctuation and blanks."""
    return F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{Nd}]", "")


def is_verbatim(quote, chunk, casefold: bool = False) -> Column:
    """Whether chunk holds quote once punctuation is folded and blanks are collapsed."""
    q, c = collapse_blanks(fold_punctuation(quote)), collapse_blanks(fold_punctuation(chunk))
    if casefold:
        q, c = F.lower(q), F.lower(c)
    return F.coalesce((F.length(q) > 0) & F.contains(c, q), F.lit(False))


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 when either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def sentences(c) -> Column:
    """Cut after . ! ? before a blank and a capital or digit; trimmed, empty ones dropped."""
    parts = F.split(collapse_blanks(c), r"(?<=[.!?])\s+(?=[\p{Lu}\d])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def surname_key(c) -> Column:
    """Comparison key of an author name in any usual order; fold accents beforehand if there are any."""
    s = F.trim(col(c))
    comma = F.element_at(F.split(F.trim(F.substring_index(s, ",", 1)), r"\s+"), -1)
    bare = F.regexp_replace(s, r"(\s+(?:\p{Lu}\.?){1,3})+$", "")
    last = F.element_at(F.split(bare, r"\s+"), -1)
    return F.lower(F.nullif(F.when(F.contains(s, F.lit(",")), comma).otherwise(last), F.lit("")))


def family_given(c) -> Column:
    """struct(family, given): at the first comma, else before the last word and a particle in front of it."""
    s = F.trim(F.coalesce(col(c), F.lit("")))
    particle = "|".join(NAME_PARTICLES)
    tail = F.regexp_extract(s, rf"((?:(?<=\s)(?:{particle})\s+)?\S+)$", 1)
    head = F.trim(F.left(s, F.length(s) - F.length(tail)))
    at = F.instr(s, ",")
    return F.struct(F.when(at > 0, F.trim(F.left(s, at - 1))).otherwise(tail).alias("family"), F.when(at > 0, F.trim(F.substr(s, at + 1))).otherwise(head).alias("given"))


def initials(c, sep: str = " ", period: bool = True) -> Column:
    words = F.filter(F.split(F.trim(F.coalesce(col(c), F.lit(""))), r"\s+"), lambda w: F.length(w) > 0)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lit("." if period else ""))), sep)


def first_author(authors) -> Column:
    """Name of the first of an array of struct(name)."""
    return F.coalesce(F.try_element_at(col(authors), F.lit(1))["name"], F.lit(""))


def author_names(authors) -> Column:
    return F.filter(F.transform(col(authors), lambda a: F.trim(a["name"])), lambda n: n.isNotNull() & (F.length(n) > 0))


def singular(c) -> Column:
    """Crude: -ies to y, -s dropped after a letter other than s, from four letters on."""
    t = col(c)
    return F.when((F.length(t) > 4) & t.endswith("ies"), F.concat(F.left(t, F.length(t) - 3), F.lit("y"))).when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.left(t, F.length(t) - 1)).otherwise(t)


def light_stem(c) -> Column:
    """Possessive off, then one ending if four characters stay."""
    t = F.regexp_replace(F.regexp_replace(col(c), r"[.,;:]+$", ""), "'s$", "")
    out = F.when(t.endswith("ies") & (F.length(t) > 5), F.concat(F.left(t, F.length(t) - 3), F.lit("y")))
    for suffix in ("ing", "ed", "ly", "es", "s"):
        out = out.when(t.endswith(suffix) & (F.length(t) - len(suffix) >= 4), F.left(t, F.length(t) - len(suffix)))
    return out.otherwise(t)


def unescape_twice(c) -> Column:
    """Doubled escapes collapsed: backslash n and t to blanks' own characters, backslash quote to the quote."""
    s = F.replace(F.replace(col(c), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    return F.regexp_replace(s, r"""\\(["'])""", "$1")


def strip_wrapping_quotes(c) -> Column:
    s = F.trim(col(c))
    return F.when(s.rlike(r"""^(".*"|'.*'|“.*”|‘.*’)$"""), F.trim(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(s)


def redact_identity(c) -> Column:
    return F.regexp_replace(col(c), r"""(mailto|api_key)=[^&\s'"]+""", "$1=***")


def latex_escape(c) -> Column:
    s = F.replace(col(c), F.lit("\\"), F.lit("\x00"))
    for ch in "&%$#_{}":
        s = F.replace(s, F.lit(ch), F.lit("\\" + ch))
    s = F.replace(F.replace(s, F.lit("~"), F.lit(r"\textasciitilde{}")), F.lit("^"), F.lit(r"\textasciicircum{}"))
    return F.replace(s, F.lit("\x00"), F.lit(r"\textbackslash{}"))


def cut_middle(c, limit: int, marker: str = " [...] ") -> Column:
    """Head and tail in the proportion 7 to 3 with a marker between when longer than limit."""
    s = col(c)
    head = limit * 7 // 10
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.left(s, F.lit(head)), F.lit(marker), F.right(s, F.lit(limit - head))))


def shown_text(title, abstract, limit: int = 4000, blank: str = "(no abstract)") -> Column:
    """What a screener is shown: title and abstract lines with placeholders for what is missing; blank is
    what an abstract of blanks alone is shown as."""
    t = F.coalesce(blank_to_null(title), F.lit("(no title)"))
    a = F.coalesce(cut_middle(blank_to_null(abstract), limit), F.when(col(abstract).isNotNull(), blank), F.lit("(no abstract)"))
    return F.concat(F.lit("Title: "), t, F.lit("\nAbstract: "), a)


def doi_slug(c) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_")


def public_url(c) -> Column:
    """The address without query and fragment."""
    return F.regexp_replace(col(c), r"[?#].*$", "")


def is_reprint_venue(c) -> Column:
    """Year books reprint what appeared elsewhere."""
    return F.coalesce(F.lower(F.trim(col(c))).rlike(r"^year\s*book\b"), F.lit(False))


def csv_cell(c) -> Column:
    """A cell that a spreadsheet does not take for a formula."""
    s = col(c).cast("string")
    return F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def strip_html(c) -> Column:
    """Text of a page: scripts, styles and tags go, a few entities are read, blanks collapse."""
    s = F.regexp_replace(col(c), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(ch))
    return F.trim(F.regexp_replace(s, r"\s+", " "))
