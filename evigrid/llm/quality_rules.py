"""Line-first cleaning and quality rules, all of it DataFrame functions.

Each line of a text is held against rules of punctuation, navigation, markup, emphasis and boilerplate and
against the lines before it. Lines that fail go; a document that loses more than half of its characters goes
too. Beside that stand counts over the whole text, two of which reject a document by themselves.

Nothing is shuffled: lines, and windows of words, are sorted within their row, so that equal ones are
neighbours.
"""
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_SQL, LOWER, UPPER

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Per cent of words that may stand in three-word windows seen twice.
MOST_REPEATED = 50
#: Per cent of a text's characters (in lines with words) that has to be left.
LEAST_LEFT = 50
#: A line without closing punctuation is a caption, a button or a heading if it has fewer words than this.
SHORT_LINE = 8
#: A line fails if one in so many of its words, or more, is a separator, has several symbols, or is shouted.
ONE_WORD_OF = 4

ENDING = r"""[.!?:;…。！？؟]["'”’»)\]]*[\x20\x09-\x0D]*$"""
SEPARATOR = r"[\x20\x09][|»›·•>/]+[\x20\x09]"
MARKED = r"[^\x20\x09-\x0D]*[#*$%&|<>]{2,}[^\x20\x09-\x0D]*"
SHOUTED = r"[^\x20\x09-\x0D]*!{2,}"
BOILERPLATE = ("accept cookies", "accept all cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "all rights reserved",
               "sign up for our newsletter", "click here to", "skip to content", "skip to main content")


def line_rules(line, low, n):
    """The rules that a line of n words fails (low: with A-Z lower-cased), of: unfinished, navigation, markup, shouted, boilerplate.

    A line without words fails none.
    """
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    rules = [
        ("unfinished", (n < SHORT_LINE) & ~line.rlike(ENDING)),
        ("navigation", line.rlike(SEPARATOR) & (count(SEPARATOR) > 1) & (count(SEPARATOR) * ONE_WORD_OF >= n)),
        ("markup", line.rlike("[#*$%&|<>]{2}") & (count(MARKED) * ONE_WORD_OF >= n)),
        ("shouted", line.contains("!!") & (count(SHOUTED) * ONE_WORD_OF >= n)),
        ("boilerplate", reduce(or_, (low.contains(p) for p in BOILERPLATE))),
    ]
    return F.array_compact(F.array(*(F.when((n > 0) & bad, name) for name, bad in rules)))


def judged_lines(docs: DataFrame) -> DataFrame:
    """docs with `lines`: array(struct(line, at, n, again, rules)), equal lines side by side.

    at is the line's place, n its words; again: it has words and an earlier line is equal; rules are those
    that it fails. A null text is one line without words.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = docs.withColumn("_split", lines).withColumn("_sorted", F.sort_array(F.arrays_zip(F.col("_split").alias("line"), F.sequence(F.lit(0), F.size("_split") - 1).alias("at"))))
    docs = docs.withColumn("_counted", F.transform("_sorted", lambda x, k: F.struct(x["line"].alias("line"), x["at"].alias("at"), F.regexp_count(x["line"], F.lit(BLANK_SQL)).alias("n"), F.translate(x["line"], UPPER, LOWER).alias("low"), F.coalesce(F.get("_sorted", k - 1)["line"] == x["line"], F.lit(False)).alias("again"))))
    judged = F.transform("_counted", lambda x: F.struct(x["line"].alias("line"), x["at"].alias("at"), x["n"].alias("n"), (x["again"] & (x["n"] > 0)).alias("again"), line_rules(x["line"], x["low"], x["n"]).alias("rules")))
    return docs.withColumn("lines", judged).drop("_split", "_sorted", "_counted")


def _passes(x):
    return ~x["again"] & (F.size(x["rules"]) == 0)


def clean_lines(docs: DataFrame) -> DataFrame:
    """docs with `cleaned`, the text without the lines that fail a rule or repeat one, and `removed`, how
    often each rule ("repeated" among them) took a line: map of rule and lines.

    A null text is cleaned to an empty one. Rows and other columns stay as they are.
    """
    docs = judged_lines(docs)
    stays = F.array_sort(F.transform(F.filter("lines", _passes), lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))))
    why = F.flatten(F.transform("lines", lambda x: F.concat(x["rules"], F.when(x["again"], F.array(F.lit("repeated"))).otherwise(F.array().cast("array<string>")))))
    removed = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("_why")), lambda r: F.struct(r, F.size(F.filter("_why", lambda x: x == r)))))
    return docs.withColumn("cleaned", F.array_join(stays["line"], "\n")).withColumn("_why", why).withColumn("removed", removed).drop("_why", "lines")


def word_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, and n_repeat_words: words in a window of three that the text has twice or more."""
    docs = docs.withColumn("_words", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(BLANK_SQL), F.lit(0)))
    n = F.size("_words")
    part = lambda k: F.slice("_words", k, F.greatest(n - 2, F.lit(0)))
    docs = docs.withColumn("_windows", F.sort_array(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))).alias("at"))))
    same = lambda x, y: F.coalesce((x["b"] == y["b"]) & (x["a"] == y["a"]) & (x["c"] == y["c"]), F.lit(False))
    docs = docs.withColumn("_twice", F.transform(F.filter("_windows", lambda x, k: same(x, F.get("_windows", k - 1)) | same(x, F.get("_windows", k + 1))), lambda x: x["at"]))
    covered = F.array_distinct(F.concat("_twice", F.transform("_twice", lambda i: i + 1), F.transform("_twice", lambda i: i + 2)))
    return docs.withColumn("n_words", n.cast("bigint")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint")).withColumn("n_repeat_words", F.size(covered).cast("bigint")).drop("_words", "_windows", "_twice")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then n_lines
    (with words), n_failed (of these, removed), chars, chars_left (of all lines with words, of those left).

    A row each, whatever repeats. A null, empty or blank text has no words, fails and is not kept. A text
    of fewer than three words has no window. A very long text is judged within its row, which holds its
    words once more, and its lines; a doc_id may be null or repeat, and other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = word_counts(judged_lines(rows))
    text = F.coalesce("text", F.lit(""))
    worded = F.filter("lines", lambda x: x["n"] > 0)
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x["line"]))
    rows = rows.select(
        "doc_id", "n_words", "word_chars",
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size(F.filter("lines", lambda x: x["again"])).cast("bigint").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.size(worded).cast("bigint").alias("n_lines"), F.size(F.filter("lines", lambda x: ~_passes(x))).cast("bigint").alias("n_failed"),
        chars(worded).alias("chars"), chars(F.filter(worded, _passes)).alias("chars_left"))
    kept = ~F.col("base_failed") & (100 * F.col("chars_left") >= LEAST_LEFT * F.col("chars"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", "n_failed", "chars", "chars_left")


#: The same rows from plain SQL, line by line and window by window.
SQL = r"""
with d as (select doc_id, row_number() over () rid, coalesce(text, '') t from documents),
l as (select rid, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) as place from d),
j as (select rid, line, len(regexp_extract_all(line, '[^ 	-
]+')) n, row_number() over (partition by rid, line order by place) > 1 again,
  len(regexp_extract_all(line, '@SEPARATOR')) seps, len(regexp_extract_all(line, '@MARKED')) marked, len(regexp_extract_all(line, '@SHOUTED')) shouted,
  regexp_matches(line, '@ENDING') ended, regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '@BOILERPLATE') boiler from l),
f as (select rid, line, again, again or (n < 8 and not ended) or (seps > 1 and seps * 4 >= n) or (marked > 0 and marked * 4 >= n) or (shouted > 0 and shouted * 4 >= n) or boiler fails from j where n > 0),
lines as (select rid, count(*) n_lines, count(*) filter (where fails) n_failed, count(*) filter (where again) n_dup_lines, sum(length(line)) chars, coalesce(sum(length(line)) filter (where not fails), 0) chars_left from f group by rid),
w as (select rid, unnest(ws) w, generate_subscripts(ws, 1) as place from (select rid, regexp_extract_all(t, '[^ 	-
]+') ws from d)),
g as (select rid, place, w a, lead(w) over o b, lead(w, 2) over o c from w window o as (partition by rid order by place)),
twice as (select rid, place from (select rid, place, count(*) over (partition by rid, a, b, c) k from g where c is not null) where k > 1),
rep as (select rid, count(distinct place + s) n from twice, (select unnest([0, 1, 2]) s) group by rid),
one as (select rid, count(*) n_words, sum(length(w)) word_chars from w group by rid)
select doc_id, coalesce(n_words, 0) n_words, coalesce(word_chars, 0)::bigint word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, coalesce(n_dup_lines, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words,
  coalesce(n_words, 0) < 50 or 100 * coalesce(rep.n, 0) > 50 * coalesce(n_words, 0) base_failed,
  not (coalesce(n_words, 0) < 50 or 100 * coalesce(rep.n, 0) > 50 * coalesce(n_words, 0)) and 100 * chars_left >= 50 * chars kept,
  coalesce(n_lines, 0) n_lines, coalesce(n_failed, 0) n_failed, coalesce(chars, 0)::bigint chars, coalesce(chars_left, 0)::bigint chars_left
from d left join lines using (rid) left join rep using (rid) left join one using (rid)
"""
for _name, _pattern in (("SEPARATOR", SEPARATOR), ("MARKED", MARKED), ("SHOUTED", SHOUTED), ("ENDING", ENDING), ("BOILERPLATE", "|".join(BOILERPLATE))):
    SQL = SQL.replace("@" + _name, _pattern.replace("'", "''"))
