"""Reference lists on odd input, rechecked edits, readings and the replay of guards, against plain loops."""
import re

from pyspark.sql import functions as F

from evigrid.operators import citing, claims, labelled, recheck, reflists
from evigrid.plans import citing as plan


def test_wrapped_entries(spark):
    text = "References\n\n running on\nLee, A. B. (2019). A title here. Jour-\nnal of X, 3. doi: 10.1000/ab.c).\n Kim, C. (2020a). Pre­ post and\nmore of it. y\nO'Neil-Smith, D. E. (in press). No year.\r\nVan Dyke, F. (1999) Untitled"
    d = spark.createDataFrame([(1, text), (2, None), (3, "  \n"), (4, "cross-\nand joined")], "doc long, text string")
    got = {(r["doc"], r["entry"]): r["raw"] for r in reflists.wrapped_entries(d).collect()}
    assert got == {(1, 1): "running on", (1, 2): "Lee, A. B. (2019). A title here. Journal of X, 3. doi: 10.1000/ab.c).", (1, 3): "Kim, C. (2020a). Prepost and more of it. y", (1, 4): "O'Neil-Smith, D. E. (in press). No year.", (1, 5): "Van Dyke, F. (1999) Untitled", (4, 1): "cross- and joined"}
    parts = {r["raw"][:3]: r["p"] for r in spark.createDataFrame([(v,) for v in got.values()], "raw string").withColumn("p", reflists.entry_parts("raw")).collect()}
    assert tuple(parts["Lee"]) == ("Lee", "2019", "2019", "A title here", "10.1000/ab.c") and tuple(parts["Kim"]) == ("Kim", "2020", "2020a", "Prepost and more of it", None)
    assert parts["run"] is None and parts["O'N"] is None and tuple(parts["Van"]) == ("Van Dyke", "1999", "1999", None, None)


def test_numbered_entries(spark):
    rows = [(1, 0, "paragraph", "[1] in the body", None), (1, 1, "heading", " Works  Cited: ", None), (1, 2, "paragraph", "1. first", None), (1, 3, "paragraph", "no number", None), (1, 4, "item", " second ", 2), (1, 5, "item", "", 3), (1, 6, "paragraph", "[1] first again", None), (1, 7, "heading", "Notes", None), (1, 8, "paragraph", "3. after", None),
            (2, 0, "heading", "参考文献：", None), (2, 1, "paragraph", "2) two", None), (3, 0, "paragraph", "1. body", None), (4, 0, "heading", "References", None), (4, 1, "heading", "References", None), (4, 2, "paragraph", "1. x", None)]
    b = spark.createDataFrame(rows, "doc long, block int, kind string, text string, number int")
    assert sorted(map(tuple, reflists.numbered_entries(b).select("doc", "number", "raw", "contiguous").collect())) == [(1, 1, "first again", True), (1, 2, "second", True), (2, 2, "two", False)]


def test_only_new_wording_is_checked(spark):
    p = "draft long, paragraph int, body string"
    old = spark.createDataFrame([(1, 0, "same  words"), (1, 1, "old words"), (1, 2, "empty of claims"), (2, 0, "same words")], p)
    new = spark.createDataFrame([(1, 0, "put before"), (1, 1, "same words"), (1, 2, "empty of claims"), (2, 0, "same words too"), (3, 0, "same words")], p)
    seen = []

    def check(x):
        seen.append(sorted((r["draft"], r["paragraph"]) for r in x.collect()))
        return x.where("body not like 'empty%'").select("draft", "paragraph", F.length("body").alias("n"))

    out = recheck.rechecked(new, recheck.remembered(old, check(old)), check)
    assert seen[1] == [(1, 0), (2, 0), (3, 0)]
    assert sorted(map(tuple, out.collect())) == [(1, 0, 10, False), (1, 1, 11, True), (2, 0, 14, False), (3, 0, 10, False)]


def test_gaps(spark):
    s = spark.createDataFrame([(1, "a  b"), (1, "c"), (1, "d"), (1, "e"), (1, " "), (2, "a b")], "draft long, sentence string")
    links, uncited = spark.createDataFrame([(1, "a b")], "draft long, sentence string"), spark.createDataFrame([(1, "c ")], "draft long, sentence string")
    answers = spark.createDataFrame([(1, "d", "odd"), (1, "e", None), (2, "a  b", "framing"), (2, "a b", "finding"), (9, "q", "framing")], "draft long, sentence string, tag string")
    assert sorted(map(tuple, recheck.gaps_closed(s, links, uncited, answers).select("draft", "sentence", "tag", "unclassified").collect())) == [(1, "d", "finding", False), (1, "e", "finding", True), (2, "a b", "finding", False)]


def test_incremental_run_equals_a_full_one(spark, data):
    old = citing.paragraphs_of(plan.drafts(spark, data))
    new = old.withColumn("body", F.when(F.col("paragraph") % 4 == 2, F.concat(F.lit("Anew, says Lee (2020). "), "body")).otherwise(F.col("body")))
    none = spark.createDataFrame([], "draft bigint, paragraph int, link bigint, sentence string, citation string, proposition string, keys array<string>")
    run = lambda p: citing.document_claims(citing.assigned(p, citing.keyed(citing.citation_units(p), plan.library(spark, data)), none), ("draft", "paragraph"))
    cols = ["draft", "paragraph", "claim", "key", "citation"]
    part = recheck.rechecked(new, recheck.remembered(old, run(old)), run)
    assert sorted(map(tuple, part.select(*cols).collect())) == sorted(map(tuple, run(new).select(*cols).collect()))
    assert part.where("carried").count() > part.where("not carried").count() > 0


def test_readings(spark):
    long_ = "word " * 14
    rows = [(long_ + "(Lee, 2020).", "Lee, A. (2020). T. J.", "2021", None), (long_ + "(Lee, 2020).", "", "2017", ["Kim"]), ("short (Lee, 2020) and (Kim, 2019).", "Kim, A. (2020). T. J.", None, None), (long_ + "Lee and Kim (2020) agree.", "see lee and kim", "x", None), (None, None, None, None), ("word " * 60 + "(Lee, 2020)", "unread", "2020", ["A. Lee"])]
    df = spark.createDataFrame(rows, "claim string, entry string, year string, authors array<string>")
    got = [r[0] for r in df.select(labelled.reading_problems("claim", "entry", "year", "authors")).collect()]
    assert got == [[], ["entry", "year_gap", "surname"], ["words", "years"], [], ["words", "years", "entry"], ["words"]]


def test_every_guard_can_be_replayed(spark):
    chunk = "the trial reported that feedback improved writing scores by 12 percent in most classes"
    rows = [("verified", "feedback improved writing scores by 12", chunk, [chunk], []), ("verified", "feedback improved writing scores by 99", chunk, [chunk], []), ("verified", "feedback improved writing scores", "wholly invented words that stand nowhere in it", [chunk], []),
            ("no_full_text", "x", "y", [chunk], []), ("error", "x", "y", [chunk], []), ("no_full_text", "x", "y", [], []), ("verified", "quite unrelated matters concerning elephants", "nothing like that is in the passage at all", [chunk], [("contradicted", True)])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, status string, claim string, quote string, chunks array<string>, assertions array<struct<verdict:string,central:boolean>>")
    full = {r["id"]: r for r in claims.guarded(df).collect()}
    for g in claims.GUARDS:
        for r in claims.replayed(df, g).collect():
            assert r["after"] == full[r["id"]]["final_status"]
            assert r["new_status"] == (r["after"] if r["status"] == "verified" and r["changed"] else r["status"]) and (not r["found"] or g in full[r["id"]]["machine_reasons"])
    one = {r["id"]: r for r in claims.replayed(df, "numeric_value_absent").collect()}
    assert (one[1]["before"], one[1]["after"], one[1]["new_reasons"]) == ("verified", "needs_nuance", ["numeric_value_absent"]) and not one[4]["changed"] and not re.search("num", str(one[0]["new_reasons"]))
