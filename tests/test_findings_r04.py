"""Queries against their SQL on odd rows: texts without words, prices like years, halves, hyphens in a row."""
import random
import re
import time

import duckdb
import pytest

from evigrid import registry
from evigrid.operators import access, citing, claims, evidence, graph, joins, passages
from tests.test_oracle import plain


@pytest.fixture
def equals_sql(spark, tmp_path):
    """Writes tables (rows and schema by name) and holds a query over them against its SQL."""

    def held(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        df = registry.QUERIES[name](spark, str(tmp_path))
        cur = con.execute(registry.ORACLE[name])
        cols = [c[0] for c in cur.description]
        got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
        assert got == sorted(repr(tuple(plain(x) for x in r)) for r in cur.fetchall())
        return got

    return held


DOC = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", "   ", "\n", "A.", " \t x" + " " * 60 + "y", "Some words, long enough to be cut in the middle of one.", "é" * 1200]


def documents(texts):
    return [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], DOC


def test_decisions_on_blank_texts(equals_sql):
    assert len(equals_sql("decision_guards", documents=documents(TEXTS * 5))) == 5 * len(TEXTS)


def test_amounts_in_the_range_of_years(equals_sql):
    orders = [(k, 1, "O", p, None, "5-LOW") for k, p in enumerate([1500.0, 1734.0, 1734.5, 2012.0, 2100.0, 2101.0, 0.95, 99.0, 499000.01] * 3)]
    assert len(equals_sql("numerals_outside_passage", orders=(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"))) == 27


def test_bare_years_alone_are_no_amounts(spark):
    rows = spark.createDataFrame([("In 1999, 2,000 and 1500.0 of 02012; 2100 2101 1499 1800% 1999.",)], "t string")
    assert [x["value"] for x in rows.select(claims.numerals("t").alias("n")).first()["n"]] == [2000.0, 1500.0, 2101.0, 1499.0, 1800.0]


def test_halves_of_citation_counts(equals_sql):
    part = [(k, "old ring", "Brand#1", "ECONOMY", 20 + k, 910.0 + k / 2) for k in range(40)]
    assert len(equals_sql("provider_search", part=(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"))) == 25


def test_documents_without_words_have_no_score(equals_sql):
    assert len(equals_sql("tfidf_ranking", documents=documents([None, "", "A. b! 3", "the shoe and the rest", "with, of the", "ab"]))) == 3


def test_record_texts_of_blanks(equals_sql):
    assert len(equals_sql("record_texts", documents=documents(TEXTS * 6))) == 6 * len(TEXTS)


def test_hyphens_before_conjunctions_in_a_row(equals_sql):
    odd = "Say it. Lee heer orer andd heer orer and more. Kim beer toer orer butter norer and. Adler he is heer andy heer or\néer and heer toé. "
    equals_sql("reference_entries", documents=documents([odd * 3, odd.replace("er ", "er-\n"), None, "", "heer orer and heer or"]))


def test_shown_texts_of_blanks(equals_sql):
    assert len(equals_sql("shown_texts", documents=documents(TEXTS))) == len(TEXTS)


def test_sources_of_blanks_and_open_hyphens(equals_sql):
    assert len(equals_sql("source_texts", documents=documents(TEXTS + ["word-", "word-\n", "wo-\nrd"]))) == 9


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entries_are_counted_before_citations_meet_them(spark):
    cites = spark.createDataFrame([(1, "lee", None, "2000"), (1, "lee", None, "2000"), (2, "lee", "kim", "2000a"), (3, "lee", "zhu", "2000"), (4, "ng", None, "1999"), (5, None, None, "2000")], "cite long, surname string, surname2 string, year string")
    entries = spark.createDataFrame([(7, "lee", "2000b", "Lee and KIM"), (8, "ng", "1999", "Ng"), (9, "ng", "1999", "Ng again")], "entry long, surname string, year string, raw string")
    out = passages.matched_entries(cites, entries)
    assert sorted(map(tuple, out.collect())) == [(1, 7), (1, 7), (2, 7)]
    assert "Aggregate" not in plan_of(out).split("Join")[0]


@pytest.mark.parametrize("few", [True, False])
def test_rows_seen_by_members(spark, monkeypatch, few):
    rng = random.Random(4)
    if not few:
        monkeypatch.setattr(joins, "small", lambda df: df)
    members = [(rng.choice([1, 2, 3, None]), rng.randrange(6), rng.choice(["editor", "viewer"])) for _ in range(25)]
    rows = [(i, rng.choice([0, 1, 5, 9, None]), rng.choice([1, 2, 3, 4, None])) for i in range(40)]
    for given in (rows, rows + [(i, o, 2) for i, o, _ in rows[:15]]):
        want = {(o, i, "owner", k) for k, (i, o, _) in enumerate(given) if o is not None}
        roles = {}
        for i, o, t in given:
            for team, user, role in members:
                if t is not None and team == t and user != o:
                    roles[user, i] = min(role, roles.get((user, i), role))
        out = access.visible(spark.createDataFrame(given, "id long, owner long, team int"), spark.createDataFrame(members, "team int, user long, role string"), "id")
        assert sorted(map(tuple, out.collect())) == sorted([x[:3] for x in want] + [(u, i, r) for (u, i), r in roles.items()])
        if given is rows:  # no pair is shuffled or gathered
            assert "Aggregate" not in plan_of(out).split("Join")[0]


def test_chunks_are_folded_once_for_all_quotes(spark):
    chunk = "One é two. Three (four) five?\n\nSix. - Seven eight!"
    quotes = {"one e two": False, "ONE É TWO": True, "two. Three four five": False, "Three four five Six": True, "Six": True, "Six Seven eight": True, "seven": False, "Seven eight": True, "-": False, None: False}
    df = spark.createDataFrame([(q, chunk) for q in quotes] + [("Six", None)], "q string, t string")
    out = df.select("q", evidence.whole_sentences("q", "t").alias("w"))
    assert [r["w"] for r in out.collect()] == [*quotes.values(), False]
    assert plan_of(out).count("regexp_replace(lower(") == 2
    items = spark.createDataFrame([(1, k, q + " b c d e f g h" if q else None, 1) for k, q in enumerate(["x. a", "a", "y z"])] + [(2, 0, "a b c d e f g h", None)], "paper_id long, item int, quote string, chunk_index int")
    chunks = spark.createDataFrame([(1, 0, "X. A b c d e f g h. I."), (1, 1, "A b c d e f g h. I."), (1, 2, "x a b c d e f g h")], "paper_id long, idx int, text string")
    assert sorted((r["paper_id"], r["item"], r["found_index"]) for r in evidence.located_items(items, chunks).collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, None), (2, 0, None)]


@pytest.mark.parametrize("few", [True, False])
def test_titles_are_matched_once_for_all_their_copies(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(joins, "small", lambda df: df)
    names = ["Old ring", "old ring!", "Cold rings", "ring", "ringy", "", None, "ab", "a", "Old", "..", "old  ring"]
    left = [(i, names[i % len(names)]) for i in range(30)] + [(1, "Old ring")]
    right = [(100 + i, names[i % 7]) for i in range(25)]
    key = lambda t: re.sub(r"[^\w\s]", "", (t or "").lower()).strip()
    alike = lambda x, y: x == y or ((x in y or y in x) and min(len(x), len(y)) / max(len(x), len(y)) > 0.7)
    out = joins.fuzzy_title_join(spark.createDataFrame(left, "lid long, title string"), spark.createDataFrame(right, "rid long, title string"))
    assert sorted(map(tuple, out.collect())) == sorted((i, j) for i, x in left for j, y in right if key(x) and key(y) and alike(key(x), key(y)))
    assert "Aggregate" not in plan_of(out).split("Join")[0]


def test_citations_are_found_once(spark):
    body = "Kim, Lee and Ng (2019) said. So (Wu, 2020; Xu, 2021a; see y) it is. Go (et al.) on 1999."
    p = spark.createDataFrame([(1, 0, body), (1, 1, "no year at all"), (1, 2, None)], "draft long, paragraph int, body string")
    found = citing.keyed(citing.citation_units(p), spark.createDataFrame([("lee_2019",)], "key string"))
    assert "regexp_extract_all" not in plan_of(found)
    assert [(r["paragraph"], r["unit"], r["key"]) for r in found.orderBy("paragraph", "unit").collect()][:1] == [(0, 0, "lee_2019")]


def test_rounds_leave_no_shuffles_behind(spark):
    edges = spark.createDataFrame([(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")], "src string, dst string")
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    before = files()
    labels = {r["node"]: r["community"] for r in graph.communities(edges).collect()}
    assert all(labels[f"{c}{i}"] == labels[f"{c}1"] for c in "ab" for i in range(5)) and labels["a1"] != labels["b1"]
    for _ in range(40):  # files go in the background
        if files() <= before + 8:
            break
        time.sleep(0.25)
    assert files() <= before + 8
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
