"""Order-dependent and numeric rules against small loops and known values."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrid.functions import arrays, scalars, text
from evigrid.operators import chunks, claims, dedup, edits, graph, metrics, ranking, screening, stats
from evigrid.sources import files


def loop_dedupe(rows, register):
    dois, titles, kept = set(), set(), []
    for pos, doi, title in rows:
        d, t = (doi or "").strip().lower() or None, title.lower().strip()
        if d in dois:
            continue
        if register and d:
            dois.add(d)
        if t in titles:
            continue
        if d:
            dois.add(d)
        titles.add(t)
        kept.append(pos)
    return kept


@pytest.mark.parametrize("register", [False, True])
def test_sequential_dedupe(spark, register):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "10.1/A", "10.1/a", "10.1/b", f"10.2/{rng.randrange(9)}"]), f"title {rng.randrange(12)}") for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, doi string, title string")
    got = sorted(r["pos"] for r in dedup.sequential(df, register).collect())
    assert got == loop_dedupe(rows, register)


@pytest.mark.parametrize("register", [False, True])
def test_sequential_dedupe_of_a_long_chain(spark, register):
    """Rows of a chain share a DOI with one neighbour and a title with the other; its far end is first."""
    n = 80
    order = [(i * 37) % n for i in range(n)]
    rows = [(pos, f"10.1/{(i + 1) // 2}", f"title {i // 2}") for pos, i in enumerate(order)]
    rows += [(n + k, "10.9/x", "copies") for k in range(200)]
    df = spark.createDataFrame(rows, "pos long, doi string, title string")
    plan = dedup.sequential(df, register)
    assert sorted(r["pos"] for r in plan.collect()) == loop_dedupe(rows, register)
    assert "InPandas" not in plan._jdf.queryExecution().toString()  # no group becomes one task's frame


def test_issn_normalisation_reads_every_supplier(spark, tmp_path):
    import duckdb

    from evigrid import plans, registry  # noqa: F401

    spark.range(990, 12_000, 7).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = sorted(map(tuple, registry.QUERIES["issn_normalisation"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    assert got == sorted(con.execute(registry.ORACLE["issn_normalisation"]).fetchall())


def test_best_by_doi_ties_and_missing(spark):
    rows = [(0, "10.1/X", 3), (1, "10.1/x", 3), (2, "10.1/x", 5), (3, None, 1), (4, "", 2)]
    out = dedup.best_by_doi(spark.createDataFrame(rows, "pos long, doi string, citation_count int")).collect()
    assert sorted((r["pos"], r["first_pos"], r["tier"]) for r in out) == [(2, 0, 0), (3, 3, 1), (4, 4, 1)]


def loop_pack(t, size):
    out, cur = [], ""
    for p in t.split("\n\n"):
        if len(cur) + len(p) > size:
            if cur:
                out.append(cur.strip())
            cur = p
        else:
            cur += "\n\n" + p
    if cur.strip():
        out.append(cur.strip())
    return out[:40]


def test_packing_equals_a_loop(spark):
    rng = random.Random(5)
    texts = ["", "one", "a" * 90 + "\n\nb"] + ["\n\n".join("w" * rng.randrange(40) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [c["text"] for c in r["c"]] for r in df.select("i", chunks.packed("t", 50).alias("c")).collect()}
    assert got == {i: loop_pack(t, 50) for i, t in enumerate(texts)}


def test_sections_and_references(spark):
    t = "front\nAbstract\nx y\n  METHODS \nm\nReferences\nSmith, J. (2020). doi: 10.1000/1"
    row = spark.createDataFrame([(t,)], "t string").select(chunks.sections("t").alias("s")).first()
    assert [(s["section"], s["text"]) for s in row["s"]][:3] == [("preamble", "front"), ("abstract", "x y"), ("methods", "m")]
    refs = "Smith, J. A. (2019). pp. 12. doi: 10.1000/abc. Jones, B. (2018). Retrieved from x. pp. 3. " * 4
    out = spark.createDataFrame([(refs,), ("plain words " * 40,), (None,)], "t string").select(chunks.is_reference_list("t").alias("r")).collect()
    assert [r["r"] for r in out] == [True, False, False]


def test_shapiro_known_values():
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)
    w, p = stats.shapiro_wilk(x)
    assert abs(w - 0.79) < 0.01 and 0.004 < p < 0.01
    w, p = stats.shapiro_wilk(np.random.default_rng(1).normal(size=400))
    assert w > 0.98 and p > 0.01
    assert math.isnan(stats.shapiro_wilk(np.ones(5))[0])


def test_statistics_of_few_and_constant_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "a double, b double")
    got = {r["column"]: r for r in stats.numeric_stats(df, ["a", "b"]).collect()}
    assert got["a"]["skewness"] is None and got["b"]["skewness"] == 0.0 and got["b"]["kurtosis"] is None
    assert [r["r"] for r in stats.correlations(df, ["a", "b"]).where("a <> b").collect()] == [None]


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    row = metrics.binary(df.agg(*metrics.counts("y", "p"))).first()
    assert row["recall"] is None and row["precision"] is None and row["f1"] is None and row["specificity"] == 1.0
    assert metrics.kappa(df, "y", "p").first()["kappa"] is None


def test_wilson_matches_published(spark):
    row = metrics.with_wilson(spark.createDataFrame([(55, 60)], "k int, n int"), "k", "n").first()
    assert round(row["lo"], 3) == 0.819


def test_guards_never_lower_a_status(spark):
    rng = random.Random(2)
    rows = []
    for i in range(80):
        q = "the effect was large and stable across all of the groups"
        rows.append((i, rng.choice(["verified", "needs_nuance", "unsupported", "error", "no_full_text"]), rng.choice([q, "nothing alike here whatever"]), rng.choice([q, None, "a quote that nobody ever wrote in any text"]), rng.choice([[q], [], [q + " 12.5%"]]), [(rng.choice(["supported", "absent", "contradicted"]), rng.random() < 0.5)]))
    df = spark.createDataFrame(rows, "i int, status string, claim string, quote string, chunks array<string>, assertions array<struct<verdict:string,central:boolean>>")
    rank = {s: k for k, s in enumerate(claims.RANK)}
    for r in claims.guarded(df).collect():
        if r["status"] in rank:
            assert rank[r["final_status"]] >= rank[r["status"]]
        else:
            assert r["final_status"] == ("unsupported" if r["status"] == "no_full_text" and r["chunks"] else r["status"])


def test_numeral_tolerance(spark):
    df = spark.createDataFrame([(36.0, True, 0.36, False, True), (36.0, False, 36.0, True, True), (1.62, False, 161.0, False, False), (10.0, False, 10.05, False, True)], "a double, ap boolean, b double, bp boolean, want boolean")
    assert all(r["g"] == r["want"] for r in df.select("want", scalars.numerals_equivalent(F.col("a"), F.col("ap"), F.col("b"), F.col("bp")).alias("g")).collect())


def test_names(spark):
    df = spark.createDataFrame([("Smith, J.",), ("J. Smith",), ("Smith J",), ("Jane Smith",), ("Teun van Dijk",), ("",)], "n string")
    rows = df.select(text.surname_key("n").alias("k"), text.family_given("n").alias("f")).collect()
    assert [r["k"] for r in rows] == ["smith", "smith", "smith", "smith", "dijk", None]
    assert (rows[4]["f"]["family"], rows[4]["f"]["given"]) == ("van Dijk", "Teun")


def test_folds(spark):
    df = spark.createDataFrame([("ﬁt Étude",), (None,)], "t string")
    assert [r[0] for r in df.select(text.compat_fold("t")).collect()] == ["fit Étude", None]
    assert [r[0] for r in df.select(text.accent_fold("t")).collect()] == ["fit etude", None]


def test_brackets_and_open_access(spark):
    df = spark.createDataFrame([("[3, 5-7]",), ("[2]",)], "t string")
    assert [r[0] for r in df.select(arrays.expand_brackets("t")).collect()] == [[3, 5, 6, 7], [2]]


def test_allocation_reaches_the_total():
    got = ranking.allocate_with_floor({"a": 100, "b": 10, "c": 2}, 30, 3, 5)
    assert sum(got.values()) == 30 and got["b"] >= 3 and all(got[k] <= n for k, n in {"a": 100, "b": 10, "c": 2}.items())


def test_communities_of_two_cliques(spark):
    e = [(f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(5) for j in range(i)] + [("x0", "y0")]
    edges = spark.createDataFrame(e, "src string, dst string")
    labels = graph.communities(edges)
    assert graph.modularity(edges, labels).first()[0] > 0.3


def test_distances_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    s = spark.createDataFrame([("a",), ("lonely",)], "node string")
    assert {r["node"]: r["d"] for r in graph.distances(e, s).collect()} == {"a": 0, "lonely": 0, "b": 1, "c": 1, "d": 2}


def test_edits(spark):
    df = spark.createDataFrame([(0, "a", 1.5), (1, "b", 2.5)], "row_index int, s string, x double")
    e = spark.createDataFrame([(1, "x", "9"), (0, "s", None)], "row_index int, column string, value string")
    assert sorted(map(tuple, edits.apply_edits(df, e).collect())) == [(0, None, 1.5), (1, "b", 9.0)]
    with pytest.raises(ValueError):
        edits.apply_edits(df, spark.createDataFrame([(7, "x", "9")], "row_index int, column string, value string"))
    with pytest.raises(ValueError):
        edits.plan_updates([{"name": "a"}, {"name": "b"}], [{"name": "a", "new_name": "b"}])


def test_two_edits_of_a_cell_need_an_order(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "row_index int, x string")
    e = spark.createDataFrame([(0, "x", "c", 2), (0, "x", "d", 1)], "row_index int, column string, value string, ord int")
    assert sorted(map(tuple, edits.apply_edits(df, e).collect())) == [(0, "c"), (1, "b")]
    with pytest.raises(ValueError):
        edits.apply_edits(df, e.drop("ord"))


def test_planned_updates():
    cols = [{"name": n, "dtype": "text", "role": "x"} for n in "abc"]
    plan = edits.plan_updates(cols, [{"name": "a", "deleted": True, "new_name": "q"}, {"name": "b", "new_name": "z", "dtype": "numeric"}, {"name": "b", "dtype": "numeric"}, {"name": "nope", "role": "y"}, {"name": "c", "role": "y"}, {"name": "a", "deleted": True}])
    assert (plan["dropped"], plan["renames"], plan["dtypes"], plan["applied"]) == (["a"], {"b": "z"}, {"b": "numeric"}, 3)
    assert plan["columns"] == [{"name": "z", "dtype": "numeric", "role": "x"}, {"name": "c", "dtype": "text", "role": "y"}]


def test_citation_forms(spark):
    cases = {"as shown (see Smith, 2020; van Dijk & Jones, 2019b, p. 4)": {("Smith", "2020"), ("van Dijk", "2019b")}, "As Smith, Jones, and Brown (2018) say": {("Smith", "2018")}, "work of de la Cruz et al. (n.d.) and Hall's (in press) view": {("de la Cruz", "n.d."), ("Hall", "in press")},
             "(Freud, 1910, as cited in O'Brien, 1999)": {("O'Brien", "1999")}, "the World Bank (2021, chap. 2)": {("Bank", "2021")}, "In 2019 (about 40 cases) nothing": set(), "García-López, Smith (2001)": {("Smith", "2001")}, "under Smith (1999) and Op den Kamp (2000)": {("Smith", "1999"), ("Op den Kamp", "2000")}, None: set()}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r["i"]: {(x["surname"], x["year"]) for x in r["c"]} for r in df.select("i", claims.citations("t").alias("c")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_numerals_are_read_from_whole_words(spark):
    df = spark.createDataFrame([("CTLA-4 rose 12.5% from 1,200 (n=34), 5-7 of 10.2, v2 in 2019; Table 3",)], "t string")
    assert [(x["value"], x["percent"]) for x in df.select(claims.numerals("t").alias("n")).first()["n"]] == [(12.5, True), (1200.0, False), (34.0, False), (5.0, False), (10.2, False)]


def test_distances_have_no_limit(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(60)], "src string, dst string")
    got = {r["node"]: r["d"] for r in graph.distances(e, spark.createDataFrame([("n0",)], "node string")).collect()}
    assert got == {f"n{i}": i for i in range(61)}


def test_table_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,x,NA\n2,,3.5\n")
    df = files.read_table(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "double"}
    assert sorted(map(tuple, df.collect())) == [(1, "x", None), (2, None, 3.5)]
    assert files.upload_problem("x.pdf", 3) == "unsupported type" and files.upload_problem("x.csv", 3) is None
    assert [r["row_index"] for r in files.numbered(df).orderBy("row_index").collect()] == [0, 1]


def test_venue_lists_and_bibliography(spark, tmp_path):
    (tmp_path / "List (SSCI).csv").write_text("t,issn,e\nJ One, 1234-567x ,\nJ Two\n")
    rows = files.read_venues(spark, str(tmp_path)).orderBy("journal_title").collect()
    assert [(r["journal_title"], r["issn"], r["collection"]) for r in rows] == [("J One", "1234-567X", "SSCI"), ("J Two", None, "SSCI")]
    p = spark.createDataFrame([(["Smith, Jane"], "On Cats", "J", 2020, "10.1/x")], "authors array<string>, title string, journal string, year int, doi string")
    back = files.to_bibtex(p).select(F.explode(files.parse_bibtex("value")).alias("b")).select("b.*").first()
    assert back["title"] == "On Cats" and back["year"] == 2020 and back["doi"] == "10.1/x" and back["authors"] == ["Smith, Jane"]


def test_flow_reconciles_and_stop(spark):
    df = spark.createDataFrame([("included",), ("duplicate",), ("unscreened",)], "outcome string")
    assert screening.flow(df).first()["reconciles"]
    r = spark.createDataFrame([(1, 10, 0), (2, 600, 3)], "round int, total int, dry int")
    assert [x["stop"] for x in screening.stop_reason(r).orderBy("round").collect()] == [None, "target_reached"]


def test_job_states_stream(spark, tmp_path):
    from evigrid.streaming import jobs

    rows = [(1, "running", "2024-01-01 00:00:00"), (1, "cancelled", "2024-01-01 00:01:00"), (1, "completed", "2024-01-01 00:02:00"), (2, "running", "2024-01-01 00:00:30")]
    df = spark.createDataFrame(rows, "job_id long, status string, t string").select("job_id", "status", F.col("t").cast("timestamp_ntz").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    s = jobs.job_states(jobs.event_stream(spark, str(tmp_path / "in"), df.schema))
    q = s.writeStream.format("memory").queryName("js").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r["job_id"]: r["status"] for r in spark.table("js").where("status <> 'failed'").collect()}
    assert last[1] == "cancelled" and last[2] == "running"
