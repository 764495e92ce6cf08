"""Agreement between reviewers, models and runs; second passes and criteria; seeds and their neighbours."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import div
from ..functions.text import col
from .metrics import kappa, with_wilson
from .screening import second_pass


def judged(rows: DataFrame, status: str, verdict: str, by: list[str] = (), withheld: str = "no_full_text") -> DataFrame:
    """n_items, n_judged, n_withheld, n_agree, accuracy and its interval. Rows whose status is `withheld`
    were answered by instruction and are left out of the share."""
    kept = F.coalesce(F.col(status) != withheld, F.lit(True))
    agg = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(kept).alias("n_judged"), F.count_if(~kept).alias("n_withheld"), F.count_if(kept & (F.col(status) == F.col(verdict))).alias("n_agree"))
    return with_wilson(agg.withColumn("accuracy", div("n_agree", "n_judged")), "n_agree", "n_judged")


def pairwise(rows: DataFrame, raters: list[str]) -> DataFrame:
    """pair, n, percent, kappa of every two columns of raters, over rows that both rated."""
    spread = F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for i, a in enumerate(raters) for b in raters[i + 1:]])
    pairs = rows.select(F.explode(spread).alias("p")).select("p.*")
    return kappa(pairs, "a", "b", ["pair"]).select("pair", "n", F.col("po").alias("percent"), "kappa")


def mean_pairwise(rows: DataFrame, raters: list[str]) -> DataFrame:
    """mean_percent and mean_kappa over the pairs; the latter is null if one of them is undefined."""
    p = pairwise(rows, raters)
    return p.agg(F.avg("percent").alias("mean_percent"), F.when(F.count_if(F.col("kappa").isNull()) == 0, F.avg("kappa")).alias("mean_kappa"))


def majority_answers(rows: DataFrame, reviewers: list[str]) -> DataFrame:
    """Adds majority: yes if more than half of the reviewers' columns say so, else no."""
    yes = sum((F.coalesce(F.lower(F.trim(r)) == "yes", F.lit(False)).cast("int") for r in map(F.col, reviewers)), F.lit(0))
    return rows.withColumn("majority", F.when(yes * 2 > len(reviewers), "yes").otherwise("no"))


def runs_compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n, n_compared, n_deterministic, n_error and the agreement of two runs(key, status, deterministic,
    error) over the items that a model decided in both, as statuses and as verified or not."""
    both = a.join(b.select(key, *[F.col(c).alias(f"_{c}") for c in ("status", "deterministic", "error")]), key)
    fixed, failed = F.col("deterministic") | F.col("_deterministic"), F.col("error") | F.col("_error")
    ok = ~fixed & ~failed
    yes = lambda c: (F.col(c) == "verified").cast("string")
    counts = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_compared"), F.count_if(fixed).alias("n_deterministic"), F.count_if(~fixed & failed).alias("n_error"))
    k = kappa(both.where(ok), "status", "_status").select(F.col("po").alias("percent_status"), F.col("kappa").alias("kappa_status"))
    y = kappa(both.where(ok).select(yes("status").alias("a"), yes("_status").alias("b")), "a", "b").select(F.col("po").alias("percent_binary"), F.col("kappa").alias("kappa_binary"))
    return counts.join(F.broadcast(k), F.lit(True), "left").join(F.broadcast(y), F.lit(True), "left")


def axis_counts(rows: DataFrame) -> DataFrame:
    """axis, n of the rows that do not agree; blank axes are not counted."""
    axis = F.trim(F.coalesce("disagreement_axis", F.lit("")))
    return rows.where("agrees = 'no'").select(axis.alias("axis")).where("axis <> ''").groupBy("axis").agg(F.count(F.lit(1)).alias("n"))


def overridden(rows: DataFrame) -> DataFrame:
    return rows.where("agrees = 'no'").select("item_id", "verifier_status", "human_verdict", F.coalesce("disagreement_axis", F.lit("")).alias("disagreement_axis"))


def stage_ids(criteria: Column, stages: Column, prefix: str, stage: str) -> Column:
    """Ids (prefix and number from 1) of the criteria whose stage is `stage`; without one it is abstract."""
    at = lambda i: F.coalesce(F.get(stages, i), F.lit("abstract"))
    return F.filter(F.transform(criteria, lambda c, i: F.when(at(i) == stage, F.concat(F.lit(prefix), (i + 1).cast("string")))), lambda x: x.isNotNull())


def to_confirm(decision, named, full_text_ids) -> Column:
    """Of an include the full-text criteria that it names, all of them if it names none; else nothing."""
    kept = F.array_sort(F.array_intersect(F.coalesce(col(named), F.array().cast("array<string>")), col(full_text_ids)))
    return F.when(col(decision) != "INCLUDE", F.array().cast("array<string>")).when(F.size(kept) > 0, kept).otherwise(F.array_sort(F.array_distinct(col(full_text_ids))))


def second_stage(candidates: DataFrame, answers: DataFrame, size: int = 5, budget: int | None = None) -> DataFrame:
    """id, batch, status, reason: includes go to a second pass in batches of `size` in order of pos, the
    first `budget` of them; without an answer(id, verdict, quote) they need review."""
    from .ranking import batches

    marked = candidates.withColumn("_in", (F.col("status") == "INCLUDE").cast("int"))
    numbered = batches(marked, ["pos"], size, ["run", "_in"])
    sent = (F.col("_in") == 1) if budget is None else (F.col("_in") == 1) & (F.col("batch") < -(-budget // size))
    out = numbered.join(answers.select("id", "verdict", "quote"), "id", "left")
    confirmed = second_pass("status", "verdict", "shown", "quote")
    status = F.when(F.col("_in") == 0, F.col("status")).when(~sent | F.col("verdict").isNull(), "NEEDS_REVIEW").otherwise(confirmed)
    reason = F.when(F.col("_in") == 0, None).when(~sent, "budget").when(F.col("verdict").isNull(), "unavailable").when(confirmed == "NEEDS_REVIEW", "not_confirmed")
    return out.select("run", "id", F.when(F.col("_in") == 1, F.col("batch")).alias("batch"), status.alias("status"), reason.alias("reason"))


def seeds_expanded(edges: DataFrame, seeds: DataFrame, works: DataFrame, library: DataFrame) -> DataFrame:
    """Works that a seed refers to or that refer to one, once each, without the seeds and what the library
    holds: work, role (reference before citing), n_seeds."""
    s = seeds.select("work").distinct()
    refs = edges.join(s, edges["src"] == s["work"]).select(F.col("dst").alias("found"), F.lit(0).alias("r"), "work")
    cites = edges.join(s, edges["dst"] == s["work"]).select(F.col("src").alias("found"), F.lit(1).alias("r"), "work")
    one = refs.unionAll(cites).groupBy(F.col("found").alias("work")).agg(F.min("r").alias("r"), F.count_distinct("work").alias("n_seeds"))
    fresh = one.join(s, "work", "left_anti").join(library.select("work").distinct(), "work", "left_anti").join(works.select("work").distinct(), "work", "left_semi")
    return fresh.select("work", F.when(F.col("r") == 0, "reference").otherwise("citing").alias("role"), "n_seeds")


def run_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, rows, tokens (null if one is unknown), first and last time, and the models reported."""
    known = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(c)).alias(c)
    return calls.groupBy(*by).agg(F.count_distinct("call_id").alias("n_calls"), F.count(F.lit(1)).alias("n_rows"), known("input_tokens"), known("output_tokens"), F.min("called_at").alias("first_at"), F.max("called_at").alias("last_at"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


def usable_works(works: DataFrame) -> DataFrame:
    """Works that are no reviews, no front matter, and have a file."""
    front = F.lower("title").rlike(r"^(editorial|front matter|table of contents|issue information|erratum|correction)\b")
    review = (F.lower("type") == "review") | F.lower("title").rlike(r"\b(systematic|literature|scoping) review\b|\bmeta-analysis\b")
    return works.where(~F.coalesce(front, F.lit(False)) & ~F.coalesce(review, F.lit(False)) & (F.length(F.coalesce("pdf_url", F.lit(""))) > 0))


def strata(rows: DataFrame, by: list[str], total: int, floor: int) -> DataFrame:
    """by, n, n_drawn: a census of the strata, and how many rows are drawn of each: the floor first (or all
    there are), the rest in proportion by largest remainder. Strata are few; the census is collected."""
    from .ranking import allocate_with_floor

    census = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sizes = {tuple(r[c] for c in by): r["n"] for r in census.collect()}
    names = {"|".join(map(str, k)): k for k in sizes}
    drawn = allocate_with_floor({n: sizes[k] for n, k in names.items()}, total, floor, 1)
    plan = rows.sparkSession.createDataFrame([(*names[n], k) for n, k in drawn.items()], rows.select(*by).schema.add("n_drawn", "long"))
    return census.join(F.broadcast(plan), by)


def answered_only(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Recall and precision over all rows and over those that the model answered itself (padded ones left
    out), and how many rows have no abstract."""
    real = ~F.coalesce("padded", F.lit(False))
    c = lambda ok: F.count_if(ok)
    hit, pos, said = (F.col("label") == 1) & (F.col("predicted") == 1), F.col("label") == 1, F.col("predicted") == 1
    agg = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), c(~real).alias("n_padded"), c(~F.col("has_abstract")).alias("n_no_abstract"), c(hit).alias("h"), c(pos).alias("p"), c(said).alias("s"), c(hit & real).alias("hr"), c(pos & real).alias("pr"), c(said & real).alias("sr"))
    return agg.select(*by, "n", "n_padded", "n_no_abstract", div("h", "p").alias("recall"), div("h", "s").alias("precision"), div("hr", "pr").alias("recall_answered"), div("hr", "sr").alias("precision_answered"))
