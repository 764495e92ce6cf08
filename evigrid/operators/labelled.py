"""Evaluation sets with people's labels: labels of record, scores of runs against them, and what is off in the sets."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import div
from .citing import units
from .metrics import kappa, with_wilson
from .reflists import entry_parts

LEAST_WORDS, MOST_WORDS = 15, 60
JUDGEMENTS = ("correct", "incorrect", "unsure")


def human_labels(verdicts: DataFrame, key: DataFrame) -> DataFrame:
    """item, set, label, unanimous, fixed, n: the label of record of verdicts(opaque, reviewer, verdict),
    named by key(opaque, item, set, expected).

    label is what most of the reviewers say, null if two verdicts share the lead. fixed: the protocol leaves
    no choice, as no full text was expected and all say so; such items are left out of agreement.
    """
    votes = verdicts.groupBy("opaque", "verdict").agg(F.count(F.lit(1)).alias("k"))
    told = votes.groupBy("opaque").agg(F.sum("k").alias("n"), F.max(F.struct("k", "verdict")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sort_array(F.collect_list("k"), asc=False).alias("ks"))
    lead = F.when((F.col("kinds") == 1) | (F.get("ks", F.lit(0)) > F.get("ks", F.lit(1))), F.col("top.verdict"))
    named = key.join(told, "opaque")
    one = F.col("kinds") == 1
    return named.select("item", "set", lead.alias("label"), one.alias("unanimous"), (one & (F.col("expected") == "no_full_text") & (F.col("top.verdict") == "no_full_text")).alias("fixed"), "n")


def scored_runs(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """set, run, n, n_missing, n_correct, accuracy, lo, hi, kappa, verified_precision, verified_recall,
    falsely_verified: runs(run, item, set, predicted) against labels(item, label) of record.

    Items without a label are counted as missing and not scored.
    """
    met = runs.join(labels.select("item", "label"), "item", "left").withColumn("hit", F.col("label") == F.col("predicted"))
    said, real = F.col("predicted") == "verified", F.col("label") == "verified"
    agg = met.groupBy("set", "run").agg(F.count("label").alias("n"), F.count_if(F.col("label").isNull()).alias("n_missing"), F.count_if("hit").alias("n_correct"),
                                        F.count_if(said & F.col("label").isNotNull()).alias("_said"), F.count_if(real).alias("_real"), F.count_if(said & real).alias("_both"))
    agg = with_wilson(agg.withColumn("accuracy", div("n_correct", "n")), "n_correct", "n")
    k = kappa(met, "label", "predicted", ["set", "run"]).select("set", "run", "kappa")
    out = agg.join(k, ["set", "run"], "left").withColumn("verified_precision", div("_both", "_said")).withColumn("verified_recall", div("_both", "_real")).withColumn("falsely_verified", F.col("_said") - F.col("_both"))
    return out.select("set", "run", "n", "n_missing", "n_correct", "accuracy", "lo", "hi", "kappa", "verified_precision", "verified_recall", "falsely_verified")


def construction_agreement(labels: DataFrame) -> DataFrame:
    """n, agree, accuracy, n_disjunctive: how often the label of record is one that the item was built for;
    labels(item, expected, final), where expected joins several by |."""
    options = F.split(F.coalesce("expected", F.lit("")), r"\|")
    agg = labels.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains(options, F.col("final"))).alias("agree"), F.count_if(F.size(options) > 1).alias("n_disjunctive"))
    return agg.select("n", "agree", div("agree", "n").alias("accuracy"), "n_disjunctive")


def annotated_runs(runs: DataFrame, labels: DataFrame, names: dict[str, str], other: str) -> DataFrame:
    """run, n, accuracy, tolerant, kappa, miss, n_miss: runs(run, item, predicted) against labels(item,
    expected, final). names maps a status to its label, any other status to `other`; tolerant counts a label
    that the item was built for as right too; miss is the commonest wrong pair, gold->predicted, the least
    of equals."""
    mapped = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("predicted")], F.lit(other))
    met = runs.join(labels, "item").select("run", "final", mapped.alias("said"), "expected")
    fits = F.array_contains(F.split(F.coalesce("expected", F.lit("")), r"\|"), F.col("said"))
    agg = met.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("final") == F.col("said")).alias("_hit"), F.count_if(fits).alias("_fit"))
    wrong = met.where("final <> said").groupBy("run", F.concat_ws("->", "final", "said").alias("pair")).agg(F.count(F.lit(1)).alias("k")).groupBy("run").agg(F.min(F.struct((-F.col("k")).alias("k"), "pair")).alias("m"))
    full = agg.join(kappa(met, "final", "said", ["run"]).select("run", "kappa"), "run", "left").join(wrong, "run", "left")
    return full.select("run", "n", div("_hit", "n").alias("accuracy"), div("_fit", "n").alias("tolerant"), "kappa", F.col("m.pair").alias("miss"), F.coalesce(-F.col("m.k"), F.lit(0)).alias("n_miss"))


def spot_check(records: DataFrame, n: int, seed: int) -> DataFrame:
    """n records(record, match, ...) that a title alone identified, drawn by a hash of seed and record: the
    same ones whatever the order and partitions. Fewer if there are fewer."""
    return records.where(F.col("match").startswith("title_exact")).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("record").cast("string"))), "record").limit(n)


def judged(records: DataFrame, judgements: DataFrame) -> DataFrame:
    """records with judgement, note and judged_by of judgements(record, judgement, note, judged_by); without
    an entry all are null. A judgement other than JUDGEMENTS is an error of the row: judgement is null then,
    and invalid is set."""
    met = records.join(judgements.withColumnRenamed("judgement", "_j"), "record", "left")
    fine = F.col("_j").isin(*JUDGEMENTS)
    return met.withColumn("judgement", F.when(fine, F.col("_j"))).withColumn("judged_by", F.when(fine, F.col("judged_by"))).withColumn("invalid", F.col("_j").isNotNull() & ~fine).drop("_j")


def chunk_coverage(items: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """by, n_items, n_named, n_found: items(..., doi) whose paper is named, and whose paper has chunks(doi):
    a folder of the wrong cache shows at once."""
    have = chunks.where("doi is not null").select("doi").distinct().withColumn("_f", F.lit(True))
    met = items.join(have, "doi", "left")
    named = F.coalesce(F.col("doi") != "", F.lit(False))
    return met.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(named).alias("n_named"), F.count_if(named & F.col("_f")).alias("n_found"))


def off_rows(rows: DataFrame) -> DataFrame:
    """section, row, kind of delivered rows that are no full reading of what was delivered: fidelity, if the
    source or the passage was not found, a quote was not found, or the sentence is not in the draft;
    location, if the passage's section is not the recorded one. A row can be both."""
    said = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    no = lambda c: said(c).isin("no", "n", "false", "0")
    yes = lambda c: said(c).isin("yes", "y", "true", "1")
    kinds = F.array(F.when(no("source_located") | no("passage_located") | no("sentence_in_draft") | (F.coalesce("unlocated_quotes", F.lit(0)) > 0), "fidelity"), F.when(yes("location_section_mismatch"), "location"))
    return rows.select("section", "row", F.explode(F.array_compact(kinds)).alias("kind"))


def reading_problems(claim, entry, cited_year, cited_authors) -> Column:
    """array of what is wrong with a reading: words (their number), years (not one year), citation (one year, but not one
    citation), entry (missing), year_gap (the citation's year is off by more than one), surname (its author
    is neither the entry's nor, where the entry cannot be read, named anywhere)."""
    from ..functions.text import col, let

    c, e = F.trim(F.coalesce(col(claim), F.lit(""))), F.coalesce(col(entry), F.lit(""))
    n = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    years = F.regexp_count(c, F.lit(r"(?<!\d)(?:19|20)\d{2}(?!\d)"))

    def of(u):
        one = F.size(u) == 1
        said = F.get(u, F.lit(0))
        gap = F.abs(said["year"].try_cast("int") - F.left(F.coalesce(col(cited_year).cast("string"), F.lit("")), F.lit(4)).try_cast("int"))
        hay = F.lower(F.concat_ws(" ", F.array(e), F.coalesce(col(cited_authors), F.array().cast("array<string>"))))
        known = F.coalesce(F.lower(F.element_at(F.split(entry_parts(e)["surname"], " "), -1)) == said["surname"], F.array_contains(F.regexp_extract_all(hay, F.lit(r"([\p{L}\p{N}’'-]+)"), F.lit(1)), said["surname"]))
        return F.array_compact(F.array(F.when(~n.between(LEAST_WORDS, MOST_WORDS), "words"), F.when(years != 1, "years").when(~one, "citation"), F.when(F.trim(e) == "", "entry"), F.when(one & (gap > 1), "year_gap"), F.when(one & ~known, "surname")))

    return let(units(F.regexp_replace(c, r"\s+", " ")), of)
