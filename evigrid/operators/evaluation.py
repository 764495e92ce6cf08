"""Evaluation tables: gate effect, label mappings, screening rows, hydration, full-text acquisition, compliance."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import div
from ..functions.text import col, title_key_ascii
from ..sources.tables import small


def gate_effect(records: DataFrame, venue_keys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, n_with_issn, n_listed, share, share_of_resolved of records(id, issns) whose any ISSN is among
    venue_keys(key). Records are exploded to keys, so the match is an equi-join."""
    by = by or []
    keys = small(venue_keys.select("key").distinct())
    hit = records.select("id", F.explode("issns").alias("key")).join(keys, "key", "left_semi").select("id").distinct().withColumn("_hit", F.lit(True))
    agg = records.join(hit, "id", "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("issns") > 0).alias("n_with_issn"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("n_listed"))
    return agg.withColumn("share", div("n_listed", "n")).withColumn("share_of_resolved", div("n_listed", "n_with_issn"))


def gold_label(labels: Column) -> Column:
    """CONTRADICT wins over SUPPORT; without either there is not enough information."""
    return F.when(F.array_contains(labels, "CONTRADICT"), "CONTRADICT").when(F.array_contains(labels, "SUPPORT"), "SUPPORT").otherwise("NOT_ENOUGH_INFO")


def mapped_status(status, mapping: str) -> Column:
    """A verifier's status as a gold label: strict takes verified alone as support, lenient needs_nuance
    too, three_way keeps needs_nuance apart."""
    s = col(status)
    support = s.isin("verified", "needs_nuance") if mapping == "lenient" else s == "verified"
    out = F.when(support, "SUPPORT")
    if mapping == "three_way":
        out = out.when(s == "needs_nuance", "PARTIAL")
    return out.when(s.isin("unsupported", "needs_nuance"), "NOT_SUPPORTED")


def padded_rows(batches: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Every record of a batch with its decision; a missing one is padded as NEEDS_REVIEW. Of repeated
    decisions the first by position counts."""
    first = decisions.groupBy("batch", key).agg(F.min_by(F.struct("decision", "criterion"), "pos").alias("d"))
    return batches.join(first, ["batch", key], "left").select(*batches.columns, F.coalesce("d.decision", F.lit("NEEDS_REVIEW")).alias("decision"), F.col("d.criterion").alias("criterion"), F.col("d").isNull().alias("padded"))


def retryable(rows: DataFrame) -> DataFrame:
    """Calls all of whose rows failed without an answer."""
    return rows.groupBy("call_id").agg(F.bool_and(F.col("error").isNotNull() & F.col("decision").isNull()).alias("all_failed"), F.count(F.lit(1)).alias("n")).where("all_failed").drop("all_failed")


def hydrate(records: DataFrame, works: DataFrame) -> DataFrame:
    """Adds work_id and route: by external id, DOI, then title key of fifteen characters or more. Each
    route is a join on its own key; the best route of a record wins, ties by least work id."""
    keys = lambda d: {"id": F.col("external_id"), "doi": F.lower(d["doi"]), "title": F.when(F.length(title_key_ascii("title")) >= 15, title_key_ascii("title"))}
    routes = None
    for rank, route in enumerate(("id", "doi", "title")):
        left = records.select("record_id", keys(records)[route].alias("k"))
        right = works.select(keys(works)[route].alias("k"), "work_id").where("k is not null").groupBy("k").agg(F.min("work_id").alias("work_id"))
        one = left.join(right, "k").select("record_id", "work_id", F.lit(rank).alias("rank"), F.lit(route).alias("route"))
        routes = one if routes is None else routes.unionAll(one)
    best = routes.groupBy("record_id").agg(F.min_by(F.struct("work_id", "route"), F.struct("rank", "work_id")).alias("b")).select("record_id", "b.*")
    return records.join(best, "record_id", "left")


def acquired(attempts: DataFrame) -> DataFrame:
    """paper_id, outcome, reason, url from ranked attempts (paper_id, rank, url, text, identity_ok,
    interstitial): the first good text; else wrong_work if any text was another's, else
    publisher_interstitial if all attempts met one."""
    good = F.col("text").isNotNull() & F.col("identity_ok")
    agg = attempts.groupBy("paper_id").agg(F.min_by("url", F.when(good, F.col("rank"))).alias("_u"), F.bool_or(good).alias("ok"), F.bool_or(F.col("text").isNotNull() & ~F.col("identity_ok")).alias("wrong"), F.bool_and("interstitial").alias("inter"))
    outcome = F.when(F.col("ok"), "acquired").otherwise("abstract_only")
    return agg.select("paper_id", outcome.alias("outcome"), F.when(F.col("ok"), None).when(F.col("wrong"), "wrong_work").when(F.col("inter"), "publisher_interstitial").alias("reason"), F.when(F.col("ok"), F.col("_u")).alias("url"))


def response_kind(status, content_type, head) -> Column:
    """What a fetch gave: retry, missing, pdf, interstitial (a page instead of a file) or other."""
    s = col(status)
    return F.when(s.isin(403, 429) | (s >= 500), "retry").when(s.isin(404, 410), "missing").when(col(head).startswith("%PDF-"), "pdf").when(F.contains(F.lower(col(content_type)), F.lit("html")) | F.lower(col(head)).rlike(r"^\s*<(!doctype|html)"), "interstitial").otherwise("other")


def compliance(drafts: DataFrame, low: int = 5000, high: int = 8000, a_low: int = 150, a_high: int = 300) -> DataFrame:
    """draft_id, check_type, status of drafts(draft_id, words, abstract_words, missing): word count,
    abstract length and required sections."""
    words = F.when(F.col("words").between(low, high), "pass").when((F.col("words") > high) | (F.col("words") >= low * 0.5), "warning").otherwise("fail")
    abstract = F.when(F.col("abstract_words") == 0, "fail").when(F.col("abstract_words").between(a_low, a_high), "pass").otherwise("warning")
    sections = F.when(F.size("missing") == 0, "pass").when(F.size("missing") > 2, "fail").otherwise("warning")
    checks = F.array(*[F.struct(F.lit(k).alias("check_type"), s.alias("status")) for k, s in (("word_count", words), ("abstract_length", abstract), ("sections_present", sections))])
    return drafts.select("draft_id", F.explode(checks).alias("c")).select("draft_id", "c.*")


def merged_standards(low: int, high: int, word_limit: int | None, abstract_limit: int | None) -> dict:
    """Limits of a paper type, a journal's own over them."""
    out = {"low": low, "high": high, "a_low": 150, "a_high": 300}
    if word_limit:
        out |= {"low": max(1000, word_limit - 1000), "high": word_limit}
    if abstract_limit:
        out |= {"a_low": max(50, abstract_limit - 50), "a_high": abstract_limit + 50}
    return out


def length_shares(records: DataFrame, text: str, limits: tuple = (500, 1000, 2000, 4000)) -> DataFrame:
    n = F.length(text)
    return records.agg(F.count(n).alias("n"), *[div(F.count_if(n <= k), F.count(n)).alias(f"within_{k}") for k in limits])


def verbatim_rate(accepted: Column, rejected: Column) -> Column:
    return div(accepted, accepted + rejected)


def majority_agreement(rows: DataFrame, item: str, reviewer: str, label: str) -> DataFrame:
    """item, n_reviewers, agreeing pairs, pairs: pairwise agreement from label counts, not from pairs."""
    c = rows.groupBy(item, label).agg(F.count(F.lit(1)).alias("k"))
    return c.groupBy(item).agg(F.sum("k").alias("n_reviewers"), F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("bigint").alias("agreeing"), (F.sum("k") * (F.sum("k") - 1) / 2).cast("bigint").alias("pairs"))
