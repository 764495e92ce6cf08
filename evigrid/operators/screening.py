"""Screening: gates, decision guards, flow counts and the review record."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, is_verbatim

#: Work types that are not primary reports.
SECONDARY_TYPES = ("editorial", "erratum", "letter", "paratext", "peer-review", "retraction", "supplementary-materials")
FLOW = ("duplicate", "excluded_gate", "excluded", "included", "needs_review", "unscreened")


def needs_review_reason(guard_reason, has_abstract) -> Column:
    return F.when(col(guard_reason).isNotNull(), col(guard_reason)).when(~col(has_abstract), "no_abstract").otherwise("undecidable")


def guarded(rows: DataFrame) -> DataFrame:
    """Adds status and guard_reason to proposed decisions.

    Needs decision (INCLUDE, EXCLUDE, NEEDS_REVIEW or null), criterion, known (array of criterion ids),
    quote, shown (text the screener saw), inclusion_full_text and exclusion_full_text (criteria that
    only a full text can settle), anchors (array of struct(slot, quote)) and slots (array). Guards move
    a decision to NEEDS_REVIEW only; the first that applies names the reason.
    """
    decision, criterion = F.col("decision"), F.col("criterion")
    anchored = lambda s: F.try_element_at(F.filter("anchors", lambda a: a["slot"] == s), F.lit(-1))["quote"]  # noqa: E731  # of repeated slots the last counts
    loose = F.exists("slots", lambda s: ~F.coalesce(is_verbatim(anchored(s), "shown", True), F.lit(False)))
    reason = (F.when(decision.isNull(), "missing_decision")
              .when(~decision.isin("INCLUDE", "EXCLUDE", "NEEDS_REVIEW"), "unknown_decision")
              .when(decision == "NEEDS_REVIEW", None)
              .when((decision == "EXCLUDE") & criterion.isNull(), "no_criterion")
              .when((decision == "EXCLUDE") & ~F.array_contains("known", criterion), "unknown_criterion")
              .when((decision == "EXCLUDE") & F.array_contains("exclusion_full_text", criterion), "full_text_criterion")
              .when((decision == "EXCLUDE") & ~is_verbatim("quote", "shown", True), "quote_not_verbatim")
              .when((decision == "INCLUDE") & loose, "unanchored_include"))
    out = rows.withColumn("guard_reason", reason)
    return out.withColumn("status", F.when(F.col("guard_reason").isNotNull(), "NEEDS_REVIEW").otherwise(decision))


def demote_type(status, work_type, is_paratext) -> Column:
    odd = F.coalesce(col(is_paratext), F.lit(False)) | F.coalesce(col(work_type).isin(*SECONDARY_TYPES), F.lit(False))
    return F.when((col(status) == "INCLUDE") & odd, "NEEDS_REVIEW").otherwise(col(status))


def is_contents_list(shown) -> Column:
    """A text with many page-numbered or chapter lines is a table of contents."""
    t = col(shown)
    return (F.regexp_count(t, F.lit(r"(?i)\b(chapter|part|section)\s+(\d+|[ivx]+)\b")) >= 3) | (F.regexp_count(t, F.lit(r"(\.{3,}|\s)\d{1,3}\s*(\n|$)")) >= 5)


def demote_contents(status, shown) -> Column:
    return F.when((col(status) == "INCLUDE") & is_contents_list(shown), "NEEDS_REVIEW").otherwise(col(status))


def second_pass(status, verdict, shown, quote) -> Column:
    """An include stands if the second pass confirms it with a quote that is there; else it needs review."""
    return F.when(col(status) != "INCLUDE", col(status)).when((col(verdict) == "CONFIRM") & is_verbatim(quote, shown, True), "INCLUDE").otherwise("NEEDS_REVIEW")


def gate_outcome(mode: str, indexed, issn) -> Column:
    """Reason a record fails the venue gate, or null: off lets all pass, auto those without an ISSN too."""
    if mode == "off":
        return F.lit(None).cast("string")
    missing = F.when(col(issn).isNull(), "no_issn" if mode == "on" else None)
    return F.when(col(issn).isNull(), missing).when(~F.coalesce(col(indexed), F.lit(False)), "not_indexed")


def flow(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of outcome in every state, and their sum, which is what was identified."""
    out = records.groupBy(*(by or [])).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in FLOW], F.count(F.lit(1)).alias("identified"))
    return out.withColumn("reconciles", F.col("identified") == sum((F.col(o) for o in FLOW[1:]), F.col(FLOW[0])))


def review_record(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of included, needs_review, excluded and unscreened records under their outcome's name."""
    out = None
    for outcome, df in parts.items():
        one = df.withColumn("outcome", F.lit(outcome))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def stop_reason(rounds: DataFrame, dry_limit: int = 2, most_rounds: int = 10, target: int = 500) -> DataFrame:
    """Adds stop: why the search ends after this round, the reasons in their order of priority.

    Needs round, total and dry (rounds since the last with something new).
    """
    return rounds.withColumn("stop", F.when(F.col("total") >= target, "target_reached").when(F.col("dry") >= dry_limit, "saturated").when(F.col("round") >= most_rounds, "round_limit"))


def verification_status(doi, found, warning) -> Column:
    return F.when(col(doi).isNull(), "no_doi").when(~F.coalesce(col(found), F.lit(False)), "fail").when(F.coalesce(col(warning), F.lit(False)), "warning").otherwise("pass")
