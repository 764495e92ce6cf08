"""Reviewer sheets, run summaries and job prerequisites."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import div
from ..functions.text import col


def by_alteration(rows: DataFrame) -> DataFrame:
    """operator, n, n_correct, accuracy; the operator stands before the colon of alteration."""
    op = F.substring_index("alteration", ":", 1)
    agg = rows.where("alteration is not null").groupBy(op.alias("operator")).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))
    return agg.withColumn("accuracy", div("n_correct", "n"))


def marked_correct(expected, status) -> Column:
    return F.array_contains(col(expected), col(status))


def verified_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows verified with a yes, and sentences all of whose rows are, by section."""
    ok = (F.col("status") == "verified") & (F.col("answer") == "yes")
    sentence = rows.groupBy(*by, "sentence").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("all_ok"), F.count(F.lit(1)).alias("k"), F.count_if(ok).alias("good"))
    agg = sentence.groupBy(*by).agg(F.sum("k").alias("n_rows"), F.sum("good").alias("n_ok"), F.count(F.lit(1)).alias("n_sentences"), F.count_if("all_ok").alias("n_sentences_ok"))
    return agg.withColumn("rate", div("n_ok", "n_rows")).withColumn("sentence_rate", div("n_sentences_ok", "n_sentences"))


def total_cost(rows: DataFrame, cost: str, answered: str, by: list[str]) -> DataFrame:
    """Sum over answered rows, null if any of their costs is unknown."""
    need = rows.where(F.col(answered))
    return need.groupBy(*by).agg(F.when(~F.bool_or(F.col(cost).isNull()), F.sum(cost)).alias("total_cost"), F.count(F.lit(1)).alias("calls"))


def false_negatives(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Included by people, excluded by the run, with what the other run decided."""
    missed = rows.where("label = 1 and predicted = 0")
    return missed.join(other.select(key, F.col("predicted").alias("other_predicted")), key, "left")


def quote_fidelity(rows: DataFrame) -> DataFrame:
    """Of verified rows: how many carry a quote, how many of those verbatim."""
    v = rows.where("status = 'verified'")
    agg = v.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quote").isNotNull()).alias("quoted"), F.count_if(F.coalesce("verbatim", F.lit(False))).alias("n_verbatim"))
    return agg.withColumn("share_quoted", div("quoted", "n")).withColumn("share_verbatim", div("n_verbatim", "quoted"))


def blanks(rows: DataFrame, key: str, required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """key, column, problem for cells that are empty or hold a value outside the allowed ones."""
    checks = []
    for c in required:
        v = F.trim(F.col(c).cast("string"))
        problem = F.when(v.isNull() | (v == ""), "blank")
        if c in allowed:
            problem = problem.when(~v.isin(*allowed[c]), "not allowed")
        checks.append(F.struct(F.lit(c).alias("column"), problem.alias("problem")))
    return rows.select(key, F.explode(F.filter(F.array(*checks), lambda x: x["problem"].isNotNull())).alias("p")).select(key, "p.*")


def key_mismatches(rows: DataFrame, key_table: DataFrame, key: str) -> DataFrame:
    """Keys that only one of the two tables has."""
    a, b = rows.select(key).distinct().withColumn("_a", F.lit(True)), key_table.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full").where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "missing").otherwise("unknown").alias("problem"))


def confirmed_pair(sessions: DataFrame, by: str) -> DataFrame:
    """Newest completed session of each coder type; ready only if both types have one."""
    done = sessions.where("status = 'completed'").groupBy(by, "coder").agg(F.max_by("session_id", F.struct("created_at", "session_id")).alias("s"))
    pick = lambda k: F.max(F.when(F.col("coder") == k, F.col("s"))).alias(f"{k}_session")
    both = done.groupBy(by).agg(pick("ai"), pick("human"))
    return both.withColumn("ready", F.col("ai_session").isNotNull() & F.col("human_session").isNotNull())


def gap_inputs(papers: DataFrame, by: str, cites: str, least: int = 5, most: int = 150) -> DataFrame:
    """The most cited papers of each project, at most `most`; projects with fewer than `least` are left out."""
    from .graph import top_relations

    enough = papers.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(by)
    return top_relations(papers.join(enough, by, "left_semi"), by, cites, "paper_id", most)


def cost_bound(batches: DataFrame, in_price: float, out_price: float, cap: int, overhead: int = 900, answer: int = 120) -> DataFrame:
    """Upper bound of a run's cost: four characters a token, abstracts cut at cap."""
    agg = batches.groupBy("batch").agg((F.sum(F.ceil(F.least(F.col("chars"), F.lit(cap)) / 4.0)) + overhead).alias("i"), (F.count(F.lit(1)) * answer).alias("o"))
    return agg.agg(F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens")).withColumn("cost", (F.col("input_tokens") * in_price + F.col("output_tokens") * out_price) / 1e6)


def frame_class(residue) -> Column:
    """What an uncovered run of words in a claim's sentence is: bare framing (f1), a lead-in before a colon
    (f2), an opener before a comma (f3), or none of these when it holds a number or a quantifier."""
    r = F.trim(col(residue))
    strong = r.rlike(r"\d") | F.lower(r).rlike(r"\b(all|most|many|few|several|majority|half|none|every|never|always)\b")
    content = F.size(F.filter(F.regexp_extract_all(F.lower(r), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin("this", "that", "these", "those", "with", "from", "their", "which", "also")))
    return F.when((content == 0) & ~strong, "f1").when(strong, None).when(r.rlike(r":$"), "f2").when(F.lower(r).rlike(r"^(in|on|for|across|among|within|during|by|moreover|however|similarly|overall)\b.*,$"), "f3").when(content <= 2, "f1")


#: Own rules, not the only ones that fit: they sort a reviewer's reason, tried in this order.
REASON_RULES = (("population", r"(?i)\b(population|participants?|patients?|adults?|children|students?)\b"), ("outcome", r"(?i)\b(outcome|measure[sd]?|endpoint)\b"), ("design", r"(?i)\b(design|trial|cohort|review|protocol|study type)\b"), ("topic", r"(?i)\b(topic|scope|off-topic|unrelated)\b"))


def reason_class(c) -> Column:
    out = F.when(col(c).isNull(), "none")
    for name, pattern in REASON_RULES:
        out = out.when(col(c).rlike(pattern), name)
    return out.otherwise("other")


def text_violations(drafts: DataFrame, key: str, text: str) -> DataFrame:
    """key, paragraph, rule: paragraphs of a delivered draft that end mid-sentence, carry no citation,
    open with a reporting verb, or are a heading standing in the body."""
    from .chunks import paragraphs
    from .claims import citations

    p = drafts.select(key, F.posexplode(paragraphs(text)).alias("paragraph", "p")).where(~F.col("p").rlike(r"^#"))
    rules = {
        "truncated": ~F.col("p").rlike(r"[.!?:][\"'”’)\]]*$"),
        "no_citation": F.size(citations("p")) == 0,
        "reporting_opening": F.lower("p").rlike(r"^(found|reported|showed|argued|noted|suggested|observed)\b"),
        "heading_in_body": (F.length("p") < 60) & ~F.col("p").rlike(r"[.!?]") & (F.size(F.split("p", r"\s+")) <= 6),
    }
    hits = F.array(*[F.when(ok, F.lit(name)) for name, ok in rules.items()])
    return p.select(key, "paragraph", F.explode(F.array_compact(hits)).alias("rule"))
