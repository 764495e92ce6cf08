"""The registered queries of this folder: each applies its operator to its whole tables."""
from .chat import digests, message_events, render
from .common import table
from .decontamination import decontaminate
from .importance_resampling import resample
from .license_scan import scan_licenses
from .lm_scoring import score_documents
from .minhash import near_duplicates
from .periodic_runs import periodic_runs
from .quality_rules import SQL as QUALITY_SQL
from .quality_rules import quality
from .sentencepiece_codec import codec_report
from .sharding import reshard
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .vector_dedup import near_vectors


def op1_lm_scoring(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark, sf_dir):
    return codec_report(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_resharding(spark, sf_dir):
    return reshard(table(spark, sf_dir, "documents"))


def op7_vector_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark, sf_dir):
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(render(message_events(rows)))


def op10_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, part=85, whole=100)


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs(table(spark, sf_dir, "documents"), tails=True)


def op12_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_decontamination, op3_toxicity, op4_sentencepiece, op5_license_scan, op6_resharding, op7_vector_dedup, op8_token_counts, op9_chat_formatting, op10_minhash_dedup,
                                   op11_periodic_runs, op12_quality_rules, op13_importance_resampling)}
ORACLE: dict[str, str] = {"op12_quality_rules": QUALITY_SQL}
__all__ = ["ORACLE", "QUERIES"]
