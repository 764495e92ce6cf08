"""The training-corpus pipeline: toxicity, near-duplicates, benchmark passages, encoding."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import shared_dir, table
from evigrid.llm.decontamination import decontaminate
from evigrid.llm.minhash import near_duplicates
from evigrid.llm.sentencepiece_codec import encode_documents
from evigrid.llm.toxicity import THRESHOLD, score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot express training, MinHash components and the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold, scored by a model of this stage's documents.

    Null and empty texts have no marks of toxicity and stay. Repeated rows stay, rows with a null doc_id
    too. Columns beside those of documents go.
    """
    docs = docs.select(*COLUMNS)
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score(docs, model, COLUMNS).where(F.col("score") < THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of every group of documents whose five-word shingles are alike by 0.8 or more.

    Of rows that repeat a doc_id one stays (the least by its columns). Documents without words are not
    alike and stay, and so do rows with a null doc_id. Columns beside those of documents go.
    """
    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id").distinct()
    stay = docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
    again = docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():  # ids alone tell; texts need not move
        return stay.select(*COLUMNS)
    one = stay.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return stay.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item.

    Null and empty texts stay. All rows of a doc_id go if one of them holds a window, and all rows with
    a null doc_id likewise. Columns beside those of documents go.
    """
    docs = docs.select(*COLUMNS)
    hit = decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["doc_id"]), "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the pieces' ids and their number, for every row; none for null and empty texts."""
    return encode_documents(docs, keep=("doc_id", "lang", "source")).select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_pieces"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
