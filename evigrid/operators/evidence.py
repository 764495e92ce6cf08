"""Evidence quotes: whole sentences of a paper's chunks, the named chunk first."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import unique_concepts
from ..functions.text import col, let, letters_digits
from .claims import computed

LEAST_WORDS = 8


def _parts(chunk: Column) -> Column:
    """The sentences and lines of a chunk, folded; those without a letter or digit left out."""
    parts = F.split(chunk, r"(?<=[.!?][\"'”’)\]]{0,2})\s+|\n+")
    return F.filter(F.transform(parts, lambda p: letters_digits(p)), lambda p: p != "")


def whole_sentences(quote, chunk) -> Column:
    """Whether the quote is a run of whole sentences of the chunk, letters and digits compared.

    The chunk is folded once: its parts stand between marks, and the quote is sought with a mark at each
    end in what is left when the marks within are passed over.
    """
    return F.coalesce(let(letters_digits(quote), lambda q: (F.length(q) > 0) & let(_parts(col(chunk)), lambda ps: _run_of(ps, q))), F.lit(False))


def _run_of(parts: Column, quote: Column) -> Column:
    """Whether parts in a row, joined, are the quote: those that go on from the runs begun before, and a
    run begun anew at each part, as places in the quote."""
    goes_on = lambda p, at: F.substr(quote, at + 1, F.length(p)) == p

    def step(acc, p):
        going = F.filter(F.concat(acc["at"], F.array(F.lit(0))), lambda at: goes_on(p, at))
        ends = F.transform(going, lambda at: at + F.length(p))
        whole = F.exists(ends, lambda e: e == F.length(quote))
        return F.struct(F.filter(ends, lambda e: e < F.length(quote)).alias("at"), (acc["hit"] | whole).alias("hit"))

    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(False).alias("hit"))
    return F.aggregate(parts, start, step, lambda acc: acc["hit"])


def located_items(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds found_index: of items(paper_id, item, quote, chunk_index) the chunk of chunks(paper_id, idx,
    text) that holds the quote as whole sentences, the named one first; null if the quote is short or
    nowhere. A chunk meets all its paper's quotes at once, so that it is read once, whatever their number."""
    long = items.where(F.size(F.split(F.trim("quote"), r"\s+")) >= LEAST_WORDS)
    asked = long.groupBy("paper_id").agg(F.collect_list(F.struct("item", "chunk_index", letters_digits("quote").alias("q"))).alias("asked"))
    found = let(_parts(F.col("text")), lambda ps: F.filter("asked", lambda x: (x["q"] != "") & _run_of(ps, x["q"])))
    both = computed(chunks.select("paper_id", "idx", "text").join(asked, "paper_id").select("paper_id", "idx", found.alias("x"))).select("paper_id", "idx", F.explode("x").alias("x")).select("paper_id", "idx", "x.*")
    best = both.groupBy("paper_id", "item").agg(F.min_by("idx", F.struct((F.col("idx") != F.coalesce("chunk_index", F.lit(-1))).alias("other"), "idx")).alias("found_index"))
    return items.join(best, ["paper_id", "item"], "left")


def accepted(located: DataFrame) -> DataFrame:
    """The rows to store, concepts in lower case and once each."""
    return located.where("found_index is not null").withColumn("concepts", unique_concepts("concepts"))


def acceptance(located: DataFrame, by: list[str]) -> DataFrame:
    return located.groupBy(*by).agg(F.count_if(F.col("found_index").isNotNull()).alias("accepted"), F.count_if(F.col("found_index").isNull()).alias("rejected"))
