"""Benchmark decontamination with a distributed positional inverted index.

The index holds, for each term that the tests name among their rarest, its places in the documents. A
window of an item has one list for its rarest term and one for its next rarest; taken less the terms'
places in the item, the lists of one window meet in the alignments of item and document that can hold
a match. Only those are checked word by word, from the text. All of it is DataFrame code.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SQL, ascii_lower, stored

WINDOW = 10
#: Tables of tests up to so many bytes of terms and texts are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20
BUCKETS = 1 << 16


def words_of(col):
    """The text's words in order; none for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(col), F.lit(ALNUM_SQL), F.lit(0)), F.array().cast("array<string>"))


def _small(df: DataFrame) -> DataFrame:
    """df, which is stored, with a broadcast hint if its measured size is small."""
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c, t in df.dtypes if not t.startswith("array")), F.lit(16))
    for c, t in df.dtypes:
        if t == "array<string>":
            width = width + F.coalesce(F.aggregate(c, F.lit(0), lambda n, w: n + F.length(w) + 16), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).collect()[0][0] or 0) <= BROADCAST_BYTES else df


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, th, pos for every place of one of terms(term, ...) in docs; further columns of terms follow.

    th is the text's hash. A null text has no places, a null doc_id stays null, repeated rows give their
    places each, and empty tables give none. Other columns of docs are not looked at.
    """
    spread = _keyed(docs).select("doc_id", "th", F.posexplode(words_of("text")).alias("pos", "term"))
    return spread.join(_small(terms), "term")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: places of each of terms(term) in the corpus, repeated rows counted each; none for a term that stands nowhere."""
    spread = docs.select(F.explode(words_of("text")).alias("term"))
    return spread.join(_small(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def ranked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item (a key), item_id, words, and ranked: for each place its corpus count, place and term."""
    clean = items.select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("words")).where(F.size("words") > 0).distinct().withColumn("item", F.xxhash64("item_id", "words"))
    clean = stored(clean, "items")
    places = clean.select("item", F.posexplode("words").alias("pos", "term"))
    counts = stored(term_counts(docs, stored(places.select("term").distinct(), "terms")), "term-counts")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("pos"), F.col("term"))
    ranked = places.join(counts, "term", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("pos", rank.alias("r")))).alias("ranked"))
    return clean.join(ranked.select("item", F.col("ranked.r").alias("ranked")), "item")


def anchors(ranked: DataFrame, window: int = WINDOW) -> DataFrame:
    """term, item, off: the two rarest places of every window whose terms all stand in the corpus, one if
    it has one word, and with each the places that it has to meet: `with_offs`, itself for a lone word."""
    w = F.least(F.size("ranked"), F.lit(window))
    two = F.transform(F.sequence(F.lit(1), F.size("ranked") - w + 1), lambda s: F.slice(F.array_sort(F.slice("ranked", s, w)), 1, 2))
    pairs = ranked.select("item", F.explode(F.array_distinct(F.filter(two, lambda rs: rs[0]["n"] > 0))).alias("rs"))
    both = pairs.select("item", F.explode(F.array_distinct(F.array(F.struct(F.element_at("rs", 1).alias("r"), F.element_at("rs", -1)["pos"].alias("other")), F.struct(F.element_at("rs", -1).alias("r"), F.element_at("rs", 1)["pos"].alias("other"))))).alias("x"))
    return both.groupBy(F.col("x.r.term").alias("term"), "item", F.col("x.r.pos").alias("off")).agg(F.collect_set("x.other").alias("with_offs"))


def alignments(docs: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, th, item, shift: where the lists of a window's two rarest terms meet. The index is stored."""
    index = postings(docs, stored(named.select("term").distinct(), "index-terms")).groupBy("doc_id", "th", "term").agg(F.collect_list("pos").alias("places"))
    index = stored(index, "postings")
    places = index.join(_small(named), "term").select("doc_id", "th", "item", "off", "with_offs", F.explode("places").alias("pos"))
    shifted = places.groupBy("doc_id", "th", "item", (F.col("pos") - F.col("off")).alias("shift")).agg(F.collect_set("off").alias("offs"), F.flatten(F.collect_set("with_offs")).alias("needed"))
    return shifted.where(F.arrays_overlap("offs", "needed")).select("doc_id", "th", "item", "shift")


def _runs(words, aligned):
    """Maximal runs of at least w equal words of a document and an item laid over it at shift."""
    shift, item = aligned["shift"], aligned["words"]
    lo, skip = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))
    w = F.least(F.size(item), F.lit(WINDOW))
    n = F.least(F.size(words) - lo, F.size(item) - skip)
    same = F.zip_with(F.slice(words, lo + 1, n), F.slice(item, skip + 1, n), lambda a, b: a == b)
    none = F.array().cast("array<struct<start:int,len:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), none.alias("out"))
    ended = lambda acc: F.when(acc["run"] >= w, F.concat(acc["out"], F.array(F.struct((lo + acc["i"] - acc["run"]).cast("int").alias("start"), acc["run"].alias("len"))))).otherwise(acc["out"])
    step = lambda acc, e: F.struct((acc["i"] + 1).alias("i"), F.when(e, acc["run"] + 1).otherwise(0).alias("run"), F.when(e, acc["out"]).otherwise(ended(acc)).alias("out"))
    return F.aggregate(same, start, step, ended)


def _covered(spans):
    """Words inside the union of spans that are sorted by start."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(acc["end"], s["start"]))).alias("n"), F.greatest(acc["end"], s["start"] + s["len"]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"].cast("bigint"))


def phrase_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), spans and items (ids) of the documents that hold a window of an item.

    Spans are (start, len) in words, sorted, and may overlap. Documents that hold none have no row; equal
    rows give one, rows of a doc_id with other texts one each. Null texts and items without words hold and
    are nothing; a null item_id has spans but is no item. Very long texts are taken whole.
    """
    ranked = stored(ranked_items(docs, items), "ranked")
    laid = alignments(docs, stored(anchors(ranked), "anchors")).join(_small(ranked.select("item", "item_id", "words")), "item")
    cand = stored(laid.groupBy("doc_id", "th").agg(F.collect_list(F.struct("shift", "item_id", "words")).alias("laid")), "alignments")
    spot = F.pmod(F.xxhash64("doc_id", "th"), F.lit(BUCKETS)).alias("spot")
    near = F.broadcast(cand.select(spot).distinct())  # at most BUCKETS rows; it only thins the scan
    # words are made below the join, so that no step above it makes them anew
    thin = _keyed(docs).withColumn("spot", spot).join(near, "spot", "left_semi").select(F.col("doc_id").alias("d"), F.col("th").alias("t"), words_of("text").alias("doc_words"))
    met = thin.join(cand, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")))
    runs = F.transform("laid", lambda a: F.struct(a["item_id"].alias("item_id"), _runs(F.col("doc_words"), a).alias("runs")))
    hit = stored(met.select("doc_id", "th", F.filter(runs, lambda r: F.size(r["runs"]) > 0).alias("hit")), "hits").where(F.size("hit") > 0).dropDuplicates(["doc_id", "th"])
    return hit.select("doc_id", "th", F.array_sort(F.flatten(F.col("hit.runs"))).alias("spans"), F.array_sort(F.array_distinct(F.filter(F.col("hit.item_id"), lambda x: x.isNotNull()))).alias("items"))


def proximity_hits(docs: DataFrame, phrases: DataFrame, slop: int = 4) -> DataFrame:
    """doc_id, item_id, pos: places of an item's rarest word with all its other words near, in any
    order, within the item's length plus slop words to either side.

    Of equally rare words the earlier counts. Null texts and items without words match nothing, repeated
    rows give their places each, and empty tables give none.
    """
    ranked = stored(ranked_items(docs, phrases), "ranked")
    rare = ranked.select("item", "item_id", "words", F.array_min("ranked").alias("r")).where("r.n > 0").select(F.col("r.term").alias("term"), "item_id", F.array_distinct("words").alias("need"), (F.size("words") + slop).alias("reach"))
    spread = _keyed(docs).select("doc_id", "th", words_of("text").alias("w"))
    found = postings(docs, stored(rare, "rare")).groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "item_id", "need", "reach")).alias("at"))
    met = spread.withColumnsRenamed({"doc_id": "d", "th": "t"}).join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")))
    whole = lambda a: F.size(F.array_except(a["need"], F.slice("w", F.greatest(F.lit(1), a["pos"] + 1 - a["reach"]), 2 * a["reach"] + 1))) == 0
    return met.select("doc_id", F.explode(F.filter("at", whole)).alias("a")).select("doc_id", "a.item_id", "a.pos")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    A null text has no words. An item without words has no window; a null item_id hits but is not
    counted as an item, and repeated items count once. Rows that repeat a doc_id are judged each by
    its own text. Empty tables hit nothing. Other columns are not looked at.
    """
    hits = phrase_hits(docs, items).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), _covered(F.col("spans")).alias("hit"), "items")
    base = _keyed(docs).select("doc_id", "th", F.coalesce(F.regexp_count(ascii_lower("text"), F.lit(ALNUM_SQL)), F.lit(0)).cast("bigint").alias("n_words"))
    out = base.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("bigint"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
