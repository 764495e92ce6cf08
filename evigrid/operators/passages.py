"""Passages, spans and links between claims, entries and quotes."""
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, collapse_blanks, compat_fold, jaccard, let, sentences, tokens, word_set
from .claims import quote_index

#: Words that stand for numbers.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
                "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "dozen": 12}
#: Words that a title echo is not judged by, and endings that are taken off.
ECHO_STOP = "a an the of in on with for and or to at by from into onto as is are was were be been this that these those their its it".split()
ECHO_ENDINGS = ("ing", "ed", "es", "s")
LEAST_MATCH, MOST_PASSAGE = 0.05, 600


def source_text(c) -> Column:
    """A source's own wording without the marks of its layout: compatibility forms, soft hyphens and
    line-end hyphens gone, blanks collapsed."""
    s = F.replace(compat_fold(c), F.lit("­"), F.lit(""))
    return collapse_blanks(F.regexp_replace(s, r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", "$1$2"))


def _fold_frame(texts: pd.Series) -> pd.DataFrame:
    import unicodedata

    seen: dict = {}

    def fold(ch):
        if ch not in seen:
            seen[ch] = "".join(x for x in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", ch)) if x.isalpha() or x.isdigit()).casefold()
        return seen[ch]

    parts = [[(k, i) for i, ch in enumerate(t or "") for k in fold(ch)] for t in texts]
    return pd.DataFrame({"folded": ["".join(k for k, _ in p) for p in parts], "offsets": [[i for _, i in p] for p in parts]})


def folded_with_offsets(c) -> Column:
    """struct<folded, offsets>: letters and digits without accents and case, and the place of each in the
    text. Spark has no builtin for the accents, so this is one Arrow function."""
    return F.pandas_udf(_fold_frame, "folded string, offsets array<int>")(col(c))


def located_span(text, quote) -> Column:
    """The text's own characters from the first to the last of a quote found in it, or null."""
    t, q = folded_with_offsets(text), folded_with_offsets(quote)
    at = F.position(q["folded"], t["folded"])
    first, last = F.get(t["offsets"], at - 1), F.get(t["offsets"], at + F.length(q["folded"]) - 2)
    return F.when((F.length(q["folded"]) > 0) & (at > 0), F.substr(col(text), first + 1, last - first + 1))


def token_spans(c) -> Column:
    """array<struct<token, start, stop>> of runs of ASCII letters and digits, lower case."""
    t = F.coalesce(col(c), F.lit(""))
    words = F.regexp_extract_all(t, F.lit("[0-9A-Za-z]+"), F.lit(0))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<token:string,start:int,stop:int>>").alias("out"))

    def step(acc, w):
        at = F.position(w, t, acc["next"])
        return F.struct((at + F.length(w)).alias("next"), F.concat(acc["out"], F.array(F.struct(F.lower(w).alias("token"), (at - 1).alias("start"), (at - 1 + F.length(w)).alias("stop")))).alias("out"))

    return F.aggregate(words, start, step, lambda acc: acc["out"])


def covered_places(sentence, spans, once: bool = False) -> Column:
    """Places (from 0) of the sentence's words inside any span's words in a row: at every occurrence, or
    at one for each span, the leftmost that is still free."""
    needles = F.filter(F.transform(col(spans), lambda s: F.transform(token_spans(s), lambda x: x["token"])), lambda n: F.size(n) > 0)
    starts = lambda words, n: F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - F.size(n), F.lit(0))), lambda i: (F.size(n) <= F.size(words)) & (F.slice(words, i + 1, F.size(n)) == n))
    run = lambda i, n: F.sequence(i, i + F.size(n) - 1)

    def take(words, acc, n):
        free = F.filter(starts(words, n), lambda i: ~F.arrays_overlap(acc, run(i, n)))
        return let(free, lambda f: F.when(F.size(f) > 0, F.concat(acc, run(F.get(f, F.lit(0)), n))).otherwise(acc))

    def places(words):
        if once:
            return F.aggregate(needles, F.array().cast("array<int>"), lambda acc, n: take(words, acc, n))
        return F.array_distinct(F.flatten(F.flatten(F.transform(needles, lambda n: F.transform(starts(words, n), lambda i: run(i, n))))))

    return F.array_sort(let(F.transform(token_spans(sentence), lambda x: x["token"]), places))


def residue(sentence, spans) -> Column:
    """The sentence's words outside all spans, in order."""
    words = F.transform(token_spans(sentence), lambda x: x["token"])
    return let(covered_places(sentence, spans), lambda at: F.filter(F.transform(words, lambda w, i: F.when(~F.array_contains(at, i), w)), lambda w: w.isNotNull()))


def numeral_keys(c) -> Column:
    """Distinct numbers of a text, in figures or in words, each in one form."""
    t = F.coalesce(col(c), F.lit(""))
    value = F.transform(F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    word = F.create_map(*[x for k, v in NUMBER_WORDS.items() for x in (F.lit(k), F.lit(float(v)))])
    said = F.filter(F.transform(F.regexp_extract_all(F.lower(t), F.lit("[0-9a-z]+"), F.lit(0)), lambda w: word[w]), lambda v: v.isNotNull())
    key = lambda v: F.when(v == F.floor(v), F.floor(v).cast("bigint").cast("string")).otherwise(v.cast("string"))
    return F.array_sort(F.array_distinct(F.transform(F.concat(value, said), key)))


def echo_words(c) -> Column:
    """Distinct words of a title for comparison: no function words, one ending off if three letters stay."""
    def stem(w):
        out = F.when(F.lit(False), w)
        for e in ECHO_ENDINGS:
            out = out.when(w.endswith(e) & (F.length(w) - len(e) >= 3), F.left(w, F.length(w) - len(e)))
        return out.otherwise(w)

    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[0-9A-Za-zÀ-ɏ]+"), F.lit(0)), lambda w: ~F.array_contains(word_set(ECHO_STOP), w))
    return F.array_distinct(F.transform(words, stem))


def best_passage(claim, text) -> Column:
    """struct<score, passage>: of all runs of one to three sentences the one most like the claim by token
    Jaccard; the shorter and then the earlier wins. Below LEAST_MATCH passage is null."""
    runs = let(sentences(text), lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda i: i + k - 1 <= F.size(s)), lambda i: F.struct((-k).alias("k"), (-i).alias("i"), F.array_join(F.slice(s, i, k), " ").alias("text"))))))
    best = F.array_max(let(tokens(claim), lambda said: F.transform(runs, lambda r: F.struct(jaccard(said, tokens(r["text"])).alias("score"), r["k"].alias("k"), r["i"].alias("i"), r["text"].alias("text")))))
    cut = F.when(F.length(best["text"]) <= MOST_PASSAGE, best["text"]).otherwise(F.concat(F.rtrim(F.regexp_replace(F.left(best["text"], F.lit(MOST_PASSAGE)), r" [^ ]*$", "")), F.lit(" ...")))
    return F.struct(F.coalesce(best["score"], F.lit(0.0)).alias("score"), F.when(best["score"] >= LEAST_MATCH, cut).alias("passage"))


def evidence_first(chunks, quotes) -> Column:
    """Places (from 0) of the chunks: those that hold a quote, in the order of the quotes, then the others."""
    held = F.array_distinct(F.filter(F.transform(col(quotes), lambda q: quote_index(q, chunks).cast("int")), lambda i: i.isNotNull()))
    every = F.filter(F.sequence(F.lit(0), F.greatest(F.size(col(chunks)) - 1, F.lit(0))), lambda i: i < F.size(col(chunks)))
    return F.concat(held, F.array_except(every, held))


def quotes_of_claims(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """sentence, key, quotes: quotes that the evidence ids of links(link, sentence, keys, evidence_ids)
    name in catalog(id, quote), in the links' order; ids without a quote are passed over."""
    ids = links.select("link", "sentence", "keys", F.posexplode("evidence_ids").alias("at", "id"))
    named = ids.join(catalog.where("quote is not null and quote <> ''").dropDuplicates(["id"]), "id")
    spread = named.select("sentence", F.explode("keys").alias("key"), F.struct("link", "at", "quote").alias("q"))
    return spread.groupBy("sentence", "key").agg(F.transform(F.array_sort(F.collect_list("q")), lambda q: q["quote"]).alias("quotes"))


def matched_entries(cites: DataFrame, entries: DataFrame) -> DataFrame:
    """cite, entry: the one entry of the same surname and year. Of several none is taken; a citation's
    second surname must stand in the entry's text. cites(cite, surname, surname2, year), entries(entry,
    surname, year, raw), surnames folded. Entries are counted before they meet a citation, which then meets
    one entry at most."""
    y = F.left("year", F.lit(4)).alias("y")
    one = entries.groupBy("surname", y).agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("entry"), F.min("raw").alias("raw")).where("n = 1")
    met = cites.select("cite", "surname", "surname2", y).join(one, ["surname", "y"])
    return met.where(F.col("surname2").isNull() | F.contains(F.lower("raw"), F.col("surname2"))).select("cite", "entry")


def split_by_group(items: DataFrame, group: str, order: str, n_test: int, n_dev: int, most: int) -> DataFrame:
    """Adds split to the items of groups taken in order, at most `most` of each by item: test until n_test
    are reached, then dev until n_dev. Only the first n_test + n_dev groups can be needed."""
    sizes = items.groupBy(group).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("k"), F.min(order).alias("o"))
    first = sizes.orderBy("o", group).limit(n_test + n_dev)
    before = F.coalesce(F.sum("k").over(Window.orderBy("o", group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = first.withColumn("b", before)
    test = cut.withColumn("split", F.when(F.col("b") < n_test, "test"))
    rest = F.coalesce(F.sum(F.when(F.col("split").isNull(), F.col("k"))).over(Window.orderBy("o", group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = test.withColumn("d", rest).withColumn("split", F.coalesce("split", F.when(F.col("d") < n_dev, "dev"))).where("split is not null").select(group, "split")
    numbered = items.join(F.broadcast(named), group).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return numbered.where(F.col("_n") <= most).drop("_n")


def shared_sentences(items: DataFrame, others: DataFrame, text: str = "sentence") -> DataFrame:
    """source, n_shared: distinct sentences, blanks collapsed, that items and each source have in common."""
    mine = items.select(collapse_blanks(text).alias("s")).distinct()
    theirs = others.select("source", collapse_blanks(text).alias("s")).distinct()
    hits = theirs.join(mine, "s", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n_shared"))
    return others.select("source").distinct().join(hits, "source", "left").select("source", F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"))


def unclassified(sentence_rows: DataFrame, links: DataFrame, uncited: DataFrame, key: str) -> DataFrame:
    """Sentences that neither a link nor the list of uncited ones names, blanks collapsed."""
    known = links.select(key, collapse_blanks("sentence").alias("_s")).unionAll(uncited.select(key, collapse_blanks("sentence"))).distinct()
    return sentence_rows.withColumn("_s", collapse_blanks("sentence")).join(known, [key, "_s"], "left_anti").drop("_s")


def byline_surnames(c, prefix: int = 3000, most: int = 60) -> Column:
    """Family names of a full text's byline: what stands before the abstract or the first numbered
    affiliation is cut at commas and "and"; short parts with two capitalised words are names."""
    head = F.element_at(F.split(F.left(F.coalesce(col(c), F.lit("")), F.lit(prefix)), r"(?i)\babstract\b|\n\s*\d{1,2}\s*[A-ZÀ-Þ]"), 1)
    parts = F.filter(F.transform(F.split(head, r",|\band\b"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: F.length(p).between(1, most))
    names = F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"[A-ZÀ-Þ][\p{L}\p{N}_’'-]*"), F.lit(0)))
    return F.filter(F.transform(F.filter(names, lambda n: F.size(n) > 1), lambda n: F.regexp_replace(F.element_at(n, -1), r"\d+$", "")), lambda n: n != "")


def byline_accepted(parsed, authors) -> Column:
    """Whether the parsed names begin with exactly the recorded authors' family names, each once, in any order."""
    mine = F.transform(col(parsed), lambda x: F.lower(x))
    last = lambda a: F.lower(F.element_at(F.split(F.trim(F.substring_index(F.trim(a), ",", 1)), r"\s+"), -1))
    theirs = F.array_distinct(F.transform(F.filter(col(authors), lambda a: F.length(F.trim(a)) > 0), last))
    places = let(theirs, lambda names: F.filter(F.transform(mine, lambda x, i: F.when(F.array_contains(names, x), i)), lambda i: i.isNotNull()))
    run = F.sequence(F.lit(0), F.greatest(F.size(theirs) - 1, F.lit(0)))
    return (F.size(mine) > 0) & (F.size(theirs) > 0) & (places == run) & (F.size(F.array_except(theirs, mine)) == 0)


def result_links(html, most: int = 3) -> Column:
    """Addresses of the results on a search page: marked links first, else redirects' targets."""
    h = F.coalesce(col(html), F.lit(""))
    web = lambda a: F.filter(a, lambda u: u.startswith("http"))
    marked = web(F.regexp_extract_all(h, F.lit(r'<a[^>]+class="result__a"[^>]+href="([^"]+)"'), F.lit(1)))
    wide = F.regexp_extract_all(h, F.lit(r'<a[^>]+href="(https?://[^"]+)"[^>]*class="[^"]*result[^"]*"'), F.lit(1))
    turned = web(F.transform(F.regexp_extract_all(h, F.lit(r"""uddg=([^&"']+)"""), F.lit(1)), lambda u: F.url_decode(u)))
    return F.slice(F.when(F.size(marked) > 0, marked).when(F.size(wide) > 0, wide).otherwise(turned), 1, most)


#: Words of which author guidelines hold two.
GUIDELINE_WORDS = ("author", "manuscript", "submission", "word limit", "references")


def looks_like_guidelines(c) -> Column:
    t = F.lower(F.coalesce(col(c), F.lit("")))
    return sum((F.contains(t, F.lit(w)).cast("int") for w in GUIDELINE_WORDS), F.lit(0)) >= 2


#: Words that a quote may have more or less than its source, how long a quote is looked
#: for, and how long a citation that it leaves out may be.
ARTICLES = ("a", "an", "the")
LEAST_TOKENS, MOST_CITATION = 8, 12


def _without_citations(c) -> Column:
    """The text with its bracketed citations blanked, so that all places stay what they were."""
    groups = F.regexp_extract_all(c, F.lit(r"(?:\([^()]*\b(?:\d{4}[a-z]?|n\.d\.)[^()]*\)|\[\d[\d,;–\s-]*\])"), F.lit(0))
    short = F.filter(groups, lambda g: F.size(F.split(F.trim(g), r"\s+")) <= MOST_CITATION)
    return F.aggregate(short, c, lambda t, g: F.replace(t, g, F.repeat(F.lit(" "), F.length(g))))


def relocated(segment, chunks) -> Column:
    """struct<chunk, text>: the source's own words for a segment that differs from a run of them by
    articles, or leaves out their bracketed citations; null for any other difference, and for segments
    of fewer than LEAST_TOKENS words. The first chunk that has it counts."""
    bare = lambda spans: F.filter(spans, lambda s: ~s["token"].isin(*ARTICLES))
    line = lambda spans: F.concat(F.lit(" "), F.array_join(F.transform(spans, lambda s: s["token"]), " "), F.lit(" "))

    def found(wanted, chunk, text):
        def slice_of(spans):
            at = F.position(line(wanted), line(spans))
            first = F.size(F.split(F.left(line(spans), at), " ")) - 1  # words before the run
            begin, hi = F.get(spans, first - 1)["start"], F.get(spans, first + F.size(wanted) - 2)["stop"]
            lo = begin - F.when(leads, F.length(F.regexp_extract(F.left(chunk, begin), r"(?i)\b((?:an?|the)\s+)$", 1))).otherwise(0)
            return F.when(at > 0, F.substr(chunk, lo + 1, hi - lo))

        return let(bare(token_spans(text)), slice_of)

    def sought(wanted):
        each = F.transform(col(chunks), lambda c, i: F.struct(i.alias("chunk"), F.coalesce(found(wanted, c, c), found(wanted, c, _without_citations(c))).alias("text")))
        return F.get(F.filter(each, lambda x: x["text"].isNotNull()), F.lit(0))

    enough = F.size(token_spans(segment)) >= LEAST_TOKENS
    leads = F.lower(F.trim(col(segment))).rlike(r"^\W*(an?|the)\b")
    return F.when(enough, let(bare(token_spans(segment)), sought))


#: Verbs that report, all their forms; words that rank, and nouns of the literature that they rank.
REPORTING = ("add adds added note notes noted report reports reported find finds found show shows showed shown document documents documented examine examines examined demonstrate demonstrates demonstrated observe observes observed argue argues argued "
             "conclude concludes concluded state states stated describe describes described write writes wrote caution cautions cautioned cautioning warn warns warned warning propose proposes proposed proposing contend contends contended contending "
             "maintain maintains maintained maintaining emphasise emphasises emphasised emphasising emphasize emphasizes emphasized emphasizing stress stresses stressed stressing acknowledge acknowledges acknowledged acknowledging concede concedes conceded conceding").split()
RANKING = "strongest clearest best weakest definitive conclusive foremost leading prime chief stronger clearer weaker".split()
DEGREE_WORDS = "direct directly convincing compelling robust striking controlled".split()
LITERATURE = "evidence support study studies research work finding findings demonstration account case treatment example illustration comparison design test tests".split()
_AFTER_CITATION = r"^\s*(?:\([^()]*\d{4}[a-z]?\)|\p{Lu}[^()]{0,80}\(\s*\d{4}[a-z]?[^()]*\))\s+([A-Za-zÀ-ɏ]+)"


def participle_opening(c) -> Column:
    """Whether a sentence is a citation followed at once by a reporting verb in -ing, with no verb of its own."""
    word = F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), _AFTER_CITATION, 1))
    return F.array_contains(word_set([v for v in REPORTING if v.endswith("ing")]), word)


def reporting_opening(c) -> Column:
    """Whether a sentence's first word is a finite form of a reporting verb other than its base form."""
    base = {v for v in REPORTING if not v.endswith(("s", "ed", "ing")) and v not in ("found", "shown", "wrote")} | {"stress"}
    word = F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"^\s*([A-Za-zÀ-ɏ]+)", 1))
    return F.array_contains(word_set([v for v in REPORTING if v not in base and not v.endswith("ing")]), word)


def ranks_literature(c) -> Column:
    """Whether a text ranks the literature: a superlative or comparative up to two words before a noun of
    it, or such a noun, "is", and a ranking word up to two words on."""
    def marks(words):
        return F.transform(words, lambda w, i: F.array_contains(word_set(RANKING), w) | (w.isin("most", "least", "more", "less") & F.coalesce(F.array_contains(word_set(DEGREE_WORDS), F.get(words, i + 1)), F.lit(False))))

    def judged(words):
        noun = lambda w: F.array_contains(word_set(LITERATURE), w)

        def over(ranked):
            wide = lambda i: F.when(F.get(words, i).isin("most", "least", "more", "less"), 1).otherwise(0)
            before = F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.coalesce(F.get(ranked, i), F.lit(False)) & F.exists(F.slice(words, i + wide(i) + 2, F.lit(3)), noun))
            after = F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.coalesce(noun(F.get(words, i)) & (F.get(words, i + 1) == "is"), F.lit(False)) & F.exists(F.slice(ranked, i + 3, F.lit(3)), lambda r: r))
            return before | after

        return let(marks(words), over)

    return let(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), judged)


def numbering_covers(texts, entries: Column) -> Column:
    """Whether every number cited in brackets in the texts has an entry."""
    from .claims import numbered_citations

    numbers = F.flatten(F.transform(col(texts), lambda t: numbered_citations(t, 10_000)))
    return F.forall(numbers, lambda n: n <= entries)
