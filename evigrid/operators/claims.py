"""Claims against their sources: citations in text, quotes, and the status guards in fixed order.

Statuses rise verified < needs_nuance < unsupported; a guard can only raise one. Guards are Column
expressions over struct-typed rows, chained so that each reads what the one before left.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import numerals_equivalent
from ..functions.text import NAME_PARTICLES, col, let, letters_digits

RANK = ("verified", "needs_nuance", "unsupported")
#: Fixed values of the quote and coverage rules.
SEGMENT_CHARS, FRAGMENT_CHARS, COVERAGE = 30, 10, 0.71
#: A year, or what stands for one.
YEAR = r"(?:[0-9]{4}[a-z]?|n\.d\.|in\s+press)"


def _name_of(segment: Column) -> Column:
    """Family name at the end of a segment: its last word, with the particles in front of it; null
    unless that word begins with a capital."""
    words = F.filter(F.split(F.regexp_replace(segment, r"['’]s$", ""), r"\s+"), lambda w: w != "")
    last = F.try_element_at(words, F.lit(-1))
    # places of the words that are no particles, before the last one
    other = F.filter(F.transform(words, lambda w, i: F.when(~F.lower(w).isin(*NAME_PARTICLES) & (i < F.size(words) - 1), i)), lambda i: i.isNotNull())
    name = F.array_join(F.slice(words, F.coalesce(F.array_max(other), F.lit(-1)) + 2, F.size(words)), " ")
    return F.when(last.rlike(r"^\p{Lu}[\p{L}\p{N}_'’-]*$"), name)


def _authors(names: Column) -> Column:
    """The segments of an author list: parted by commas, "&" and "and", without "et al."."""
    bare = F.regexp_replace(names, r"\s+et\s+al\b\.?", "")
    return F.transform(F.split(bare, r"\s*,\s*(?:&|and\b)?\s*|\s+(?:&|and)\s+"), lambda x: F.trim(x))


def _bracketed(part: Column) -> Column:
    """Surname and year of one entry of a parenthetical group, "names, year ...", or null."""
    year = F.regexp_extract(part, rf",\s*({YEAR})(?![\p{{L}}\p{{N}}])", 1)
    names = F.regexp_extract(part, rf"^(.*?),\s*{YEAR}(?![\p{{L}}\p{{N}}])", 1)
    named = F.filter(F.transform(_authors(names), _name_of), lambda n: n.isNotNull())
    return F.when((year != "") & (F.size(named) > 0), F.struct(named[0].alias("surname"), year.alias("year")))


def _narrated(before: Column, inside: Column) -> Column:
    """Surname and year of "names (year ...)": the list of names that ends where the bracket opens.

    Names stand alone between their commas but for the first, which prose may precede; without
    "and" only the last one counts.
    """
    year = F.regexp_extract(inside, rf"^\s*({YEAR})(?![\p{{L}}\p{{N}}])", 1)
    tail = F.rtrim(F.regexp_replace(F.rtrim(F.regexp_extract(before, r"([^.;:!?()]*(?:\bal\.)?[^.;:!?()]*)$", 1)), r"['’]s$", ""))
    names = _authors(tail)
    joined = tail.rlike(r"\s(?:&|and)\s")
    lone = lambda x: F.forall(F.split(x, r"\s+"), lambda w: w.rlike(r"^\p{Lu}") | F.lower(w).isin(*NAME_PARTICLES)) & (F.size(F.filter(F.split(x, r"\s+"), lambda w: ~F.lower(w).isin(*NAME_PARTICLES))) == 1)
    prose = F.array_max(F.filter(F.transform(names, lambda x, i: F.when(~lone(x) & (i < F.size(names) - 1), i)), lambda i: i.isNotNull()))
    first = F.when(joined, F.coalesce(prose, F.lit(0))).otherwise(F.size(names) - 1)
    name = F.coalesce(_name_of(F.get(names, first)), F.when(joined, _name_of(F.get(names, first + 1))))
    return F.when((year != "") & name.isNotNull(), F.struct(name.alias("surname"), year.alias("year")))


def citations(c) -> Column:
    """array<struct<surname, year>> of parenthetical citations (the last part of "as cited in") and narrative ones.

    The text is cut at its opening brackets: a piece's first part up to the closing bracket is the
    group, the end of the piece before is what it stands behind. Groups are lists parted by ";".
    """
    pieces = F.split(F.coalesce(col(c), F.lit("")), r"\(")
    closed = F.filter(F.transform(pieces, lambda x, i: F.when((i > 0) & F.contains(x, F.lit(")")), F.struct(F.substring_index(x, ")", 1).alias("inside"), F.get(pieces, i - 1).alias("before")))), lambda x: x.isNotNull())
    entries = F.flatten(F.transform(closed, lambda g: F.split(F.element_at(F.split(g["inside"], r"(?i)as\s+cited\s+in"), -1), ";")))
    both = F.concat(F.transform(entries, _bracketed), F.transform(closed, lambda g: _narrated(g["before"], g["inside"])))
    return F.filter(both, lambda x: x.isNotNull())


def citation_keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, surname, year, label: distinct citations of each text. year is null for placeholders."""
    s = docs.select(key, F.explode(F.array_distinct(citations(text))).alias("c")).select(key, "c.surname", F.col("c.year").alias("raw"))
    last = F.lower(F.element_at(F.split("surname", r"\s+"), -1))
    year = F.nullif(F.regexp_extract("raw", r"^(\d{4})", 1), F.lit(""))
    return s.select(key, last.alias("surname"), year.alias("year"), F.concat_ws(", ", "surname", F.coalesce(year, F.regexp_replace("raw", r"\s+", " "))).alias("label")).dropDuplicates([key, "surname", "year"])


def needs_citation_flags(c) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"(?i)\[\s*NEEDS\s+CITATION\b[^\]]*\]"))


def numbered_citations(c, most: int) -> Column:
    """Distinct numbers of bracket citations up to `most`, in order of appearance; an exponent's bracket is skipped."""
    from ..functions.arrays import expand_brackets

    groups = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?<![\p{L}\p{N}^])(\[\d{1,3}(?:\s*[,–-]\s*\d{1,3})*\])"), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(groups, lambda g: expand_brackets(g))), lambda n: n.between(1, most)))


def cap(status: Column, floor: Column) -> Column:
    """The stricter of two statuses; statuses outside the lattice and null floors change nothing."""
    return F.when(_rank(floor) > _rank(status), floor).otherwise(status)


def quote_segments(c) -> Column:
    """Parts of a quote that can be looked up: its quoted fragments of ten or more characters, or all of
    it, without ellipses, from thirty characters on; the whole quote if all fragments are too short."""
    q = F.coalesce(col(c), F.lit(""))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^(\.\.\.|…)\s*", ""), r"\s*(\.\.\.|…)$", ""))
    frags = F.filter(F.regexp_extract_all(q, F.lit(r'["“]([^"“”]+)["”]'), F.lit(1)), lambda f: F.length(f) >= FRAGMENT_CHARS)
    long = lambda a: F.filter(F.transform(a, clean), lambda s: F.length(s) >= SEGMENT_CHARS)
    first = long(F.when(F.size(frags) > 0, frags).otherwise(F.array(q)))
    return F.when(F.size(first) > 0, first).otherwise(long(F.array(q)))


def _folded(chunks) -> Column:
    return F.transform(col(chunks), lambda x: letters_digits(x))


def _folded_segments(quote) -> Column:
    return F.transform(quote_segments(quote), lambda s: letters_digits(s))


def located(quote, chunks) -> Column:
    """Whether any segment of the quote stands in any chunk, letters and digits only."""
    return let(_folded(chunks), lambda c: F.exists(_folded_segments(quote), lambda s: F.exists(c, lambda x: F.contains(x, s))))


def all_located(quote, chunks) -> Column:
    return let(_folded(chunks), lambda c: F.forall(_folded_segments(quote), lambda s: F.exists(c, lambda x: F.contains(x, s))))


def quote_index(quote, chunks) -> Column:
    """Place (from 0) of the first chunk that holds the longest segment found; null if none is found."""
    hit = lambda c, s: F.array_position(F.transform(c, lambda x: F.contains(x, letters_digits(s))), F.lit(True)) - 1
    found = let(_folded(chunks), lambda c: F.transform(quote_segments(quote), lambda s, i: F.struct((-F.length(s)).alias("l"), i.alias("i"), hit(c, s).alias("at"))))
    return F.array_min(F.filter(found, lambda x: x["at"] >= 0))["at"]


def numerals(c) -> Column:
    """array<struct<value, percent>> of numbers that are not part of an identifier, nor a bare year: digits alone, from 1500 to 2100."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?i)\b(?:table|figure|chunk)\s+\d+", " ")
    # whole words first, so that the digits of an identifier are never read; of a range the start
    words = F.transform(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_.,-]*[\p{L}\p{N}_]%?"), F.lit(0)), lambda w: F.regexp_extract(w, r"^,*([^-]*)", 1))
    plain = F.transform(words, lambda w: F.regexp_replace(w, r"[.,]+$", ""))
    numbers = F.filter(plain, lambda w: w.rlike(r"^(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)%?$"))
    year = r"^0*(?:1[5-9]\d\d|20\d\d|2100)$"  # 1500.00 and 1,500 are amounts
    return F.transform(F.filter(numbers, lambda w: ~w.rlike(year)), lambda w: F.struct(F.regexp_replace(w, "[,%]", "").cast("double").alias("value"), w.endswith("%").alias("percent")))


def missing_numerals(claim, sources) -> Column:
    """Numerals of the claim that no text of an array of sources gives."""
    have = F.flatten(F.transform(col(sources), lambda s: numerals(s)))
    return let(have, lambda read: F.filter(numerals(claim), lambda n: ~F.exists(read, lambda h: numerals_equivalent(n["value"], n["percent"], h["value"], h["percent"]))))


def term_coverage(claim, chunks, stop: tuple = ()) -> Column:
    """Share of the claim's words of four letters or more that the chunks hold; null without such words."""
    return term_share(claim, letters_digits(F.array_join(col(chunks), " ")), stop)


def term_share(claim, folded: Column, stop: tuple = ()) -> Column:
    """The same of texts that are folded and joined."""
    bare = F.lower(F.regexp_replace(F.coalesce(col(claim), F.lit("")), r"\([^()]*(?:1[5-9]|20)\d{2}[a-z]?[^()]*\)", " "))
    terms = F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"[A-Za-z][A-Za-z'-]{3,}"), F.lit(0)), lambda w: letters_digits(w)))
    terms = F.filter(terms, lambda w: ~w.isin(*stop)) if stop else terms
    share = lambda t, h: F.try_divide(F.size(F.filter(t, lambda w: F.contains(h, w))).cast("double"), F.size(t).cast("double"))
    return let(folded, lambda h: let(terms, lambda t: share(t, h)))


def computed(rows: DataFrame) -> DataFrame:
    """rows with their columns' values fixed: expressions above name them as they are, while the optimizer
    would move a column's expression into each function that names it, to be computed there for each element."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


#: The guards in their order, by the reason that each gives.
GUARDS = ("no_full_text_with_chunks", "attribution_mismatch", "assertion_status_inconsistent", "quote_not_verbatim", "scale_word_mismatch", "negation_scope_shift", "numeric_outside_cited_passage", "numeric_value_absent")


def guarded(rows: DataFrame) -> DataFrame:
    """Adds final_status, machine_reasons and diagnostics to claims.

    Needs status, claim, quote, chunks (array of texts) and assertions (array of struct(verdict, central)).
    no_full_text with chunks at hand becomes unsupported; error and no_full_text without chunks pass.
    Texts are folded and numbers read once for each row; the guards are flags over those, and the
    status is the strictest floor of the flags that are set.
    """
    return decided(guard_flags(rows), [c for c in rows.columns if c not in FOLDED])


#: What folded_chunks() adds.
FOLDED = ("chunks_folded", "chunks_numerals")


def folded_chunks(papers: DataFrame) -> DataFrame:
    """papers(chunks, ...) with their texts folded and numbers read, for rows of many claims on one paper:
    joined before the guards, that work is done once a paper and not once a claim."""
    c = F.coalesce("chunks", F.array().cast("array<string>"))
    return papers.withColumn("chunks_folded", F.transform(c, lambda x: letters_digits(x))).withColumn("chunks_numerals", F.transform(c, lambda x: numerals(x)))


def guard_flags(rows: DataFrame) -> DataFrame:
    """rows with what the guards read off their texts: _holds, _whole, _unread, _g1, _g2, _g3, _g6."""
    kept = [c for c in rows.columns if c not in FOLDED]
    rows = rows if set(FOLDED) <= set(rows.columns) else folded_chunks(computed(rows))
    read = rows.select(*kept, F.col("chunks_folded").alias("_folded"), F.transform(quote_segments("quote"), lambda x: letters_digits(x)).alias("_segments"), numerals("claim").alias("_said"), F.col("chunks_numerals").alias("_read"))
    holds = let(F.col("_segments"), lambda segs: F.transform("_folded", lambda x: F.exists(segs, lambda s: F.contains(x, s))))
    whole = let(F.col("_folded"), lambda f: F.forall("_segments", lambda s: F.exists(f, lambda x: F.contains(x, s))))
    same = lambda n, h: numerals_equivalent(n["value"], n["percent"], h["value"], h["percent"])
    absent = let(F.flatten("_read"), lambda r: F.filter("_said", lambda n: ~F.exists(r, lambda h: same(n, h))))
    seen = computed(read).select("*", holds.alias("_holds"), whole.alias("_whole"), absent.alias("_absent"), (F.size("_folded") > 0).alias("_has_chunks"), (F.size("_segments") > 0).alias("_has_segments"))
    cited = F.flatten(F.filter(F.zip_with("_read", "_holds", lambda r, h: F.when(h, r)), lambda r: r.isNotNull()))
    outside = let(cited, lambda c: let(F.col("_absent"), lambda gone: F.exists("_said", lambda n: ~F.exists(gone, lambda a: a == n) & ~F.exists(c, lambda h: same(n, h)))))
    located = F.exists("_holds", lambda h: h)
    return computed(seen).select(*kept, "_holds", "_whole", (F.size("_absent") > 0).alias("_unread"), ((F.col("status") == "no_full_text") & F.col("_has_chunks")).alias("_g1"),
                        ((F.coalesce(term_share("claim", F.array_join("_folded", "")), F.lit(1.0)) < COVERAGE) & ~located).alias("_g2"), _assertion_floor("assertions").alias("_g3"), (located & outside).alias("_g6"))


def decided(flags: DataFrame, kept: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """The guards' decision on guard_flags(), as if those of skip (reasons of GUARDS) did not exist.

    Guards of quotes, scale words and negation look only at claims that those before left verified.
    """
    from .scale import negation_shifted, scale_shifts

    off = lambda name, on: F.lit(False) if name in skip else on
    flags = flags.withColumn("_g1", off(GUARDS[0], F.col("_g1"))).withColumn("_g2", off(GUARDS[1], F.col("_g2"))).withColumn("_g3", F.lit(None).cast("string") if GUARDS[2] in skip else F.col("_g3"))
    flags = flags.withColumn("_g6", off(GUARDS[6], F.col("_g6"))).withColumn("_absent_number", off(GUARDS[7], F.col("_unread")))
    start = F.when(F.col("_g1"), RANK[2]).otherwise(F.col("status"))
    live = start.isin(*RANK)
    rank = F.greatest(_rank(start), F.when(F.col("_g2"), 2).otherwise(0), F.coalesce(_rank(F.col("_g3")), F.lit(0)))
    ranked = computed(flags).select("*", start.alias("_start"), F.coalesce(live, F.lit(False)).alias("_live"), rank.alias("_r"))
    unquoted = F.col("_live") & (F.col("_r") == 0) & ~F.col("_whole")
    verified = F.col("_live") & (F.col("_r") == 0) & F.col("_whole")
    quotes = F.array("quote")
    shifts = computed(ranked).select("*", off(GUARDS[3], unquoted).alias("_g4"), off(GUARDS[4], verified & (F.size(F.when(verified, scale_shifts("claim", quotes))) > 0)).alias("_g5a"), off(GUARDS[5], verified & F.coalesce(F.when(verified, negation_shifted("claim", quotes)), F.lit(False))).alias("_g5b"))
    fired = (F.col("_g1"), F.col("_live") & F.col("_g2"), F.col("_live") & F.col("_g3").isNotNull(), F.col("_g4"), F.col("_g5a"), F.col("_g5b"), F.col("_live") & F.col("_g6"), F.col("_live") & F.col("_absent_number"))
    slugs = list(zip(GUARDS, fired))
    softened = F.col("_g4") | F.col("_g5a") | F.col("_g5b") | F.col("_g6") | F.col("_absent_number")
    final = F.when(F.col("_live"), F.get(F.array(*[F.lit(s) for s in RANK]), F.greatest(F.col("_r"), softened.cast("int")))).otherwise(F.col("_start"))
    unmarked = F.size(F.filter("assertions", lambda a: F.coalesce(a["central"], F.lit(False)))) != 1
    diagnostics = F.array_compact(F.array(F.when((F.size("assertions") > 0) & unmarked & ~F.exists("assertions", lambda a: a["verdict"] == "contradicted"), "centrality_unmarked"), F.when(F.col("_unread"), "numeric_not_in_source")))
    return shifts.select(*kept, final.alias("final_status"), F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in slugs])).alias("machine_reasons"), diagnostics.alias("diagnostics"))


def replayed(rows: DataFrame, guard: str) -> DataFrame:
    """rows with before and after (the decision without and with one of GUARDS), found, examined, changed,
    new_status and new_reasons: what bringing that guard in does to frozen rows.

    Texts are read once for both. examined: the row could reach the guard, being verified without it; found:
    it fires. A row's frozen status moves, and the guard's reason is added to its own, only if that status
    was verified and the decision changes; rows that failed (error, or no_full_text without chunks) stay.
    """
    kept = [c for c in rows.columns if c not in FOLDED]
    flags = computed(guard_flags(rows))
    # with all guards first: that leaves the flags as they are
    whole = decided(flags, flags.columns).withColumnsRenamed({"final_status": "after", "machine_reasons": "_all", "diagnostics": "_d"})
    both = decided(computed(whole), [*kept, "after", "_all"], (guard,)).withColumnRenamed("final_status", "before")
    live = F.coalesce(F.col("before").isin(*RANK), F.lit(False))
    found = F.array_contains("_all", guard) & ~F.array_contains("machine_reasons", guard)
    out = both.select(*kept, "before", "after", (live & found).alias("found"), (F.col("before") == RANK[0]).alias("examined"), (live & (F.col("before") != F.col("after"))).alias("changed"))
    moves = (F.col("status") == RANK[0]) & F.col("changed")
    return out.withColumn("new_status", F.when(moves, F.col("after")).otherwise(F.col("status"))).withColumn("new_reasons", F.when(moves & F.col("found"), F.array(F.lit(guard))).otherwise(F.array().cast("array<string>")))


def guard_reach(rows: DataFrame, guards: tuple[str, ...] = GUARDS) -> DataFrame:
    """guard, n_rows, n_examined, n_found, n_changed, n_moved: how far each guard reaches into frozen rows."""
    one = lambda g: replayed(rows, g).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("examined").alias("n_examined"), F.count_if("found").alias("n_found"), F.count_if("changed").alias("n_changed"), F.count_if(F.col("new_status") != F.col("status")).alias("n_moved")).select(F.lit(g).alias("guard"), "*")
    out = one(guards[0])
    for g in guards[1:]:
        out = out.unionByName(one(g))
    return out


def _rank(s: Column) -> Column:
    return F.when(s == RANK[0], 0).when(s == RANK[1], 1).when(s == RANK[2], 2)


def _assertion_floor(c) -> Column:
    """unsupported for a contradicted assertion or an absent central one, needs_nuance for another absent one."""
    a = F.col(c)
    central = F.filter(a, lambda x: F.coalesce(x["central"], F.lit(False)))
    absent = F.exists(a, lambda x: x["verdict"] == "absent")
    return F.when(F.size(a) < 1, None).when(F.exists(a, lambda x: x["verdict"] == "contradicted"), "unsupported").when((F.size(central) == 1) & F.exists(central, lambda x: x["verdict"] == "absent"), "unsupported").when(absent, "needs_nuance")


def status_counts(rows: DataFrame, status: str = "final_status") -> DataFrame:
    names = (*RANK, "no_full_text", "error")
    return rows.agg(*[F.count_if(F.col(status) == s).alias(s) for s in names], F.count(F.lit(1)).alias("total"))


def tallied(rows: DataFrame, slugs: str, by: list[str] = ()) -> DataFrame:
    """slug, n and the group's number of flagged rows, of an array column of slugs."""
    counts = rows.select(*by, F.explode(slugs).alias("slug")).groupBy(*by, "slug").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(*by).agg(F.count_if(F.size(slugs) > 0).alias("n_flagged"), F.count(F.lit(1)).alias("n_rows"))
    return totals.join(counts, list(by), "left") if by else counts.crossJoin(totals)


def reason_counts(rows: DataFrame) -> DataFrame:
    """reason, n, and n_changed: rows with it whose status the guards changed."""
    r = rows.select(F.explode("machine_reasons").alias("reason"), (F.col("status") != F.col("final_status")).alias("c"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("c").alias("n_changed"))
