"""Claims that say more, or less, than the passage they rest on: words on ordinal scales and negation.

A text is an array of tokens; an occurrence is a scale word with the stems of the content words near
it. A claim's and a quote's occurrences are paired once each, those with most stems in common first.
"""
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col, let, light_stem, word_set

#: Words of the three scales by rank, and the band of each rank.
EXTENT = {0: "no none never neither nobody nothing zero", 1: "rarely seldom hardly scarcely barely infrequently few minority handful", 2: "occasionally sometimes some several",
          3: "often frequently regularly commonly repeatedly many much numerous", 4: "usually generally typically mostly predominantly most majority", 5: "always invariably universally consistently all every entirely wholly"}
DEGREE = {1: "slight slightly marginal marginally minimally modest modestly", 2: "somewhat moderate moderately partial partially", 3: "considerable considerably substantial substantially notable notably appreciably",
          4: "marked markedly great greatly strong strongly sharp sharply", 5: "dramatic dramatically drastic drastically vast vastly enormous enormously radical radically overwhelming overwhelmingly huge hugely massive massively"}
HEDGE = {1: "may might could possibly perhaps potentially seem seems appear appears suggest suggests suggesting tend tends", 2: "probably likely presumably", 3: "show shows demonstrate demonstrates establish establishes prove proves confirm confirms"}
BANDS = {"extent": {0: 0, 1: 1, 2: 2, 3: 2, 4: 3, 5: 4}, "degree": {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}, "hedge": {1: 1, 2: 2, 3: 3}}
FUNCTION_WORDS = ("a an the of to in on for with by from at as that this these those and or but yet so than then also into over under between within across about is are was were be been being am do does did has have had "
                  "it its their they them he she his her we our you your i not nor if when while whereas because which who whom whose there here such more less other others one two both per via up out off again further s t re ve ll d m 's").split()
ABSOLUTE_NEGATORS, NEGATORS = ("no", "none", "never", "zero", "nothing"), ("not", "never", "n't", "cannot", "failed", "nor", "neither", "without")
EPISTEMIC = r"^(establish|show|demonstrat|prove|confirm)"
#: Reach of the anchors to the right and left and how many count, for the two sets.
HEAD, CONTEXT = ((6, 3), (2, 1)), ((8, 4), (8, 4))
LEAST_HEAD, LEAST_CONTEXT = 1, 2
SCALES = {"extent": EXTENT, "degree": DEGREE, "hedge": HEDGE}
_WORDS = [w for ranks in SCALES.values() for ws in ranks.values() for w in ws.split()]


def _entry(word: Column) -> Column:
    """struct<scale, band> of a scale word; null for another word."""
    pairs = ",".join(f"{w}={scale}/{BANDS[scale][rank]}" for scale, ranks in SCALES.items() for rank, ws in ranks.items() for w in ws.split())
    found = F.str_to_map(F.lit(pairs), F.lit(","), F.lit("="))[word]
    return F.when(found.isNotNull(), F.struct(F.substring_index(found, "/", 1).alias("scale"), F.substring_index(found, "/", -1).cast("int").alias("band")))


def _among(c: Column, words) -> Column:
    return F.array_contains(word_set(words), c)


def scale_tokens(c) -> Column:
    s = F.translate(F.coalesce(col(c), F.lit("")), "‘’“”–—", "''\"\"--")
    return F.regexp_extract_all(F.lower(s), F.lit(r"[a-z0-9][a-z0-9'.%-]*"), F.lit(0))


def _near(marks: Column, i: Column, reach: tuple) -> Column:
    """Stems among marks (the stem of each content token, else null) near place i (from 0)."""
    (right, most_right), (left, most_left) = reach
    known = lambda a: F.filter(a, lambda s: s.isNotNull())
    after = F.slice(known(F.slice(marks, i + 2, F.lit(right))), 1, most_right)
    start = F.greatest(i - left, F.lit(0))
    before = F.slice(F.reverse(known(F.slice(marks, start + 1, i - start))), 1, most_left)
    return F.array_distinct(F.concat(after, before))


def occurrences(c) -> Column:
    """array<struct<i, word, scale, band, head, context>> of the scale words of a text."""
    content = lambda t: ~_among(t, FUNCTION_WORDS + _WORDS) & ~_among(light_stem(t), FUNCTION_WORDS) & ~t.rlike(r"\d")
    marked = lambda tokens: F.transform(tokens, lambda t: F.when(content(t), light_stem(t)))
    at = lambda tokens: F.filter(F.transform(tokens, lambda t, i: F.when(_among(t, _WORDS), F.struct(i.alias("i"), t.alias("word"), _entry(t).alias("e")))), lambda x: x.isNotNull())
    anchored = lambda marks, x: F.struct(x["i"].alias("i"), x["word"].alias("word"), x["e"]["scale"].alias("scale"), x["e"]["band"].alias("band"), _near(marks, x["i"], HEAD).alias("head"), _near(marks, x["i"], CONTEXT).alias("context"))
    return let(scale_tokens(c), lambda tokens: let(at(tokens), lambda found: F.when(F.size(found) == 0, F.transform(found, lambda x: anchored(F.array().cast("array<string>"), x))).otherwise(let(marked(tokens), lambda marks: F.transform(found, lambda x: anchored(marks, x))))))


def scale_shifts(claim, quotes) -> Column:
    """array<struct<scale, claim_word, claim_band, quote_word, quote_band>>: pairs of occurrences that
    stand on different bands, in the claim's order."""
    ours = occurrences(claim)
    theirs = F.flatten(F.transform(F.filter(col(quotes), lambda q: q.isNotNull()), lambda q: occurrences(q)))
    shared = lambda x, y, k: F.size(F.array_intersect(x[k], y[k]))
    pair = lambda x, y, i, j: F.struct((-shared(x, y, "head")).alias("h"), (-shared(x, y, "context")).alias("c"), F.abs(x["band"] - y["band"]).alias("gap"), i.alias("i"), j.alias("j"), x["scale"].alias("scale"),
                                       x["word"].alias("claim_word"), x["band"].alias("claim_band"), y["word"].alias("quote_word"), y["band"].alias("quote_band"))
    fits = lambda x, y: (x["scale"] == y["scale"]) & (shared(x, y, "head") >= LEAST_HEAD) & (shared(x, y, "context") >= LEAST_CONTEXT)
    pairs = let(theirs, lambda t: F.flatten(F.transform(ours, lambda x, i: F.filter(F.transform(t, lambda y, j: F.when(fits(x, y), pair(x, y, i, j))), lambda p: p.isNotNull()))))
    free = lambda acc, p: ~F.exists(acc, lambda a: (a["i"] == p["i"]) | (a["j"] == p["j"]))
    greedy = lambda ps: F.aggregate(F.array_sort(ps), F.filter(ps, lambda p: F.lit(False)), lambda acc, p: F.when(free(acc, p), F.concat(acc, F.array(p))).otherwise(acc))
    shifted = F.array_sort(F.transform(F.filter(let(pairs, greedy), lambda p: p["claim_band"] != p["quote_band"]), lambda p: F.struct(p["i"].alias("i"), *[p[k].alias(k) for k in ("scale", "claim_word", "claim_band", "quote_word", "quote_band")])))
    return F.transform(shifted, lambda p: F.struct(*[p[k].alias(k) for k in ("scale", "claim_word", "claim_band", "quote_word", "quote_band")]))


def _epistemic(tokens: Column, negated, after: bool) -> Column:
    """For each epistemic verb with a negator within three tokens behind (or before) it: the stems of the seven tokens after it."""
    window = lambda i: F.slice(tokens, i + 2, F.lit(3)) if after else F.slice(tokens, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
    hit = lambda t, i: light_stem(t).rlike(EPISTEMIC) & F.exists(window(i), lambda x: _among(x, negated))
    found = F.transform(tokens, lambda t, i: F.when(light_stem(t).rlike(EPISTEMIC) & hit(t, i), F.transform(F.slice(tokens, i + 2, F.lit(7)), lambda x: F.struct(x.alias("t"), light_stem(x).alias("s")))))
    return F.filter(found, lambda x: x.isNotNull())


def negation_shifted(claim, quotes) -> Column:
    """Whether the claim reports a finding of absence ("established no role") where a quote reports the
    absence of a finding ("has not established a role") on the same object."""
    said = F.transform(let(scale_tokens(claim), lambda t: _epistemic(t, ABSOLUTE_NEGATORS, True)), lambda o: F.transform(F.filter(o, lambda x: ~_among(x["s"], FUNCTION_WORDS) & ~_among(x["t"], ABSOLUTE_NEGATORS)), lambda x: x["s"]))
    read = F.flatten(F.transform(F.filter(col(quotes), lambda q: q.isNotNull()), lambda q: F.transform(let(scale_tokens(q), lambda t: _epistemic(t, NEGATORS, False)), lambda o: F.transform(o, lambda x: x["s"]))))
    return let(read, lambda r: F.exists(said, lambda a: F.exists(r, lambda b: F.arrays_overlap(a, b))))
