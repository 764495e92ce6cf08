"""Dates, numbers, costs and indicators as Column expressions. Undefined results are null."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Hours (UTC) of Monday to Friday that are billed at the peak rate.
PEAK_HOURS = (1, 2, 3, 6, 7, 8, 9)
#: Fixed value: the normal quantile for 95 per cent intervals.
Z95 = 1.959963984540054
ABS_TOL, REL_TOL = 0.005, 0.01


def month_bucket(c) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def is_peak(ts) -> Column:
    t = col(ts)
    return (F.weekday(t) < 5) & F.hour(t).isin(*PEAK_HOURS)


def recency(year, as_of: int, years: int = 10) -> Column:
    y = col(year)
    return F.when(y.isNull(), "skipped").when(F.lit(as_of) - y <= years, "info").otherwise("note")


def citation_indicator(count, least: int = 10) -> Column:
    c = col(count)
    return F.when(c.isNull(), "skipped").when(c >= least, "info").otherwise("note")


def venue_indicator(indexed) -> Column:
    """Three states: not checked, listed, not listed."""
    return F.when(col(indexed).isNull(), "skipped").when(col(indexed), "pass").otherwise("note")


def to_year(c) -> Column:
    y = F.expr("1") * 0 + col(c).try_cast("double").try_cast("int")
    return F.when(y.between(1000, 2100), y)


def year_key(c) -> Column:
    return F.nullif(F.regexp_extract(col(c).cast("string"), r"^(\d{4})", 1), F.lit(""))


def year_label(c) -> Column:
    return F.coalesce(year_key(c), F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def to_label(c) -> Column:
    """0 or 1 of a number or of yes/no words; else null."""
    s = F.lower(F.trim(col(c).cast("string")))
    n = s.try_cast("double")
    return F.when(n == 1, 1).when(n == 0, 0).when(s.isin("true", "yes"), 1).when(s.isin("false", "no"), 0)


def finite(c) -> Column:
    x = col(c)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def div(a, b) -> Column:
    """a / b as a double, null when b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def numerals_match(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(ABS_TOL), REL_TOL * F.greatest(F.abs(a), F.abs(b)))


def numerals_equivalent(a: Column, a_percent: Column, b: Column, b_percent: Column) -> Column:
    """Equal within tolerance, or one a percentage of which the other is the proportion."""
    x, y = F.when(a_percent, a).otherwise(a * 100.0), F.when(b_percent, b).otherwise(b * 100.0)
    return numerals_match(a, b) | ((a_percent != b_percent) & numerals_match(x, y))


def call_cost(ts, input_tokens, output_tokens, cached, peak: tuple, offpeak: tuple) -> Column:
    """Cost of a call; a tier is (input missed, input from cache, output) for a million tokens."""
    i, o = col(input_tokens), col(output_tokens)
    hit = F.greatest(F.lit(0), F.least(F.coalesce(col(cached), F.lit(0)), i))
    at = lambda k: F.when(is_peak(ts), F.lit(float(peak[k]))).otherwise(F.lit(float(offpeak[k])))
    return ((i - hit) * at(0) + hit * at(1) + o * at(2)) / 1e6


def flat_cost(input_tokens, output_tokens, price_in: float, price_out: float) -> Column:
    return (col(input_tokens) * price_in + col(output_tokens) * price_out) / 1e6


def hard_maximum_words(target) -> Column:
    return F.ceil(col(target) * 1.25)


def wilson(count, n) -> tuple[Column, Column]:
    """Lower and upper end of the 95 per cent interval of a proportion."""
    k, n = col(count).cast("double"), col(n).cast("double")
    p, z2 = F.try_divide(k, n), Z95 * Z95
    d = 1 + F.try_divide(F.lit(z2), n)
    mid, half = p + F.try_divide(F.lit(z2), 2 * n), Z95 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n))
    return F.greatest(F.lit(0.0), (mid - half) / d), F.least(F.lit(1.0), (mid + half) / d)
