"""Column expressions shared by the operators: code lists, dates, labels, scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartermark.schemas import IMPUTED_PREFIX, SERIES_DIMS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """Evaluate `value` once and use it by name in `fn`. An outer expression that appears inside a
    lambda is otherwise evaluated again for every element."""
    return F.get(F.transform(F.array(value), fn), 0)


# --- delimited code lists -------------------------------------------------


def code_list(codes: Column | str) -> Column:
    """`a-b-c` to an array of distinct codes."""
    return F.array_distinct(F.split(col(codes), "-"))


def has_code(codes: Column | str, code: Column | str) -> Column:
    """The delimited list holds `code` (itself one code, or a run of codes)."""
    wanted = F.lit(code) if isinstance(code, str) else code
    return F.concat(F.lit("-"), col(codes), F.lit("-")).contains(
        F.concat(F.lit("-"), wanted, F.lit("-"))
    )


def series_id(*dims: str) -> Column:
    return F.concat_ws("|", *(dims or SERIES_DIMS))


def split_series_id(sid: Column | str) -> list[Column]:
    return [F.split_part(col(sid), F.lit("|"), F.lit(i + 1)).alias(n) for i, n in enumerate(SERIES_DIMS)]


# --- provenance -----------------------------------------------------------


def is_imputed(source: Column | str = "source_file") -> Column:
    """C7. A missing source counts as observed."""
    return F.coalesce(col(source).startswith(IMPUTED_PREFIX), F.lit(False))


def source_class(source: Column | str = "source_file") -> Column:
    return F.when(is_imputed(source), F.lit("imputed")).otherwise(F.lit("observed"))


def tier_of(kind: Column | str = "geospatial_type") -> Column:
    return F.when(col(kind) == "suburb", "sal").when(col(kind) == "lga", "lga")


def composite_qualifier(a: Column | str, b: Column | str) -> Column:
    """J18. A forecast side wins; otherwise the number of imputed sides decides."""
    a, b = col(a), col(b)
    imputed = (a == "imputed").cast("int") + (b == "imputed").cast("int")
    return (
        F.when((a == "forecast") | (b == "forecast"), "forecast")
        .when(imputed == 2, "fully_imputed")
        .when(imputed == 1, "partially_imputed")
        .otherwise("observed")
    )


def yield_ratio(weekly_rent: Column | str, price: Column | str) -> Column:
    """Annual rent over price; NaN when the price is not positive."""
    return F.when(col(price) > 0, col(weekly_rent) * 52 / col(price)).otherwise(F.lit(float("nan")))


# --- dates ----------------------------------------------------------------


def year_of(d: Column | str) -> Column:
    return F.year(col(d))


def quarter_ordinal(d: Column | str) -> Column:
    return F.year(col(d)) * 4 + F.quarter(col(d)) - 1


def quarter_label_date(label: Column | str) -> Column:
    """`2025-Q3` to the first day of the quarter's last month."""
    label = col(label)
    year = F.split_part(label, F.lit("-Q"), F.lit(1)).try_cast("int")
    quarter = F.split_part(label, F.lit("-Q"), F.lit(2)).try_cast("int")
    return F.when(quarter.between(1, 4), F.make_date(year, quarter * 3, F.lit(1)))


def month_label_date(label: Column | str, fmt: str = "MMM yyyy") -> Column:
    """Header text to a date; NULL where the text does not parse."""
    return F.to_date(F.try_to_timestamp(col(label), F.lit(fmt)))


# --- ordering and scaling -------------------------------------------------


def slice_order(dwelling: str = "dwelling_type", bedrooms: str = "bedrooms") -> list[Column]:
    """G4. The overall roll-up first, then dwelling, then bedrooms as a number."""
    headline = (F.col(dwelling) == "all") & (F.col(bedrooms) == "all")
    return [
        F.when(headline, 0).otherwise(1).asc(),
        F.col(dwelling).asc(),
        bedroom_rank(bedrooms).asc(),
    ]


def bedroom_rank(bedrooms: Column | str = "bedrooms") -> Column:
    return F.when(col(bedrooms) == "all", F.lit(-1.0)).otherwise(
        F.coalesce(col(bedrooms).try_cast("double"), F.lit(99.0))
    )


def scale(value: Column | str, largest: Column | str, lo: float, hi: float) -> Column:
    """K13. Linear map of value/largest onto [lo, hi], clamped."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(value) / col(largest)))
    return F.when(col(largest) <= 0, F.lit(float(lo))).otherwise(lo + (hi - lo) * share)


# The six colour stops of the map ramp.
RAMP = [(68, 1, 84), (71, 44, 122), (59, 81, 139), (44, 113, 142), (33, 144, 141), (39, 173, 129)]


def ramp_position(value: Column | str, lo: Column | str, hi: Column | str) -> tuple[Column, Column]:
    """L12. Stop index and fraction towards the next stop; a flat domain is the first stop."""
    last = len(RAMP) - 1
    t = F.when(col(hi) <= col(lo), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(value) - col(lo)) / (col(hi) - col(lo))))
    )
    pos = t * last
    stop = F.floor(pos).cast("int")
    return stop, pos - stop


def ramp_colour(value: Column | str, lo: Column | str, hi: Column | str) -> Column:
    stop, frac = ramp_position(value, lo, hi)
    nxt = F.least(F.lit(len(RAMP) - 1), stop + 1)
    channels = []
    for i in range(3):
        stops = F.array(*[F.lit(float(s[i])) for s in RAMP])
        mixed = F.get(stops, stop) * (1 - frac) + F.get(stops, nxt) * frac
        channels.append(F.floor(mixed + 0.5).cast("int"))
    return F.array(*channels)


# --- labels (O1) ----------------------------------------------------------

DASH = "—"


def slice_label(dwelling: Column | str = "dwelling_type", bedrooms: Column | str = "bedrooms") -> Column:
    d, b = col(dwelling), col(bedrooms)
    cap = F.concat(F.upper(F.substring(d, 1, 1)), F.substr(d, F.lit(2)))
    return (
        F.when((d == "all") & (b == "all"), "All dwellings")
        .when(b == "all", cap)
        .when(d == "all", F.concat(F.lit("All · "), b, F.lit(" br")))
        .otherwise(F.concat(cap, F.lit(" · "), b, F.lit(" br")))
    )


def order_label() -> Column:
    """`(p,d,q)(P,D,Q)[s]`, or a dash for rows without a model."""
    parts = ["ar_p", "ar_d", "ar_q", "seasonal_p", "seasonal_d", "seasonal_q", "seasonal_period"]
    missing = reduce(lambda a, b: a | b, [F.col(p).isNull() for p in parts])
    return F.when(missing, DASH).otherwise(F.format_string("(%d,%d,%d)(%d,%d,%d)[%d]", *parts))


def variance_label(v: Column | str) -> Column:
    v = col(v)
    mantissa = F.regexp_replace(F.format_string("%.2e", v), r"e([+-])0*(\d)", "e$1$2")
    return (
        F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), DASH)
        .when(F.abs(v) >= 1000, mantissa)
        .otherwise(F.format_string("%.3f", v))
    )


def source_label(source: Column | str) -> Column:
    s = col(source)
    tail = F.replace(F.substr(s, F.lit(len(IMPUTED_PREFIX) + 1)), F.lit("_"), F.lit(" "))
    return (
        F.when(s == "observed", "Observed")
        .when(s.startswith(IMPUTED_PREFIX), F.concat(F.lit("Imputed · "), tail))
        .otherwise(s)
    )


def money_label(v: Column | str) -> Column:
    return F.concat(F.lit("$"), F.format_number(col(v), 0))


def month_year_label(d: Column | str) -> Column:
    return F.date_format(col(d), "MMM yyyy")


def level_slug(file_name: Column | str) -> Column:
    """A4. File stem without its year suffix and the `_integrated` infix."""
    stem = F.regexp_replace(F.lower(col(file_name)), r"\.[a-z]+$", "")
    return F.replace(F.regexp_replace(stem, r"_[0-9]{4}$", ""), F.lit("_integrated"), F.lit(""))


def title_slug(slug: Column | str) -> Column:
    return F.initcap(F.replace(col(slug), F.lit("_"), F.lit(" ")))


def strip_qualifier(name: Column | str, qualifier: str = " (Vic.)") -> Column:
    """L10."""
    return F.trim(F.replace(col(name), F.lit(qualifier), F.lit("")))
