"""Answer ranges to single values, by draws that depend only on the row id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondage.functions.draws import int_between, u
from sondage.functions.text import integer, number

_PAIR = r"^(\d+)\s*-\s*(\d+)"
_ABOVE = r"^>\s*(\d+)"
_BELOW = r"^<\s*(\d+)"


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(text, pattern, index).try_cast("long")


def smooth_age(col: Column, row_id: Column, salt: str = "Age") -> Column:
    """Age range to a whole age, as text; answers that are no range stay as they are."""
    text, draw = F.trim(col.cast("string")), u(row_id, salt)
    span = int_between(_group(text, _PAIR, 1), _group(text, _PAIR, 2), draw)
    return (
        F.when(text.rlike(_PAIR), span.cast("string"))
        .when(text.rlike(_ABOVE) & (_group(text, _ABOVE, 1) >= 50), int_between(F.lit(50), F.lit(70), draw).cast("string"))
        .when(text.rlike(_BELOW) & (_group(text, _BELOW, 1) <= 20), int_between(F.lit(18), F.lit(20), draw).cast("string"))
        .otherwise(F.coalesce(integer(text).cast("string"), text))
    )


def smooth_income(col: Column, row_id: Column, salt: str = "Income_Category") -> Column:
    """Income range to a multiple of 100, as text."""
    text, draw = F.trim(F.replace(col.cast("string"), F.lit("."), F.lit(""))), u(row_id, salt)
    pair = r"^(\d+)[^\d]+(\d+)"

    def hundreds(low: Column, high: Column) -> Column:
        drawn = int_between(F.floor(low / F.lit(100)), F.floor(high / F.lit(100)), draw)
        return (drawn * F.lit(100)).cast("string")

    above, below = _group(text, _ABOVE, 1), _group(text, _BELOW, 1)
    floor = (F.floor(integer(text) / F.lit(100)) * F.lit(100)).cast("string")
    return (
        F.when(text.rlike(pair), hundreds(_group(text, pair, 1), _group(text, pair, 2)))
        .when(text.rlike(_ABOVE), hundreds(above, above + F.lit(10000)))
        .when(text.rlike(_BELOW), hundreds(F.lit(3000), below))
        .otherwise(F.coalesce(floor, text))
    )


def smooth_lifetime(col: Column, row_id: Column, salt: str, encoded: bool = False) -> Column:
    """Lifetime range to months (``encoded``) or to text such as '7 months', '4 years'.

    The result is text in both modes, since an encoded answer that names years
    without a range stays text and becomes a gap to fill later.
    """
    text, draw = F.trim(col.cast("string")), u(row_id, salt)
    few, months, bare = r"(?i)^<\s*(\d+)\s*months", r"(?i)^(\d+)\s*-\s*(\d+)\s*months", r"^(\d+)"
    span, over, under = r"(?i)^(\d+)\s*-\s*(\d+)\s*years", r"(?i)^>\s*(\d+)\s*years", r"(?i)^<\s*(\d+)\s*years"

    def out(count: Column, unit: str) -> Column:
        if encoded:
            return (count * F.lit(12 if unit == "years" else 1)).cast("string")
        return F.concat(count.cast("string"), F.lit(f" {unit}"))

    has_month, has_year = F.lower(text).contains("month"), F.lower(text).contains("year")
    n = _group(text, few, 1)
    first = F.greatest(F.lit(1), n - F.lit(3))
    # the upper end is left out here, unlike in every other range
    below = int_between(first, F.greatest(first, n - F.lit(1)), draw)
    over_n, under_n = _group(text, over, 1), _group(text, under, 1)
    nothing = F.lit("0") if encoded else text
    return (
        F.when(text.contains("Not purchased yet"), nothing)
        .when(text.rlike(few), out(below, "months"))
        .when(has_month & text.rlike(months), out(int_between(_group(text, months, 1), _group(text, months, 2), draw), "months"))
        .when(has_month & text.rlike(bare), out(_group(text, bare, 1), "months"))
        .when(has_year & text.rlike(span), out(int_between(_group(text, span, 1), _group(text, span, 2), draw), "years"))
        .when(has_year & text.rlike(over), out(int_between(over_n, over_n + F.lit(5), draw), "years"))
        .when(has_year & text.rlike(under), out(int_between(F.greatest(F.lit(1), under_n - F.lit(5)), under_n, draw), "years"))
        .when(has_year, text)
        .otherwise(nothing)
    )


def smooth_needs(col: Column, row_id: Column, salt: str = "Essential_Needs_Percentage") -> Column:
    """Share of income for essential needs, to the nearest 5 inside its range."""
    text = F.replace(F.replace(F.trim(col.cast("string")), F.lit("%"), F.lit("")), F.lit(","), F.lit("."))
    parts = F.split(text, "-", -1)
    value = number(text)
    ranged = (~text.contains("<")) & (~text.contains(">")) & text.contains("-")
    start = (
        F.when(text.contains("<"), F.lit(30.0))
        .when(text.contains(">"), F.lit(75.0))
        .when(ranged, number(F.get(parts, 0)))
        .when(value < 50, F.lit(30.0))
        .when(value <= 75, F.lit(50.0))
        .when(value > 75, F.lit(75.0))
    )
    stop = (
        F.when(text.contains("<"), F.lit(50.0))
        .when(text.contains(">"), F.lit(80.0))
        .when(ranged, number(F.get(parts, 1)))
        .when(value < 50, F.lit(50.0))
        .when(value <= 75, F.lit(75.0))
        .when(value > 75, F.lit(80.0))
    )
    low = F.when(start.isNotNull() & stop.isNotNull(), F.least(start, stop))
    high = F.when(start.isNotNull() & stop.isNotNull(), F.greatest(start, stop))
    drawn = low + u(row_id, salt) * (high - low)
    stepped = F.bround(drawn / F.lit(5.0)) * F.lit(5.0)
    return F.when(low == high, low).otherwise(F.greatest(low, F.least(stepped, high)))
