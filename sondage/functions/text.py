"""Text answers: numbers, choices, labels and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions.literals import map_literal

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


def number(col: Column) -> Column:
    """Text as a double; NULL where it is not a plain number."""
    text = col.cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def integer(col: Column) -> Column:
    """Text as a whole number; NULL where it is anything else."""
    text = col.cast("string")
    return F.when(text.rlike(_INTEGER), F.trim(text).try_cast("long"))


def lookup(col: Column, mapping: dict, default: Column | None = None) -> Column:
    """Value of a literal map, or ``default`` (NULL if not given) where the key is missing."""
    found = F.element_at(map_literal(mapping), col)
    return found if default is None else F.coalesce(found, default)


def normalise_choices(col: Column) -> Column:
    """Multi-choice cell with '; ' between choices; NULL becomes an empty cell."""
    pattern = f", (?=[{vocab.CHOICE_CAPITALS}])"
    return F.trim(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), pattern, "; "))


def translate_choices(col: Column, mapping: dict[str, str]) -> Column:
    """Translate every choice of a '; ' separated cell; unknown choices stay."""
    parts = F.transform(F.split(col, "; ", -1), lambda t: lookup(F.trim(t), mapping, F.trim(t)))
    return F.when(col == "", col).otherwise(F.array_join(parts, "; "))


def has_choice(col: Column, option: str) -> Column:
    """1 where the option is among the choices of the cell, else 0."""
    hit = F.array_contains(F.split(col, r";\s*", -1), option)
    return F.coalesce(hit, F.lit(False)).cast("int")


def label_text(col: Column) -> Column:
    """Risk level 1 as 'Risky', anything else as 'Beneficial'."""
    return F.when(col == 1, F.lit("Risky")).otherwise(F.lit("Beneficial"))


def label_code(col: Column) -> Column:
    """'Beneficial' as 0, 'Risky' as 1, anything else NULL."""
    return F.when(col == "Beneficial", F.lit(0)).when(col == "Risky", F.lit(1))


def label_display(col: Column) -> Column:
    """Risk level as shown in figures: 0 'Beneficially', 1 'Risky'."""
    return F.when(col == 0, F.lit("Beneficially")).when(col == 1, F.lit("Risky"))


def lifetime_months(col: Column) -> Column:
    """Lifetime text in months; a bare number counts as years, nothing bought is NULL."""
    text = col.cast("string")
    pattern = r"(\d+\.?\d*)\s*([a-zA-Z]+)"
    amount = F.regexp_extract(text, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    months = amount * lookup(unit, vocab.MONTHS_PER_UNIT, F.lit(1))
    return (
        F.when(text == "Not purchased yet", F.lit(None).cast("double"))
        .when(text.rlike(_NUMBER), number(text) * F.lit(12.0))
        .when(text.rlike(pattern), months)
    )


def duration_months(col: Column) -> Column:
    """'N months' or 'N years' in months, from the first word; else NULL."""
    count = integer(F.split(F.trim(col), r"\s+")[0])
    return F.when(col.contains("month"), count).when(col.contains("year"), count * F.lit(12))


def duration_text(col: Column) -> Column:
    """Months as 'N months' below a year, else as whole years."""
    months = F.concat(col.cast("long").cast("string"), F.lit(" months"))
    years = F.concat(F.floor(col / F.lit(12)).cast("string"), F.lit(" years"))
    return F.when(col < 12, months).otherwise(years)


def strip_units(col: Column) -> Column:
    """Number left after removing the words months and years."""
    return number(F.regexp_replace(col.cast("string"), "months|years", ""))


def safe_int(col: Column) -> Column:
    """Whole part of a number in text; 0 where there is none."""
    return F.coalesce(number(col).try_cast("int"), F.lit(0))


def round_step(col: Column, step: int) -> Column:
    """Nearest multiple of ``step``; ties go to the even multiple."""
    return (F.bround(col / F.lit(step)) * F.lit(step)).cast("int")
