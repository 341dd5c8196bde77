"""Projections, filters and schema operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage import vocab


def ref(name: str) -> Column:
    """Column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def drop_form_timestamp(df: DataFrame) -> DataFrame:
    """Drop the first column if it is the form's own timestamp."""
    first = df.columns[0]
    return df.drop(ref(first)) if first.lower() in vocab.TIMESTAMP_TITLES else df


def rename_questions(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Question titles to identifiers; unknown titles stay."""
    mapping = mapping or vocab.QUESTIONS
    return df.toDF(*[mapping.get(name, name) for name in df.columns])


def strip_suffix(df: DataFrame, suffix: str = "_encoded") -> DataFrame:
    return df.toDF(*[name.replace(suffix, "") for name in df.columns])


def drop_if_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def select_existing(df: DataFrame, order: list[str]) -> DataFrame:
    """The listed columns that exist, in list order."""
    return df.select(*[ref(c) for c in order if c in df.columns])


def ensure_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the missing columns as NULL text."""
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


def numeric_columns(df: DataFrame, skip: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def group_map(df: DataFrame) -> dict[str, list[str]]:
    """Columns of each analysis group, by name or name prefix."""
    groups = {}
    for group, (names, prefixes) in vocab.GROUPS.items():
        if prefixes:
            groups[group] = [c for c in df.columns if c in names or c.startswith(tuple(prefixes))]
        else:
            groups[group] = [c for c in names if c in df.columns]
    return groups


def split_target(df: DataFrame, target: str = vocab.TARGET, excluded: list[str] | None = None) -> tuple[list[str], str]:
    """Feature names and the target name; auxiliary columns are no features."""
    excluded = vocab.EXCLUDED if excluded is None else excluded
    return [c for c in df.columns if c != target and c not in excluded], target


def features_of(df: DataFrame, target: str = vocab.TARGET, row_id: str | None = None) -> list[str]:
    """Numeric feature columns, without target, auxiliary columns and row id."""
    names, _ = split_target(df, target)
    numeric = set(numeric_columns(df))
    return [c for c in names if c in numeric and c != row_id]


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column with a NULL, from one aggregation."""
    counts = df.agg(*[F.count_if(ref(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], [ref(c) for c in df.columns], "column", "nulls").filter("nulls > 0")


def null_examples(df: DataFrame, row_id: str, n: int = 5) -> DataFrame:
    """(column, row id) of the first ``n`` rows with a NULL, per column, in one pass."""
    empty = F.array(*[F.when(ref(c).isNull(), F.lit(c)) for c in df.columns if c != row_id])
    hits = df.select(ref(row_id), F.explode(F.array_compact(empty)).alias("column"))
    first = Window.partitionBy("column").orderBy(row_id)
    return hits.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= n).drop("n")


def infer_roles(df: DataFrame, excluded: list[str] | None = None, categories: int = 20) -> list[tuple[str, str, str]]:
    """(column, type, role): numerical, boolean or categorical.

    Whole-number columns are boolean within {0, 1} and categorical below
    ``categories`` distinct values. A sketch finds the few columns near that
    limit; only those are counted exactly.
    """
    excluded = vocab.EXCLUDED if excluded is None else excluded
    fields = [f for f in df.schema.fields if f.name not in excluded]
    whole = [f.name for f in fields if isinstance(f.dataType, T.IntegralType)]
    low, high, distinct = {}, {}, {}
    if whole:
        row = df.agg(
            *[F.min(ref(c)) for c in whole], *[F.max(ref(c)) for c in whole],
            *[F.approx_count_distinct(ref(c)) for c in whole],
        ).first()
        n = len(whole)
        low, high = dict(zip(whole, row[:n])), dict(zip(whole, row[n:2 * n]))
        distinct = dict(zip(whole, row[2 * n:]))
        near = [c for c in whole if distinct[c] <= 2 * categories]
        if near:
            melted = df.select(*[ref(c).cast("long").alias(c) for c in near]).unpivot([], [ref(c) for c in near], "column", "value")
            exact = melted.dropna().distinct().groupBy("column").count().collect()
            distinct.update({c: 0 for c in near})
            distinct.update({r["column"]: r["count"] for r in exact})
    roles = []
    for f in fields:
        kind = f.dataType.simpleString()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            role = "numerical"
        elif f.name in low:
            if low[f.name] is None or (low[f.name] >= 0 and high[f.name] <= 1):
                role = "boolean"
            else:
                role = "categorical" if distinct[f.name] < categories else "numerical"
        else:
            role = "categorical"
        roles.append((f.name, kind, role))
    return roles


def roles_table(df: DataFrame, **kwargs) -> DataFrame:
    return df.sparkSession.createDataFrame(infer_roles(df, **kwargs), "column string, dtype string, role string")


def cast_roles(df: DataFrame, roles: list[tuple[str, str, str]]) -> DataFrame:
    """Boolean-role columns as booleans."""
    return df.withColumns({c: ref(c).cast("boolean") for c, _, role in roles if role == "boolean"})


def uncast_booleans(df: DataFrame) -> DataFrame:
    """Boolean columns back as 0/1, for writing."""
    return df.withColumns({f.name: ref(f.name).cast("int") for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)})


def non_constant(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least two different values."""
    row = df.agg(*[F.min(ref(c)) for c in columns], *[F.max(ref(c)) for c in columns]).first()
    return [c for c, low, high in zip(columns, row[:len(columns)], row[len(columns):]) if low is not None and low != high]


def non_empty(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least one value."""
    row = df.agg(*[F.count(ref(c)) for c in columns]).first()
    return [c for c, n in zip(columns, row) if n > 0]


def drop_null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & ref(c).isNotNull()
    return df.filter(keep)


def melt_factors(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Wide to long (ids, Factor, Value); underscores of factor names become spaces."""
    wide = df.select(*[ref(c) for c in ids], *[ref(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot([ref(c) for c in ids], [ref(c) for c in columns], "Factor", "Value")
    return long.withColumn("Factor", F.translate("Factor", "_", " "))


def split_labelled(df: DataFrame, level: str = vocab.TARGET) -> tuple[DataFrame, DataFrame]:
    """Rows with a level, rows still at -1."""
    return df.filter(ref(level) != -1), df.filter(ref(level) == -1)


def class_subset(df: DataFrame, value, target: str = vocab.TARGET) -> DataFrame:
    return df.filter(ref(target) == F.lit(value))


def has_variation(df: DataFrame, column: str = vocab.TARGET) -> bool:
    """Whether a column holds more than one value; NULL counts as a value."""
    low, high, nulls = df.agg(F.min(ref(column)), F.max(ref(column)), F.count_if(ref(column).isNull())).first()
    return low != high or (low is not None and nulls > 0)
