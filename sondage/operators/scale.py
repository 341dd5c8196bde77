"""Scaling, linear scores and feature vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions.literals import list_literal
from sondage.functions.text import lookup
from sondage.operators.order import quantiles
from sondage.operators.schema import ref


@dataclass(frozen=True)
class ScalerParams:
    """Centre and spread per column: a handful of scalars, used as literals."""

    columns: tuple[str, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(zip(self.columns, self.centre, self.spread))
        spark.createDataFrame(rows, "column string, centre double, spread double").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ScalerParams":
        rows = spark.read.parquet(path).collect()
        return ScalerParams(tuple(r[0] for r in rows), tuple(r[1] for r in rows), tuple(r[2] for r in rows))


def fit_standard(df: DataFrame, columns: list[str]) -> ScalerParams:
    """Mean and population deviation; a constant column keeps deviation 1."""
    row = df.agg(*[F.avg(ref(c)) for c in columns], *[F.stddev_pop(ref(c)) for c in columns]).first()
    n = len(columns)
    spread = [1.0 if s is None or s == 0 else float(s) for s in row[n:]]
    return ScalerParams(tuple(columns), tuple(float(m or 0.0) for m in row[:n]), tuple(spread))


def apply_scaler(df: DataFrame, params: ScalerParams) -> DataFrame:
    return df.withColumns({
        c: (ref(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(params.columns, params.centre, params.spread)
    })


def invert_scaler(df: DataFrame, params: ScalerParams) -> DataFrame:
    return df.withColumns({c: ref(c) * F.lit(s) + F.lit(m) for c, m, s in zip(params.columns, params.centre, params.spread)})


def standardise(df: DataFrame, columns: list[str]) -> tuple[DataFrame, ScalerParams]:
    params = fit_standard(df, columns)
    return apply_scaler(df, params), params


def fit_robust(df: DataFrame, columns: list[str], **kwargs) -> ScalerParams:
    """Median and interquartile range; a zero range counts as 1."""
    cut = quantiles(df, columns, [0.25, 0.5, 0.75], **kwargs)
    spread = [(cut[c][2] - cut[c][0]) or 1.0 for c in columns]
    return ScalerParams(tuple(columns), tuple(cut[c][1] for c in columns), tuple(spread))


def robust_scale(df: DataFrame, columns: list[str], **kwargs) -> tuple[DataFrame, ScalerParams]:
    params = fit_robust(df, columns, **kwargs)
    return apply_scaler(df, params), params


def scale_numeric(df: DataFrame, columns: list[str], path: str | None = None, fit: bool = True) -> DataFrame:
    """Fit and save, fit only, or load and apply."""
    if fit:
        params = fit_standard(df, columns)
        if path:
            params.save(df.sparkSession, path)
        return apply_scaler(df, params)
    if not path:
        raise ValueError("a path is required when fit=False")
    return apply_scaler(df, ScalerParams.load(df.sparkSession, path))


def linear_score(weights: dict[str, float], params: ScalerParams | None = None) -> Column:
    """Weighted sum of columns, scaled by ``params`` where given."""
    scale = {} if params is None else {c: (m, s) for c, m, s in zip(params.columns, params.centre, params.spread)}
    total = None
    for name, weight in weights.items():
        value = ref(name).cast("double")
        if name in scale:
            value = (value - F.lit(scale[name][0])) / F.lit(scale[name][1])
        total = value * F.lit(weight) if total is None else total + value * F.lit(weight)
    return total


def risk_score(df: DataFrame, weights: dict[str, float] | None = None, name: str = "Risk_Score") -> DataFrame:
    """Robust-scaled features times their weights."""
    weights = weights or vocab.RISK_WEIGHTS
    return df.withColumn(name, linear_score(weights, fit_robust(df, list(weights))))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to [0, 1] by their range; a constant column becomes NULL."""
    row = df.agg(*[F.min(ref(c)) for c in columns], *[F.max(ref(c)) for c in columns]).first()
    n = len(columns)
    return df.withColumns({
        c: F.lit(None).cast("double") if low is None or high == low
        else (ref(c).cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low))
        for c, low, high in zip(columns, row[:n], row[n:])
    })


def zero_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(ref(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})


def feature_array(columns: list[str]) -> Column:
    return F.array(*[ref(c).cast("double") for c in columns])


def with_vector(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(feature_array(columns)))


@dataclass(frozen=True)
class FeatureLayout:
    """Order of the assembled array: scaled numbers, ordinal codes, one-hot flags, flags as they are."""

    scaler: ScalerParams
    ordinal: dict[str, list[str]]
    nominal: dict[str, list[str]]
    passed: tuple[str, ...]

    @property
    def size(self) -> int:
        return len(self.scaler.columns) + len(self.ordinal) + sum(map(len, self.nominal.values())) + len(self.passed)


def fit_layout(df: DataFrame, numeric: list[str], ordinal: dict[str, list[str]], nominal: dict[str, list[str]] | list[str],
               passed: list[str]) -> FeatureLayout:
    from sondage.operators.encode import infer_vocabulary

    nominal = nominal if isinstance(nominal, dict) else infer_vocabulary(df, nominal)
    return FeatureLayout(fit_standard(df, numeric), ordinal, nominal, tuple(passed))


def assemble(df: DataFrame, layout: FeatureLayout, name: str = "features") -> DataFrame:
    """One array<double> per row in layout order; gaps become 0."""
    parts = [(ref(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(layout.scaler.columns, layout.scaler.centre, layout.scaler.spread)]
    parts += [lookup(ref(c), {v: float(i) for i, v in enumerate(values)}) for c, values in layout.ordinal.items()]
    parts += [(ref(c) == F.lit(v)).cast("double") for c, values in layout.nominal.items() for v in values]
    parts += [ref(c).cast("double") for c in layout.passed]
    return df.withColumn(name, F.array(*[F.coalesce(p, F.lit(0.0)) for p in parts]))


def inverse_features(df: DataFrame, layout: FeatureLayout, name: str = "features") -> DataFrame:
    """Columns back from the array: unscaled numbers, nearest ordinal, strongest category."""
    at, out = 0, {}
    for c, m, s in zip(layout.scaler.columns, layout.scaler.centre, layout.scaler.spread):
        out[c] = F.get(name, at) * F.lit(s) + F.lit(m)
        at += 1
    for c, values in layout.ordinal.items():
        code = F.greatest(F.lit(0), F.least(F.lit(len(values) - 1), F.bround(F.get(name, at)).cast("int")))
        out[c] = F.element_at(list_literal(values), code + F.lit(1))
        at += 1
    for c, values in layout.nominal.items():
        flags = F.slice(name, at + 1, len(values))
        out[c] = F.element_at(list_literal(values), F.array_position(flags, F.array_max(flags)).cast("int"))
        at += len(values)
    for c in layout.passed:
        out[c] = F.get(name, at)
        at += 1
    return df.withColumns(out).drop(name)
