"""Reproducible uniform draws.

A draw depends only on the row id and a salt, so a recomputed task, a lost
executor or a second evaluation of the plan gives the same value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondage.functions.literals import list_literal

_MD5_SPAN = float(16**13)
_HASH_SPAN = float(2**53)


def u(row_id: Column | str, salt: str) -> Column:
    """Uniform draw in [0, 1) from 52 bits of md5(id:salt); the id is a column or a column name."""
    if isinstance(row_id, str):
        mark = salt.replace("\\", "\\\\").replace("'", "\\'")
        return F.expr(
            f"cast(conv(substring(md5(concat(cast(`{row_id}` as string), ':{mark}')), 1, 13), 16, 10) as double) / {_MD5_SPAN!r}D"
        )
    digest = F.md5(F.concat(row_id.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_MD5_SPAN)


def u_hash(row_id: Column, salt: str) -> Column:
    """Cheaper uniform draw in (0, 1) from a 64-bit hash; for bulk generation."""
    bits = F.shiftrightunsigned(F.xxhash64(row_id, F.lit(salt)), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(_HASH_SPAN)


def int_between(low: Column, high: Column, draw: Column) -> Column:
    """Integer uniform in [low, high], both ends included."""
    return (low + F.floor(draw * (high - low + F.lit(1)))).cast("long")


def pick(values: list, draw: Column) -> Column:
    """One of the literal values, equally likely."""
    if len(values) == 1:
        return F.lit(values[0])
    at = F.floor(draw * F.lit(len(values))).cast("int") + F.lit(1)
    return F.element_at(list_literal(values), at)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


# Coefficients of the published rational approximation of the
# inverse normal distribution function (P. J. Acklam, relative error 1.15e-9).
_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572]
_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416]
_TAIL = 0.02425


def _poly(coefficients: list[float], x: Column) -> Column:
    acc = F.lit(coefficients[0])
    for value in coefficients[1:]:
        acc = acc * x + F.lit(value)
    return acc


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution at p in (0, 1)."""
    low = F.sqrt(F.lit(-2.0) * F.log(F.least(p, F.lit(_TAIL))))
    high = F.sqrt(F.lit(-2.0) * F.log(F.least(F.lit(1.0) - p, F.lit(_TAIL))))
    mid = p - F.lit(0.5)
    square = mid * mid
    one = F.lit(1.0)
    return (
        F.when(p < _TAIL, _poly(_C, low) / (_poly(_D, low) * low + one))
        .when(p > 1.0 - _TAIL, -_poly(_C, high) / (_poly(_D, high) * high + one))
        .otherwise(_poly(_A, square) * mid / (_poly(_B, square) * square + one))
    )


def truncated_normal(mean: float, sd: float, low: float, high: float, row_id: Column, salt: str = "truncnorm") -> Column:
    """Normal draw restricted to [low, high], by inverting the distribution function."""
    start, stop = normal_cdf((low - mean) / sd), normal_cdf((high - mean) / sd)
    share = F.lit(start) + u(row_id, salt) * F.lit(stop - start)
    # keep the share inside (0, 1) where the inverse is finite
    share = F.greatest(F.lit(1e-15), F.least(share, F.lit(1.0 - 1e-15)))
    value = F.lit(float(mean)) + F.lit(float(sd)) * inverse_normal(share)
    return F.greatest(F.lit(float(low)), F.least(value, F.lit(float(high))))
