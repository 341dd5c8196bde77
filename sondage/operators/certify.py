"""Facts that a fitted model must satisfy, recomputed from the rows by plain aggregations.

A solver's own report is not read here: gradients, moments and distances are
summed anew over the table, so a wrong fit shows. Each function gives a
dictionary of named figures; ``facts`` makes rows of them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage import vocab
from sondage.operators.models import Fitted, class_weights
from sondage.operators.scale import feature_array
from sondage.operators.schema import ref


def facts(df: DataFrame, figures: dict[str, float | bool]) -> DataFrame:
    """(fact, value) rows; a truth is 1."""
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in figures.items()], "fact string, value double")


def _weight(target: str, weights: dict | None) -> Column:
    out = F.lit(1.0)
    for c, w in (weights or {}).items():
        out = F.when(ref(target) == F.lit(c), F.lit(float(w))).otherwise(out)
    return out


def _linear(values: list[float], constant: float, features: list[str]) -> Column:
    x = feature_array(features)
    products = F.zip_with(x, F.array(*[F.lit(float(v)) for v in values]), lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(float(constant)), lambda acc, v: acc + v)


def logistic_facts(df: DataFrame, fitted: Fitted, target: str = vocab.TARGET, balanced: bool = True) -> dict[str, float]:
    """Of the ridge logistic loss: its largest partial derivative at the fit, the loss, and the weighted mean score.

    At the minimum all derivatives are 0, so the weighted mean score is the weighted share of the positive class.
    """
    weights = class_weights(df, target) if balanced else None
    beta = [float(v) for v in fitted.model.coefficients.toArray()]
    rows = df.select(F.transform(feature_array(fitted.features), lambda v: v.cast("double")).alias("x"), ref(target).cast("double").alias("y"), _weight(target, weights).alias("w"),
                     _linear(beta, float(fitted.model.intercept), fitted.features).alias("m"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("m")))
    # ln(1 + e^m) - y m without overflow
    loss = F.greatest(F.col("m"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("m"))) - F.col("y") * F.col("m")
    pull = [F.sum(F.col("w") * (p - F.col("y")) * F.get("x", j)) for j in range(len(beta))]
    row = rows.agg(F.sum("w"), F.sum(F.col("w") * p), F.sum(F.col("w") * (p - F.col("y"))), F.sum(F.col("w") * loss), *pull).first()
    mass = row[0]
    slope = [row[4 + j] / mass + b / mass for j, b in enumerate(beta)] + [row[2] / mass]
    return {"mean_score": row[1] / mass, "steepest": max(map(abs, slope)), "loss": row[3] / mass + sum(b * b for b in beta) / (2 * mass)}


def svm_facts(df: DataFrame, fitted: Fitted, target: str = vocab.TARGET) -> dict[str, float]:
    """Of the ridge hinge loss: its value at the fit, and the part of it that no dual point reached explains.

    Any weights between 0 and 1 on the rows, balanced between the classes, bound the least loss from below. Rows
    well inside the margin weigh 1, those outside 0, with a ramp between; the best of some ramps is taken.
    """
    beta = [float(v) for v in fitted.model.coefficients.toArray()]
    sign = ref(target).cast("double") * 2 - 1
    rows = df.select(F.transform(feature_array(fitted.features), lambda v: v.cast("double")).alias("x"), sign.alias("s"), _weight(target, class_weights(df, target)).alias("w"),
                     (sign * _linear(beta, float(fitted.model.intercept), fitted.features)).alias("m"))
    ramps = [0.002, 0.01, 0.05, 0.2]
    parts = []
    for r in ramps:
        a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(1.0 + r) - F.col("m")) / (2 * r))) * F.col("w")
        for s in (1, -1):
            mine = F.when(F.col("s") == s, a).otherwise(0.0)
            parts += [F.sum(mine), *[F.sum(mine * F.get("x", j)) for j in range(len(beta))]]
    row = rows.agg(F.sum("w"), F.sum(F.col("w") * F.greatest(F.lit(0.0), 1 - F.col("m"))), *parts).first()
    mass, size = row[0], len(beta) + 1
    primal = row[1] / mass + sum(b * b for b in beta) / (2 * mass)
    best = -math.inf
    for k in range(len(ramps)):
        up, down = (np.array(row[2 + (2 * k + j) * size:2 + (2 * k + j + 1) * size], dtype=float) for j in (0, 1))
        if up[0] <= 0 or down[0] <= 0:
            continue
        # the heavier class is scaled down, so both sides balance
        even = min(up[0], down[0])
        up, down = up * even / up[0], down * even / down[0]
        pull = (up[1:] - down[1:]) / mass
        best = max(best, 2 * even / mass - mass / 2 * float(pull @ pull))
    return {"loss": primal, "gap": (primal - best) / primal}


def kmeans_facts(labelled: DataFrame, columns: list[str], centres: list, label: str) -> dict[str, float]:
    """Of a clustering: the squares around the centres, those of the whole table as the sum of its parts, rows not in their nearest centre's cluster, and how far a centre lies from its members' mean.

    Squares around the members' means and between these means add up to those around the mean of all rows.
    """
    x = F.transform(feature_array(columns), lambda v: v.cast("double"))
    ways = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    rows = labelled.select(x.alias("x"), ref(label).alias("c")).withColumn("ways", F.array(*ways))
    own = F.get("ways", F.col("c"))
    means = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("within"), F.count_if(own > F.array_min("ways") * (1 + 1e-9)).alias("astray"), *[F.avg(F.get("x", j)).alias(f"m{j}") for j in range(len(columns))]).collect()
    n = np.array([r["n"] for r in means], dtype=float)
    m = np.array([[r[f"m{j}"] for j in range(len(columns))] for r in means])
    middle = (n[:, None] * m).sum(axis=0) / n.sum()
    off = m - np.array([np.asarray(centres[r["c"]], dtype=float) for r in means])
    drift, within = float(np.abs(off).max()), float(sum(r["within"] for r in means))
    between = float((n * ((m - middle) ** 2).sum(axis=1)).sum())
    return {"within": within, "squares": within - float((n * (off**2).sum(axis=1)).sum()) + between, "astray": float(sum(r["astray"] for r in means)), "drift": drift, "rows": float(n.sum())}


def mixture_facts(labelled: DataFrame, weights: list[float], means: list, probabilities: str = "probabilities") -> dict[str, float]:
    """Of a Gaussian mixture: sums of its weights and of each row's probabilities, and its mean vector, which is that of the rows after each round of its fit."""
    total = F.aggregate(ref(probabilities), F.lit(0.0), lambda a, v: a + v)
    off = labelled.agg(F.max(F.abs(total - 1)).alias("off")).first()["off"]
    middle = (np.array(weights)[:, None] * np.array([list(map(float, m)) for m in means])).sum(axis=0)
    return {"weights": float(sum(weights)), "off": float(off), **{f"mean_{j}": float(v) for j, v in enumerate(middle)}}


def pca_facts(df: DataFrame, fit) -> dict[str, float]:
    """Of principal components: how far they are from orthonormal, how far C v is from a multiple of v, and the share that all of them explain.

    C is the matrix of correlations, summed anew; the eigenvalues follow from it, so order and shares are checked too.
    """
    known = df.select(*[ref(c).cast("double").alias(f"x{j}") for j, c in enumerate(fit.features)]).dropna()
    d, v = len(fit.features), fit.model.pc.toArray()
    scaled = known.select(F.array(*[(F.col(f"x{j}") - F.lit(m)) / F.lit(s) for j, (m, s) in enumerate(zip(fit.scaler.centre, fit.scaler.spread))]).alias("x"))
    cells = scaled.select(F.posexplode("x").alias("i", "a"), "x").select("i", F.posexplode(F.transform("x", lambda b: b * F.col("a"))).alias("j", "p"))
    c = np.zeros((d, d))
    for r in cells.groupBy("i", "j").agg(F.avg("p").alias("p")).collect():
        c[r["i"], r["j"]] = r["p"]
    values = np.array([v[:, k] @ c @ v[:, k] for k in range(d)])
    return {
        "skew": float(np.abs(v.T @ v - np.eye(d)).max()), "residual": float(np.abs(c @ v - v * values).max()), "falling": bool((np.diff(values) <= 1e-8).all()),
        "shares": float(np.abs(np.array(fit.ratios) - values / values.sum()).max()), "trace": float(np.trace(c)), "total": float(sum(fit.ratios)),
    }


def forest_facts(df: DataFrame, fitted: Fitted, target: str = vocab.TARGET) -> dict[str, float]:
    """Of trees: whether importances and probabilities sum to 1, and the part of the rows that the model gets right beyond the largest class."""
    out = fitted.model.transform(df.withColumn("features", array_to_vector(feature_array(fitted.features))))
    total = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, v: a + v)
    row = out.agg(F.max(F.abs(total - 1)), F.avg((F.col("prediction") == ref(target)).cast("double")), F.avg(ref(target).cast("double"))).first()
    return {"off": float(row[0]), "right": float(row[1]), "beyond": float(row[1] - max(row[2], 1 - row[2])), "importances": float(sum(fitted.model.featureImportances.toArray()))}

