"""Linear support vectors by an interior-point method on the dual.

A step needs sums over the rows of the size of the features' square, however many rows there are, and a few dozen steps end it. All
rows are learned from in one task where they are few; else they stay in parts, and a step is two jobs.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators.trees import PART_ROWS, coded_arrays, plain_arrays
from sondage.session import ensure_checkpoint_dir


@dataclass
class Summary:
    objectiveHistory: list[float]


@dataclass
class LinearSVCModel:
    """Coefficients and intercept; ``transform`` adds ``rawPrediction`` and ``prediction``, as MLlib's model does."""

    coefficients: DenseVector
    intercept: float
    history: list[float]

    def summary(self) -> Summary:
        return Summary(self.history)

    def transform(self, df: DataFrame) -> DataFrame:
        products = F.zip_with(vector_to_array("features"), F.array(*[F.lit(float(v)) for v in self.coefficients.toArray()]), lambda a, b: a * b)
        out = df.withColumn("__m", F.aggregate(products, F.lit(float(self.intercept)), lambda s, v: s + v))
        return out.withColumns({"rawPrediction": array_to_vector(F.array(-F.col("__m"), F.col("__m"))), "prediction": (F.col("__m") > 0).cast("double")}).drop("__m")


@dataclass
class Part:
    """Rows of one part: ``a`` holds features times sign, ``c`` the weights; ``alpha`` lies between 0 and c, ``v`` and ``u`` press on its two ends."""

    a: np.ndarray
    s: np.ndarray
    c: np.ndarray
    alpha: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros(0))
    u: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.a, self.s, self.c, self.alpha, self.v, self.u

    def totals(self) -> list[np.ndarray]:
        """Of a first look: weight by side, and the weighted features of each."""
        up, down = self.s > 0, self.s < 0
        return [np.array([self.c[up].sum(), self.c[down].sum()]), self.c[up] @ self.a[up], self.c[down] @ self.a[down]]

    def spread(self, w: np.ndarray) -> np.ndarray:
        return np.array([np.abs(self.a @ w - 1.0).sum(), len(self.s)])

    def begun(self, share: tuple[float, float], w: np.ndarray, room: float) -> Part:
        alpha = self.c * np.where(self.s > 0, *share)
        far = self.a @ w - 1.0
        return Part(self.a, self.s, self.c, alpha, np.maximum(far, 0.0) + room, np.maximum(-far, 0.0) + room)

    def _system(self, w: np.ndarray, b: float, mu: float) -> tuple[np.ndarray, np.ndarray]:
        rest = self.c - self.alpha
        slope = self.a @ w + self.s * b - 1.0 - mu / self.alpha + mu / rest
        return 1.0 / (self.v / self.alpha + self.u / rest), -slope

    def sums(self, w: np.ndarray, b: float, mu: float) -> list[np.ndarray]:
        """What a step's equations are made of, and the loss where it starts."""
        inverse, g = self._system(w, b, mu)
        scaled = self.a * inverse[:, None]
        hinge = (self.c * np.maximum(0.0, 1.0 - self.a @ w - self.s * b)).sum()
        return [self.a.T @ scaled, scaled.T @ g, scaled.T @ self.s, np.array([(self.s * inverse) @ g, (self.s * inverse) @ self.s, self.s @ self.alpha, hinge])]

    def _step(self, w, b, mu, db, q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inverse, g = self._system(w, b, mu)
        rest, da = self.c - self.alpha, inverse * (g - self.s * db - self.a @ q)
        return da, (mu - self.v * da) / self.alpha - self.v, (mu + self.u * da) / rest - self.u

    def longest(self, *step) -> float:
        """The part of a step after which something comes to its end."""
        da, dv, du = self._step(*step)
        pairs = ((self.alpha, da), (self.c - self.alpha, -da), (self.v, dv), (self.u, du))
        return min((float((-x[d < 0] / d[d < 0]).min()) for x, d in pairs if (d < 0).any()), default=np.inf)

    def moved(self, size: float, *step) -> Part:
        da, dv, du = self._step(*step)
        return Part(self.a, self.s, self.c, self.alpha + size * da, self.v + size * dv, self.u + size * du)

    def gap(self) -> float:
        return float(self.alpha @ self.v + (self.c - self.alpha) @ self.u)


class Here:
    """All rows in this task."""

    def __init__(self, part: Part):
        self.part = part

    def each(self, ask) -> list:
        return [ask(self.part)]

    def become(self, change) -> None:
        self.part = change(self.part)


class Spread:
    """Rows in many parts; a changed table is kept when it is first asked."""

    def __init__(self, parts):
        self.parts, self.before, self.times = parts.persist(StorageLevel.MEMORY_AND_DISK), None, 0

    def each(self, ask) -> list:
        out = self.parts.map(lambda held: ask(Part(*held))).collect()
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        return out

    def become(self, change) -> None:
        self.before, self.parts, self.times = self.parts, self.parts.map(lambda held: change(Part(*held)).arrays()).persist(StorageLevel.MEMORY_AND_DISK), self.times + 1
        if self.times % 10 == 0:
            self.parts.checkpoint()


def _added(told: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.sum(part, axis=0) for part in zip(*told)]


def solve(rows: Here | Spread, mass: float, steps: int, tol: float) -> tuple[np.ndarray, float, list[float]]:
    """(coefficients, intercept, loss after each step) of the least half square of the coefficients plus the weighted hinge losses.

    Every point is feasible on both sides, so the gap between them bounds what is left; it ends the search at ``tol`` of a tenth of the loss.
    """
    sides, up, down = _added(rows.each(lambda p: p.totals()))
    if sides.min() <= 0:
        # one class: no loss at all
        return np.zeros(len(up)), float(np.sign(sides[0] - sides[1])), [1.0, 0.0]
    share = tuple(0.5 * sides.min() / sides)
    w, b, history = share[0] * up + share[1] * down, 0.0, []
    wide = np.sum(rows.each(lambda p, w=w: p.spread(w)), axis=0)
    room = 1e-3 + wide[0] / wide[1]
    rows.become(lambda p, w=w: p.begun(share, w, room))
    count, aim = 2.0 * wide[1], 0.1
    gap = float(np.sum(rows.each(lambda p: p.gap())))
    for _ in range(steps + 1):
        mu = aim * gap / count
        square, pull, lean, few = _added(rows.each(lambda p, w=w, b=b, mu=mu: p.sums(w, b, mu)))
        loss = 0.5 * float(w @ w) + few[3]
        history.append(loss / mass)
        if len(history) > steps or gap <= 0.1 * tol * loss:
            break
        solved = np.linalg.lstsq(np.eye(len(w)) + square, np.stack((pull, lean), axis=1), rcond=None)[0]
        db = (few[0] - lean @ solved[:, 0] + few[2]) / max(few[1] - lean @ solved[:, 1], 1e-300)
        q = solved[:, 0] - db * solved[:, 1]
        if not (np.isfinite(db) and np.isfinite(q).all()):
            break
        step = (w, b, mu, db, q)
        size = min(1.0, 0.99 * min(rows.each(lambda p, step=step: p.longest(*step))))
        if size < 1e-10:
            break
        rows.become(lambda p, size=size, step=step: p.moved(size, *step))
        # the equations of the step say what it leaves of the gap
        gap = gap * (1 - size + size * aim) + size * size * float(q @ q)
        w, b, aim = w + size * q, b + size * db, 0.03 if size > 0.8 else 0.1 if size > 0.5 else 0.4
    return w, b, history


@dataclass
class LinearSVC:
    """MLlib's settings of the ridge hinge loss: the mean weighted loss plus ``regParam`` times half the square of the coefficients."""

    regParam: float
    maxIter: int = 100
    tol: float = 1e-3
    weightCol: str = "weight"
    standardization: bool = False
    part_rows: int = PART_ROWS

    def fit(self, rows: DataFrame) -> LinearSVCModel:
        plain = plain_arrays(rows.withColumn("weight", F.col(self.weightCol))).filter("w > 0").persist()
        n, mass, d = plain.agg(F.count(F.lit(1)), F.sum("w"), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows to learn from")
        parts, steps, tol = -(-n // self.part_rows), self.maxIter, self.tol
        # the solver's losses are summed, MLlib's a mean
        scale = 1.0 / (self.regParam * mass)

        def part(batches) -> Part:
            x, y, w = coded_arrays(batches, d)
            sign = y * 2 - 1
            return Part(x * sign[:, None], sign, w * scale)

        dealt = plain.repartition(parts)
        if parts == 1:
            def learn(batches):
                yield pd.DataFrame({"made": [pickle.dumps(solve(Here(part(batches)), mass * scale, steps, tol))]})

            w, b, history = pickle.loads(dealt.mapInPandas(learn, "made binary").collect()[0]["made"])
        else:
            def block(batches):
                yield pd.DataFrame({"block": [pickle.dumps(part(batches).arrays())]})

            ensure_checkpoint_dir(rows.sparkSession)
            spread = Spread(dealt.mapInPandas(block, "block binary").rdd.map(lambda r: pickle.loads(bytes(r[0]))))
            w, b, history = solve(spread, mass * scale, steps, tol)
            spread.parts.unpersist()
        plain.unpersist()
        return LinearSVCModel(Vectors.dense(w), float(b), [float(v) for v in history])
