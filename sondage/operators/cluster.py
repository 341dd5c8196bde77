"""PCA, k-means, mixtures, isolation trees."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sondage import vocab
from sondage.functions.draws import u, u_hash
from sondage.functions.literals import list_literal
from sondage.operators.metrics import silhouette, silhouette_1d, silhouettes_exact
from sondage.operators.order import quantiles
from sondage.operators.profile import argmin_group
from sondage.operators.scale import ScalerParams, apply_scaler, feature_array, fit_standard, risk_score
from sondage.operators.schema import drop_null_rows, numeric_columns, ref
from sondage.session import BLOCK_ROWS, cut_lineage

# ------------------------------------------------------------------------ PCA


@dataclass
class PcaFit:
    features: list[str]
    scaler: ScalerParams
    model: object
    signs: list[float]
    ratios: list[float]
    components: int
    threshold: float

    @property
    def cumulative(self) -> list[float]:
        return list(np.cumsum(self.ratios))


def fit_pca(df: DataFrame, threshold: float = 0.80, target: str = "Risk_Score", row_id: str | None = None) -> PcaFit:
    """Standardised PCA; keeps the fewest components that reach the threshold.

    One pass gives means and deviations, one the d x d covariance; all
    components come from it at once, so nothing is fitted twice.
    """
    features = [c for c in numeric_columns(df) if c not in (target, row_id)]
    known = drop_null_rows(df, features)
    scaler = fit_standard(known, features)
    vectors = apply_scaler(known.select(*[ref(c) for c in features]), scaler).select(array_to_vector(feature_array(features)).alias("x"))
    model = PCA(k=len(features), inputCol="x", outputCol="pc").fit(vectors)
    ratios = [float(v) for v in model.explainedVariance]
    reached = np.cumsum(ratios) >= threshold - 1e-12
    components = int(np.argmax(reached)) + 1 if reached.any() else len(ratios)
    matrix = model.pc.toArray()
    signs = [1.0 if matrix[np.abs(matrix[:, j]).argmax(), j] >= 0 else -1.0 for j in range(matrix.shape[1])]
    return PcaFit(features, scaler, model, signs, ratios, components, threshold)


def project_pca(df: DataFrame, fit: PcaFit) -> DataFrame:
    """Adds PC1..PCm; rows with gaps are left out, as they were in the fit."""
    known = drop_null_rows(df, fit.features)
    scaled = [(ref(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(fit.scaler.columns, fit.scaler.centre, fit.scaler.spread)]
    out = fit.model.transform(known.withColumn("x", array_to_vector(F.array(*scaled)))).withColumn("pc", vector_to_array("pc"))
    return out.withColumns({f"PC{i + 1}": F.get("pc", i) * F.lit(fit.signs[i]) for i in range(fit.components)}).drop("x", "pc")


def loadings(df: DataFrame, fit: PcaFit) -> DataFrame:
    """(feature, PC1, ..., PCm); the largest loading of a component is positive."""
    matrix = fit.model.pc.toArray() * np.array(fit.signs)
    rows = [(c, *[float(v) for v in matrix[i, :fit.components]]) for i, c in enumerate(fit.features)]
    columns = ", ".join(f"PC{i + 1} double" for i in range(fit.components))
    return df.sparkSession.createDataFrame(rows, f"feature string, {columns}")


def top_loadings(table: DataFrame, n: int = 10) -> DataFrame:
    return table.orderBy(F.desc(F.abs("PC1")), "feature").limit(n)


def scree_rows(df: DataFrame, fit: PcaFit) -> DataFrame:
    """(component, ratio, cumulative, kept)."""
    rows = [(i + 1, r, float(c), i < fit.components) for i, (r, c) in enumerate(zip(fit.ratios, fit.cumulative))]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double, kept boolean")


# -------------------------------------------------------------------- k-means


@dataclass
class Centres:
    """The centres of a clustering; rows belong to the nearest one."""

    values: np.ndarray

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  (as MLlib's models name it)
        return list(self.values)


@dataclass
class KMeansRange:
    models: dict[int, Centres]
    labelled: DataFrame
    table: DataFrame
    best: int


def _with_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("features", array_to_vector(feature_array(columns)))


def _packed(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """(ids, x): up to ``BLOCK_ROWS`` rows as the bytes of their ids' hashes and of their values, so a pass costs little more than its arithmetic."""

    def run(batches):
        for t in batches:
            for at in range(0, t.num_rows, BLOCK_ROWS):
                b = t.slice(at, BLOCK_ROWS)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_pydict({"ids": pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    values = F.transform(feature_array(columns), lambda v: v.cast("double"))
    return df.select(F.xxhash64(ref(row_id)).alias("id"), values.alias("x")).mapInArrow(run, "ids binary, x binary")


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    far = x @ (centres.T * -2.0)
    far += (x * x).sum(axis=1)[:, None]
    far += (centres * centres).sum(axis=1)
    return np.maximum(far, 0.0, out=far)


def _pass(packed: DataFrame, d: int, fn, schema: str) -> DataFrame:
    """What ``fn`` gives for the blocks of a part, (hashes of the ids, rows) one after the other."""

    def run(batches):
        def blocks():
            for b in batches:
                for ids, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield np.frombuffer(ids, dtype=np.int64).view(np.uint64), np.frombuffer(x).reshape(-1, d)

        yield from fn(blocks())

    return packed.mapInArrow(run, schema)


def _summed(packed: DataFrame, d: int, sets: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Of each set of centres the rows that are nearest to each centre, their sums, and the squares around the centres, in one pass."""

    def fn(blocks):
        n = {f: np.zeros(len(c)) for f, c in sets.items()}
        sums = {f: np.zeros((len(c), d)) for f, c in sets.items()}
        cost = dict.fromkeys(sets, 0.0)
        for _, x in blocks:
            every = _squares(x, np.concatenate(list(sets.values())))
            at = 0
            for f, c in sets.items():
                far, at = every[:, at:at + len(c)], at + len(c)
                near = far.argmin(axis=1)
                cost[f] += float(far[np.arange(len(x)), near].sum())
                hot = (near == np.arange(len(c))[:, None]).astype(float)
                n[f] += hot.sum(axis=1)
                sums[f] += hot @ x
        rows = [(f, i, np.concatenate((sums[f][i], [n[f][i], cost[f]]))) for f in sets for i in range(len(sets[f]))]
        fit, centre, v = zip(*rows)
        yield pa.RecordBatch.from_pydict({"fit": pa.array(fit, pa.int32()), "centre": pa.array(centre, pa.int32()), "v": pa.array(list(v), pa.list_(pa.float64()))})

    # the sums of parts meet in a shuffle; only those of the centres reach the driver
    parts = _pass(packed, d, fn, "fit int, centre int, v array<double>").select("fit", "centre", F.posexplode("v").alias("j", "v"))
    out = {f: np.zeros((len(c), d + 2)) for f, c in sets.items()}
    got = parts.groupBy("fit", "centre", "j").agg(F.sum("v").alias("v")).toArrow()
    fit, centre, j, v = (got[c].to_numpy() for c in ("fit", "centre", "j", "v"))
    for f in out:
        mine = fit == f
        out[f][centre[mine], j[mine]] = v[mine]
    return {f: (v[:, d], v[:, :d], float(v[0, d + 1])) for f, v in out.items()}


def _draw(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 that follow from the hash of an id and a salt."""
    h = ids ^ (np.uint64(salt % 2**31 + 1) * np.uint64(0x9E3779B97F4A7C15))
    for _ in range(2):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(11)) / float(1 << 53)


def _starts(packed: DataFrame, d: int, tasks: list[tuple[int, int]], seed: int, steps: int = 2) -> dict[int, np.ndarray]:
    """First centres of all fits, by k-means||: per step about 2k rows drawn by their squared distance to the candidates so far, which are then
    weighed by the rows nearest to them and drawn from by k-means++. All fits share the passes."""

    def drawn(chances: dict[int, np.ndarray | None], scale: dict[int, float]):
        def fn(blocks):
            fits, rows, first = [], [], {}
            for ids, x in blocks:
                for f, c in chances.items():
                    u_ = _draw(ids, seed + 1000 * f + 17 * (0 if c is None else len(c)))
                    if c is None:
                        # the row of the smallest draw
                        i = int(u_.argmin())
                        if f not in first or (u_[i], x[i].tobytes()) < first[f][:2]:
                            first[f] = (float(u_[i]), x[i].tobytes(), x[i])
                    else:
                        for i in np.flatnonzero(u_ < scale[f] * _squares(x, c).min(axis=1)):
                            fits.append(f)
                            rows.append((float(u_[i]), x[i]))
            fits, rows = fits + list(first), rows + [(v[0], v[2]) for v in first.values()]
            yield pa.RecordBatch.from_pydict({"fit": pa.array(fits, pa.int32()), "u": pa.array([r[0] for r in rows], pa.float64()), "x": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})

        return _pass(packed, d, fn, "fit int, u double, x array<double>")

    # bounded: one row, then about 2k rows, for each fit
    held = {r["fit"]: np.array([r["x"]]) for r in drawn(dict.fromkeys(range(len(tasks))), {}).groupBy("fit").agg(F.min_by("x", F.struct("u", "x")).alias("x")).collect()}
    for _ in range(steps):
        cost = {f: v[2] for f, v in _summed(packed, d, held).items()}
        scale = {f: 2.0 * tasks[f][0] / v for f, v in cost.items() if v > 0}
        for r in drawn({f: held[f] for f in scale}, scale).groupBy("fit").agg(F.sort_array(F.collect_list("x")).alias("x")).collect():
            held[r["fit"]] = np.unique(np.concatenate((held[r["fit"]], np.array(r["x"]))), axis=0)
    weights = {f: v[0] for f, v in _summed(packed, d, held).items()}
    out = {}
    for f, c in held.items():
        k, rng = tasks[f][0], np.random.default_rng([seed, f])
        if len(c) <= k:
            out[f] = c
            continue
        picked = [int(rng.choice(len(c), p=weights[f] / weights[f].sum()))]
        for _ in range(k - 1):
            share = weights[f] * _squares(c, c[picked]).min(axis=1)
            share[picked] = 0.0
            picked.append(int(rng.choice(len(c), p=share / share.sum())) if share.sum() > 0 else int(np.setdiff1d(np.arange(len(c)), picked)[0]))
        out[f] = c[picked]
    return out


def kmeans_range(df: DataFrame, columns: list[str], row_id: str, ks=range(2, 11), n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4, mode: str = "fast") -> KMeansRange:
    """k-means per k, the best of ``n_init`` starts; labels k2, k3, ... side by side.

    All starts of all k take their rounds together: one pass over the rows and one small table of sums serve every fit
    that still moves. ``mode`` names
    the silhouette as in ``metrics.silhouette``; the exact ones of all k share one
    pass over the distances.
    """
    ks, d = list(ks), len(columns)
    known = drop_null_rows(df, columns)
    data = known.select(ref(row_id), *[ref(c) for c in columns]).persist()
    packed = _packed(data, columns, row_id).persist()
    tasks = [(k, s) for k in ks for s in range(n_init)]
    centres = _starts(packed, d, tasks, seed)
    if not centres:
        raise ValueError("no rows to cluster")
    moving = dict(centres)
    for _ in range(max_iter):
        for f, (n, sums, _) in _summed(packed, d, moving).items():
            # a centre without rows stays where it is
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1.0)[:, None], centres[f])
            if (((moved - centres[f]) ** 2).sum(axis=1) <= tol * tol).all():
                del moving[f]
            else:
                moving[f] = moved
            centres[f] = moved
        if not moving:
            break
    cost = {f: v[2] for f, v in _summed(packed, d, centres).items()}
    packed.unpersist()
    best = {k: min((f for f in centres if tasks[f][0] == k), key=lambda f: (cost[f], f)) for k in ks}
    models = {k: Centres(centres[best[k]]) for k in ks}

    def labels(batches):
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, d)
            near = [pa.array(_squares(x, models[k].values).argmin(axis=1).astype(np.int32)) for k in ks]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *near], names=[*b.schema.names[:-1], *[f"k{k}" for k in ks]])

    schema = StructType([*data.schema.fields, *[StructField(f"k{k}", IntegerType()) for k in ks]])
    values = F.transform(feature_array(columns), lambda v: v.cast("double"))
    labelled = _with_features(data.withColumn("__x", values).mapInArrow(labels, schema), columns).persist()
    if mode == "exact":
        scores, metric = silhouettes_exact(labelled, columns, [f"k{k}" for k in ks], row_id), "euclidean"
        scores = {k: scores[f"k{k}"] for k in ks}
    else:
        metric = "squared_euclidean"
        scores = {k: ClusteringEvaluator(predictionCol=f"k{k}").evaluate(labelled) for k in ks}
    table = df.sparkSession.createDataFrame(
        [(k, float(cost[best[k]]), None if scores[k] is None else float(scores[k]), metric) for k in ks], "k int, inertia double, silhouette double, metric string"
    )
    return KMeansRange(models, labelled.drop("features"), table, best_k(table, "silhouette"))


def best_k(table: DataFrame, method: str = "silhouette") -> int:
    """k with the highest silhouette, or the one after the steepest fall of inertia."""
    if method == "silhouette":
        return table.agg(F.max_by("k", F.struct(F.col("silhouette"), -F.col("k")))).first()[0]
    # one row per k
    falls = table.withColumn("fall", F.col("inertia") - F.lag("inertia").over(Window.orderBy("k"))).filter("fall IS NOT NULL")
    return falls.agg(F.min_by("k", F.struct("fall", "k"))).first()[0]


def silhouette_rows(table: DataFrame) -> DataFrame:
    """Silhouette per k with a mark on the best."""
    best = best_k(table, "silhouette")
    return table.select("k", "silhouette", (F.col("k") == best).alias("best"))


@dataclass
class GmmFit:
    labelled: DataFrame
    silhouette: float | None
    metric: str
    bic: float
    aic: float
    model: object = None


def gmm(df: DataFrame, columns: list[str], k: int, row_id: str, seed: int = 42, max_iter: int = 100) -> GmmFit:
    """Full-covariance Gaussian mixture: cluster_gmm, probabilities and cluster_confidence per row."""
    known = drop_null_rows(df, columns)
    data = _with_features(known, columns).persist()
    model = GaussianMixture(k=k, seed=seed, maxIter=max_iter, tol=1e-3, predictionCol="cluster_gmm", probabilityCol="__p").fit(data)
    labelled = model.transform(data).withColumn("probabilities", vector_to_array("__p")).drop("__p", "features")
    labelled = labelled.withColumn("cluster_confidence", F.array_max("probabilities"))
    n, d = data.count(), len(columns)
    likelihood = model.summary.logLikelihood
    free = (k - 1) + k * d + k * d * (d + 1) / 2
    score, metric = silhouette(labelled, columns, "cluster_gmm", row_id)
    return GmmFit(labelled, score, metric, -2 * likelihood + free * math.log(n), -2 * likelihood + 2 * free, model)


# -------------------------------------------------- one-dimensional mixtures


def digamma(x: float) -> float:
    """Derivative of log gamma, by recurrence and the asymptotic series."""
    shift = 0.0
    while x < 8.0:
        shift -= 1.0 / x
        x += 1.0
    f = 1.0 / (x * x)
    return shift + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


@dataclass
class Mixture1D:
    """Log density of component i at x: constant[i] - (x - mean[i])^2 / (2 variance[i])."""

    column: str
    constant: list[float]
    mean: list[float]
    variance: list[float]
    rounds: int

    def log_densities(self, x: str) -> str:
        """SQL of the array of component densities at column ``x``.

        The parameters sit in array literals, so the generated code is the
        same in every round and compiles once.
        """
        constant, mean, spread = _doubles(self.constant), _doubles(self.mean), _doubles([2.0 * v for v in self.variance])
        return f"transform({constant}, (c, i) -> c - ({x} - {mean}[i]) * ({x} - {mean}[i]) / {spread}[i])"

    def cluster(self, column: str) -> Column:
        """Index of the most likely component."""
        parts = self.log_densities(f"cast(`{column}` as double)")
        return F.expr(f"cast(array_position({parts}, array_max({parts})) - 1 as int)")

    @property
    def safest(self) -> int:
        return int(np.argmin(self.mean))


def _doubles(values: list[float]) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def bayes_gmm_1d(df: DataFrame, column: str, k: int = 3, prior: float | None = None, max_iter: int = 500, tol: float = 1e-6) -> Mixture1D:
    """Variational mixture of k normals over one column, with stick-breaking weights.

    Rows are counted per distinct value once. Each round is one aggregation of
    k x 3 sums over those counts; only these sums reach the driver.
    """
    prior = 1.0 / k if prior is None else prior
    x = ref(column).cast("double")
    counts = df.filter(x.isNotNull()).groupBy(x.alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # a checkpoint leaves a leaf plan, so the rounds below plan fast and survive lost executors
    distinct = cut_lineage(counts)
    total, shift = distinct.agg(F.sum("n"), F.sum(F.col("n") * F.col("x")) / F.sum("n")).first()
    if total is None:
        raise ValueError(f"no values in {column}")
    # all sums below are of values less the mean, so a large mean does not eat up a small spread
    distinct = distinct.select((F.col("x") - F.lit(shift)).alias("x"), "n")
    centre, spread = distinct.agg(F.sum(F.col("n") * F.col("x")) / F.sum("n"), F.sum(F.col("n") * F.col("x") * F.col("x"))).first()
    variance = max((spread - total * centre * centre) / max(total - 1, 1), 1e-12)
    cut = quantiles(distinct.withColumn("w", F.col("n").cast("long")), ["x"], [(i + 0.5) / k for i in range(k)], weight="w")["x"]
    means = [float(v) for v in cut]

    picks = [f"sum(n * shares[{i}]{x})" for i in range(k) for x in ("", " * x", " * x * x")] + ["sum(n * norm)"]

    def sums(shares: DataFrame):
        row = shares.selectExpr(*picks).first()
        return [row[3 * i:3 * i + 3] for i in range(k)], row[3 * k]

    state = None
    for _ in range(20):  # nearest-centre rounds give the starting shares
        gaps = distinct.selectExpr("x", "n", f"transform({_doubles(means)}, m -> abs(x - m)) AS gaps")
        nearest = f"transform(sequence(1, {k}), i -> cast(array_position(gaps, array_min(gaps)) = i as double)) AS shares"
        state, _ = sums(gaps.selectExpr("x", "n", nearest, "0.0D AS norm"))
        moved = [s[1] / s[0] if s[0] else m for s, m in zip(state, means)]
        if max(abs(a - b) for a, b in zip(moved, means)) < 1e-9:
            break
        means = moved
    previous, mixture = None, None
    for step in range(max_iter):
        mass = [s[0] + 1e-15 for s in state]
        middle = [s[1] / m for s, m in zip(state, mass)]
        scatter = [max(s[2] / m - c * c, 0.0) + 1e-6 for s, m, c in zip(state, mass, middle)]
        later = [sum(mass[i + 1:]) for i in range(k)]
        a, b = [1.0 + m for m in mass], [prior + t for t in later]
        precision = [1.0 + m for m in mass]
        mean = [(centre + m * c) / p for m, c, p in zip(mass, middle, precision)]
        freedom = [1.0 + m for m in mass]
        var = [(variance + m * s + m / p * (c - centre) ** 2) / f for m, s, p, c, f in zip(mass, scatter, precision, middle, freedom)]
        constant, stick = [], 0.0
        for i in range(k):
            whole = digamma(a[i] + b[i])
            log_weight = digamma(a[i]) - whole + stick
            stick += digamma(b[i]) - whole
            log_scale = math.log(2.0) + digamma(freedom[i] / 2.0) - math.log(freedom[i])
            constant.append(log_weight - 0.5 * (math.log(2 * math.pi) + math.log(var[i])) + 0.5 * (log_scale - 1.0 / precision[i]))
        mixture = Mixture1D(column, constant, mean, var, step + 1)
        dense = distinct.selectExpr("x", "n", f"{mixture.log_densities('x')} AS parts")
        normed = dense.selectExpr("x", "n", "parts", "array_max(parts) + ln(aggregate(parts, 0.0D, (a, p) -> a + exp(p - array_max(parts)))) AS norm")
        state, level = sums(normed.selectExpr("x", "n", "transform(parts, p -> exp(p - norm)) AS shares", "norm"))
        level /= total
        if previous is not None and abs(level - previous) < tol:
            break
        previous = level
    return Mixture1D(column, mixture.constant, [m + shift for m in mixture.mean], mixture.variance, mixture.rounds)


def risk_clusters(df: DataFrame, ks=range(2, 9), weights: dict[str, float] | None = None, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """(scored rows with Cluster and level, silhouette per component count).

    The component counts are independent and run side by side.
    """
    scored = cut_lineage(risk_score(df, weights))

    def fit(k: int):
        mixture = bayes_gmm_1d(scored, "Risk_Score", k)
        labelled = scored.withColumn("Cluster", mixture.cluster("Risk_Score"))
        return k, silhouette_1d(labelled.select("Risk_Score", "Cluster"), "Risk_Score", "Cluster"), mixture

    with ThreadPoolExecutor(parallel) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(fit), ks))
    usable = [f for f in found if f[1] is not None and f[1] == f[1]]
    if not usable:
        raise ValueError("no valid clustering found")
    best = max(usable, key=lambda f: f[1])[2]
    labelled = scored.withColumn("Cluster", best.cluster("Risk_Score"))
    safe = argmin_group(labelled, "Cluster", "Risk_Score")
    out = labelled.withColumn(vocab.TARGET, F.when(F.col("Cluster") == safe, F.lit(0)).otherwise(F.lit(1)))
    table = df.sparkSession.createDataFrame([(k, s, k == len(best.mean)) for k, s, _ in found], "components int, silhouette double, best boolean")
    return out, table


# ------------------------------------------------------------- isolation trees

TREES, SAMPLE = 100, 256


def _mean_path(n: float) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(seed: int):
    """One random tree over one column, as sorted cuts and the path length between them."""

    def split(values: np.ndarray, depth: int, limit: int, rng, cuts: list, paths: list) -> None:
        if depth >= limit or len(values) <= 1 or values[0] == values[-1]:
            paths.append(depth + _mean_path(len(values)))
            return
        at = rng.uniform(values[0], values[-1])
        left = int(np.searchsorted(values, at, side="right"))
        split(values[:left], depth + 1, limit, rng, cuts, paths)
        cuts.append(float(at))
        split(values[left:], depth + 1, limit, rng, cuts, paths)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        values = np.sort(rows["x"].to_numpy(dtype=float))
        cuts, paths = [], []
        split(values, 0, math.ceil(math.log2(max(len(values), 2))), np.random.default_rng([seed, tree]), cuts, paths)
        return pd.DataFrame({"tree": [tree], "cuts": [cuts], "paths": [paths], "size": [len(values)]})

    return run


def isolation_outliers(df: DataFrame, column: str, row_id: str, contamination: float = 0.05, seed: int = 42, name: str = "Outlier") -> DataFrame:
    """Adds 1 for the rows that random trees isolate soonest, else 0.

    Trees grow from samples of 256 rows out of a pool of fixed expected size.
    A forest over one column is a step function, so rows are counted per step
    and outliers become a few value ranges: one codegen expression.
    """
    x = ref(column).cast("double")
    n = df.filter(x.isNotNull()).count()
    share = min(1.0, 4.0 * TREES * SAMPLE / max(n, 1))
    pool = df.filter(x.isNotNull() & (u(ref(row_id), f"pool:{seed}") <= share)).select(ref(row_id).alias("id"), x.alias("x"))
    each = pool.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    order = Window.partitionBy("tree").orderBy(u_hash(F.struct("id", "tree"), str(seed)), "id")
    chosen = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE).select("tree", "x")
    trees = chosen.groupBy("tree").applyInPandas(_grow(seed), "tree int, cuts array<double>, paths array<double>, size int").orderBy("tree").collect()
    cuts = np.unique(np.concatenate([np.array(t["cuts"], dtype=float) for t in trees])) if trees else np.array([])
    if not len(cuts):
        return df.withColumn(name, F.lit(0))
    # a value equal to a cut belongs to the left of it
    inside = np.append(cuts, np.inf)
    depth = np.mean([np.array(t["paths"])[np.searchsorted(np.array(t["cuts"], dtype=float), inside, side="left")] for t in trees], axis=0)
    score = -np.power(2.0, -depth / _mean_path(trees[0]["size"]))
    splits = [-float("inf"), *np.nextafter(cuts, np.inf).tolist(), float("inf")]
    steps = Bucketizer(splits=splits, inputCol="x", outputCol="step").transform(df.filter(x.isNotNull()).select(x.alias("x")))
    held = np.zeros(len(inside))
    for r in steps.groupBy("step").count().collect():
        held[int(r["step"])] = r["count"]
    by_score = np.argsort(score, kind="stable")
    ends = np.cumsum(held[by_score])
    at = contamination * (n - 1)
    low = score[by_score[np.searchsorted(ends, math.floor(at), side="right")]]
    high = score[by_score[min(np.searchsorted(ends, math.ceil(at), side="right"), len(ends) - 1)]]
    cut = low + (at - math.floor(at)) * (high - low)
    flagged = score < cut
    ranges, begin = [], None
    for i, hit in enumerate(np.append(flagged, False)):
        if hit and begin is None:
            begin = i
        elif not hit and begin is not None:
            ranges.append((splits[begin], splits[i]))
            begin = None
    lows, highs = list_literal([f"{a!r}" for a, _ in ranges] or ["0"]).cast("array<double>"), list_literal([f"{b!r}" for _, b in ranges] or ["0"]).cast("array<double>")
    hit = F.exists(F.arrays_zip(lows.alias("a"), highs.alias("b")), lambda r: (x >= r["a"]) & (x < r["b"]))
    return df.withColumn(name, F.coalesce(hit.cast("int"), F.lit(0)))


# ------------------------------------------------------------------ comparison


def clustering_summary(df: DataFrame, k: int, kmeans_silhouette: float, fit: GmmFit, ari: float, agreed: float) -> DataFrame:
    """(metric, value): the eight figures of a clustering run; a labeling with one cluster has no silhouette."""
    rows = [
        ("Optimal K", float(k)), ("K-Means Silhouette", kmeans_silhouette), ("GMM Silhouette", fit.silhouette),
        ("Silhouette Difference", None if None in (kmeans_silhouette, fit.silhouette) else abs(kmeans_silhouette - fit.silhouette)), ("Adjusted Rand Index", ari),
        ("Agreement Rate (%)", agreed * 100.0), ("GMM BIC", fit.bic), ("GMM AIC", fit.aic),
    ]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def comparison_rows(df: DataFrame, kmeans_silhouette: float, gmm_silhouette: float, a: str = "cluster_kmeans", b: str = "cluster_gmm") -> DataFrame:
    """(part, name, value): silhouettes, agreement, Rand index and the contingency cells."""
    from sondage.operators.metrics import adjusted_rand, agreement
    from sondage.operators.profile import contingency

    spark = df.sparkSession
    heads = spark.createDataFrame([("silhouette", "K-Means", kmeans_silhouette), ("silhouette", "GMM", gmm_silhouette)], "part string, name string, value double")
    agreed = agreement(df, a, b).select(F.lit("agreement").alias("part"), F.lit("Agreement Rate (%)").alias("name"), (F.col("agreement") * 100).alias("value"))
    rand = adjusted_rand(df, a, b).select(F.lit("agreement").alias("part"), F.lit("Adjusted Rand Index").alias("name"), F.col("ari").alias("value"))
    cells = contingency(df, a, b).select(F.lit("crosstab").alias("part"), F.concat(F.lit("K"), ref(a).cast("string"), F.lit("/G"), ref(b).cast("string")).alias("name"), F.col("count").cast("double").alias("value"))
    return heads.unionByName(agreed).unionByName(rand).unionByName(cells)
