"""Aggregations, profiles and the tables behind the figures."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions.text import label_display
from sondage.operators.encode import most_frequent
from sondage.operators.order import group_quantiles, medians, quantiles
from sondage.operators.relate import balanced_sample, sample_upto
from sondage.operators.scale import min_max, standardise
from sondage.operators.schema import group_map, melt_factors, non_constant, numeric_columns, ref

# Distinct values up to which a density uses them as they are; finer tables use this many bins.
DENSITY_BINS = 2048


def class_counts(df: DataFrame, column: str = vocab.TARGET) -> DataFrame:
    return df.groupBy(ref(column)).agg(F.count(F.lit(1)).alias("count"))


def score_stats(df: DataFrame, by: str, target: str = "Risk_Score", digits: int | None = 3) -> DataFrame:
    """count, mean, std, min, median and max of a score per group."""

    def shown(col: Column) -> Column:
        return col if digits is None else F.round(col, digits)

    value = ref(target)
    known = df.filter(ref(by).isNotNull())
    stats = known.groupBy(ref(by)).agg(
        F.count(value).alias("count"), shown(F.avg(value)).alias("mean"), shown(F.stddev_samp(value)).alias("std"),
        shown(F.min(value)).alias("min"), shown(F.max(value)).alias("max"),
    )
    middle = group_quantiles(known, [by], target, [0.5], ["median"])
    joined = stats.join(middle.withColumn("median", shown(F.col("median"))), by, "left")
    return joined.select(ref(by), "count", "mean", "std", "min", "median", "max")


def risk_score_analysis(kmeans: DataFrame, gmm: DataFrame, target: str = "Risk_Score") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Score statistics of both labelings, and their means side by side by position."""
    a, b = score_stats(kmeans, "cluster_kmeans", target), score_stats(gmm, "cluster_gmm", target)
    # one row per cluster, so a single ordered window over them stays small
    pa = a.select(F.row_number().over(Window.orderBy("cluster_kmeans")).alias("position"), F.col("cluster_kmeans").alias("cluster"), F.col("mean").alias("kmeans_mean"))
    pb = b.select(F.row_number().over(Window.orderBy("cluster_gmm")).alias("position"), F.col("mean").alias("gmm_mean"))
    pairs = pa.join(pb, "position").withColumn("difference", F.col("kmeans_mean") - F.col("gmm_mean")).drop("position")
    return a, b, pairs


def cluster_means(df: DataFrame, label: str, features: list[str], prefix: str) -> DataFrame:
    means = df.filter(ref(label).isNotNull()).groupBy(ref(label)).agg(*[F.avg(ref(c)).alias(c) for c in features])
    return means.select(F.concat(F.lit(prefix), ref(label).cast("string")).alias("cluster"), *[ref(c) for c in features])


def cluster_profiles(df: DataFrame, features: list[str], kmeans: str = "cluster_kmeans", gmm: str = "cluster_gmm") -> DataFrame:
    """Feature means per cluster of two labelings, stacked."""
    return cluster_means(df, kmeans, features, "KMeans_C").unionByName(cluster_means(df, gmm, features, "GMM_C"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table (a, b, count); any number of labels."""
    both = df.filter(ref(a).isNotNull() & ref(b).isNotNull())
    return both.groupBy(ref(a), ref(b)).agg(F.count(F.lit(1)).alias("count"))


def crosstab(df: DataFrame, a: str, b: str, values: list | None = None) -> DataFrame:
    """Wide contingency table; one column per value of ``b``."""
    both = df.filter(ref(a).isNotNull() & ref(b).isNotNull())
    grouped = both.groupBy(ref(a))
    return (grouped.pivot(b, values) if values else grouped.pivot(b)).count().na.fill(0)


def _moments(columns: list[str], centre: list[float]):
    """Per-batch sums over rows where both columns of a pair have values."""
    middle = np.array(centre)
    d = len(columns)
    upper = np.triu_indices(d, 1)

    def run(batches):
        total = np.zeros((6, d, d))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - middle
            ok = ~np.isnan(x)
            x, m = np.where(ok, x, 0.0), ok.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        yield pd.DataFrame({"i": upper[0], "j": upper[1], **{f"s{k}": total[k][upper] for k in range(6)}})

    return run


def corr_pairs(df: DataFrame, columns: list[str]) -> list[tuple[str, str, float | None]]:
    """Pearson r of every column pair, over rows where both have values."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1:]]
    if not pairs:
        return []
    narrow = df.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    centre = [v or 0.0 for v in narrow.agg(*[F.avg(c) for c in narrow.columns]).first()]
    parts = narrow.mapInPandas(_moments(columns, centre), "i int, j int, " + ", ".join(f"s{k} double" for k in range(6)))
    sums = parts.groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)]).collect()
    out = []
    for r in sums:
        n, sx, sy, sxx, syy, sxy = (r[f"s{k}"] for k in range(6))
        value = None
        if n > 1:
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            # a column whose spread is lost in the rounding of its centre is constant
            if vx > n * (1e-12 * centre[r["i"]]) ** 2 and vy > n * (1e-12 * centre[r["j"]]) ** 2:
                value = (sxy - sx * sy / n) / (vx * vy) ** 0.5
        out.append((r["i"], r["j"], value))
    return [(columns[i], columns[j], v) for i, j, v in sorted(out, key=lambda t: t[:2])]


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) for all ordered pairs and the diagonal; d x d rows, whatever the table height."""
    pairs = corr_pairs(df, columns)
    rows = [(c, c, 1.0) for c in columns] + pairs + [(y, x, r) for x, y, r in pairs]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def top_pairs(df: DataFrame, groups: dict[str, list[str]] | None = None, k: int = 3) -> DataFrame:
    """Strongest pairs by signed r per column group with two or more numeric columns."""
    groups = group_map(df) if groups is None else groups
    numeric = set(numeric_columns(df))
    rows = []
    for group, names in groups.items():
        names = [c for c in names if c in numeric]
        found = [p for p in corr_pairs(df, names) if p[2] is not None] if len(names) > 1 else []
        for x, y, r in sorted(found, key=lambda p: -p[2])[:k]:
            rows.append((group, x, y, r))
    return df.sparkSession.createDataFrame(rows, "group string, x string, y string, r double")


def target_corr(df: DataFrame, target: str = "Risk_Score", k: int | None = 5, row_id: str | None = None) -> DataFrame:
    """(column, abs_r): columns by absolute correlation with the target, from one aggregation."""
    columns = [c for c in numeric_columns(df) if c not in (target, row_id)]
    row = df.agg(*[F.abs(F.corr(ref(c).cast("double"), ref(target).cast("double"))).alias(c) for c in columns])
    long = row.unpivot([], [ref(c) for c in columns], "column", "abs_r").filter(F.col("abs_r").isNotNull() & ~F.isnan("abs_r"))
    ordered = long.orderBy(F.desc("abs_r"), "column")
    return ordered.limit(k) if k else ordered


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, left, right, count) of equal-width bins; the last bin holds the maximum."""
    value = ref(column).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, left double, right double, count bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(value.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("left"),
        (F.lit(low) + (F.col("bin") + F.lit(1)) * F.lit(width)).alias("right"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def kde(df: DataFrame, column: str, grid: int = 200, bins: int = DENSITY_BINS) -> DataFrame:
    """(x, density) of a Gaussian density on a grid over the range of the data.

    Rows are first counted per fine bin and stand at its middle, for any number
    of values, so the work after one scan is grid x bins.
    """
    value = ref(column).cast("double")
    known = df.filter(value.isNotNull()).select(value.alias("v"))
    n, low, high, sd = known.agg(F.count("v"), F.min("v"), F.max("v"), F.stddev_samp("v")).first()
    if n < 2 or not sd:
        return df.sparkSession.createDataFrame([], "x double, density double")
    width = (high - low) / bins
    at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    known = known.select((F.lit(low) + (at + F.lit(0.5)) * F.lit(width)).alias("v"))
    counts = known.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    band = sd * n ** -0.2
    step = (high - low) / (grid - 1)
    points = counts.select("v", "n", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    x = F.lit(low) + F.col("g") * F.lit(step)
    z = (x - F.col("v")) / F.lit(band)
    height = F.col("n") * F.exp(F.lit(-0.5) * z * z)
    norm = n * band * (2 * np.pi) ** 0.5
    return points.groupBy("g").agg((F.sum(height) / F.lit(float(norm))).alias("density")).select(
        (F.lit(low) + F.col("g") * F.lit(step)).alias("x"), "density"
    )


def _box_limits(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    cut = group_quantiles(df, by, column, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    return cut.withColumns({"fence_low": F.col("q1") - reach, "fence_high": F.col("q3") + reach})


def box_stats(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Quartiles, whiskers at most 1.5 ranges out, and the number of outliers, per group."""
    by = by or []
    value = ref(column).cast("double")
    known = df.filter(value.isNotNull())
    for c in by:
        known = known.filter(ref(c).isNotNull())
    limits = _box_limits(known, column, by)
    joined = known.select(*[ref(c) for c in by], value.alias("__v")).join(limits, by) if by else _with_row(known.select(value.alias("__v")), limits)
    inside = F.col("__v").between(F.col("fence_low"), F.col("fence_high"))
    return joined.groupBy(*[ref(c) for c in by], "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__v"))).alias("whisker_low"), F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def box_outliers(df: DataFrame, column: str, row_id: str, by: list[str] | None = None) -> DataFrame:
    """The rows outside the whiskers."""
    by = by or []
    value = ref(column).cast("double")
    known = df.filter(value.isNotNull())
    limits = _box_limits(known, column, by)
    joined = known.join(limits, by) if by else _with_row(known, limits)
    return joined.filter(~value.between(F.col("fence_low"), F.col("fence_high"))).select(ref(row_id), *[ref(c) for c in by], ref(column))


def _with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Values of a one-row table as literal columns."""
    row = one.first()
    return df.withColumns({name: F.lit(row[name]).cast("double") for name in one.columns})


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, slope, intercept, r) of the least-squares line."""
    a, b = ref(x).cast("double"), ref(y).cast("double")
    return df.agg(
        F.lit(x).alias("x"), F.lit(y).alias("y"), F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"), F.corr(a, b).alias("r"),
    )


def fit_lines(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Lines of several pairs from one aggregation."""
    cells = []
    for x, y in pairs:
        a, b = ref(x).cast("double"), ref(y).cast("double")
        cells.append(F.struct(
            F.lit(x).alias("x"), F.lit(y).alias("y"), F.regr_slope(b, a).alias("slope"),
            F.regr_intercept(b, a).alias("intercept"), F.corr(a, b).alias("r"),
        ))
    return df.agg(F.array(*cells).alias("lines")).select(F.inline("lines"))


def scalar_stats(df: DataFrame, column: str) -> dict[str, float]:
    """median, mean, mode, min and max of a column."""
    mean, low, high = df.agg(F.avg(ref(column)), F.min(ref(column)), F.max(ref(column))).first()
    return {"median": medians(df, [column])[column], "mean": mean, "mode": most_frequent(df, column), "min": low, "max": high}


def argmin_group(df: DataFrame, by: str, target: str):
    """Group with the lowest mean."""
    means = df.groupBy(ref(by).alias("g")).agg(F.avg(ref(target)).alias("m"))
    return means.agg(F.min_by("g", F.struct("m", "g"))).first()[0]


def mean_vector(df: DataFrame, columns: list[str]) -> list[float]:
    return [float(v) if v is not None else float("nan") for v in df.agg(*[F.avg(ref(c)) for c in columns]).first()]


# ------------------------------------------------------------- figure tables


def univariate(df: DataFrame, groups: dict[str, list[str]] | None = None, bins: int = 30) -> DataFrame:
    """(group, column, part, position, value): histogram, density and box of each varying column."""
    groups = group_map(df) if groups is None else groups
    names = non_constant(df, list(dict.fromkeys(c for cols in groups.values() for c in cols)))
    parts = []
    for group, columns in groups.items():
        for c in (c for c in columns if c in names):
            head = [F.lit(group).alias("group"), F.lit(c).alias("column")]
            parts.append(histogram(df, c, bins).select(*head, F.lit("histogram").alias("part"), F.col("left").alias("position"), F.col("count").cast("double").alias("value")))
            parts.append(kde(df, c).select(*head, F.lit("density").alias("part"), F.col("x").alias("position"), F.col("density").alias("value")))
            box = box_stats(df, c).unpivot([], ["q1", "median", "q3", "whisker_low", "whisker_high"], "name", "value")
            parts.append(box.select(*head, F.concat(F.lit("box_"), F.col("name")).alias("part"), F.lit(None).cast("double").alias("position"), "value"))
    return reduce(DataFrame.unionByName, parts)


def short_name(name: str) -> str:
    return name.replace("Impulse_Buying_", "IB_").replace("Financial_", "Fin_")[:20]


def bivariate(df: DataFrame, groups: dict[str, list[str]] | None = None, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Heat-map table (group, x, y, r) with short names, and the lines of the top pairs."""
    groups = group_map(df) if groups is None else groups
    numeric = set(numeric_columns(df))
    heat, lines = [], []
    for group, names in groups.items():
        names = [c for c in names if c in numeric]
        if len(names) < 2:
            continue
        pairs = corr_pairs(df, names)
        heat += [(group, short_name(c), short_name(c), 1.0) for c in names]
        heat += [(group, short_name(a), short_name(b), r) for x, y, r in pairs for a, b in ((x, y), (y, x))]
        best = sorted((p for p in pairs if p[2] is not None), key=lambda p: -p[2])[:k]
        if best:
            lines.append(fit_lines(df, [(x, y) for x, y, _ in best]).select(F.lit(group).alias("group"), "*"))
    table = df.sparkSession.createDataFrame(heat, "group string, x string, y string, r double")
    return table, reduce(DataFrame.unionByName, lines)


def target_profile(df: DataFrame, target: str = "Risk_Score", k: int = 5, row_id: str | None = None) -> DataFrame:
    """Strongest columns against the target with their lines."""
    best = target_corr(df, target, k, row_id).collect()
    lines = fit_lines(df, [(r["column"], target) for r in best])
    ranks = df.sparkSession.createDataFrame([(i + 1, r["column"], r["abs_r"]) for i, r in enumerate(best)], "rank int, x string, abs_r double")
    return lines.join(F.broadcast(ranks), "x").select("rank", "x", "abs_r", "slope", "intercept", "r")


def parallel_rows(df: DataFrame, features: list[str], row_id: str, label: str, prefix: str, per_cluster: int = 200, n_features: int = 8) -> DataFrame:
    """First features and cluster name of a bounded sample per cluster."""
    known = df.filter(ref(label).isNotNull())
    kept = balanced_sample(known, label, per_cluster, row_id, exact=False)
    return kept.select(ref(row_id), *[ref(c) for c in features[:n_features]], F.concat(F.lit(prefix), ref(label).cast("string")).alias("Cluster"))


def radar_rows(profiles: DataFrame, n_features: int = 8) -> DataFrame:
    """(cluster, feature, value): range-scaled cluster means of the first features."""
    features = [c for c in profiles.columns if c != "cluster"][:n_features]
    scaled = min_max(profiles, features)
    return scaled.unpivot(["cluster"], [ref(c) for c in features], "feature", "value")


def scatter_rows(df: DataFrame, row_id: str, limit: int = 5000, kmeans: str = "cluster_kmeans", gmm: str = "cluster_gmm") -> DataFrame:
    """First two components and both labels of a bounded sample."""
    return sample_upto(df.select(ref(row_id), "PC1", "PC2", ref(kmeans), ref(gmm)), limit, row_id)


def factor_boxes(df: DataFrame, factors: list[str] | None = None, target: str = vocab.TARGET) -> DataFrame:
    """Boxes of standardised factors by risk label, without outliers."""
    factors = [c for c in (factors or vocab.RISK_FACTORS) if c in df.columns]
    scaled, _ = standardise(df, factors)
    labelled = scaled.withColumn("Behavior_Risk_Label", label_display(ref(target)))
    long = melt_factors(labelled, ["Behavior_Risk_Label"], factors)
    return box_stats(long, "Value", ["Factor", "Behavior_Risk_Label"]).drop("outliers")
