"""Classification, distribution and cluster-quality metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage import vocab
from sondage.operators.order import range_edges, ranked_values, with_buckets
from sondage.operators.profile import mean_vector
from sondage.operators.scale import feature_array
from sondage.operators.schema import ref
from sondage.session import BLOCK_ROWS

MAX_LABELS = 256


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p, count, share) with shares per true class."""
    cells = df.groupBy(ref(y).alias("y"), ref(p).alias("p")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("y"))
    return cells.withColumn("share", F.col("count") / total)


def class_table(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, tp, support, predicted, precision, recall, f1) from one pass over the rows."""
    cells = df.groupBy(ref(y).cast("double").alias("y"), ref(p).cast("double").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(none).alias("tp"), F.col("n").alias("support"), none.alias("predicted")),
        F.struct(F.col("p").alias("label"), none.alias("tp"), none.alias("support"), F.col("n").alias("predicted")),
    )
    sums = cells.select(F.inline(sides)).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))

    def share(top: Column, bottom: Column) -> Column:
        return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)

    return sums.withColumns({
        "precision": share(F.col("tp"), F.col("predicted")),
        "recall": share(F.col("tp"), F.col("support")),
        "f1": share(F.lit(2) * F.col("tp"), F.col("support") + F.col("predicted")),
    })


def classification_report(df: DataFrame, y: str, p: str, names: dict | None = None) -> DataFrame:
    """(label, precision, recall, f1, support) per class plus accuracy, macro and weighted averages."""
    table = class_table(df, y, p)
    total = F.sum("support")
    label = F.col("label").cast("int").cast("string")
    for code, name in (names or {}).items():
        label = F.when(F.col("label") == code, F.lit(name)).otherwise(label)
    rows = table.select(label.alias("label"), "precision", "recall", "f1", "support")
    parts = ["precision", "recall", "f1"]
    macro = table.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in parts], total.alias("support"))
    weighted = table.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in parts], total.alias("support"))
    hit = F.sum("tp") / total
    accuracy = table.agg(F.lit("accuracy").alias("label"), *[hit.alias(c) for c in parts], total.alias("support"))
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def f1_table(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: f1 of class 1 and the support-weighted f1."""
    table = class_table(df, y, p)
    return table.agg(
        F.coalesce(F.max(F.when(F.col("label") == 1, F.col("f1"))), F.lit(0.0)).alias("f1_binary"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def f1(df: DataFrame, y: str, p: str, average: str = "binary") -> float:
    row = f1_table(df, y, p).first()
    return float((row["f1_binary"] if average == "binary" else row["f1_weighted"]) or 0.0)


def kappa_table(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: Cohen's kappa."""
    table = class_table(df, y, p)
    n = F.sum("support")
    seen = F.sum("tp") / n
    chance = F.sum(F.col("support").cast("double") * F.col("predicted")) / (n * n.cast("double"))
    return table.agg(seen.alias("po"), chance.alias("pe")).select(
        F.when(F.col("pe") == 1, F.lit(None).cast("double")).otherwise((F.col("po") - F.col("pe")) / (F.lit(1.0) - F.col("pe"))).alias("kappa")
    )


def cohen_kappa(df: DataFrame, y: str, p: str) -> float:
    value = kappa_table(df, y, p).first()[0]
    return float("nan") if value is None else float(value)


def accuracy(df: DataFrame, y: str, p: str) -> float:
    return float(df.agg(F.avg((ref(y) == ref(p)).cast("double"))).first()[0])


def _score_ranks(df: DataFrame, y: str, score: str, buckets: int | None = None) -> DataFrame:
    return ranked_values(df, score, {"pos": F.sum((ref(y) == 1).cast("long")), "neg": F.sum((ref(y) == 0).cast("long"))}, buckets=buckets)


def auc_table(df: DataFrame, y: str, score: str, buckets: int | None = None) -> DataFrame:
    """One row: area under the ROC curve, ties counted half."""
    ranked = _score_ranks(df, y, score, buckets)
    area = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked.agg((area / (F.max("pos_total").cast("double") * F.max("neg_total"))).alias("auc"))


def roc_auc(df: DataFrame, y: str, score: str) -> float | None:
    return auc_table(df, y, score).first()[0]


def roc_curve(df: DataFrame, y: str, score: str, buckets: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score; rows at or above the threshold count as positive."""
    ranked = _score_ranks(df, y, score, buckets)
    return ranked.select(
        ref(score).cast("double").alias("threshold"),
        ((F.col("neg_total") - F.col("neg_before")) / F.col("neg_total")).alias("fpr"),
        ((F.col("pos_total") - F.col("pos_before")) / F.col("pos_total")).alias("tpr"),
    )


def ks_distance(a: DataFrame, b: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """(column, ks): largest gap between the two distribution functions of each column."""
    both = a.select(*[ref(c) for c in columns], F.lit(1).alias("__a")).unionByName(b.select(*[ref(c) for c in columns], F.lit(0).alias("__a")))
    wide = with_buckets(both, range_edges(both, columns, buckets))
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), ref(f"__b_{c}").alias("bucket"), ref(c).cast("double").alias("value")) for c in columns
    ])
    long = wide.select(F.explode(cells).alias("c"), "__a").select("c.*", "__a")
    ranked = ranked_values(long, "value", {"na": F.sum("__a"), "nb": F.sum(F.lit(1) - F.col("__a"))}, ["column"], bucket="bucket")
    gap = F.abs((F.col("na_before") + F.col("na")) / F.col("na_total") - (F.col("nb_before") + F.col("nb")) / F.col("nb_total"))
    return ranked.groupBy("column").agg(F.max(gap).alias("ks"))


def cosine(a: list[float], b: list[float]) -> float:
    x, y = np.array(a, dtype=float), np.array(b, dtype=float)
    norm = float(np.linalg.norm(x) * np.linalg.norm(y))
    return float(x @ y) / norm if norm else float("nan")


def mean_cosine(a: DataFrame, b: DataFrame, columns: list[str]) -> float:
    """Cosine similarity of the two mean vectors."""
    return cosine(mean_vector(a, columns), mean_vector(b, columns))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return beta_share(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def _anova_sums(df: DataFrame, columns: list[str], target: str):
    """Class sizes, means and variances; classes x columns scalars, in one pass.

    Spark's variance merges centred sums pair by pair, so large values with a small spread keep their digits.
    """
    known = df.filter(ref(target).isNotNull())
    parts = [f(ref(c).cast("double")) for c in columns for f in (F.count, F.avg, F.var_pop)]
    return known.groupBy(ref(target)).agg(*parts).collect()


def anova(df: DataFrame, columns: list[str], target: str = vocab.TARGET) -> list[tuple[str, float | None, float | None]]:
    """(column, F, p) of the one-way analysis of variance; None for a constant column."""
    rows = _anova_sums(df, columns, target)
    out = []
    for i, c in enumerate(columns):
        groups = [r[1 + 3 * i:4 + 3 * i] for r in rows if r[1 + 3 * i] > 0]
        n, k = sum(g[0] for g in groups), len(groups)
        if k < 2 or n <= k:
            out.append((c, None, None))
            continue
        # means are taken from the first one on, so their own size does not round the differences
        start = groups[0][1]
        grand = sum(g[0] * (g[1] - start) for g in groups) / n
        between = sum(g[0] * (g[1] - start - grand) ** 2 for g in groups)
        within = sum(g[0] * g[2] for g in groups)
        if within <= 1e-12 * max(1.0, between):
            out.append((c, None, None if between <= 1e-12 else 0.0))
            continue
        value = between / (k - 1) / (within / (n - k))
        out.append((c, value, f_tail(value, k - 1, n - k)))
    return out


def anova_table(df: DataFrame, columns: list[str], target: str = vocab.TARGET) -> DataFrame:
    return df.sparkSession.createDataFrame(anova(df, columns, target), "column string, f double, p double")


def mean_anova_p(df: DataFrame, columns: list[str], target: str = vocab.TARGET) -> float:
    """Mean p over the features; 1.0 when there is a single class."""
    values = [p for _, _, p in anova(df, columns, target) if p is not None]
    return float(np.mean(values)) if values else 1.0


def rank_by_f(df: DataFrame, columns: list[str], target: str = vocab.TARGET) -> DataFrame:
    """Features by falling F."""
    return anova_table(df, columns, target).filter("f is not null").orderBy(F.desc("f"), "column")


def label_values(df: DataFrame, label: str) -> list:
    rows = df.filter(ref(label).isNotNull()).select(ref(label)).distinct().limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels in {label}")
    return sorted(r[0] for r in rows)


def silhouette_1d_table(df: DataFrame, column: str, label: str, buckets: int | None = None) -> DataFrame:
    """One row: exact mean silhouette of a one-dimensional score.

    Sums of distances to each cluster come from running counts and sums over
    the sorted distinct values, so no pairs of rows are formed.
    """
    labels = label_values(df, label)
    value = ref(column).cast("double")
    df = df.filter(ref(label).isNotNull()).select(value.alias("__x"), ref(label).alias("__l"))
    sums = {}
    for i, v in enumerate(labels):
        mine = F.col("__l") == F.lit(v)
        sums[f"n{i}"] = F.sum(mine.cast("long"))
        sums[f"s{i}"] = F.sum(F.when(mine, F.col("__x")).otherwise(F.lit(0.0)))
    ranked = ranked_values(df, "__x", sums, buckets=buckets)
    x = F.col("__x")

    def away(i: int) -> Column:
        left = x * F.col(f"n{i}_before") - F.col(f"s{i}_before")
        right = (F.col(f"s{i}_total") - F.col(f"s{i}_before") - F.col(f"s{i}")) - x * (F.col(f"n{i}_total") - F.col(f"n{i}_before") - F.col(f"n{i}"))
        return F.greatest(left + right, F.lit(0.0))

    k = range(len(labels))
    # one projection per step keeps the expressions flat
    ranked = ranked.select(*[f"n{i}" for i in k], *[f"n{i}_total" for i in k], *[away(i).alias(f"d{i}") for i in k])
    own = [(F.col(f"d{i}") / F.greatest(F.col(f"n{i}_total") - F.lit(1), F.lit(1))).alias(f"a{i}") for i in k]
    means = [(F.col(f"d{i}") / F.col(f"n{i}_total")).alias(f"m{i}") for i in k]
    ranked = ranked.select(*[f"n{i}" for i in k], *[f"n{i}_total" for i in k], *own, *means)

    def nearest(i: int) -> Column:
        others = [F.col(f"m{j}") for j in k if j != i]
        return F.least(*others) if len(others) > 1 else others[0] if others else F.lit(0.0)

    ranked = ranked.select("*", *[nearest(i).alias(f"b{i}") for i in k])
    total, rows = F.lit(0.0), F.lit(0)
    for i in k:
        top = F.greatest(F.col(f"a{i}"), F.col(f"b{i}"))
        score = F.when((F.col(f"n{i}_total") <= 1) | (top == 0), F.lit(0.0)).otherwise((F.col(f"b{i}") - F.col(f"a{i}")) / top)
        total, rows = total + F.col(f"n{i}") * score, rows + F.col(f"n{i}")
    return ranked.agg((F.sum(total) / F.sum(rows)).alias("silhouette"))


def silhouette_1d(df: DataFrame, column: str, label: str) -> float | None:
    return silhouette_1d_table(df, column, label).first()[0]


# Blocks of rows that meet at a time in an exact silhouette, where the table has more than a few; distances held at a time.
WIDE, FEW, CELLS = 8, 6, 1_000_000


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by a product of matrices; where rounding could show, from the differences."""
    middle = b.mean(axis=0)
    middle = np.where(np.isfinite(middle), middle, 0.0)
    a, b = a - middle, b - middle
    own, theirs = (a * a).sum(axis=1), (b * b).sum(axis=1)
    far = np.concatenate((a * -2.0, own[:, None], np.ones((len(a), 1))), axis=1) @ np.concatenate((b, np.ones((len(b), 1)), theirs[:, None]), axis=1).T
    i, j = np.nonzero(far < 1e-5 * (own + np.where(np.isfinite(theirs), theirs, 0.0).max())[:, None])
    near = np.zeros(len(i))
    for k in range(a.shape[1]):
        near += (a[i, k] - b[j, k]) ** 2
    far[i, j] = near
    return np.sqrt(far, out=far)


def _block_sums(sizes: list[int]):
    """Distance sums of each left row to the labels of the right rows of a block pair."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "sums": []})
        a, b = np.array(left["x"].tolist(), dtype=float), np.array(right["x"].tolist(), dtype=float)
        codes = np.array(right["l"].tolist())
        hot = np.concatenate([(codes[:, j, None] == np.arange(size)[None, :]).astype(float) for j, size in enumerate(sizes)], axis=1)
        step = max(1, CELLS // len(b))
        parts = [_far(a[at:at + step], b) @ hot for at in range(0, len(a), step)]
        return pd.DataFrame({"id": left["id"], "sums": list(np.concatenate(parts))})

    return run


def _mean_of_others(size: Column, mine: Column):
    return lambda total, i: F.when(i != mine, total / F.get(size, i))


def silhouettes_exact(df: DataFrame, columns: list[str], labels: list[str], row_id: str) -> dict[str, float | None]:
    """Exact Euclidean silhouette of several labelings, distances computed once.

    The metric needs the distance between any two rows, so its work grows with
    the square of the table; each unit of work is one pair of bounded blocks.
    ``silhouette`` uses it only when asked for the exact form.
    """
    values = {c: label_values(df, c) for c in labels}
    n = df.count()
    # every row is sent once for each block, so a large table has wide ones
    blocks = max(1, min(-(-n // BLOCK_ROWS), FEW), -(-n // (WIDE * BLOCK_ROWS)))
    code = F.array(*[F.array_position(F.array(*[F.lit(v) for v in values[c]]), ref(c)).cast("int") - F.lit(1) for c in labels])
    rows = df.select(
        ref(row_id).cast("long").alias("id"), code.alias("l"), feature_array(columns).alias("x"),
        F.pmod(F.xxhash64(ref(row_id)), F.lit(blocks)).cast("int").alias("block"),
    ).persist()
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select("id", "x", F.col("block").alias("i"), every.alias("j")).groupBy("i", "j")
    right = rows.select("x", "l", F.col("block").alias("j"), every.alias("i")).groupBy("i", "j")
    sizes = [len(values[c]) for c in labels]
    parts = left.cogroup(right).applyInPandas(_block_sums(sizes), "id long, sums array<double>")
    sums = parts.groupBy("id").agg(F.array(*[F.sum(F.get("sums", i)) for i in range(sum(sizes))]).alias("sums"))
    counted = df.agg(*[F.count_if(ref(c) == F.lit(v)) for c in labels for v in values[c]]).first()
    joined = rows.select("id", "l").join(sums, "id")
    scores, at = [], 0
    for j, c in enumerate(labels):
        size = F.array(*[F.lit(int(v)) for v in counted[at:at + sizes[j]]])
        mine = F.get("l", j)
        away = F.slice("sums", at + 1, sizes[j])
        own = F.get(away, mine) / F.greatest(F.get(size, mine) - F.lit(1), F.lit(1))
        means = F.transform(away, _mean_of_others(size, mine))
        joined = joined.withColumns({f"own{j}": own, f"near{j}": F.array_min(means), f"size{j}": F.get(size, mine)})
        top = F.greatest(f"own{j}", f"near{j}")
        scores.append(F.avg(F.when((F.col(f"size{j}") <= 1) | (top == 0), F.lit(0.0)).otherwise((F.col(f"near{j}") - F.col(f"own{j}")) / top)))
        at += sizes[j]
    row = joined.agg(*scores).first()
    rows.unpersist()
    return {c: row[j] for j, c in enumerate(labels)}


def silhouette(df: DataFrame, columns: list[str], label: str, row_id: str, mode: str = "fast") -> tuple[float | None, str]:
    """(silhouette, metric): squared Euclidean in linear time (``fast``), or Euclidean from all distances (``exact``).

    The metric follows from ``mode`` alone, never from the size of the table,
    and is part of the result, since the two are not comparable.
    """
    if mode not in ("fast", "exact"):
        raise ValueError(f"mode is fast or exact, not {mode}")
    if len(label_values(df, label)) < 2:
        return None, "none"
    if mode == "exact":
        return silhouettes_exact(df, columns, [label], row_id)[label], "euclidean"
    vectors = df.select(array_to_vector(feature_array(columns)).alias("features"), ref(label).cast("double").alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(vectors), "squared_euclidean"


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two labelings, from the contingency counts."""
    cells = df.filter(ref(a).isNotNull() & ref(b).isNotNull()).groupBy(ref(a).alias("a"), ref(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))

    def pairs(col: Column) -> Column:
        return col.cast("double") * (col.cast("double") - F.lit(1.0)) / F.lit(2.0)

    both = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias("rows"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias("cols"))
    one = F.lit(1).alias("k")
    joined = both.select(one, "*").join(rows.select(one, "*"), "k").join(cols.select(one, "*"), "k")
    expected = F.col("rows") * F.col("cols") / pairs(F.col("n"))
    top = (F.col("rows") + F.col("cols")) / F.lit(2.0)
    return joined.select(F.when(top == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: share of rows whose two labels are equal as they are."""
    return df.agg(F.avg((ref(a) == ref(b)).cast("double")).alias("agreement"))
