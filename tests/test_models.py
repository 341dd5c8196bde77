"""Fitted models against facts that only a right fit satisfies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage import vocab
from sondage.operators import certify, cluster, metrics, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.7 * rng.normal(size=240) > 0.2).astype(int)
    data = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, f"respondent_id long, a double, b double, c double, {vocab.TARGET} int").repartition(3).cache()


def test_logistic_facts_tell_a_right_fit(rows):
    fitted = models.fit_logistic(rows, ["a", "b", "c"])
    found = certify.logistic_facts(rows, fitted)
    assert found["steepest"] < 1e-4 and abs(found["mean_score"] - 0.5) < 1e-4
    short = models.fit_logistic(rows, ["a", "b", "c"], max_iter=1)
    worse = certify.logistic_facts(rows, short)
    assert worse["steepest"] > 1e-3 and worse["loss"] > found["loss"]


def test_svm_stages(rows):
    fitted = models.fit_svm(rows, ["a", "b", "c"], stages=(60,), tol=1e-2)
    assert fitted.stage == "converged within 60"
    found = certify.svm_facts(rows, fitted)
    assert found["loss"] < 1 and -1e-9 < found["gap"] < 0.2
    # two stages that cannot end lead to the calibrated model
    short = models.fit_svm(rows, ["a", "b", "c"], stages=(1, 2), tol=0.0)
    assert short.stage == "calibrated over 5 folds" and certify.svm_facts(rows, short)["gap"] > found["gap"]
    assert short.predict(rows).filter(~F.col("score").between(0, 1)).count() == 0


def test_permuted_columns(rows):
    def rule(df):
        return df.withColumn("predicted", (F.col("a") > 0).cast("int"))

    got = {r["feature"]: r for r in models.permutation_importances(rows, rule, ["a", "b"], repeats=4).collect()}
    assert got["a"]["importance"] > 0.1 and got["a"]["spread"] > 0
    assert got["b"]["importance"] == got["b"]["spread"] == 0
    again = {r["feature"]: r for r in models.permutation_importances(rows.repartition(5), rule, ["a", "b"], repeats=4).collect()}
    assert all(np.allclose(again[c][1:], got[c][1:]) for c in got)


def test_large_values_with_a_small_spread(spark):
    rng = np.random.default_rng(4)
    small = np.concatenate([rng.normal(-2, 1, 150), rng.normal(2, 1, 150)])
    df = spark.createDataFrame([(float(v), float(v) + 1e9, int(k >= 150)) for k, v in enumerate(small)], "x double, y double, g int").cache()
    (_, f, _), (_, far, _) = metrics.anova(df, ["x", "y"], "g")
    assert abs(f / far - 1) < 1e-5
    near, shifted = cluster.bayes_gmm_1d(df, "x", 2, max_iter=30), cluster.bayes_gmm_1d(df, "y", 2, max_iter=30)
    assert np.allclose(near.mean, np.array(shifted.mean) - 1e9, atol=1e-4) and np.allclose(near.variance, shifted.variance, rtol=1e-4)


def test_cluster_and_component_facts(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, size=(30, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    df = spark.createDataFrame([(i, float(a), float(b), float(a + b)) for i, (a, b) in enumerate(x)], "id long, a double, b double, c double").cache()
    found = cluster.kmeans_range(df, ["a", "b"], "id", ks=[3], n_init=2)
    right = certify.kmeans_facts(found.labelled, ["a", "b"], found.models[3].clusterCenters(), "k3")
    assert right["astray"] == 0 and right["drift"] < 1e-3 and abs(right["squares"] - ((x - x.mean(axis=0)) ** 2).sum()) < 1e-6
    wrong = certify.kmeans_facts(found.labelled, ["a", "b"], found.models[3].clusterCenters()[::-1], "k3")
    assert wrong["astray"] > 0 and wrong["drift"] > 1
    pca = certify.pca_facts(df, cluster.fit_pca(df, row_id="id"))
    assert pca["skew"] < 1e-6 and pca["residual"] < 1e-6 and pca["falling"] and abs(pca["trace"] - 3) < 1e-9
