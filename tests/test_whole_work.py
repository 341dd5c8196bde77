"""Queries of models do their whole work, and trees, boosting and support vectors need few jobs for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import cluster as cluster_queries
from catalog import learn
from sondage import vocab
from sondage.operators import certify, label, margins, models, trees

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(3000, 4)) * 10)
    y = (x[:, 0] - 0.5 * x[:, 1] + 8 * rng.normal(size=3000) > 2).astype(int)
    data = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, f"respondent_id long, a double, b double, c double, d double, {vocab.TARGET} int").repartition(4).cache()


class Asked(Exception):
    pass


def asked_of(monkeypatch, module, name, query):
    """The settings with which a query calls a function."""
    seen = {}

    def told(*args, **settings):
        seen.update(settings)
        raise Asked

    monkeypatch.setattr(module, name, told)
    with pytest.raises(Asked):
        query()
    return seen


def jobs(spark, run):
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    return run(), scheduler.numTotalJobs() - before


def test_a_forest_of_deep_trees_needs_few_jobs(spark, rows):
    fitted, n = jobs(spark, lambda: models.fit_forest(rows, COLUMNS))
    assert n <= 15
    found = certify.forest_facts(rows, fitted)
    assert fitted.model.getNumTrees == 150 and found["off"] < 1e-9 and found["right"] > 0.95 and abs(found["importances"] - 1) < 1e-9
    used = dict(zip(COLUMNS, fitted.model.featureImportances.toArray()))
    assert used["a"] > used["b"] > max(used["c"], used["d"])
    # a tree is grown until its leaves are pure, whatever the parts of the table
    x, y = np.array([[i % 7, i % 11, i % 13] for i in range(1001)], dtype=np.uint8), np.random.default_rng(2).integers(0, 2, 1001).astype(np.uint8)
    tree, _ = trees.grow_tree(x, y, np.ones(1001), 2, 3, 30, np.random.default_rng(1))
    assert (tree.leaf[tree.at(x), 0].round() == y).mean() > 0.9


def test_trees_of_several_classes_and_more_values_than_codes(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=4000)
    df = spark.createDataFrame([(float(a), int(a > 0.5) + int(a > -0.5)) for a in v], f"a double, {vocab.TARGET} int").repartition(3)
    out = models.fit_forest(df, ["a"], trees=8).predict(df)
    assert out.filter(F.col("predicted") == F.col(vocab.TARGET)).count() > 3900


def test_boosting_in_parts_is_boosting_in_one(spark, rows):
    data = models.training_rows(rows, COLUMNS, vocab.TARGET, {1: 2.0})
    one, n = jobs(spark, lambda: trees.fit_boosted(data, 6, 4, 0.3, 42))
    assert n <= 10
    parts = trees.fit_boosted(data, 6, 4, 0.3, 42, part_rows=700)
    assert np.allclose(one.evaluateEachIteration(data), parts.evaluateEachIteration(data))
    losses = one.evaluateEachIteration(data)
    assert len(losses) == 6 and all(b < a for a, b in zip(losses, losses[1:]))
    # the loss of the first tree, a plain tree of least squares, from its own predictions
    told = one.transform(data.withColumn("y", F.col("label"))).select("y", "weight", "prediction", "probability").collect()
    p = np.array([r["probability"][1] for r in told])
    y, w = np.array([r["y"] for r in told]), np.array([r["weight"] for r in told])
    assert abs((w * -2 * np.log(np.where(y == 1, p, 1 - p))).sum() / w.sum() - losses[-1]) < 1e-6


def test_boosted_children_keep_their_least_rows(spark):
    df = spark.createDataFrame([(float(i), float(i == 0), 5.0) for i in range(40)], "a double, label double, weight double").select(F.array("a").alias("x"), "label", "weight")
    data = df.select(learn.models.array_to_vector("x").alias("features"), "label", "weight")
    for least in (1, 3):
        tree = trees.Tree.unpacked(trees.fit_boosted(data, 1, 1, 0.3, 1, least=least).trees[0])
        assert tree.bin[0] == least - 1


def test_permuted_trees_lose_what_a_table_of_predictions_loses(rows):
    fitted = models.fit_boosted(rows, COLUMNS, rounds=5)

    def predict(df):
        return fitted.predict(df)

    by_table = {r["feature"]: r for r in models.permutation_importances(rows, predict, COLUMNS, repeats=2).collect()}
    by_trees = {r["feature"]: r for r in models.permutation_importances(rows, fitted.model, COLUMNS, repeats=2).collect()}
    assert by_table.keys() == by_trees.keys() and all(np.allclose(by_table[c][1:], by_trees[c][1:]) for c in COLUMNS)


def test_support_vectors_need_no_job_for_a_step(spark, rows):
    data = models.training_rows(rows, COLUMNS, vocab.TARGET, models.class_weights(rows))
    mass = data.agg(F.sum("weight")).first()[0]
    fit = margins.LinearSVC(weightCol="weight", regParam=1.0 / mass, maxIter=500)
    model, n = jobs(spark, lambda: fit.fit(data))
    assert n <= 8 and len(model.summary().objectiveHistory) < 200
    assert certify.svm_facts(rows, models.Fitted("SVM", model, COLUMNS))["gap"] < 0.1
    parts = margins.LinearSVC(weightCol="weight", regParam=1.0 / mass, maxIter=500, part_rows=800).fit(data)
    assert np.allclose(parts.coefficients.toArray(), model.coefficients.toArray(), atol=1e-3)
    alone = margins.LinearSVC(weightCol="weight", regParam=0.1).fit(data.filter("label = 1"))
    assert alone.transform(data).filter("prediction = 0").count() == 0


def test_boosted_query_runs_all_rounds(spark, sf, monkeypatch):
    assert asked_of(monkeypatch, models, "fit_boosted", lambda: learn.fit_boosted(spark, sf)).get("rounds", 100) == 100


def test_labelling_query_runs_all_rounds(spark, sf, monkeypatch):
    assert asked_of(monkeypatch, label, "label_risk_report", lambda: cluster_queries.label_risk(spark, sf)).get("max_iter", 100) == 100


def test_suite_query_trains_all_models(spark, sf, monkeypatch):
    assert asked_of(monkeypatch, models, "train_suite", lambda: learn.train_suite(spark, sf)).get("names") in (None, list(models.TRAINERS))
