"""What keeps a larger table within time and memory, each on rows made here."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sondage import vocab
from sondage.operators import cluster, metrics, models, neighbours
from sondage.sources.survey import ROW_ID, survey_raw


def test_survey_of_one_file_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 9000).cast("double").alias("c_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    raw = survey_raw(spark, str(tmp_path))
    assert raw.rdd.getNumPartitions() > 1
    assert raw.agg(F.count(F.lit(1)), F.count_distinct(ROW_ID)).first() == (20_000, 20_000)


def test_visits_are_handed_over_a_few_at_a_time():
    rng = np.random.default_rng(3)
    pivots, n = rng.normal(size=(120, 8)), 120
    wide = neighbours._runs(np.zeros(n), np.full(n, 2000), 16_384)
    rings = neighbours._Rings(pivots, np.zeros(n, int), np.arange(n), np.zeros(n), np.full(n, 50.0), np.full(n, 2000), np.ones(n, int), wide, np.ones(wide.max() + 1, int))
    asked = pd.DataFrame({"key": [str(i) for i in range(1000)], "x": list(rng.normal(size=(1000, 8))), "g": 0, "ub": np.inf})
    every = list(neighbours._visits(rings, "any", 0, n)([asked]))
    assert sum(map(len, every)) == 1000 * n and max(map(len, every)) <= neighbours.VISIT_ROWS
    # what two rounds leave open meets runs of rings
    rest = pd.concat(neighbours._visits(rings, "any", 8, None)([asked]))
    assert len(rest) == 1000 * (wide.max() + 1) and len(rest) * 7 < 1000 * n


def test_products_of_matrices_find_the_nearest_rows():
    rng = np.random.default_rng(4)
    for shift, size in ((0.0, 1.0), (1e6, 1.0), (0.0, 1e-9)):
        points = np.round(rng.normal(size=(400, 6)), 2) * size + shift
        points[50:80] = points[7]
        points[0] += 100 * size
        asked = points[5:60]
        far = neighbours._distances(asked, points)
        best = np.argsort(far, axis=1, kind="stable")[:, :5]
        for ub in (np.full(len(asked), np.inf), np.take_along_axis(far, best, 1)[:, -1]):
            i, j, d = neighbours._closest(asked, points, ub, 5)
            assert (j.reshape(-1, 5) == best).all() and (d.reshape(-1, 5) == np.take_along_axis(far, best, 1)).all()
        assert np.allclose(metrics._far(asked, points), far, rtol=1e-7, atol=1e-12 * size)


def test_all_starts_of_k_means_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, size=(60, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").repartition(3).cache()
    calls, real = [], cluster._summed
    monkeypatch.setattr(cluster, "_summed", lambda p, d, sets: (calls.append(len(sets)), real(p, d, sets))[1])
    found = cluster.kmeans_range(df, ["a", "b"], "id", ks=[2, 3, 4], n_init=6)
    # one pass a round for all fits, beside three for the starts and one for the squares
    assert max(calls) == 18 and len(calls) < 60
    assert found.best == 3 and [len(found.models[k].clusterCenters()) for k in (2, 3, 4)] == [2, 3, 4]
    told = {r["k"]: r["inertia"] for r in found.table.collect()}
    own = [((x[60 * i : 60 * i + 60] - x[60 * i : 60 * i + 60].mean(axis=0)) ** 2).sum() for i in range(3)]
    assert abs(told[3] - sum(own)) < 1e-6 and told[2] > told[3] > told[4]


def test_support_vectors_run_no_stage_twice(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = [(i, float(a), int(a + 0.5 * e > 0)) for i, (a, e) in enumerate(rng.normal(size=(120, 2)))]
    rows = spark.createDataFrame(data, f"respondent_id long, a double, {vocab.TARGET} int").cache()
    asked, real = [], models.LinearSVC
    monkeypatch.setattr(models, "LinearSVC", lambda **k: (asked.append(k["maxIter"]), real(**k))[1])
    assert models.fit_svm(rows, ["a"], stages=(1, 2), tol=0.0).stage == "calibrated over 5 folds"
    assert asked == [2] * 6
