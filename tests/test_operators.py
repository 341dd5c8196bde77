"""Operators against brute force on small tables, with blocks and buckets forced small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage import vocab
from sondage.operators import augment, cluster, metrics, neighbours, order, relate, scale


def points(spark, n=300, d=3, seed=1, copies=80):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    x[:copies] = x[0]  # over a quarter of the rows are one point
    y = rng.integers(0, 2, n)
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "respondent_id long, " + ", ".join(f"c{j} double" for j in range(d)) + ", y int"), x, y


def brute(x, k, allowed):
    far = np.zeros((len(x), len(x)))
    for j in range(x.shape[1]):
        far += (x[:, j, None] - x[None, :, j]) ** 2
    far = np.sqrt(far)
    out = {}
    for i in range(len(x)):
        ids = [b for b in range(len(x)) if b != i and allowed(i, b)]
        out[i] = sorted(ids, key=lambda b: (far[i, b], b))[:k]
    return out


@pytest.mark.parametrize("relation", ["any", "same", "other"])
def test_knn_with_many_blocks_and_copies(spark, monkeypatch, relation):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "PACK_ROWS", 8)
    df, x, y = points(spark)
    allowed = {"any": lambda a, b: True, "same": lambda a, b: y[a] == y[b], "other": lambda a, b: y[a] != y[b]}[relation]
    want = brute(x, 4, allowed)
    got = {}
    for r in neighbours.knn(df, ["c0", "c1", "c2"], 4, group="y", relation=relation).collect():
        got.setdefault(r["respondent_id"], {})[r["rank"]] = r["nbr_id"]
    assert {i: [got[i][r] for r in sorted(got[i])] for i in got} == want


def clustered(spark, n, dims=6):
    """Rows around n / 50 centres, a few of them copies."""
    rng = np.random.default_rng(n)
    x = np.repeat(rng.normal(size=(n // 50, dims)) * 20, 50, axis=0) + rng.normal(size=(n, dims))
    x[::97] = x[0]
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "respondent_id long, " + ", ".join(f"c{j} double" for j in range(dims))), [f"c{j}" for j in range(dims)]


def test_knn_rounds_visit_no_more_than_the_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "PACK_ROWS", 40)
    sent, real = [], neighbours._search
    monkeypatch.setattr(neighbours, "_search", lambda v, r, n: (sent.append(v.count()), real(v, r, n))[1])
    visits = []
    for n in (500, 1000):
        df, columns = clustered(spark, n)
        neighbours.knn(df, columns, 4).count()
        visits.append(sum(sent))
        assert len(sent) > 1
        sent.clear()
    assert visits[1] < 2.6 * visits[0]


def test_hash_tables_find_nearly_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    df, columns = clustered(spark, 800)
    exact = neighbours.knn(df, columns, 4).persist()
    full = neighbours.Lsh(sample=300)
    found = neighbours.knn(df, columns, 4, method="lsh", lsh=full).persist()
    r = neighbours.recall(found, exact).first()
    assert (r["rows"], r["neighbours"]) == (800, 3200) and r["recall"] >= 0.9
    # what is found has its true distance, no row is its own neighbour, ranks are gapless
    far = {(a["respondent_id"], a["nbr_id"]): a["dist"] for a in exact.collect()}
    rows = found.collect()
    assert all(a["respondent_id"] != a["nbr_id"] and far.get((a["respondent_id"], a["nbr_id"]), a["dist"]) == a["dist"] for a in rows)
    # crowded buckets are divided, and few tables with single probes find less
    divided = neighbours.recall(neighbours.knn(df, columns, 4, method="lsh", lsh=neighbours.Lsh(sample=300, crowd=60)), exact).first()["recall"]
    few = neighbours.recall(neighbours.knn(df, columns, 4, method="lsh", lsh=neighbours.Lsh(sample=300, tables=1, probes=1, scale=0.5)), exact).first()["recall"]
    assert 0.8 <= divided <= 1 and few < r["recall"]
    grouped = df.withColumn("y", (F.col("respondent_id") % 2).cast("int"))
    same = neighbours.knn(grouped, columns, 3, group="y", relation="same", method="lsh", lsh=full).collect()
    assert same and all((a["respondent_id"] - a["nbr_id"]) % 2 == 0 for a in same)
    assert neighbours.knn(df.limit(0), columns, 3, method="lsh").count() == 0
    with pytest.raises(ValueError):
        neighbours.knn(grouped, columns, 3, group="y", relation="other", method="lsh")


def test_knn_fewer_rows_than_k(spark):
    df, _, _ = points(spark, n=3, copies=1)
    assert neighbours.knn(df, ["c0", "c1", "c2"], 5).count() == 6


def test_knn_plan_has_no_cartesian_product(spark):
    df, _, _ = points(spark, n=50)
    plan = neighbours.knn(df, ["c0", "c1", "c2"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_knn_vote_1d(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=200), 1)
    v[:70] = 0.3
    label = (v + rng.normal(size=200) * 0.3 > 0).astype(int)
    df = spark.createDataFrame([(i, float(v[i]), int(label[i])) for i in range(200)], "respondent_id long, v double, l int")
    got = {r[0]: r[1] for r in neighbours.knn_vote_1d(df.filter("respondent_id % 5 = 0"), df.filter("respondent_id % 5 <> 0"), "v", "l", 7, buckets=4).collect()}
    base = [i for i in range(200) if i % 5]
    for i in range(0, 200, 5):
        near = sorted(base, key=lambda b: (abs(v[b] - v[i]), b))[:7]
        assert got[i] == int(sum(label[b] for b in near) >= 4)


def test_quantiles_through_buckets(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([np.full(150, 2.5), rng.normal(size=301)])
    df = spark.createDataFrame([(float(a), int(i % 3)) for i, a in enumerate(v)] + [(None, 0)], "v double, g int")
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    for small in (0, 10_000):
        got = order.quantiles(df, ["v"], shares, buckets=7, small=small)["v"]
        assert np.allclose(got, np.quantile(v, shares))
        table = {r["g"]: [r[f"q{i}"] for i in range(6)] for r in order.group_quantiles(df, ["g"], "v", shares, buckets=5, small=small).collect()}
        for g in range(3):
            assert np.allclose(table[g], np.quantile(v[np.arange(len(v)) % 3 == g], shares))


def test_class_ranks_are_complete(spark):
    df = spark.range(1000).withColumn("c", (F.col("id") > 100).cast("int"))
    got = order.class_ranks(df, ["c"], F.pmod(F.xxhash64("id"), F.lit(997)) / 997.0, "id", rows_per_bucket=50)
    for r in got.groupBy("c").agg(F.collect_list("rank").alias("r"), F.max("total").alias("t")).collect():
        assert sorted(r["r"]) == list(range(1, r["t"] + 1))


def test_silhouettes(spark, monkeypatch):
    df, x, y = points(spark, n=90, copies=10)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    parts = []
    for i in range(len(x)):
        own = far[i, y == y[i]].sum() / max((y == y[i]).sum() - 1, 1)
        other = far[i, y != y[i]].mean()
        parts.append((other - own) / max(own, other))
    monkeypatch.setattr(metrics, "BLOCK_ROWS", 20)
    got, name = metrics.silhouette(df, ["c0", "c1", "c2"], "y", "respondent_id", "exact")
    assert name == "euclidean" and abs(got - np.mean(parts)) < 1e-9
    assert metrics.silhouette(df.withColumn("y", F.lit(1)), ["c0"], "y", "respondent_id")[0] is None


def test_anova_tail():
    assert abs(metrics.f_tail(4.0, 2, 20) - 0.034572) < 1e-4 and metrics.f_tail(0.0, 1, 5) == 1.0
    assert abs(cluster.digamma(1.0) + 0.5772156649) < 1e-9


def test_sampling_and_sets(spark):
    df = spark.range(200).select(F.col("id").alias("respondent_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    split = relate.stratified_split(df, "y")
    assert {(r["y"], r["n"]) for r in split.filter("is_test = 1").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(0, 38), (1, 13)}
    assert relate.sample_upto(df, 500, "respondent_id").count() == 200 and relate.sample_upto(df, 30, "respondent_id").count() == 30
    with pytest.raises(ValueError):
        relate.balanced_sample(df, "y", 60, "respondent_id")
    a = spark.createDataFrame([(1, None), (1, None), (2, "b"), (3, "c")], "a int, b string")
    b = spark.createDataFrame([(2, "b")], "a int, b string")
    assert [tuple(r) for r in relate.remove_exact_duplicates(a, b).collect()] == [(3, "c")]
    assert relate.synthetic_only(a, a.limit(1), []).count() == 2


def test_isolation_and_mixture(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(-3, 0.3, 300), rng.normal(0, 0.3, 300), rng.normal(3, 0.3, 300), [30.0]])
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "respondent_id long, s double")
    flagged = cluster.isolation_outliers(df, "s", "respondent_id", 0.05)
    assert flagged.filter("respondent_id = 900").first()["Outlier"] == 1
    assert 0 < flagged.agg(F.sum("Outlier")).first()[0] <= 46
    mixture = cluster.bayes_gmm_1d(df.filter("respondent_id < 900"), "s", 3)
    assert np.allclose(sorted(mixture.mean), [-3, 0, 3], atol=0.15)


def test_smote_rows_lie_between_rows_of_the_class(spark):
    df, x, y = points(spark, n=60, copies=5)
    sizes = np.bincount(y)
    out = augment.smote(df, ["c0", "c1", "c2"], "y", {0: int(sizes[0]) + 33, 1: int(sizes[1])})
    made = out.filter("respondent_id < 0").collect()
    assert len(made) == 33 and len({r["respondent_id"] for r in made}) == 33
    members = x[y == 0]
    for r in made:
        p = np.array([r["c0"], r["c1"], r["c2"]])
        assert (p >= members.min(0) - 1e-9).all() and (p <= members.max(0) + 1e-9).all()


def test_accept_rule():
    good = dict(f1_weighted=0.9, silhouette=0.5, kappa=0.9, cosine_similarity=1.0, avg_knn_distance=1.0, anova_p_value=0.2)
    assert augment.accept(good, None) == "good" and augment.accept(good, good) == "good"
    assert augment.accept({**good, "kappa": 0.5}, good) == "tolerated"
    assert augment.accept({**good, "kappa": 0.5, "silhouette": 0.1, "avg_knn_distance": 2.0}, good) == "repeated"


def test_generator_keeps_types_and_is_repeatable(spark):
    df = spark.range(400).select(F.col("id").alias("respondent_id"), (F.col("id") % 97).cast("int").alias("n"), (F.col("id") % 2).cast("int").alias("b"),
                                 F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("s"), (F.col("id") % 50 / 7.0).alias("f"))
    gen = augment.TabularGenerator.fit(df)
    a, b = gen.sample(spark, 300), gen.sample(spark, 300)
    assert a.dtypes == [("respondent_id", "bigint"), ("n", "int"), ("b", "int"), ("s", "string"), ("f", "double")]
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.repartition(3).collect()))
    row = a.agg(F.min("n"), F.max("n"), F.count_distinct("respondent_id"), F.count_if(~F.col("s").isin("x", "y")), F.max("b")).first()
    assert row[0] >= 0 and row[1] <= 96 and row[2] == 300 and row[3] == 0 and row[4] <= 1


def test_scaler_without_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got, params = scale.standardise(df, ["a", "b"])
    assert [tuple(r) for r in got.collect()] == [(-1.0, 0.0), (1.0, 0.0)] and params.spread == (1.0, 1.0)


def test_checkpoint_dir_comes_from_the_session(spark, tmp_path):
    from sondage.session import cut_lineage

    assert cut_lineage(spark.range(5)).count() == 5 and spark.sparkContext.getCheckpointDir()


def test_vocabulary_is_consistent():
    assert len(vocab.QUESTIONS) == 22 and set(vocab.CHOICES) == set(vocab.MULTI_COLUMNS)
