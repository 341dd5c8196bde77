"""Rows with gaps, one-class batches, numbered jobs and labelings with one cluster."""

import warnings
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage import vocab
from sondage.operators import augment, cluster, encode, relate
from sondage.session import Rounds, cut_lineage, ensure_checkpoint_dir


def test_unique_rows_with_gaps_keep_their_ids(spark):
    schema = "respondent_id long, a int, b string"
    train = spark.createDataFrame([(1, None, "x"), (2, 5, None), (3, 7, "y"), (4, 7, "y"), (5, None, None)], schema)
    test = spark.createDataFrame([(9, None, None)], schema)
    got = relate.remove_exact_duplicates(train, test, "respondent_id")
    assert got.columns == train.columns
    assert sorted(r["respondent_id"] for r in got.collect()) == [1, 2]


def cloud(spark, n, share):
    cols = [(F.rand(k + 1) * 10).alias(f"f{k}") for k in range(3)]
    return spark.range(n).select(F.col("id").alias("respondent_id"), *cols, (F.col("id") < n * share).cast("int").alias(vocab.TARGET))


def test_a_batch_of_one_row_has_one_row(spark):
    df = cloud(spark, 60, 0.1).cache()
    generator = augment.TabularGenerator.fit(df)
    assert augment.balance_batch(generator, spark, 1).count() >= 1


def test_adasyn_ids_stay_in_their_round_and_differ(spark):
    df = cloud(spark, 80, 0.2).cache()
    out = augment.adasyn(df, ["f0", "f1", "f2"], vocab.TARGET, 5, round_no=2)
    made = [r[0] for r in out.filter("respondent_id < 0").select("respondent_id").collect()]
    assert made and len(set(made)) == len(made)
    assert sorted(-i - 2 * augment.ROUND_SPAN for i in made) == list(range(len(made)))


def test_a_short_growth_says_so():
    with pytest.warns(RuntimeWarning):
        augment._told_if_short("step", 3, 4)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        augment._told_if_short("step", 4, 4)


def test_summary_of_one_cluster(spark):
    class Fit:
        silhouette, bic, aic = None, 1.0, 2.0

    rows = {r["metric"]: r["value"] for r in cluster.clustering_summary(spark.range(1), 2, 0.5, Fit, 0.0, 0.5).collect()}
    assert rows["Silhouette Difference"] is None and rows["Optimal K"] == 2.0


def _tables_in(spark, root):
    return sorted(p for p in Path(root).rglob("rdd-*"))


def test_a_loop_keeps_two_tables(spark, tmp_path):
    context = spark.sparkContext
    ensure_checkpoint_dir(spark)
    root = context.getCheckpointDir().removeprefix("file:")
    before = set(_tables_in(spark, root))
    rounds, df, most = Rounds(spark), spark.range(50).toDF("n"), 0
    df = rounds.hand_on(df)
    for _ in range(6):
        with rounds.round():
            scratch = cut_lineage(df.filter("n % 2 = 0"))
            inner = Rounds(spark)
            part = inner.hand_on(scratch)
            for _ in range(3):
                with inner.round():
                    part = inner.hand_on(part.withColumn("n", F.col("n") + 1))
            df = rounds.hand_on(df.withColumn("n", F.col("n") + part.count()))
        most = max(most, len(set(_tables_in(spark, root)) - before))
    assert most == 2 and df.agg(F.min("n")).first()[0] > 0 and df.count() == 50
    # a round that fails leaves nothing of its own and keeps what was handed on
    with pytest.raises(ZeroDivisionError), rounds.round():
        cut_lineage(df)
        1 / 0
    assert len(set(_tables_in(spark, root)) - before) == 2 and df.count() == 50


def test_growth_leaves_two_tables(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal(i % 2)), float(rng.normal()), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, f"respondent_id long, a double, b double, {vocab.TARGET} int")
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(_tables_in(spark, root))
    out, history = augment.augment_incremental(df, 180, step_fraction=0.15, score_batch=lambda b: b)
    assert out.count() == 180 and len(history) > 2
    assert len(set(_tables_in(spark, root)) - before) == 2


def test_twenty_thousand_answers_encode(spark):
    df = spark.range(40_000).select(F.col("id"), F.format_string("a%05d", F.col("id") % 20_000).alias("wide"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("few"))
    got = {r["id"]: r["slots"] for r in encode.one_hot_sparse(df, ["wide", "few"], "id").collect()}
    # few comes before wide and has two answers
    assert len(got) == 40_000
    assert all(s == ([] if i % 3 == 0 else [i % 3 - 1]) + [2 + i % 20_000] for i, s in got.items())


def test_unseen_answers_are_kept_or_reported(spark):
    train = spark.createDataFrame([(1, "a", "x"), (2, "c", "x"), (3, None, "y")], "id long, p string, q string")
    new = spark.createDataFrame([(1, "b", "x"), (2, "c", None), (3, None, None), (4, "d", "z")], "id long, p string, q string")
    levels = encode.answer_levels(train, ["p", "q"], "id")
    assert sorted(map(tuple, levels.collect())) == [("p", "a", 0, 0), ("p", "c", 1, 1), ("q", "x", 0, 2), ("q", "y", 1, 3)]
    assert sorted(map(tuple, encode.one_hot_long(new, ["p", "q"], "id", levels).filter("slot IS NULL").select("id", "column", "value").collect())) == [(1, "p", "b"), (4, "p", "d"), (4, "q", "z")]
    assert sorted(map(tuple, encode.one_hot_sparse(new, ["p", "q"], "id", levels).collect())) == [(1, [2], 1), (2, [1], 0), (3, [], 0), (4, [], 2)]
    wide = encode.one_hot(new, ["p"], {"p": ["a", "c"]}, unseen=True)
    assert sorted((r["id"], r["p_a"], r["p_c"], r["p_unseen"]) for r in wide.collect()) == [(1, 0, 0, 1), (2, 0, 1, 0), (3, 0, 0, 0), (4, 0, 0, 1)]
    assert encode.answer_levels(train.limit(0), ["p", "q"], "id").count() == 0
