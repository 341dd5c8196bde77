"""Classifiers, cross-validation and reports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions.draws import u
from sondage.operators import metrics, trees as ensembles
from sondage.operators.margins import LinearSVC
from sondage.operators.order import class_ranks
from sondage.operators.relate import stratified_folds
from sondage.operators.scale import feature_array
from sondage.operators.schema import ref


def class_sizes(df: DataFrame, target: str = vocab.TARGET) -> dict:
    return {r[0]: r[1] for r in df.groupBy(ref(target)).count().collect() if r[0] is not None}


def class_weights(df: DataFrame, target: str = vocab.TARGET) -> dict:
    """Balanced weight n / (classes * n_c) per class."""
    sizes = class_sizes(df, target)
    total = sum(sizes.values())
    return {c: total / (len(sizes) * n) for c, n in sizes.items()}


def positive_weight(df: DataFrame, target: str = vocab.TARGET) -> float:
    """Negatives per positive."""
    sizes = class_sizes(df, target)
    return sizes.get(0, 0) / max(sizes.get(1, 0), 1)


def training_rows(df: DataFrame, features: list[str], target: str, weights: dict | None) -> DataFrame:
    """features, label and weight columns, as the trainers read them."""
    weight = F.lit(1.0)
    for c, w in (weights or {}).items():
        weight = F.when(ref(target) == F.lit(c), F.lit(float(w))).otherwise(weight)
    return df.select(array_to_vector(feature_array(features)).alias("features"), ref(target).cast("double").alias("label"), weight.alias("weight"))


@dataclass
class Fitted:
    """A trained model; ``predict`` adds ``predicted`` and ``score``, the probability of class 1."""

    name: str
    model: Model
    features: list[str]
    platt: Model | None = None
    # how far the solver had to go, where it escalates
    stage: str | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        names = df.columns
        out = self.model.transform(df.withColumn("features", array_to_vector(feature_array(self.features))))
        if self.platt is not None:
            margin = F.array(F.get(vector_to_array("rawPrediction"), 1))
            out = out.drop("features").withColumn("features", array_to_vector(margin)).withColumnsRenamed({"prediction": "__hard"}).drop("rawPrediction")
            out = self.platt.transform(out).withColumn("prediction", F.col("__hard"))
        score = F.get(vector_to_array("probability"), 1)
        return out.withColumns({"predicted": F.col("prediction").cast("int"), "score": score}).select(*[ref(c) for c in names], "predicted", "score")


def fit_logistic(df: DataFrame, features: list[str], target: str = vocab.TARGET, balanced: bool = True, max_iter: int = 2000) -> Fitted:
    """Ridge logistic regression; the penalty equals a unit inverse strength on summed losses."""
    rows = training_rows(df, features, target, class_weights(df, target) if balanced else None)
    mass = rows.agg(F.sum("weight")).first()[0]
    trainer = LogisticRegression(weightCol="weight", regParam=1.0 / mass, elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return Fitted("LogisticRegression", trainer.fit(rows), features)


def fit_forest(df: DataFrame, features: list[str], target: str = vocab.TARGET, trees: int = 150, depth: int = 30, seed: int = 42) -> Fitted:
    rows = training_rows(df, features, target, class_weights(df, target))
    return Fitted("RandomForest", ensembles.fit_forest(rows, trees, depth, seed), features)


def fit_boosted(df: DataFrame, features: list[str], target: str = vocab.TARGET, rounds: int = 100, seed: int = 42) -> Fitted:
    rows = training_rows(df, features, target, {1: positive_weight(df, target)})
    return Fitted("BoostedTrees", ensembles.fit_boosted(rows, rounds, depth=6, rate=0.3, seed=seed), features)


# Iterations of the support-vector solver: the stage that it ends in, and how its folds are fitted.
SVM_STAGES = (500, 2000)


def held_out_margins(train, split: DataFrame, features: list[str], target: str, folds: int, parallel: int = 5) -> DataFrame:
    """(features, label): each row's margin under the model of the other folds. The folds are independent jobs and run side by side."""

    def fit(fold: int) -> Model:
        return train(split.filter(F.col("fold") != fold))

    with ThreadPoolExecutor(parallel) as pool:
        fitted = list(pool.map(inheritable_thread_target(split.sparkSession)(fit), range(folds)))
    margins = None
    for fold, model in enumerate(fitted):
        scored = model.transform(training_rows(split.filter(F.col("fold") == fold), features, target, None))
        part = scored.select(array_to_vector(F.array(F.get(vector_to_array("rawPrediction"), 1))).alias("features"), "label")
        margins = part if margins is None else margins.unionByName(part)
    return margins


def fit_svm(df: DataFrame, features: list[str], target: str = vocab.TARGET, row_id: str = "respondent_id", folds: int = 3, stages: tuple[int, ...] = SVM_STAGES,
            tol: float = 1e-3, seed: int = 42, fallback_folds: int = 5) -> Fitted:
    """Linear support vectors; probabilities by logistic calibration on held-out margins.

    The solver's own history says in which stage it stopped by its tolerance: the iterations of a stage begin with those of the
    one before, so they are run once. If it never stops, the last one's hinge model is kept, then calibrated over ``fallback_folds`` folds, so
    that no single unfinished solution sets the probabilities. ``stage`` of the result says which it was. An iteration is
    one step over all rows, so far fewer are needed than of a solver that moves two rows at a time.
    """
    weights = class_weights(df, target)

    def trainer(max_iter: int):
        def train(part: DataFrame) -> Model:
            rows = training_rows(part, features, target, weights)
            mass = rows.agg(F.sum("weight")).first()[0]
            return LinearSVC(weightCol="weight", regParam=1.0 / mass, standardization=False, maxIter=max_iter, tol=tol).fit(rows)

        return train

    model = trainer(stages[-1])(df)
    # the history has the start and a value for every iteration made
    made = len(model.summary().objectiveHistory) - 1
    finished = made < stages[-1]
    most = next((s for s in stages if made < s), stages[-1])
    parts = folds if finished else fallback_folds
    split = stratified_folds(df, target, parts, row_id, seed).persist()
    platt = LogisticRegression(maxIter=100).fit(held_out_margins(trainer(most), split, features, target, parts))
    split.unpersist()
    return Fitted("SVM", model, features, platt, f"converged within {most}" if finished else f"calibrated over {parts} folds")


TRAINERS = {"LogisticRegression": fit_logistic, "RandomForest": fit_forest, "BoostedTrees": fit_boosted, "SVM": fit_svm}


def _call(trainer, df: DataFrame, features: list[str], target: str, row_id: str) -> Fitted:
    return trainer(df, features, target, row_id=row_id) if trainer is fit_svm else trainer(df, features, target)


def train_suite(train: DataFrame, test: DataFrame, features: list[str], target: str = vocab.TARGET, row_id: str = "respondent_id", names: list[str] | None = None,
                folds: int = 5, parallel: int = 4, trainers: dict | None = None) -> tuple[dict[str, Fitted], DataFrame]:
    """(models, metrics): test scores and cross-validated F1 per model.

    The full fits and the folds are independent jobs and run side by side. The
    reported model is the one fitted on the whole training table.
    """
    trainers = trainers or TRAINERS
    names = names or list(trainers)
    keep = [ref(row_id), *[ref(c) for c in features], ref(target)]
    split = stratified_folds(train.select(*keep), target, folds, row_id).persist()
    held_out = test.select(*keep).persist()
    classes = {(r["fold"], r[1]): r["count"] for r in split.groupBy("fold", ref(target)).count().collect()}

    def varied(fold: int) -> bool:
        return len({c for (f, c) in classes if f != fold}) > 1

    def run(task):
        name, fold = task
        if fold is None:
            return name, None, _call(trainers[name], split.drop("fold"), features, target, row_id)
        fitted = _call(trainers[name], split.filter(F.col("fold") != fold).drop("fold"), features, target, row_id)
        return name, fold, metrics.f1(fitted.predict(split.filter(F.col("fold") == fold)), target, "predicted")

    tasks = [(n, f) for n in names for f in [None, *[f for f in range(folds) if varied(f)]]]
    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(inheritable_thread_target(run), tasks))
    models = {n: m for n, f, m in done if f is None}
    rows = []
    for name in names:
        scores = [s for n, f, s in done if n == name and f is not None]
        judged = models[name].predict(held_out).select(target, "predicted", "score").persist()
        report = {r["label"]: {"precision": r["precision"], "recall": r["recall"], "f1": r["f1"], "support": float(r["support"])}
                  for r in metrics.classification_report(judged, target, "predicted", {0: "Beneficially", 1: "Risky"}).collect()}
        rows.append((name, report, metrics.roc_auc(judged, target, "score"), report.get("Risky", {}).get("f1", 0.0),
                     float(np.mean(scores)) if scores else None, float(np.std(scores)) if scores else None))
        judged.unpersist()
    table = train.sparkSession.createDataFrame(
        rows, "model string, classification_report map<string,map<string,double>>, roc_auc double, f1_score double, cv_f1_mean double, cv_f1_std double"
    )
    return models, table


def overfit_report(models: dict[str, Fitted], train: DataFrame, test: DataFrame, target: str = vocab.TARGET) -> DataFrame:
    """(model, train_accuracy, test_accuracy, overfit_ratio), rounded to 4 digits."""
    rows = []
    for name, fitted in models.items():
        a, b = metrics.accuracy(fitted.predict(train), target, "predicted"), metrics.accuracy(fitted.predict(test), target, "predicted")
        rows.append((name, round(a, 4), round(b, 4), round(a - b, 4)))
    return train.sparkSession.createDataFrame(rows, "model string, train_accuracy double, test_accuracy double, overfit_ratio double")


def learning_curve(df: DataFrame, features: list[str], target: str = vocab.TARGET, row_id: str = "respondent_id", fractions=(0.1, 0.325, 0.55, 0.775, 1.0),
                   folds: int = 5, seed: int = 42, parallel: int = 4) -> DataFrame:
    """(fraction, fold, rows, train_f1, cv_f1) of a logistic regression on growing training parts."""
    split = stratified_folds(df.select(ref(row_id), *[ref(c) for c in features], ref(target)), target, folds, row_id, seed)
    ranked = class_ranks(split, ["fold"], u(ref(row_id), f"curve:{seed}"), row_id, "__rank", "__total").persist()

    def run(task):
        fraction, fold = task
        part = ranked.filter((F.col("fold") != fold) & (F.col("__rank") <= F.ceil(F.col("__total") * F.lit(fraction))))
        if len(class_sizes(part, target)) < 2:
            return fraction, fold, part.count(), None, None
        fitted = fit_logistic(part, features, target, balanced=False, max_iter=1000)
        inner = metrics.f1(fitted.predict(part), target, "predicted")
        outer = metrics.f1(fitted.predict(ranked.filter(F.col("fold") == fold)), target, "predicted")
        return fraction, fold, part.count(), inner, outer

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(inheritable_thread_target(run), [(f, k) for f in fractions for k in range(folds)]))
    ranked.unpersist()
    return df.sparkSession.createDataFrame(rows, "fraction double, fold int, rows bigint, train_f1 double, cv_f1 double")


def coefficient_table(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Coefficients by falling size."""
    rows = sorted(zip(fitted.features, (float(v) for v in fitted.model.coefficients.toArray())), key=lambda r: (-abs(r[1]), r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def importance_table(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Importances by falling value, rounded to 6 digits."""
    rows = sorted(((c, round(float(v), 6)) for c, v in zip(fitted.features, fitted.model.featureImportances.toArray())), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def permutation_importances(df: DataFrame, predict, features: list[str], target: str = vocab.TARGET, row_id: str = "respondent_id", repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance, spread): accuracy lost when a column's values are dealt to other rows, mean and deviation over the repeats.

    ``predict`` takes a table with the features as columns and adds ``predicted``, or it is a model of boosted trees. For each repeat rows get places by a
    seeded draw, and every row meets the one a seeded number of places on, so a column is permuted without fixed
    rows. One join serves all features of a repeat, and one aggregation counts the hits of all features and repeats.
    """
    trees = isinstance(predict, ensembles.Ensemble)
    x = F.transform(feature_array(features), lambda v: v.cast("double"))
    kept = df.select(ref(row_id).alias("__id"), ref(target).alias("__y"), (predict.coded(x) if trees else x).alias("__x"))
    n = kept.count()
    pairs = None
    for r in range(repeats):
        placed = class_ranks(kept.withColumn("__all", F.lit(0)), ["__all"], u(F.col("__id"), f"permute:{seed}:{r}"), "__id", "__rank", "__total").select("__id", "__y", "__x", (F.col("__rank") - 1).alias("__at"))
        step = permutation_step(n, r, seed)
        other = placed.select(F.pmod(F.col("__at") - F.lit(step), F.lit(n)).alias("__at"), F.col("__x").alias("__other"))
        one = placed.join(other, "__at").select(F.lit(r).alias("__repeat"), "__y", "__x", "__other")
        pairs = one if pairs is None else pairs.unionByName(one)

    if trees:
        return _lost(_tree_hits(pairs, predict, len(features)), features)
    # -1 leaves the row as it is; one array expression serves all features, so the plan does not grow with their number
    every = pairs.withColumn("__j", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    x = F.transform("__x", lambda v, i: F.when(i == F.col("__j"), F.get("__other", i)).otherwise(v))
    wide = every.select("__repeat", "__y", "__j", x.alias("__v")).select("__repeat", "__y", "__j", *[F.get("__v", k).alias(c) for k, c in enumerate(features)])
    return _lost(predict(wide).groupBy("__j", "__repeat").agg(F.avg((F.col("predicted") == F.col("__y")).cast("double")).alias("right")), features)


def _tree_hits(pairs: DataFrame, model: ensembles.Ensemble, d: int) -> DataFrame:
    """(__j, __repeat, right): a task asks the trees for all features of its rows, and hands over its counts."""
    judge = model.hits_if_permuted()

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            batch = batch[batch["__y"].notna()]
            for repeat, part in batch.groupby("__repeat"):
                own, theirs = (np.frombuffer(b"".join(part[c]), dtype=np.uint8).reshape(-1, d) for c in ("__x", "__other"))
                right = (judge(own, theirs) == (part["__y"].to_numpy(dtype=float) == 1)[:, None]).sum(axis=0)
                counts[repeat] = counts.get(repeat, 0) + np.concatenate(([len(part)], right))
        for repeat, n in counts.items():
            yield pd.DataFrame({"__repeat": repeat, "__j": np.arange(-1, d), "hit": n[1:], "n": n[0]})

    told = pairs.select("__repeat", F.col("__y").cast("double").alias("__y"), "__x", "__other").mapInPandas(run, "__repeat int, __j int, hit long, n long")
    return told.groupBy("__j", "__repeat").agg((F.sum("hit") / F.sum("n")).alias("right"))


def _lost(hits: DataFrame, features: list[str]) -> DataFrame:
    base = hits.filter("__j = -1").select("__repeat", F.col("right").alias("base"))
    lost = hits.filter("__j >= 0").join(base, "__repeat").withColumn("lost", F.col("base") - F.col("right"))
    names = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("__j") + 1)
    return lost.groupBy(names.alias("feature")).agg(F.avg("lost").alias("importance"), F.stddev_pop("lost").alias("spread"))


def permutation_step(n: int, repeat: int, seed: int) -> int:
    """Places between a row and the one whose values it gets: 1 to n - 1, by the seed."""
    return 1 + (7919 * (repeat + 1) + seed) % max(n - 1, 1)


def metrics_table(results: DataFrame, overfit: DataFrame, models: dict[str, Fitted]) -> DataFrame:
    """One row per model, ready for JSON: report, scores, accuracies, coefficients, importances."""
    spark = results.sparkSession
    rows = []
    for name, fitted in models.items():
        coefficients = importance = None
        if name == "LogisticRegression":
            coefficients = [(r[0], r[1]) for r in coefficient_table(results, fitted).collect()]
        if name == "RandomForest":
            importance = [(r[0], r[1]) for r in importance_table(results, fitted).collect()]
        rows.append((name, coefficients, importance))
    entry = "array<struct<feature:string,value:double>>"
    details = spark.createDataFrame(rows, f"model string, coefficients {entry}, feature_importance {entry}")
    return results.join(overfit, "model").join(details, "model")
