"""Semi-supervised risk labelling: score, mixture, outliers, self-training, rules."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions.rules import apply_rules
from sondage.operators.cluster import bayes_gmm_1d, isolation_outliers
from sondage.operators.metrics import classification_report, silhouette_1d
from sondage.operators.models import permutation_importances
from sondage.operators.neighbours import knn_vote_1d
from sondage.operators.relate import attach
from sondage.operators.scale import feature_array, risk_score
from sondage.operators.schema import numeric_columns, ref, split_labelled
from sondage.operators.trees import Ensemble, fit_boosted
from sondage.session import Rounds, cut_lineage, ensure_checkpoint_dir

MIN_TRAIN = 10


def auto_label(df: DataFrame, k: int = 3, prior: float = 0.1, column: str = "Risk_Score") -> DataFrame:
    """Adds Cluster and Auto_Label: 0 in the component with the smallest mean, else 1."""
    mixture = bayes_gmm_1d(df, column, k, prior)
    df = df.withColumn("Cluster", mixture.cluster(column))
    return df.withColumn("Auto_Label", F.when(F.col("Cluster") == mixture.safest, F.lit(0)).otherwise(F.lit(1)))


def relabel_outliers(df: DataFrame, row_id: str, k: int = 7, column: str = "Risk_Score") -> DataFrame:
    """Outliers take the majority label of the k nearest other rows."""
    votes = knn_vote_1d(df.filter("Outlier = 1"), df.filter("Outlier = 0"), column, "Auto_Label", k, row_id)
    joined = attach(df, votes, row_id)
    return joined.withColumn("Auto_Label", F.coalesce("predicted", "Auto_Label")).drop("predicted")


def boosted(rows: DataFrame, max_iter: int = 100, seed: int = 42) -> Ensemble:
    """Shallow trees at a small rate over features, label and weight."""
    return fit_boosted(rows, max_iter, depth=3, rate=0.05, seed=seed, sampling=0.7, features=0.7, least=3)


def importances(model, features: list[str], round_no: int = 1) -> list[tuple[int, str, float]]:
    """(round, feature, importance), most important first."""
    values = [(round_no, c, float(v)) for c, v in zip(features, model.featureImportances.toArray())]
    return sorted(values, key=lambda r: (-r[2], r[1]))


def self_train(df: DataFrame, row_id: str, threshold: float = 0.9, rounds: int = 2, max_iter: int = 100,
               exclude: tuple[str, ...] = (), permute: int = 0) -> tuple[DataFrame, list[tuple[int, str, float, float | None]]]:
    """Levels for rows that a boosted model is sure about; (rows, importances per round).

    An importance is the model's own, by gain, and with ``permute`` repeats also the accuracy on the training rows that is lost when
    the feature is permuted.

    Each round writes its rows to the checkpoint folder, so plans stay short
    and a lost executor does not train again; the rows of the last two rounds stay there.
    """
    ensure_checkpoint_dir(df.sparkSession)
    skip = {vocab.TARGET, "Confidence", "Auto_Label", row_id, *exclude}
    features = [c for c in numeric_columns(df) if c not in skip]
    df = df.withColumns({"Confidence": F.lit(1.0), vocab.TARGET: F.lit(-1)})
    report: list[tuple[int, str, float, float | None]] = []
    loop = Rounds(df.sparkSession)
    df = loop.hand_on(df)
    for step in range(1, rounds + 1):
        with loop.round():
            labelled, waiting, sure = df.agg(
                F.count_if(F.col(vocab.TARGET) != -1), F.count_if(F.col(vocab.TARGET) == -1), F.count_if(F.col("Confidence") > threshold)
            ).first()
            if labelled >= MIN_TRAIN:
                train = df.filter(F.col(vocab.TARGET) != -1)
            elif sure >= MIN_TRAIN:
                train = df.filter(F.col("Confidence") > threshold)
            else:
                break
            model = boosted(train.select(
                array_to_vector(feature_array(features)).alias("features"), F.col("Auto_Label").cast("double").alias("label"),
                F.when(F.col("Auto_Label") == 1, F.lit(1.5)).otherwise(F.lit(1.0)).alias("weight"),
            ), max_iter)
            lost = {}
            if permute:
                lost = {r["feature"]: r["importance"] for r in permutation_importances(train, model, features, "Auto_Label", row_id, permute).collect()}
            report += [(*r, lost.get(r[1])) for r in importances(model, features, step)]
            if not waiting:
                break
            scored = model.transform(df.withColumn("features", array_to_vector(feature_array(features))))
            top = F.array_max(vector_to_array("probability"))
            take = (F.col(vocab.TARGET) == -1) & (top >= threshold)
            marked = scored.withColumn("__take", take)
            df = marked.withColumns({
                vocab.TARGET: F.when(F.col("__take"), F.col("prediction").cast("int")).otherwise(F.col(vocab.TARGET)),
                "Confidence": F.when(F.col("__take"), top).otherwise(F.col("Confidence")),
            }).drop("features", "probability", "prediction", "__take")
            df = loop.hand_on(df)
            if df.filter(F.col(vocab.TARGET) != -1).count() == labelled:
                break
    return df, report


def label_quality(df: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """Counts and silhouette of the labelled rows, and the report of Auto_Label against the level."""
    known, unknown = split_labelled(df)
    summary = {"labelled": float(known.count()), "unlabelled": float(unknown.count())}
    if summary["labelled"]:
        summary["silhouette"] = silhouette_1d(known.select("Risk_Score", vocab.TARGET), "Risk_Score", vocab.TARGET)
    return summary, classification_report(known, "Auto_Label", vocab.TARGET)


def label_risk_report(df: DataFrame, row_id: str = "respondent_id", k: int = 3, threshold: float = 0.9, rounds: int = 2, contamination: float = 0.05,
                      neighbours: int = 7, income: str = "Income_Category", max_iter: int = 100, permute: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows, importances): Risk_Score, Outlier, Cluster, Auto_Label, Confidence and the risk level of every row, and what
    the levels rest on, (round, feature, importance, permuted), most important first within a round."""
    scored = cut_lineage(risk_score(df))
    flagged = isolation_outliers(scored, "Risk_Score", row_id, contamination)
    labelled = relabel_outliers(auto_label(flagged, k), row_id, neighbours)
    skip = (income,) if income.startswith("__") else ()
    trained, report = self_train(labelled, row_id, threshold, rounds, max_iter, exclude=skip, permute=permute)
    table = df.sparkSession.createDataFrame(report, "round int, feature string, importance double, permuted double")
    return apply_rules(trained, income), table


def label_risk(df: DataFrame, row_id: str = "respondent_id", k: int = 3, threshold: float = 0.9, rounds: int = 2, contamination: float = 0.05,
               neighbours: int = 7, income: str = "Income_Category", max_iter: int = 100) -> DataFrame:
    """Risk_Score, Outlier, Cluster, Auto_Label, Confidence and the risk level of every row."""
    return label_risk_report(df, row_id, k, threshold, rounds, contamination, neighbours, income, max_iter, permute=0)[0]
