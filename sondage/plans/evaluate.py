"""Train and judge classifiers on an encoded table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sondage import vocab
from sondage.operators import models, profile
from sondage.operators.encode import impute
from sondage.operators.relate import remove_exact_duplicates, stratified_split
from sondage.operators.schema import drop_if_present, features_of
from sondage.session import cut_lineage
from sondage.sources.tables import write_json


@dataclass
class Evaluation:
    models: dict[str, models.Fitted]
    metrics: DataFrame
    boxes: DataFrame
    heat: DataFrame
    curve: DataFrame

    def write(self, folder: str) -> None:
        write_json(self.metrics, f"{folder}/dataset_metrics")


def evaluate(test: DataFrame, train: DataFrame | None = None, row_id: str = "respondent_id", target: str = vocab.TARGET, names: list[str] | None = None) -> Evaluation:
    """One table is split 75/25; two tables are used as they are, without shared rows."""
    test = drop_if_present(impute(test), vocab.EXCLUDED)
    if train is None:
        split = cut_lineage(stratified_split(test, target, 0.25, row_id))
        train, test = split.filter("is_test = 0").drop("is_test"), split.filter("is_test = 1").drop("is_test")
    else:
        train = drop_if_present(impute(train), vocab.EXCLUDED)
        train = cut_lineage(remove_exact_duplicates(train, test, row_id))
    features = features_of(train, target, row_id)
    fitted, table = models.train_suite(train, test, features, target, row_id, names)
    report = models.overfit_report(fitted, train, test, target)
    shown = [c for c in [*vocab.RISK_FACTORS, target, *vocab.HEATMAP_FLAGS] if c in test.columns]
    return Evaluation(
        fitted, models.metrics_table(table, report, fitted), profile.factor_boxes(test, target=target), profile.corr_matrix(test, shown),
        models.learning_curve(test, features, target, row_id),
    )
