"""Enlarge a labelled table by oversampling or by the tabular generator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sondage import vocab
from sondage.operators import augment
from sondage.operators.relate import synthetic_only
from sondage.operators.schema import uncast_booleans
from sondage.sources.tables import GENERATOR_SCHEMA, write_history, write_table


def oversample(df: DataFrame, folder: str | None = None, total: int = 2000, row_id: str = "respondent_id", only_new: bool = False,
               state: augment.GrowState | None = None) -> tuple[DataFrame, list[dict]]:
    """Balance, expand and relabel; optionally keep only the rows that are not in the original."""
    grown, history = augment.augment_smote(df, total, vocab.TARGET, row_id, state)
    if only_new:
        original = df.select(*[f"`{c}`" for c in df.columns if c != row_id])
        grown = synthetic_only(grown, original)
    if folder:
        write_table(grown, f"{folder}/augmented_dataset_encoded", "csv")
        write_history(df.sparkSession, history, f"{folder}/augmentation_metrics")
    return grown, history


def generate(df: DataFrame, folder: str | None = None, max_size: int = 2000, row_id: str = "respondent_id", **options) -> tuple[DataFrame, list[dict], DataFrame]:
    """Filtered growth to ``max_size``, then an exact half of each class; (rows, history, summary)."""
    grown, history, funnel = augment.augment_filtered(df, max_size, row_id=row_id, **options)
    grown = augment.top_up(grown, max_size, row_id=row_id, funnel=funnel)
    if folder:
        write_table(uncast_booleans(grown), f"{folder}/augmented_dataset_encoded", "csv")
        write_history(df.sparkSession, history, f"{folder}/augmentation_metrics", GENERATOR_SCHEMA)
    return grown, history, augment.augmentation_summary(grown, funnel)
