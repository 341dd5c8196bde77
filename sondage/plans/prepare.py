"""Raw survey to decoded and encoded, labelled tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions.smooth import smooth_lifetime
from sondage.functions.text import label_text
from sondage.operators.encode import postprocess, range_smoothing, translate_survey
from sondage.operators.relate import attach
from sondage.operators.scale import scale_numeric
from sondage.operators.schema import ensure_columns, has_variation, ref, select_existing, strip_suffix


def split_branches(raw: DataFrame, row_id: str, vocabulary: dict | None = vocab.NOMINALS) -> tuple[DataFrame, DataFrame]:
    """(decoded, encoded) of a raw survey; both share the draws of a respondent."""
    survey = translate_survey(raw)
    decoded = range_smoothing(ensure_columns(survey, vocab.MULTI_COLUMNS), row_id, lifetimes=vocab.LIFETIMES)
    decoded = select_existing(decoded, [row_id, *vocab.DECODED_ORDER])
    encoded = strip_suffix(survey.drop(*vocab.MULTI_COLUMNS))
    encoded = range_smoothing(encoded, row_id, lifetimes=vocab.LIFETIMES, lifetime_fn=partial(smooth_lifetime, encoded=True))
    return decoded, postprocess(encoded, vocabulary)


def prepare(raw: DataFrame, row_id: str = "respondent_id", scaler_path: str | None = None, refit: bool = True,
            rules_on: str = "scaled", **label_options) -> tuple[DataFrame, DataFrame]:
    """(decoded, encoded): translate, smooth, encode, scale, score and label.

    The rule vote sees the scaled income by default; ``rules_on='raw'`` shows
    it the amounts. Raises when every row gets the same level.
    """
    from sondage.operators.label import label_risk

    decoded, encoded = split_branches(raw, row_id)
    # the whole-number table feeds the scaler, the score and the model; read it once
    encoded = encoded.persist()
    income = "Income_Category"
    if rules_on == "raw":
        income = "__income"
        scaled = scale_numeric(encoded.withColumn(income, F.col("Income_Category")), vocab.SCALED, scaler_path, refit)
    else:
        scaled = scale_numeric(encoded, vocab.SCALED, scaler_path, refit)
    labelled = label_risk(scaled, row_id, income=income, **label_options).drop("__income")
    if not has_variation(labelled, vocab.TARGET):
        raise ValueError("all rows have the same risk level")
    levels = labelled.select(ref(row_id), label_text(F.col(vocab.TARGET)).alias(vocab.TARGET))
    return attach(decoded, levels, row_id), labelled
