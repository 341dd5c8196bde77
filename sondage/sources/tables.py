"""Readers and writers of survey tables, metrics and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage import vocab
from sondage.operators.schema import select_existing


def read_survey(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "csv") -> DataFrame:
    """Raw survey; every column is text. Titles may hold line breaks."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_encoded(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "csv") -> DataFrame:
    """Encoded table; types are inferred unless a schema is given."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table; CSV gets a header and UTF-8."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    else:
        writer.format(fmt).save(path)


def write_pca(loadings: DataFrame, projected: DataFrame, folder: str, fmt: str = "parquet") -> None:
    write_table(loadings, f"{folder}/pca_loadings", fmt)
    write_table(projected, f"{folder}/pca_transformed_data", fmt)


def write_analysis(kmeans: DataFrame, gmm: DataFrame, pairs: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """The three risk-score tables side by side."""
    for name, table in (("K-Means", kmeans), ("GMM", gmm), ("Comparison", pairs)):
        write_table(table, f"{folder}/risk_score_analysis/{name}", fmt)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


HISTORY_METRICS = "struct<f1_weighted:double,silhouette:double,kappa:double,cosine_similarity:double,avg_knn_distance:double,anova_p_value:double>"
HISTORY_SCHEMA = f"phase int, round int, class_distribution array<bigint>, metrics {HISTORY_METRICS}, status string, applied boolean"
GENERATOR_METRICS = "struct<cohen_kappa:double,f1_score:double,cosine_similarity:double,ks_distance:map<string,double>>"
GENERATOR_SCHEMA = f"round int, generated bigint, new_total bigint, metrics {GENERATOR_METRICS}"


def history_frame(spark: SparkSession, history: list[dict], schema: str = HISTORY_SCHEMA) -> DataFrame:
    return spark.createDataFrame(history, T._parse_datatype_string(schema))


def write_history(spark: SparkSession, history: list[dict], path: str, schema: str = HISTORY_SCHEMA) -> None:
    """Loop history with the placeholder scores of a run that trained no model."""
    rounds = history_frame(spark, history, schema)
    wrapped = rounds.agg(F.collect_list(F.struct(*rounds.columns)).alias("augmentation_history")).select(
        "augmentation_history", F.lit(0.0).alias("f1_score"), F.lit(None).cast("double").alias("roc_auc"),
        F.lit(0.0).alias("cv_f1_mean"), F.lit(0.0).alias("cv_f1_std"),
    )
    write_json(wrapped.coalesce(1), path)


def export_pair(decoded: DataFrame, encoded: DataFrame, folder: str, fmt: str = "csv") -> None:
    """Decoded and encoded results of one run; auxiliary columns stay out of the encoded one."""
    write_table(select_existing(decoded, vocab.DECODED_ORDER), f"{folder}/decoded", fmt)
    write_table(encoded.drop(*vocab.AUXILIARY), f"{folder}/encoded", fmt)
