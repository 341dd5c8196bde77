"""Source and sink queries: write to the checkpoint folder, read back, compare with the source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import ENCODED, LABELS, NUMBERS, ROW_ID, SURVEY, encoded_columns, encoded_table, ident, numeric_survey, query, read_table, rounded, survey_raw
from catalog.profile import TWO, two_labels
from sondage import vocab
from sondage.operators import cluster, encode, profile, scale
from sondage.operators.schema import ref, split_target
from sondage.session import ensure_checkpoint_dir
from sondage.sources import tables


def folder(spark) -> str:
    """A fresh folder beside the session's checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@query("csv_survey_round_trip", f"{SURVEY} SELECT respondent_id, {', '.join(LABELS)} FROM survey")
def csv_survey_round_trip(spark, d):
    """Titles with line breaks and commas survive a CSV file."""
    path = folder(spark)
    tables.write_table(survey_raw(spark, d), path, "csv")
    df = encode.translate_survey(tables.read_survey(spark, path))
    return df.select(F.col(ROW_ID).cast("long").alias(ROW_ID), *LABELS)


@query("csv_encoded_round_trip", f"{ENCODED} SELECT respondent_id, {', '.join(ident(c) for c in encoded_columns())} FROM encoded")
def csv_encoded_round_trip(spark, d):
    path = folder(spark)
    tables.write_table(encoded_table(spark, d), path, "csv")
    return tables.read_encoded(spark, path).select(F.col(ROW_ID).cast("long").alias(ROW_ID), *[ref(c) for c in encoded_columns()])


@query("parquet_round_trip", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def parquet_round_trip(spark, d):
    path = folder(spark)
    tables.write_table(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return tables.read_encoded(spark, path, fmt="parquet")


@query("scaler_round_trip", f"{ENCODED} SELECT respondent_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in vocab.SCALED) + " FROM encoded")
def scaler_round_trip(spark, d):
    """Fit and save on one pass, load and apply on the next."""
    path = folder(spark)
    df = encoded_table(spark, d).select(ROW_ID, *vocab.SCALED)
    scale.scale_numeric(df, vocab.SCALED, path)
    return rounded(scale.scale_numeric(df, vocab.SCALED, path, fit=False))


@query("export_pair", f"{ENCODED} SELECT e.respondent_id, e.Age, s.Gender, (e.Debt_Level >= 3)::INT AS Behavior_Risk_Level FROM encoded e JOIN survey s USING (respondent_id)")
def export_pair(spark, d):
    path = folder(spark)
    enc = encoded_table(spark, d).withColumns({vocab.TARGET: (F.col("Debt_Level") >= 3).cast("int"), "Cluster": F.lit(0)})
    dec = survey_raw(spark, d)
    dec = encode.translate_survey(dec)
    tables.export_pair(dec, enc, path)
    back = tables.read_encoded(spark, f"{path}/encoded")
    if "Cluster" in back.columns:
        raise AssertionError("auxiliary columns stay out of the export")
    written = tables.read_survey(spark, f"{path}/decoded")
    checked = written.agg(F.count(F.lit(1)).alias("n")).first()[0]
    genders = dec.select(ROW_ID, "Gender")
    return back.filter(F.lit(checked) > 0).select(F.col(ROW_ID).cast("long").alias(ROW_ID), "Age", vocab.TARGET).join(genders, ROW_ID)


@query("json_history", "SELECT l_linenumber AS round, count(*) AS generated FROM lineitem GROUP BY 1")
def json_history(spark, d):
    path = folder(spark)
    sizes = read_table(spark, d, "lineitem").groupBy("l_linenumber").count().collect()
    history = [{"round": r[0], "generated": r[1], "new_total": r[1], "metrics": {"cohen_kappa": 1.0, "f1_score": 1.0, "cosine_similarity": 1.0, "ks_distance": {"a": 0.0}}} for r in sizes]
    tables.write_history(spark, history, path, tables.GENERATOR_SCHEMA)
    return spark.read.json(path).select(F.inline("augmentation_history")).select(F.col("round").cast("int").alias("round"), "generated")


# the columns of the decoded file that the derived survey has as plain labels
_DECODED = [c for c in vocab.DECODED_ORDER if c in LABELS]


@query("export_pair_decoded", f"{SURVEY} SELECT {', '.join(ident(c) for c in _DECODED)} FROM survey")
def export_pair_decoded(spark, d):
    """Every label column of the decoded file, read back from it."""
    path = folder(spark)
    tables.export_pair(encode.translate_survey(survey_raw(spark, d)), encoded_table(spark, d), path)
    return tables.read_survey(spark, f"{path}/decoded").select(*[ref(c) for c in _DECODED])


@query("pca_files", """WITH s AS (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round((a + b) / sqrt(2), 5) + 0.0 AS PC1, 2 AS features, round(1 / sqrt(2), 5) AS least, round(1 / sqrt(2), 5) AS most FROM s""")
def pca_files(spark, d):
    """Loadings and projection written, read back and put side by side: both features load alike on the one component."""
    path = folder(spark)
    df = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    fit = cluster.fit_pca(df.select("l_quantity", "l_extendedprice"))
    tables.write_pca(cluster.loadings(df, fit), cluster.project_pca(df, fit).select("l_orderkey", "l_linenumber", "PC1"), path)
    loads = tables.read_encoded(spark, f"{path}/pca_loadings", fmt="parquet")
    loads = loads.agg(F.count("feature").cast("int").alias("features"), F.min("PC1").alias("least"), F.max("PC1").alias("most"))
    return rounded(tables.read_encoded(spark, f"{path}/pca_transformed_data", fmt="parquet").join(F.broadcast(loads)), 5)


def _stats_sql(name: str, label: str) -> str:
    return f"""SELECT '{name}' AS sheet, {label} AS cluster, count(*) AS count, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS std,
round(min(o_totalprice), 3) AS min, round(median(o_totalprice), 3) AS median, round(max(o_totalprice), 3) AS max, NULL::DOUBLE AS difference FROM two GROUP BY 2"""


@query("analysis_files", f"""{TWO}, k AS ({_stats_sql('K-Means', 'cluster_kmeans')}), g AS ({_stats_sql('GMM', 'cluster_gmm')}),
m AS (SELECT cluster_kmeans AS cluster, round(avg(o_totalprice), 3) AS a, row_number() OVER (ORDER BY cluster_kmeans) AS p FROM two GROUP BY 1), n AS (SELECT round(avg(o_totalprice), 3) AS b, row_number() OVER (ORDER BY cluster_gmm) AS p FROM two GROUP BY cluster_gmm)
FROM k UNION ALL FROM g UNION ALL SELECT 'Comparison', cluster, NULL, a, NULL, NULL, NULL, NULL, round(a - b, 3) FROM m JOIN n USING (p)""")
def analysis_files(spark, d):
    """The three risk-score tables, written, read back and stacked."""
    path = folder(spark)
    df = two_labels(spark, d)
    tables.write_analysis(*profile.risk_score_analysis(df, df, "o_totalprice"), path)
    stats = ["count", "mean", "std", "min", "median", "max"]
    sheets = []
    for name, label in (("K-Means", "cluster_kmeans"), ("GMM", "cluster_gmm")):
        sheet = tables.read_encoded(spark, f"{path}/risk_score_analysis/{name}", fmt="parquet")
        sheets.append(sheet.select(F.lit(name).alias("sheet"), F.col(label).alias("cluster"), *stats, F.lit(None).cast("double").alias("difference")))
    both = tables.read_encoded(spark, f"{path}/risk_score_analysis/Comparison", fmt="parquet").withColumnRenamed("kmeans_mean", "mean")
    sheets.append(both.select(F.lit("Comparison").alias("sheet"), "cluster", "mean", "difference"))
    return rounded(sheets[0].unionByName(sheets[1]).unionByName(sheets[2], allowMissingColumns=True), 3)


@query("feature_target_split", f"SELECT c_custkey, c_acctbal, (c_acctbal < 0)::INT AS {vocab.TARGET} FROM customer")
def feature_target_split(spark, d):
    """Auxiliary columns are neither features nor target."""
    df = read_table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("Cluster"), F.lit(0.5).alias("Confidence"), F.lit(1).alias("Risk_Score"), (F.col("c_acctbal") < 0).cast("int").alias(vocab.TARGET))
    names, target = split_target(df)
    return df.select(*names, target)
