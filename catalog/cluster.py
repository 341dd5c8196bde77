"""Clustering and labelling queries; of iterative fits SQL recomputes the facts that any right fit has to satisfy."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog.base import ENCODED, ROW_ID, SCORED, encoded_columns, encoded_table, facts_sql, ident, query, read_table, rounded
from catalog.neighbours import VALUES, VECTORS, vectors
from sondage import vocab
from sondage.operators import certify, cluster, label, metrics, scale


@query("pca_scree", """WITH s AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT 1 AS component, round((1 + abs(r)) / 2, 6) AS ratio FROM s UNION ALL SELECT 2, round((1 - abs(r)) / 2, 6) FROM s""")
def pca_scree(spark, d):
    """Two standardised columns: the shares follow from their correlation."""
    df = read_table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    return rounded(cluster.scree_rows(df, cluster.fit_pca(df)).select("component", "ratio"))


_VARYING = " + ".join(f"(max({ident(c)}) <> min({ident(c)}))::INT" for c in encoded_columns())


@query("pca_loadings", facts_sql(ENCODED, {
    "orthonormal": "1", "eigenvectors": "1", "falling": "1", "shares": "1", "total": "1", "trace": f"(SELECT {_VARYING} FROM encoded)", "features": str(len(encoded_columns())), "loadings": "10", "ordered": "1"}))
def pca_loadings(spark, d):
    """Components of the whole encoded survey: orthonormal eigenvectors of its correlations, whose trace counts the columns that vary."""
    df = encoded_table(spark, d)
    fit = cluster.fit_pca(df, row_id=ROW_ID)
    found = certify.pca_facts(df, fit)
    top = [abs(r["PC1"]) for r in cluster.top_loadings(cluster.loadings(df, fit)).collect()]
    return certify.facts(df, {
        "orthonormal": found["skew"] < 1e-6, "eigenvectors": found["residual"] < 1e-6, "falling": found["falling"], "shares": found["shares"] < 1e-6, "total": round(found["total"], 6),
        "trace": round(found["trace"], 6), "features": len(fit.features), "loadings": len(top), "ordered": top == sorted(top, reverse=True)})


@query("pca_project", """WITH s AS (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round((a + b) / sqrt(2), 5) + 0.0 AS PC1 FROM s""")
def pca_project(spark, d):
    df = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    fit = cluster.fit_pca(df.select("l_quantity", "l_extendedprice"))
    return rounded(cluster.project_pca(df, fit).select("l_orderkey", "l_linenumber", "PC1"), 5)


_SQUARES = f"""{VECTORS}, m AS (SELECT [{", ".join(f"avg(e[{i}])" for i in range(1, 65))}] AS c, count(*) AS n FROM v), t AS (SELECT sum(list_distance(e, c) ** 2) AS squares, max(n) AS n FROM v, m)"""


@query("kmeans_range", f"{_SQUARES} SELECT k::INT AS k, round(squares, 3) AS squares, n::BIGINT AS rows, 0::BIGINT AS astray, true AS centred, true AS inertia, true AS silhouette FROM t, (SELECT unnest(range(2, 11)) AS k)")
def kmeans_range(spark, d):
    """Of the best of ten starts for each k: squares within and between clusters, which add up to those of the table, rows outside their
    nearest centre's cluster, and whether centres are means, the reported inertia is the one within, and the silhouette is one."""
    found = cluster.kmeans_range(vectors(spark, d), VALUES, "vec_id")
    told, rows = {r["k"]: r for r in found.table.collect()}, []
    for k, model in found.models.items():
        f = certify.kmeans_facts(found.labelled, VALUES, model.clusterCenters(), f"k{k}")
        own = abs(f["within"] - told[k]["inertia"]) <= 1e-6 * f["within"]
        rows.append((k, f["squares"], int(f["rows"]), int(f["astray"]), f["drift"] < 1e-2, own, -1 <= told[k]["silhouette"] <= 1))
    return rounded(spark.createDataFrame(rows, "k int, squares double, rows long, astray long, centred boolean, inertia boolean, silhouette boolean"), 3)


@query("silhouette_by_k", "SELECT unnest(range(2, 11))::INT AS k, true AS in_range, true AS best_is_highest, 1::BIGINT AS marked")
def silhouette_by_k(spark, d):
    found = cluster.kmeans_range(vectors(spark, d), VALUES, "vec_id")
    rows = cluster.silhouette_rows(found.table).collect()
    high = max(r["silhouette"] for r in rows)
    marked = sum(r["best"] for r in rows)
    return spark.createDataFrame([(r["k"], -1 <= r["silhouette"] <= 1, r["best"] == (r["silhouette"] == high), marked) for r in rows], "k int, in_range boolean, best_is_highest boolean, marked long")


@query("best_k_elbow", """WITH t AS (SELECT l_linenumber AS k, sum(l_quantity) AS inertia FROM lineitem GROUP BY 1), f AS (SELECT k, inertia - lag(inertia) OVER (ORDER BY k) AS fall FROM t)
SELECT k::INT AS elbow FROM f WHERE fall IS NOT NULL ORDER BY fall, k LIMIT 1""")
def best_k_elbow(spark, d):
    table = read_table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("inertia"))
    return spark.createDataFrame([(cluster.best_k(table, "elbow"),)], "elbow int")


@query("gmm_clusters", facts_sql(VECTORS, {
    "rows": "(SELECT count(*) FROM v)", "weights": "1", "probabilities": "1", "confident": "1", "clusters": "1",
    "bic_aic": "(SELECT round((2 + 3 * 64 + 3 * 64 * 65 / 2) * (ln(count(*)) - 2), 4) FROM v)", **{f"mean_{i}": f"(SELECT round(avg(e[{i + 1}]), 5) + 0.0 FROM v)" for i in range(64)}}))
def gmm_clusters(spark, d):
    """Of the mixture: its mean vector, which is the table's, its weights, the probabilities of each row, and what its two criteria differ by."""
    fit = cluster.gmm(vectors(spark, d), VALUES, 3, "vec_id")
    found = certify.mixture_facts(fit.labelled, list(fit.model.weights), [g.mean.toArray() for g in fit.model.gaussians])
    row = fit.labelled.agg(F.count(F.lit(1)), F.min("cluster_confidence"), F.max("cluster_confidence"), F.min("cluster_gmm"), F.max("cluster_gmm")).first()
    return certify.facts(fit.labelled, {
        "rows": row[0], "weights": round(found["weights"], 6), "probabilities": found["off"] < 1e-9, "confident": 1 / 3 - 1e-9 <= row[1] and row[2] <= 1 + 1e-9, "clusters": 0 <= row[3] and row[4] <= 2,
        "bic_aic": round(fit.bic - fit.aic, 4), **{f"mean_{i}": round(found[f"mean_{i}"], 5) + 0.0 for i in range(64)}})


@query("clustering_summary", facts_sql(VECTORS, {"figures": "8", "cells": "(SELECT count(*) FROM v)", "k": "1", "agreement": "1", "rand": "1", "difference": "1", "bic_aic": "1"}))
def clustering_summary(spark, d):
    df = vectors(spark, d)
    found = cluster.kmeans_range(df, VALUES, "vec_id")
    fit = cluster.gmm(df, VALUES, found.best, "vec_id")
    both = found.labelled.select("vec_id", F.col(f"k{found.best}").alias("cluster_kmeans")).join(fit.labelled.select("vec_id", "cluster_gmm"), "vec_id").persist()
    best = found.table.filter(F.col("k") == found.best).first()["silhouette"]
    ari = metrics.adjusted_rand(both, "cluster_kmeans", "cluster_gmm").first()[0]
    agreed = metrics.agreement(both, "cluster_kmeans", "cluster_gmm").first()[0]
    told = {r["metric"]: r["value"] for r in cluster.clustering_summary(df, found.best, best, fit, ari, agreed).collect()}
    parts = {(r["part"], r["name"]): r["value"] for r in cluster.comparison_rows(both, best, fit.silhouette).collect()}
    k, n = found.best, both.count()
    free = (k - 1) + k * 64 + k * 64 * 65 / 2
    return certify.facts(df, {
        "figures": len(told), "cells": sum(v for (p, _), v in parts.items() if p == "crosstab"), "k": told["Optimal K"] == k and 2 <= k <= 10,
        "agreement": abs(told["Agreement Rate (%)"] - parts["agreement", "Agreement Rate (%)"]) < 1e-9 and 0 <= agreed <= 1, "rand": told["Adjusted Rand Index"] == parts["agreement", "Adjusted Rand Index"] <= 1,
        "difference": told["Silhouette Difference"] is None or abs(abs(told["K-Means Silhouette"] - told["GMM Silhouette"]) - told["Silhouette Difference"]) < 1e-9,
        "bic_aic": abs(told["GMM BIC"] - told["GMM AIC"] - free * (math.log(n) - 2)) < 1e-6 * abs(told["GMM BIC"])})


_SPAN = {"rows": "(SELECT count(*) FROM scored)", "low": "(SELECT round(min(Risk_Score), 6) FROM scored)", "high": "(SELECT round(max(Risk_Score), 6) FROM scored)"}


@query("bayes_gmm", facts_sql(SCORED, {**_SPAN, "clusters": "1", "safe": "1", "safest_is_lowest": "1"}))
def bayes_gmm(spark, d):
    df = label.auto_label(scale.risk_score(encoded_table(spark, d)))
    rows = df.groupBy("Cluster", "Auto_Label").agg(F.count(F.lit(1)).alias("n"), F.min("Risk_Score").alias("low"), F.max("Risk_Score").alias("high"), F.avg("Risk_Score").alias("mean")).collect()
    safe = [r for r in rows if r["Auto_Label"] == 0]
    return certify.facts(df, {
        "rows": sum(r["n"] for r in rows), "low": round(min(r["low"] for r in rows), 6), "high": round(max(r["high"] for r in rows), 6), "clusters": {r["Cluster"] for r in rows} <= {0, 1, 2} and len(rows) == len({r["Cluster"] for r in rows}),
        "safe": len(safe), "safest_is_lowest": all(r["mean"] >= safe[0]["mean"] for r in rows)})


@query("risk_clusters", facts_sql(SCORED, {**_SPAN, "counts": "7", "best": "1", "highest": "1", "levels": "1"}))
def risk_clusters(spark, d):
    """All component counts from 2 to 8: one is best, the one with the highest silhouette; level 0 is the cluster of the lowest mean."""
    out, table = cluster.risk_clusters(encoded_table(spark, d))
    tried = [(r["components"], r["silhouette"], r["best"]) for r in table.collect()]
    row = out.agg(F.count(F.lit(1)), F.min("Risk_Score"), F.max("Risk_Score"), F.avg(F.when(F.col(vocab.TARGET) == 0, F.col("Risk_Score"))), F.avg(F.when(F.col(vocab.TARGET) == 1, F.col("Risk_Score")))).first()
    return certify.facts(out, {
        "rows": row[0], "low": round(row[1], 6), "high": round(row[2], 6), "counts": len(tried), "best": sum(b for _, _, b in tried),
        "highest": max(s for _, s, b in tried if b) == max(s for _, s, _ in tried if s is not None and s == s), "levels": row[3] < row[4]})


@query("isolation_outliers", facts_sql(SCORED, {**_SPAN, "share": "1", "some": "1", "outer": "1"}))
def isolation(spark, d):
    """Flagged rows are some, at most a twentieth, and lie further out than the others."""
    df = cluster.isolation_outliers(scale.risk_score(encoded_table(spark, d)), "Risk_Score", ROW_ID)
    middle = df.agg(F.percentile("Risk_Score", 0.5)).first()[0]
    rows = {r["Outlier"]: r for r in df.groupBy("Outlier").agg(F.count(F.lit(1)).alias("n"), F.min("Risk_Score").alias("low"), F.max("Risk_Score").alias("high"), F.avg(F.abs(F.col("Risk_Score") - middle)).alias("far")).collect()}
    n = sum(r["n"] for r in rows.values())
    return certify.facts(df, {
        "rows": n, "low": round(min(r["low"] for r in rows.values()), 6), "high": round(max(r["high"] for r in rows.values()), 6), "share": rows[1]["n"] <= 0.05 * (n - 1) + 1, "some": rows[1]["n"] > 0, "outer": rows[1]["far"] > rows[0]["far"]})


@query("label_risk", facts_sql(SCORED, {"rows": _SPAN["rows"], "score": "(SELECT round(avg(Risk_Score), 5) + 0.0 FROM scored)", "levels": "1", "sure": "1", "importances": "1", "permuted": "1", "first_counts": "1"}))
def label_risk(spark, d):
    """The whole labelling with what its levels rest on: per round the model's importances add up to 1, and permuting a feature it uses costs accuracy."""
    df = scale.standardise(encoded_table(spark, d), vocab.SCALED)[0]
    out, report = label.label_risk_report(df, ROW_ID)
    row = out.agg(F.count(F.lit(1)), F.avg("Risk_Score"), F.min(vocab.TARGET), F.max(vocab.TARGET), F.min("Confidence"), F.max("Confidence")).first()
    told = report.collect()
    sums = {}
    for r in told:
        sums[r["round"]] = sums.get(r["round"], 0.0) + r["importance"]
    unused = [r for r in told if r["importance"] == 0]
    return certify.facts(out, {
        "rows": row[0], "score": round(row[1], 5) + 0.0, "levels": {row[2], row[3]} <= {-1, 0, 1}, "sure": 0.5 <= row[4] and row[5] <= 1, "importances": bool(sums) and all(abs(v - 1) < 1e-6 for v in sums.values()),
        # a feature that no tree asks for changes nothing when it is dealt anew
        "permuted": all(r["permuted"] == 0 for r in unused), "first_counts": all(max((r for r in told if r["round"] == k), key=lambda r: r["importance"])["permuted"] > 0 for k in sums)})


@query("label_quality", f"""{SCORED}, v AS (SELECT (round(Risk_Score, 9) > 0.1)::INT AS y, CASE WHEN Debt_Level = 0 THEN -1 WHEN Debt_Level >= 3 THEN 1 ELSE 0 END AS p FROM scored), k AS (SELECT * FROM (VALUES (0), (1)) t(label)),
c AS (SELECT label, count(*) FILTER (y = label AND p = label)::DOUBLE AS tp, count(*) FILTER (y = label)::DOUBLE AS s, count(*) FILTER (p = label)::DOUBLE AS q FROM v, k WHERE p <> -1 GROUP BY 1)
SELECT label::VARCHAR AS label, round(tp / q, 6) AS precision, round(tp / s, 6) AS recall, s::BIGINT AS support, (SELECT count(*) FROM v WHERE p = -1)::DOUBLE AS unlabelled FROM c""")
def label_quality(spark, d):
    df = scale.risk_score(encoded_table(spark, d)).withColumns({
        "Auto_Label": (F.round("Risk_Score", 9) > 0.1).cast("int"),
        vocab.TARGET: F.when(F.col("Debt_Level") == 0, -1).when(F.col("Debt_Level") >= 3, 1).otherwise(0),
    })
    summary, report = label.label_quality(df)
    return rounded(report.filter("label IN ('0', '1')").select("label", "precision", "recall", "support", F.lit(summary["unlabelled"]).alias("unlabelled")))
