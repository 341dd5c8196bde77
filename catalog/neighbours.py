"""Nearest-neighbour queries with quadratic SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ROW_ID, SCORED, encoded_table, query, read_table, rounded, u_sql
from sondage.functions.draws import u
from sondage.operators import metrics, neighbours, scale


VALUES = [f"e{i}" for i in range(64)]


def vectors(spark, d):
    """Embeddings with their label as two risk classes."""
    df = read_table(spark, d, "embeddings")
    return df.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).alias("y"), "label",
                     *[F.get("embedding", i).cast("double").alias(c) for i, c in enumerate(VALUES)])


VECTORS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, (label % 2)::INT AS y, label, embedding::DOUBLE[] AS e FROM embeddings)"""


def pairs_sql(extra: str = "", field: str = "x") -> str:
    return f"{VECTORS}, p AS (SELECT a.vec_id, b.vec_id AS nbr_id, list_distance(a.{field}, b.{field}) AS dist, a.y AS ya, b.y AS yb FROM v a, v b WHERE a.vec_id <> b.vec_id {extra}), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr_id) AS rank FROM p)"


@query("knn_exact", f"{pairs_sql()} SELECT vec_id, nbr_id, round(dist, 5) AS dist, rank::INT AS rank FROM n WHERE rank <= 5")
def knn_exact(spark, d):
    return rounded(neighbours.knn(vectors(spark, d), F.col("x"), 5, "vec_id"), 5)


@query("knn_lsh_recall", "SELECT count(*) AS rows, 5 * count(*) AS neighbours, true AS enough FROM embeddings")
def knn_lsh_recall(spark, d):
    """The approximate search over all rows held against the exact one: the part of the neighbours found has to reach 0.9."""
    df = vectors(spark, d).select("vec_id", "x")
    found = neighbours.recall(neighbours.knn(df, F.col("x"), 5, "vec_id", method="lsh"), neighbours.knn(df, F.col("x"), 5, "vec_id"), "vec_id")
    return found.select("rows", "neighbours", (F.col("recall") >= 0.9).alias("enough"))


@query("knn_same_class", f"{pairs_sql('AND a.y = b.y')} SELECT vec_id, nbr_id, round(dist, 5) AS dist, rank::INT AS rank FROM n WHERE rank <= 5")
def knn_same_class(spark, d):
    return rounded(neighbours.knn(vectors(spark, d), F.col("x"), 5, "vec_id", group="y", relation="same"), 5)


@query("avg_knn_distance", f"{pairs_sql()} SELECT round(sum(dist) / (5.0 * (SELECT count(*) FROM v)), 5) AS distance FROM n WHERE rank <= 4".replace("list_distance(a.x, b.x)", "list_distance(a.e, b.e)"))
def avg_knn_distance(spark, d):
    value = neighbours.avg_knn_distance(vectors(spark, d), VALUES, "vec_id")
    return rounded(spark.createDataFrame([(value,)], "distance double"), 5)


@query("tomek_links", f"{pairs_sql()}, o AS (SELECT * FROM n WHERE rank = 1) SELECT a.vec_id FROM o a JOIN o b ON a.nbr_id = b.vec_id AND b.nbr_id = a.vec_id WHERE a.ya <> b.ya")
def tomek_links(spark, d):
    return neighbours.tomek_links(vectors(spark, d), F.col("x"), "y", "vec_id")


@query("knn_predict", f"{pairs_sql('AND a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0', 'e')} SELECT vec_id, (avg(yb) > 0.5)::INT AS predicted FROM n WHERE rank <= 5 GROUP BY 1")
def knn_predict(spark, d):
    df = vectors(spark, d)
    return neighbours.knn_predict(df.filter("vec_id % 4 = 0"), df.filter("vec_id % 4 <> 0"), VALUES, "y", 5, "vec_id")


@query("knn_vote_1d", f"""{SCORED}, v AS (SELECT respondent_id AS id, round(Risk_Score, 6) AS x, (Risk_Score > 0.1)::INT AS l, ({u_sql('respondent_id', 'outlier')} < 0.05) AS o FROM scored),
p AS (SELECT a.id, b.l, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.x - b.x), b.id) AS r FROM v a, v b WHERE a.o AND NOT b.o)
SELECT id AS respondent_id, (sum(l) >= 4)::INT AS predicted FROM p WHERE r <= 7 GROUP BY 1""")
def knn_vote_1d(spark, d):
    df = scale.risk_score(encoded_table(spark, d)).select(ROW_ID, F.round("Risk_Score", 6).alias("Risk_Score"), (F.col("Risk_Score") > 0.1).cast("int").alias("l"))
    far = u(ROW_ID, "outlier") < 0.05
    return neighbours.knn_vote_1d(df.filter(far), df.filter(~far), "Risk_Score", "l", 7, ROW_ID)


@query("silhouette_exact", f"""{VECTORS}, s AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e)) AS s FROM v a, v b GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM v GROUP BY 1),
t AS (SELECT vec_id, max(s / greatest(n - 1, 1)) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b, max(n) FILTER (own = other) AS size FROM s JOIN n ON n.label = s.other GROUP BY 1)
SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette, 'euclidean' AS metric FROM t""")
def silhouette_exact(spark, d):
    value, metric = metrics.silhouette(vectors(spark, d), VALUES, "label", "vec_id", "exact")
    return rounded(spark.createDataFrame([(value, metric)], "silhouette double, metric string"), 5)


@query("silhouette_fast", f"""{VECTORS}, k AS (SELECT label, count(*) AS n, [{", ".join(f"avg(e[{i}])" for i in range(1, 65))}] AS c, avg(list_inner_product(e, e)) AS q FROM v GROUP BY 1),
s AS (SELECT vec_id, v.label AS own, k.label AS other, n, list_inner_product(e, e) - 2 * list_inner_product(e, c) + q AS m FROM v, k),
t AS (SELECT vec_id, max(m * n / greatest(n - 1, 1)) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b, max(n) FILTER (own = other) AS size FROM s GROUP BY 1)
SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette, 'squared_euclidean' AS metric FROM t""")
def silhouette_fast(spark, d):
    value, metric = metrics.silhouette(vectors(spark, d), VALUES, "label", "vec_id", "fast")
    return rounded(spark.createDataFrame([(value, metric)], "silhouette double, metric string"), 5)
