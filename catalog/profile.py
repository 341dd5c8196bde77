"""Aggregation, correlation, distribution and figure-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ENCODED, ROW_ID, SCORED, encoded_columns, encoded_table, ident, query, read_table, rounded, u_sql
from sondage import vocab
from sondage.functions.draws import u
from sondage.operators import profile, scale
from sondage.operators.metrics import adjusted_rand, agreement
from sondage.operators.schema import ref

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def two_labels(spark, d):
    """Orders with two labelings: by draw, and by price."""
    df = read_table(spark, d, "orders")
    a = F.floor(u("o_orderkey", "a") * 3).cast("int")
    return df.select("o_orderkey", "o_totalprice", "o_custkey", a.alias("cluster_kmeans"),
                     F.when(F.col("o_totalprice") > 250000, F.lit(2)).otherwise(a % 2).cast("int").alias("cluster_gmm"))


TWO = f"""WITH a AS (SELECT o_orderkey, o_totalprice, o_custkey, floor({u_sql('o_orderkey', 'a')} * 3)::INT AS cluster_kmeans FROM orders),
two AS (SELECT *, (CASE WHEN o_totalprice > 250000 THEN 2 ELSE cluster_kmeans % 2 END)::INT AS cluster_gmm FROM a)"""


@query("class_counts", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def class_counts(spark, d):
    return profile.class_counts(read_table(spark, d, "orders"), "o_orderpriority")


def stats_sql(by: str, target: str, source: str) -> str:
    return f"""SELECT {by}, count({target}) AS count, round(avg({target}), 3) AS mean, round(stddev_samp({target}), 3) AS std, round(min({target}), 3) AS min,
round(quantile_cont({target}, 0.5), 3) AS median, round(max({target}), 3) AS max FROM {source} GROUP BY 1"""


@query("score_stats", stats_sql("event_type", "value", "events"))
def score_stats(spark, d):
    return profile.score_stats(read_table(spark, d, "events"), "event_type", "value")


@query("group_quantiles_ranked", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def group_quantiles_ranked(spark, d):
    """Exact group quantiles through range buckets, as used for continuous columns."""
    from sondage.operators.order import group_quantiles

    return rounded(group_quantiles(read_table(spark, d, "events"), ["event_type"], "value", [0.25, 0.9], ["q1", "p90"], small=0))


@query("risk_score_analysis", f"""{TWO}, a1 AS (SELECT cluster_kmeans AS cluster, round(avg(o_totalprice), 3) AS kmeans_mean, row_number() OVER (ORDER BY cluster_kmeans) AS p FROM two GROUP BY 1),
b1 AS (SELECT round(avg(o_totalprice), 3) AS gmm_mean, row_number() OVER (ORDER BY cluster_gmm) AS p FROM two GROUP BY cluster_gmm)
SELECT cluster, kmeans_mean, gmm_mean, round(kmeans_mean - gmm_mean, 3) AS difference FROM a1 JOIN b1 USING (p)""")
def risk_score_analysis(spark, d):
    df = two_labels(spark, d)
    return rounded(profile.risk_score_analysis(df, df, "o_totalprice")[2], 3)


@query("cluster_profiles", f"""{TWO} SELECT 'KMeans_C' || cluster_kmeans AS cluster, round(avg(o_totalprice), 4) AS o_totalprice, round(avg(o_custkey), 4) AS o_custkey FROM two GROUP BY 1
UNION ALL SELECT 'GMM_C' || cluster_gmm, round(avg(o_totalprice), 4), round(avg(o_custkey), 4) FROM two GROUP BY 1""")
def cluster_profiles(spark, d):
    return rounded(profile.cluster_profiles(two_labels(spark, d), ["o_totalprice", "o_custkey"]), 4)


@query("crosstab", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def crosstab(spark, d):
    return profile.crosstab(read_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("contingency", f"{TWO} SELECT cluster_kmeans, cluster_gmm, count(*) AS count FROM two GROUP BY 1, 2")
def contingency(spark, d):
    return profile.contingency(two_labels(spark, d), "cluster_kmeans", "cluster_gmm")


def corr_sql(columns: list[str], source: str) -> str:
    parts = [f"SELECT '{x}' AS x, '{y}' AS y, " + ("1.0::DOUBLE" if x == y else f"round(corr({x}, {y}), 6) + 0.0") + f" AS r FROM {source}" + (" LIMIT 1" if x == y else "") for x in columns for y in columns]
    return " UNION ALL ".join(f"({p})" for p in parts)


@query("corr_matrix", corr_sql(LINE, "lineitem"))
def corr_matrix(spark, d):
    return rounded(profile.corr_matrix(read_table(spark, d, "lineitem"), LINE))


_ENC_GROUPS = {g: [ident(c) for c in encoded_columns()
                   if c in names or c.startswith(tuple(prefixes))] if prefixes else [ident(c) for c in names] for g, (names, prefixes) in vocab.GROUPS.items()}


def top_pairs_sql() -> str:
    """Signed correlations per column group from long rows, so the SQL stays short."""
    parts = []
    for g, cols in _ENC_GROUPS.items():
        for i, x in enumerate(cols):
            for j in range(i + 1, len(cols)):
                parts.append(f"SELECT '{g}' AS g, '{x[1:-1]}' AS x, '{cols[j][1:-1]}' AS y, {i} AS i, {j} AS j, corr({x}, {cols[j]}) AS r FROM encoded".replace("Don't", "Don''t", 0))
    safe = [p.replace("'Budget_Planning_Don't plan at all'", "'Budget_Planning_Don''t plan at all'") for p in parts]
    return f"{ENCODED}, p AS ({' UNION ALL '.join(safe)}) SELECT g AS \"group\", x, y, round(r, 6) + 0.0 AS r FROM p WHERE r IS NOT NULL AND NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY g ORDER BY r DESC, i, j) <= 3"


@query("top_pairs", top_pairs_sql())
def top_pairs(spark, d):
    return rounded(profile.top_pairs(encoded_table(spark, d)))


@query("target_corr", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(abs(corr({c}, l_extendedprice)), 6) AS abs_r FROM lineitem" for c in ["l_quantity", "l_discount", "l_tax"]))
def target_corr(spark, d):
    df = read_table(spark, d, "lineitem").select(*LINE)
    return rounded(profile.target_corr(df, "l_extendedprice"))


@query("survey_target_corr", f"""{SCORED}, p AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, abs(corr({c}, Risk_Score)) AS r FROM scored" for c in [*vocab.SCALED, 'Debt_Level', 'Impulse_Buying_Frequency', 'Bank_Account_Analysis_Frequency'])})
SELECT c AS "column", round(r, 6) AS abs_r FROM p ORDER BY r DESC, c LIMIT 5""")
def survey_target_corr(spark, d):
    keep = [*vocab.SCALED, "Debt_Level", "Impulse_Buying_Frequency", "Bank_Account_Analysis_Frequency"]
    df = scale.risk_score(encoded_table(spark, d)).select(*keep, "Risk_Score")
    return rounded(profile.target_corr(df))


@query("histogram", """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders),
h AS (SELECT least(floor((o_totalprice - lo) / w), 29)::INT AS bin, count(*) AS n FROM orders, r GROUP BY 1)
SELECT b.range::INT AS bin, round(lo + b.range * w, 4) AS "left", round(lo + (b.range + 1) * w, 4) AS "right", coalesce(n, 0)::BIGINT AS count FROM range(30) b CROSS JOIN r LEFT JOIN h ON h.bin = b.range""")
def histogram(spark, d):
    return rounded(profile.histogram(read_table(spark, d, "orders"), "o_totalprice"), 4)


@query("kde", """WITH r AS (SELECT count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, stddev_samp(l_quantity) AS sd FROM lineitem),
c AS (SELECT lo + (least(floor((l_quantity - lo) / ((hi - lo) / 2048)), 2047) + 0.5::DOUBLE) * ((hi - lo) / 2048) AS v, count(*) AS m FROM lineitem, r GROUP BY 1), g AS (SELECT range AS k FROM range(200))
SELECT round(lo + k * (hi - lo) / 199, 5) AS x, round(sum(m * exp(-0.5 * pow((lo + k * (hi - lo) / 199 - v) / (sd * pow(n, -0.2)), 2))) / (any_value(n) * any_value(sd) * pow(any_value(n), -0.2) * sqrt(2 * pi())), 6) AS density
FROM g, c, r GROUP BY lo, hi, k""")
def kde(spark, d):
    out = profile.kde(read_table(spark, d, "lineitem"), "l_quantity")
    return out.select(F.round("x", 5).alias("x"), F.round("density", 6).alias("density"))


def box_sql(column: str, by: str, source: str) -> str:
    return f"""q AS (SELECT {by}, quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median, quantile_cont({column}, 0.75) AS q3 FROM {source} GROUP BY ALL),
f AS (SELECT q.*, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@query("box_stats", f"""WITH {box_sql('value', 'event_type', 'events')} SELECT f.event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
round(min(value) FILTER (value BETWEEN lo AND hi), 6) AS whisker_low, round(max(value) FILTER (value BETWEEN lo AND hi), 6) AS whisker_high, count(*) FILTER (value NOT BETWEEN lo AND hi) AS outliers
FROM events e JOIN f ON e.event_type = f.event_type GROUP BY ALL""")
def box_stats(spark, d):
    return rounded(profile.box_stats(read_table(spark, d, "events"), "value", ["event_type"]))


@query("box_outliers", f"WITH {box_sql('value', 'event_type', 'events')} SELECT event_id, e.event_type, round(value, 6) AS value FROM events e JOIN f ON e.event_type = f.event_type WHERE value NOT BETWEEN lo AND hi")
def box_outliers(spark, d):
    return rounded(profile.box_outliers(read_table(spark, d, "events"), "value", "event_id", ["event_type"]))


@query("fit_line", """SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem""")
def fit_line(spark, d):
    return rounded(profile.fit_line(read_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 4)


@query("scalar_stats", """SELECT quantile_cont(l_quantity, 0.5) AS median, round(avg(l_quantity), 6) AS mean, (SELECT l_quantity FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem""")
def scalar_stats(spark, d):
    df = read_table(spark, d, "lineitem")
    return rounded(spark.createDataFrame([profile.scalar_stats(df, "l_quantity")]))


@query("argmin_group", "SELECT event_type AS safest, 5 AS means FROM events GROUP BY 1 ORDER BY avg(value), 1 LIMIT 1")
def argmin_group(spark, d):
    df = read_table(spark, d, "events")
    return df.agg(F.lit(profile.argmin_group(df, "event_type", "value")).alias("safest"), F.count_distinct("event_type").cast("int").alias("means"))


@query("mean_vector", f"SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in LINE)} FROM lineitem")
def mean_vector(spark, d):
    df = read_table(spark, d, "lineitem")
    return rounded(spark.createDataFrame([tuple(profile.mean_vector(df, LINE))], LINE))


@query("adjusted_rand", f"""{TWO}, c AS (SELECT cluster_kmeans AS a, cluster_gmm AS b, count(*)::DOUBLE AS n FROM two GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS r,
(SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS k, (SELECT sum(n) FROM c) AS n)
SELECT round((i - r * k / (n * (n - 1) / 2)) / ((r + k) / 2 - r * k / (n * (n - 1) / 2)), 6) AS ari FROM s""")
def adjusted_rand_query(spark, d):
    return rounded(adjusted_rand(two_labels(spark, d), "cluster_kmeans", "cluster_gmm"))


@query("agreement", f"{TWO} SELECT round(avg((cluster_kmeans = cluster_gmm)::INT), 6) AS agreement FROM two")
def agreement_query(spark, d):
    return rounded(agreement(two_labels(spark, d), "cluster_kmeans", "cluster_gmm"))


# ----------------------------------------------------------- figure tables


@query("univariate_tables", f"""WITH t AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, {c}::DOUBLE AS v FROM lineitem" for c in LINE)}),
s AS (SELECT c, min(v) AS lo, max(v) - min(v) AS span, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS band, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM t GROUP BY 1),
h AS (SELECT c, least(floor((v - lo) / (span / 30)), 29)::INT AS bin, count(*) AS m FROM t JOIN s USING (c) GROUP BY ALL),
f AS (SELECT c, lo + (least(floor((v - lo) / (span / {profile.DENSITY_BINS})), {profile.DENSITY_BINS - 1}) + 0.5) * (span / {profile.DENSITY_BINS}) AS x, count(*) AS m FROM t JOIN s USING (c) GROUP BY ALL),
w AS (SELECT c, q1, median, q3, min(v) AS whisker_low, max(v) AS whisker_high FROM t JOIN s USING (c) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL),
o AS (SELECT s.c, 'histogram' AS part, lo + b.k * (span / 30) AS position, coalesce(m, 0)::DOUBLE AS value FROM s CROSS JOIN range(30) b(k) LEFT JOIN h ON h.c = s.c AND h.bin = b.k
UNION ALL SELECT s.c, 'density', lo + g.k * (span / 199), sum(m * exp(-0.5 * pow((lo + g.k * (span / 199) - x) / band, 2))) / (n * band * sqrt(2 * pi())) FROM s CROSS JOIN range(200) g(k) JOIN f ON f.c = s.c GROUP BY s.c, g.k, lo, span, n, band
UNION ALL SELECT c, 'box_' || name, NULL, value FROM (UNPIVOT w ON q1, median, q3, whisker_low, whisker_high INTO NAME name VALUE value))
SELECT 'line' AS "group", c AS "column", part, round(position, 6) + 0.0 AS position, round(value, 9) + 0.0 AS value FROM o""")
def univariate(spark, d):
    table = profile.univariate(read_table(spark, d, "lineitem").select(*LINE), {"line": LINE})
    return rounded(rounded(table, 6, skip=("value",)), 9, skip=("position",))


_HEAT = [("demographic", ["Age", "Gender", "Income_Category"])]


@query("bivariate_heat", f"{ENCODED} " + " UNION ALL ".join(
    f"SELECT 'demographic' AS \"group\", '{x}' AS x, '{y}' AS y, " + ("1.0::DOUBLE" if x == y else f"round(corr({x}, {y}), 6) + 0.0") + " AS r FROM encoded" + ("" if x != y else " WHERE respondent_id = (SELECT min(respondent_id) FROM encoded)")
    for x in _HEAT[0][1] for y in _HEAT[0][1]))
def bivariate_heat(spark, d):
    return rounded(profile.bivariate(encoded_table(spark, d), dict(_HEAT))[0])


@query("bivariate_lines", """WITH p AS (SELECT 'line' AS g, 'l_quantity' AS x, 'l_extendedprice' AS y, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, corr(l_quantity, l_extendedprice) AS r FROM lineitem
UNION ALL SELECT 'line', 'l_quantity', 'l_discount', regr_slope(l_discount, l_quantity), regr_intercept(l_discount, l_quantity), corr(l_quantity, l_discount) FROM lineitem
UNION ALL SELECT 'line', 'l_extendedprice', 'l_discount', regr_slope(l_discount, l_extendedprice), regr_intercept(l_discount, l_extendedprice), corr(l_extendedprice, l_discount) FROM lineitem)
SELECT g AS "group", x, y, round(s, 4) + 0.0 AS slope, round(i, 4) + 0.0 AS intercept, round(r, 4) + 0.0 AS r FROM p""")
def bivariate_lines(spark, d):
    return rounded(profile.bivariate(read_table(spark, d, "lineitem"), {"line": ["l_quantity", "l_extendedprice", "l_discount"]})[1], 4)


@query("target_profile", """WITH p AS (SELECT 'l_quantity' AS x, abs(corr(l_quantity, l_extendedprice)) AS a, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, corr(l_quantity, l_extendedprice) AS r FROM lineitem
UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)), regr_slope(l_extendedprice, l_discount), regr_intercept(l_extendedprice, l_discount), corr(l_discount, l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)), regr_slope(l_extendedprice, l_tax), regr_intercept(l_extendedprice, l_tax), corr(l_tax, l_extendedprice) FROM lineitem)
SELECT row_number() OVER (ORDER BY a DESC, x)::INT AS rank, x, round(a, 4) AS abs_r, round(s, 2) + 0.0 AS slope, round(i, 2) + 0.0 AS intercept, round(r, 4) + 0.0 AS r FROM p QUALIFY rank <= 2""")
def target_profile(spark, d):
    out = profile.target_profile(read_table(spark, d, "lineitem").select(*LINE), "l_extendedprice", 2)
    return out.select("rank", "x", (F.round("abs_r", 4)).alias("abs_r"), (F.round("slope", 2) + 0.0).alias("slope"), (F.round("intercept", 2) + 0.0).alias("intercept"), (F.round("r", 4) + 0.0).alias("r"))


@query("parallel_rows", f"""{TWO}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_kmeans ORDER BY {u_sql('o_orderkey', 'balanced:42')}, o_orderkey) AS n FROM two)
SELECT o_orderkey, o_totalprice, o_custkey, 'K' || cluster_kmeans AS Cluster FROM r WHERE n <= 50""")
def parallel_rows(spark, d):
    return profile.parallel_rows(two_labels(spark, d), ["o_totalprice", "o_custkey"], "o_orderkey", "cluster_kmeans", "K", 50)


_RADAR = ["l_quantity", "l_extendedprice", "l_discount"]


@query("radar_rows", f"""WITH m AS (SELECT 'KMeans_C' || l_linenumber AS cluster, {', '.join(f'avg({c}) AS {c}' for c in _RADAR)} FROM lineitem GROUP BY 1),
s AS (SELECT cluster, {', '.join(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}' for c in _RADAR)} FROM m)
{' UNION ALL '.join(f"SELECT cluster, '{c}' AS feature, round({c}, 4) + 0.0 AS value FROM s" for c in _RADAR)}""")
def radar_rows(spark, d):
    means = profile.cluster_means(read_table(spark, d, "lineitem"), "l_linenumber", _RADAR, "KMeans_C")
    return rounded(profile.radar_rows(means), 4)


@query("scatter_rows", f"""{TWO}, r AS (SELECT *, row_number() OVER (ORDER BY {u_sql('o_orderkey', 'sample:42')}, o_orderkey) AS n FROM two)
SELECT o_orderkey, o_totalprice AS PC1, o_custkey AS PC2, cluster_kmeans, cluster_gmm FROM r WHERE n <= 500""")
def scatter_rows(spark, d):
    df = two_labels(spark, d).withColumnsRenamed({"o_totalprice": "PC1", "o_custkey": "PC2"})
    return profile.scatter_rows(df, "o_orderkey", 500)


_FACTORS = ["Age", "Income_Category", "Essential_Needs_Percentage"]
_FACTOR_LONG = " UNION ALL ".join(f"SELECT label, '{c.replace('_', ' ')}' AS Factor, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS v FROM lab" for c in _FACTORS)


@query("factor_boxes", f"""{ENCODED}, lab AS (SELECT *, CASE WHEN Debt_Level >= 3 THEN 'Risky' ELSE 'Beneficially' END AS label FROM encoded), w AS ({_FACTOR_LONG}),
{box_sql('v', 'Factor, label', 'w')} SELECT w.Factor, w.label AS Behavior_Risk_Label, round(q1, 5) + 0.0 AS q1, round(median, 5) + 0.0 AS median, round(q3, 5) + 0.0 AS q3,
round(min(v) FILTER (v BETWEEN lo AND hi), 5) + 0.0 AS whisker_low, round(max(v) FILTER (v BETWEEN lo AND hi), 5) + 0.0 AS whisker_high FROM w JOIN f ON w.Factor = f.Factor AND w.label = f.label GROUP BY ALL""")
def factor_boxes(spark, d):
    df = encoded_table(spark, d).withColumn(vocab.TARGET, (F.col("Debt_Level") >= 3).cast("int"))
    return rounded(profile.factor_boxes(df, _FACTORS), 5)
