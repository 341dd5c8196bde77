"""Row matching, sampling, metric and neighbour queries with exact checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.base import ENCODED, ROW_ID, SCORED, SURVEY, encoded_table, query, read_table, rounded, survey_translated, u_sql
from sondage import vocab
from sondage.functions.draws import u
from sondage.operators import metrics, order, relate, scale
from sondage.operators.schema import ref
from sondage.session import cut_lineage

# ------------------------------------------------------------- set operations


@query("attach_labels", """SELECT o_orderkey, (CASE WHEN o_totalprice > 100000 THEN o_custkey % 4 END)::INT AS cluster_kmeans FROM orders""")
def attach_labels(spark, d):
    df = read_table(spark, d, "orders")
    labels = df.filter("o_totalprice > 100000").select("o_orderkey", (F.col("o_custkey") % 4).cast("int").alias("cluster_kmeans"))
    return relate.attach(df.select("o_orderkey"), labels, "o_orderkey")


@query("append_tables", "SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier")
def append_tables(spark, d):
    a = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return relate.append(a, b)


@query("remove_exact_duplicates", """WITH t AS (SELECT l_linenumber, l_quantity, l_returnflag, l_discount FROM lineitem WHERE l_linestatus = 'O'),
e AS (SELECT l_linenumber, l_quantity, l_returnflag, l_discount FROM lineitem WHERE l_linestatus = 'F'),
b AS (SELECT *, 1 AS s FROM t UNION ALL SELECT *, 0 FROM e)
SELECT l_linenumber, l_quantity, l_returnflag, l_discount FROM b GROUP BY ALL HAVING count(*) = 1 AND sum(s) = 1""")
def remove_exact_duplicates(spark, d):
    df = read_table(spark, d, "lineitem")
    keep = ["l_linenumber", "l_quantity", "l_returnflag", "l_discount"]
    return relate.remove_exact_duplicates(df.filter("l_linestatus = 'O'").select(*keep), df.filter("l_linestatus = 'F'").select(*keep))


@query("duplicate_texts", """WITH b AS (SELECT text, lang, source, 1 AS s FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT text, lang, source, 0 FROM documents WHERE doc_id % 2 = 1)
SELECT md5(text) AS text, lang, source FROM b GROUP BY b.text, lang, source HAVING count(*) = 1 AND sum(s) = 1""")
def duplicate_texts(spark, d):
    df = read_table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    train, test = df.filter("doc_id % 2 = 0").drop("doc_id"), df.filter("doc_id % 2 = 1").drop("doc_id")
    return relate.remove_exact_duplicates(train, test).withColumn("text", F.md5("text"))


@query("synthetic_only", """SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linestatus = 'F'
AND a.l_quantity IS NOT DISTINCT FROM b.l_quantity AND a.l_discount IS NOT DISTINCT FROM b.l_discount AND a.l_tax IS NOT DISTINCT FROM b.l_tax AND a.l_suppkey IS NOT DISTINCT FROM b.l_suppkey)""")
def synthetic_only(spark, d):
    df = read_table(spark, d, "lineitem")
    known = df.filter("l_linestatus = 'F'").select("l_quantity", "l_discount", "l_tax", "l_suppkey")
    return relate.synthetic_only(df, known).select("l_orderkey", "l_linenumber")


# ------------------------------------------------------------ sorts, samples


def positions(df):
    """``position`` from 1 in the order in which the rows stand, read off their partitions and places in them."""
    placed = cut_lineage(df.withColumn("__id", F.monotonically_increasing_id()))
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    return placed.withColumns({"__part": part, "__at": at}).join(starts, "__part").select(*df.columns, (F.col("__before") + F.col("__at") + 1).alias("position"))


@query("sort_all", "SELECT o_orderstatus, o_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_custkey, o_orderkey) AS position FROM orders")
def sort_all(spark, d):
    return positions(relate.sort_all(read_table(spark, d, "orders").select("o_orderstatus", "o_custkey", "o_orderkey")))


@query("limit_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_rows(spark, d):
    return relate.limit_rows(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey")


@query("distinct_ranks", "SELECT DISTINCT o_totalprice, dense_rank() OVER (ORDER BY o_totalprice) - 1 AS rank FROM orders")
def distinct_ranks(spark, d):
    return order.distinct_ranks(read_table(spark, d, "orders"), "o_totalprice")


@query("shuffle_rows", f"SELECT c_custkey, row_number() OVER (ORDER BY {u_sql('c_custkey', 'shuffle:42')}, c_custkey) AS position FROM customer")
def shuffle_rows(spark, d):
    return positions(relate.shuffle_rows(read_table(spark, d, "customer").select("c_custkey"), "c_custkey"))


def ranked_sql(key: str, by: str, salt: str, source: str) -> str:
    return f"SELECT {key}, {by}, row_number() OVER (PARTITION BY {by} ORDER BY {u_sql(key, salt)}, {key}) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {source}"


@query("balanced_sample", f"WITH r AS ({ranked_sql('event_id', 'event_type', 'balanced:42', 'events')}) SELECT event_id, event_type FROM r WHERE r <= 60")
def balanced_sample(spark, d):
    return relate.balanced_sample(read_table(spark, d, "events").select("event_id", "event_type"), "event_type", 60, "event_id")


@query("sample_upto", f"SELECT o_orderkey FROM orders ORDER BY {u_sql('o_orderkey', 'sample:42')}, o_orderkey LIMIT 2000")
def sample_upto(spark, d):
    return relate.sample_upto(read_table(spark, d, "orders").select("o_orderkey"), 2000, "o_orderkey")


@query("stratified_split", f"WITH r AS ({ranked_sql('event_id', 'event_type', 'split:42', 'events')}) SELECT event_id, event_type, (r <= ceil(0.25 * n))::INT AS is_test FROM r")
def stratified_split(spark, d):
    return relate.stratified_split(read_table(spark, d, "events").select("event_id", "event_type"), "event_type", 0.25, "event_id")


@query("stratified_folds", f"WITH r AS ({ranked_sql('doc_id', 'quality', 'fold:42', 'labels')}) SELECT doc_id, quality, (r % 5)::INT AS fold FROM r")
def stratified_folds(spark, d):
    return relate.stratified_folds(read_table(spark, d, "labels").select("doc_id", "quality"), "quality", 5, "doc_id")


@query("trim_balanced", f"WITH r AS ({ranked_sql('doc_id', 'quality', 'trim:42', 'labels')}) SELECT doc_id, quality FROM r WHERE r <= 100")
def trim_balanced(spark, d):
    return relate.trim_balanced(read_table(spark, d, "labels").select("doc_id", "quality"), "quality", 100, "doc_id")


# ------------------------------------------------------------------- metrics


def predicted(spark, d):
    """Events with a true class, a predicted class and a score that goes with both."""
    df = read_table(spark, d, "events").select("event_id", "value")
    score = F.round(F.lit(0.5) * u("event_id", "score") + F.lit(0.5) * (F.col("value") / (F.col("value") + F.lit(50.0))), 3)
    df = df.withColumn("score", score)
    return df.withColumns({"y": (u("event_id", "truth") < F.col("score")).cast("int"), "p": (F.col("score") >= 0.5).cast("int")})


PREDICTED = f"""WITH s AS (SELECT event_id, value, round(0.5::DOUBLE * {u_sql('event_id', 'score')} + 0.5::DOUBLE * (value / (value + 50.0::DOUBLE)), 3) AS score FROM events),
m AS (SELECT *, ({u_sql('event_id', 'truth')} < score)::INT AS y, (score >= 0.5)::INT AS p FROM s)"""
TABLE = f"""{PREDICTED}, k AS (SELECT * FROM (VALUES (0), (1)) t(label)),
c AS (SELECT label, count(*) FILTER (y = label AND p = label)::DOUBLE AS tp, count(*) FILTER (y = label)::DOUBLE AS s, count(*) FILTER (p = label)::DOUBLE AS q FROM m, k GROUP BY 1),
t AS (SELECT label, tp, s, q, tp / q AS precision, tp / s AS recall, 2 * tp / (s + q) AS f1 FROM c)"""


@query("confusion", f"{PREDICTED} SELECT y, p, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM m GROUP BY 1, 2")
def confusion(spark, d):
    return rounded(metrics.confusion(predicted(spark, d), "y", "p"))


@query("f1_scores", f"{TABLE} SELECT round(max(f1) FILTER (label = 1), 6) AS f1_binary, round(sum(f1 * s) / sum(s), 6) AS f1_weighted FROM t")
def f1_scores(spark, d):
    return rounded(metrics.f1_table(predicted(spark, d), "y", "p"))


@query("classification_report", f"""{TABLE} SELECT CASE label WHEN 0 THEN 'Beneficially' ELSE 'Risky' END AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, s::BIGINT AS support FROM t
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(s), 6), round(sum(tp) / sum(s), 6), round(sum(tp) / sum(s), 6), sum(s)::BIGINT FROM t
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(s)::BIGINT FROM t
UNION ALL SELECT 'weighted avg', round(sum(precision * s) / sum(s), 6), round(sum(recall * s) / sum(s), 6), round(sum(f1 * s) / sum(s), 6), sum(s)::BIGINT FROM t""")
def classification_report(spark, d):
    return rounded(metrics.classification_report(predicted(spark, d), "y", "p", {0: "Beneficially", 1: "Risky"}))


@query("cohen_kappa", f"{TABLE}, z AS (SELECT sum(tp) / sum(s) AS po, sum(s * q) / pow(sum(s), 2) AS pe FROM t) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM z")
def cohen_kappa(spark, d):
    return rounded(metrics.kappa_table(predicted(spark, d), "y", "p"))


_CURVE = f"{PREDICTED}, g AS (SELECT score, sum(y)::DOUBLE AS pos, count(*) - sum(y)::DOUBLE AS neg FROM m GROUP BY 1)"


@query("roc_auc", f"{_CURVE}, w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM w")
def roc_auc(spark, d):
    return rounded(metrics.auc_table(predicted(spark, d), "y", "score"))


@query("roc_curve", f"{_CURVE} SELECT score AS threshold, round(sum(neg) OVER (ORDER BY score DESC) / (SELECT sum(neg) FROM g), 6) AS fpr, round(sum(pos) OVER (ORDER BY score DESC) / (SELECT sum(pos) FROM g), 6) AS tpr FROM g")
def roc_curve(spark, d):
    return rounded(metrics.roc_curve(predicted(spark, d), "y", "score"))


def ks_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", round(max(abs(ca - cb)), 6) AS ks FROM (SELECT sum(na) OVER (ORDER BY v) / sum(na) OVER () AS ca, sum(nb) OVER (ORDER BY v) / sum(nb) OVER () AS cb
FROM (SELECT {column} AS v, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS na, count(*) FILTER (l_returnflag <> 'R')::DOUBLE AS nb FROM lineitem GROUP BY 1))"""


@query("ks_distance", " UNION ALL ".join(ks_sql(c) for c in ["l_quantity", "l_extendedprice", "l_discount"]))
def ks_distance(spark, d):
    df = read_table(spark, d, "lineitem")
    return rounded(metrics.ks_distance(df.filter("l_returnflag = 'R'"), df.filter("l_returnflag <> 'R'"), ["l_quantity", "l_extendedprice", "l_discount"]))


def anova_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(v * n) / (sum(n) - count(*))), 6) AS f
FROM (SELECT count(*)::DOUBLE AS n, avg({column}) AS m, var_pop({column}) AS v, (SELECT avg({column}) FROM lineitem) AS g FROM lineitem GROUP BY l_linenumber)"""


@query("anova_f", " UNION ALL ".join(anova_sql(c) for c in ["l_quantity", "l_extendedprice", "l_tax"]))
def anova_f(spark, d):
    return rounded(metrics.anova_table(read_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], "l_linenumber").select("column", "f"))


# seven classes leave 6 degrees of freedom, for which the upper tail of F is a finite sum
@query("anova_p", f"""WITH a AS ({' UNION ALL '.join(anova_sql(c) for c in ['l_quantity', 'l_extendedprice', 'l_tax'])}), b AS (SELECT (count(*) - 7) / 2 AS b FROM lineitem),
x AS (SELECT "column", f, b, 6 * f / (2 * b + 6 * f) AS y FROM a, b) SELECT "column", f, round(exp(b * ln(1 - y)) * (1 + b * y + b * (b + 1) / 2 * y * y), 5) + 0.0 AS p FROM x""")
def anova_p(spark, d):
    table = metrics.anova_table(read_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], "l_linenumber")
    return rounded(rounded(table, 6, skip=("p",)), 5, skip=("f",))


@query("rank_by_f", f"WITH a AS ({' UNION ALL '.join(anova_sql(c) for c in ['l_quantity', 'l_extendedprice', 'l_tax'])}) SELECT \"column\", f, row_number() OVER (ORDER BY f DESC) AS place FROM a")
def rank_by_f(spark, d):
    ranked = metrics.rank_by_f(read_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], "l_linenumber")
    place = order.distinct_ranks(ranked.withColumn("back", -F.col("f")), "back")
    return rounded(ranked.withColumn("back", -F.col("f")).join(place, "back").select("column", "f", (F.col("rank") + 1).alias("place")))


@query("mean_cosine", """WITH a AS (SELECT avg(l_quantity) AS x, avg(l_discount) AS y, avg(l_tax) AS z FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT avg(l_quantity) AS x2, avg(l_discount) AS y2, avg(l_tax) AS z2 FROM lineitem WHERE l_returnflag <> 'R')
SELECT round((x * x2 + y * y2 + z * z2) / (sqrt(x * x + y * y + z * z) * sqrt(x2 * x2 + y2 * y2 + z2 * z2)), 6) AS cosine FROM a, b""")
def mean_cosine(spark, d):
    df = read_table(spark, d, "lineitem")
    value = metrics.mean_cosine(df.filter("l_returnflag = 'R'"), df.filter("l_returnflag <> 'R'"), ["l_quantity", "l_discount", "l_tax"])
    return rounded(spark.createDataFrame([(value,)], "cosine double"))


@query("silhouette_1d", f"""{SCORED}, v AS (SELECT respondent_id AS id, Risk_Score AS x, Debt_Level AS l FROM scored), n AS (SELECT l, count(*) AS n FROM v GROUP BY 1),
s AS (SELECT a.id, a.l AS own, b.l AS other, sum(abs(a.x - b.x)) AS s FROM v a, v b GROUP BY ALL),
t AS (SELECT id, any_value(n.n) FILTER (own = other) AS size, max(s / greatest(n.n - 1, 1)) FILTER (own = other) AS a, min(s / n.n) FILTER (own <> other) AS b FROM s JOIN n ON n.l = s.other GROUP BY id)
SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM t""")
def silhouette_1d(spark, d):
    return rounded(metrics.silhouette_1d_table(scale.risk_score(encoded_table(spark, d)), "Risk_Score", "Debt_Level"), 5)


@query("evaluate_unique_train", """WITH c AS (SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, CASE WHEN floor(c_acctbal / 500)::BIGINT % 3 <> 0 THEN floor(c_acctbal / 500)::BIGINT END AS step FROM customer),
g AS (SELECT min(id) AS id, count(*) AS n FROM c GROUP BY nation, segment, step)
SELECT c.id, nation, segment, step FROM c JOIN g ON g.id = c.id WHERE n = 1 AND c.id % 4 <> 0""")
def evaluate_unique_train(spark, d):
    """Train rows that occur once in train and test, gaps counted as content, with their ids."""
    step = F.floor(F.col("c_acctbal") / 500)
    df = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.when(F.expr("floor(c_acctbal / 500) % 3 <> 0"), step).alias("step"))
    return relate.remove_exact_duplicates(df.filter("id % 4 <> 0"), df.filter("id % 4 = 0"), "id")
