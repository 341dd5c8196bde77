"""Model and augmentation queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog.base import ENCODED, ROW_ID, encoded_table, facts_sql, query, read_table, rounded, survey_translated, u_sql
from catalog.neighbours import VALUES, VECTORS, vectors
from catalog.prepare import constraint_input
from catalog.rows import ranked_sql
from sondage import vocab
from sondage.functions.draws import u
from sondage.operators import augment, certify, metrics, models, relate, scale
from sondage.operators.label import label_risk
from sondage.operators.schema import features_of, ref


def labelled(spark, d):
    """Encoded survey with a level that follows debt, saving and a draw."""
    df = encoded_table(spark, d)
    risk = F.col("Debt_Level") / 4.0 - 0.3 * F.col("Save_Money") + 0.5 * u(ROW_ID, "risk")
    return scale.standardise(df.withColumn(vocab.TARGET, (risk > 0.75).cast("int")), vocab.SCALED)[0]


FEATURES = [*vocab.SCALED, "Gender", "Save_Money", *vocab.ORDINALS]
LEVEL = f"{ENCODED}, lv AS (SELECT *, (Debt_Level / 4.0::DOUBLE - 0.3::DOUBLE * Save_Money + 0.5::DOUBLE * {u_sql('respondent_id', 'risk')} > 0.75)::INT AS y FROM encoded)"


@query("class_weights", f"{LEVEL} SELECT y AS level, round((SELECT count(*) FROM lv) / (2.0::DOUBLE * count(*)), 6) AS weight FROM lv GROUP BY 1")
def class_weights(spark, d):
    rows = list(models.class_weights(labelled(spark, d)).items())
    return rounded(spark.createDataFrame(rows, "level int, weight double"))


def halves(spark, d):
    split = relate.stratified_split(labelled(spark, d), vocab.TARGET, 0.25, ROW_ID).persist()
    return split.filter("is_test = 0").drop("is_test"), split.filter("is_test = 1").drop("is_test")


# rows per class, and of them those that train: the test part is a quarter, rounded up
SPLIT = f"{LEVEL}, z AS (SELECT y, count(*) - ceil(0.25::DOUBLE * count(*)) AS n, ceil(0.25::DOUBLE * count(*)) AS t FROM lv GROUP BY 1)"
TRAIN_ROWS = {"rows": "(SELECT sum(n) FROM z)", "test_rows": "(SELECT sum(t) FROM z)"}


def judge(fitted, train, test) -> dict:
    """Rows, and whether the model beats the largest class and a coin on rows that it has not seen."""
    out = fitted.predict(test).persist()
    n, share = out.agg(F.count(F.lit(1)), F.avg(vocab.TARGET)).first()
    right, auc = metrics.accuracy(out, vocab.TARGET, "predicted"), metrics.roc_auc(out, vocab.TARGET, "score")
    return {"rows": train.count(), "test_rows": n, "beats_class": right >= max(share, 1 - share), "beats_coin": auc > 0.5, "scores": out.filter(~F.col("score").between(0, 1)).count() == 0}


_GOOD = {"beats_class": "1", "beats_coin": "1", "scores": "1"}


@query("fit_logistic", facts_sql(SPLIT, {**TRAIN_ROWS, **_GOOD, "mean_score": "(SELECT sum(n * y * (SELECT sum(n) FROM z) / (2 * n)) / sum(n * (SELECT sum(n) FROM z) / (2 * n)) FROM z)", "flat": "1", "below_nothing": "1"}))
def fit_logistic(spark, d):
    """At the minimum every derivative of the ridge loss is 0, so the weighted mean score is the weighted share of class 1."""
    train, test = halves(spark, d)
    fitted = models.fit_logistic(train, FEATURES)
    found = certify.logistic_facts(train, fitted)
    return certify.facts(train, {**judge(fitted, train, test), "mean_score": round(found["mean_score"], 4), "flat": found["steepest"] < 1e-4, "below_nothing": found["loss"] < math.log(2)})


@query("fit_forest", facts_sql(SPLIT, {**TRAIN_ROWS, **_GOOD, "probabilities": "1", "importances": "1", "learned": "1", "trees": "150"}))
def fit_forest(spark, d):
    train, test = halves(spark, d)
    fitted = models.fit_forest(train, FEATURES)
    found = certify.forest_facts(train, fitted)
    return certify.facts(train, {**judge(fitted, train, test), "probabilities": found["off"] < 1e-9, "importances": round(found["importances"], 6), "learned": found["right"] > 0.95, "trees": fitted.model.getNumTrees})


@query("fit_boosted", facts_sql(SPLIT, {**TRAIN_ROWS, **_GOOD, "probabilities": "1", "importances": "1", "learned": "1", "falling": "1"}))
def fit_boosted(spark, d):
    """The weighted loss falls from its first to its last round."""
    train, test = halves(spark, d)
    fitted = models.fit_boosted(train, FEATURES)
    found = certify.forest_facts(train, fitted)
    losses = fitted.model.evaluateEachIteration(models.training_rows(train, FEATURES, vocab.TARGET, {1: models.positive_weight(train)}))
    return certify.facts(train, {**judge(fitted, train, test), "probabilities": found["off"] < 1e-9, "importances": round(found["importances"], 6), "learned": found["beyond"] > 0, "falling": len(losses) == 100 and losses[-1] < losses[0]})


@query("fit_svm", facts_sql(SPLIT, {**TRAIN_ROWS, **_GOOD, "gap": "1", "below_nothing": "1", "converged": "1"}))
def fit_svm(spark, d):
    """The hinge loss lies within a quarter of a bound from its dual (0.16 at sf0.01; the bound is the best of a few ramps, not the dual optimum)."""
    train, test = halves(spark, d)
    fitted = models.fit_svm(train, FEATURES)
    found = certify.svm_facts(train, fitted)
    return certify.facts(train, {**judge(fitted, train, test), "gap": found["gap"] < 0.25, "below_nothing": found["loss"] < 1, "converged": fitted.stage.startswith("converged")})


IMPORTANT = ["Debt_Level", "Save_Money", "Age"]


@query("permutation_importances", f"""{LEVEL}, c AS (SELECT count(*) AS n FROM lv), r AS (SELECT unnest(range(3)) AS r),
p AS (SELECT r, y, {", ".join(IMPORTANT)}, row_number() OVER (PARTITION BY r ORDER BY CASE r {" ".join(f"WHEN {k} THEN {u_sql('respondent_id', f'permute:42:{k}')}" for k in range(3))} END, respondent_id) - 1 AS at FROM lv, r),
j AS (SELECT a.r, a.y, {", ".join(f"a.{c}, b.{c} AS o_{c}" for c in IMPORTANT)} FROM p a JOIN c ON true JOIN p b ON a.r = b.r AND b.at = (a.at + 1 + (7919 * (a.r + 1) + 42) % (n - 1)) % n),
v AS ({" UNION ALL ".join(f"SELECT r, y, {k} AS j, {', '.join(('o_' if i == k else '') + c + ' AS ' + c for i, c in enumerate(IMPORTANT))} FROM j" for k in range(-1, 3))}),
h AS (SELECT r, j, avg(((Debt_Level / 4.0::DOUBLE - 0.3::DOUBLE * Save_Money > 0.25::DOUBLE)::INT = y)::INT) AS hit FROM v GROUP BY 1, 2)
SELECT CASE a.j {" ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(IMPORTANT))} END AS feature, round(avg(b.hit - a.hit), 6) + 0.0 AS importance, round(stddev_pop(b.hit - a.hit), 6) AS spread FROM h a JOIN h b ON a.r = b.r AND b.j = -1 WHERE a.j >= 0 GROUP BY a.j""")
def permutation_importances(spark, d):
    """Of a fixed linear rule, so that SQL can deal the columns anew as well; the rule does not ask for the age."""
    df = labelled(spark, d).select(ROW_ID, *IMPORTANT, vocab.TARGET)
    rule = (F.col("Debt_Level") / 4.0 - 0.3 * F.col("Save_Money") > 0.25).cast("int")
    return rounded(models.permutation_importances(df, lambda rows: rows.withColumn("predicted", rule), IMPORTANT, repeats=3))


@query("train_suite")
def train_suite(spark, d):
    """All four models."""
    train, test = halves(spark, d)
    fitted, table = models.train_suite(train, test, FEATURES)
    full = models.metrics_table(table, models.overfit_report(fitted, train, test), fitted)
    return full.select("model", "roc_auc", "f1_score", "cv_f1_mean", "cv_f1_std", "train_accuracy", "test_accuracy", "overfit_ratio")


@query("learning_curve", f"""{LEVEL}, z AS (SELECT y, count(*) AS n FROM lv GROUP BY 1), f AS (SELECT fold, sum(n // 5 + (fold BETWEEN 1 AND n % 5)::INT) AS size FROM z, (SELECT unnest(range(5)) AS fold) GROUP BY 1)
SELECT p.part::DOUBLE AS fraction, a.fold::INT AS fold, sum(ceil(b.size * p.part::DOUBLE))::BIGINT AS rows, true AS sound FROM f a JOIN f b ON a.fold <> b.fold, (SELECT unnest([0.1::DOUBLE, 0.325::DOUBLE, 0.55::DOUBLE, 0.775::DOUBLE, 1.0::DOUBLE]) AS part) p GROUP BY 1, 2""")
def learning_curve(spark, d):
    """Rows that each part and fold trains on; sound: both F1 scores exist and lie between 0 and 1."""
    return models.learning_curve(labelled(spark, d), FEATURES).select("fraction", "fold", "rows", (F.col("train_f1").between(0, 1) & F.col("cv_f1").between(0, 1)).alias("sound"))


@query("coefficient_table", f"{LEVEL} SELECT unnest([{', '.join(repr(c) for c in FEATURES)}]) AS feature, true AS flat, true AS falling, round((SELECT avg(0.5::DOUBLE) FROM lv), 4) AS mean_score")
def coefficient_table(spark, d):
    """The features of a fit on all rows by falling coefficients; flat: the loss has no slope at them."""
    df = labelled(spark, d)
    fitted = models.fit_logistic(df, FEATURES)
    found, sizes = certify.logistic_facts(df, fitted), [abs(r["coefficient"]) for r in models.coefficient_table(df, fitted).collect()]
    return models.coefficient_table(df, fitted).select("feature", F.lit(found["steepest"] < 1e-4).alias("flat"), F.lit(sizes == sorted(sizes, reverse=True)).alias("falling"), F.lit(round(found["mean_score"], 4)).alias("mean_score"))


def grown_by_smote(spark, d):
    df = vectors(spark, d).select("vec_id", *VALUES, "label")
    sizes = {r[0]: r[1] for r in df.groupBy("label").count().collect()}
    return augment.smote(df, VALUES, "label", {0: sizes[0] + 40, 1: sizes[1] + 25}, 5, "vec_id")


@query("smote", f"""{VECTORS}, p AS (SELECT a.vec_id, a.label, a.e AS x, b.e AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {u_sql('vec_id', 'base:42')}, vec_id) AS base, count(*) OVER (PARTITION BY label) AS have FROM v WHERE label < 2),
g AS (SELECT 0 AS label, range AS n, 0 AS skip FROM range(40) UNION ALL SELECT 1, range, 40 FROM range(25)),
s AS (SELECT g.*, o.vec_id, floor({u_sql('n', 'neighbour:42')} * 5)::INT + 1 AS rank, {u_sql('n', 'share:42')} AS share FROM g JOIN o ON o.label = g.label AND o.base = g.n % o.have + 1)
SELECT -(1099511627776 + skip) - n AS vec_id, s.label, {', '.join(f'round(x[{i + 1}] + share * (y[{i + 1}] - x[{i + 1}]), 5) + 0.0 AS e{i}' for i in range(64))} FROM s JOIN p ON p.vec_id = s.vec_id AND p.rank = s.rank
UNION ALL SELECT vec_id, label, {', '.join(f'round(e[{i + 1}], 5) + 0.0' for i in range(64))} FROM v""")
def smote(spark, d):
    return rounded(grown_by_smote(spark, d), 5)


@query("drop_tomek", f"""{VECTORS}, p AS (SELECT a.vec_id, b.vec_id AS nbr, a.y AS ya, b.y AS yb, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r FROM v a, v b WHERE a.vec_id <> b.vec_id),
o AS (SELECT * FROM p WHERE r = 1) SELECT vec_id FROM v WHERE vec_id NOT IN (SELECT a.vec_id FROM o a JOIN o b ON a.nbr = b.vec_id AND b.nbr = a.vec_id WHERE a.ya <> b.ya)""")
def drop_tomek(spark, d):
    return augment.drop_tomek(vectors(spark, d).select("vec_id", *VALUES, "y"), VALUES, "y", "vec_id").select("vec_id")


# the rows that lie between a base and a neighbour, from a plan g of (c, n, base, skip)
_BETWEEN = f"""p AS (SELECT a.vec_id, a.e AS x, b.e AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank FROM c a JOIN c b ON a.c = b.c AND a.vec_id <> b.vec_id),
s AS (SELECT g.*, o.vec_id, floor({u_sql('n', 'neighbour:42')} * 5)::INT + 1 AS rank, {u_sql('n', 'share:42')} AS share FROM g JOIN o USING (c, base)),
grown AS (SELECT -(1099511627776 + skip) - n AS vec_id, s.c, [x[i] + share * (y[i] - x[i]) FOR i IN range(1, 65)] AS e FROM s JOIN p ON p.vec_id = s.vec_id AND p.rank = s.rank UNION ALL SELECT vec_id, c, e FROM c)"""
_BASES = f"o AS (SELECT vec_id, c, row_number() OVER (PARTITION BY c ORDER BY {u_sql('vec_id', 'base:42')}, vec_id) AS base FROM c)"


@query("smote_tomek", f"""{VECTORS}, c AS (SELECT vec_id, y AS c, e FROM v), {_BASES}, z AS (SELECT c, count(*) AS have FROM c GROUP BY 1), m AS (SELECT c, have, (SELECT max(have) FROM z) + 20 - have AS extra FROM z),
k AS (SELECT *, coalesce(sum(extra) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS skip FROM m), j AS (SELECT *, unnest(range(extra)) AS n FROM k), g AS (SELECT c, n, n % have + 1 AS base, skip FROM j),
{_BETWEEN}, q AS (SELECT a.vec_id, b.vec_id AS nbr, a.c AS ca, b.c AS cb, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r FROM grown a, grown b WHERE a.vec_id <> b.vec_id),
f AS (SELECT * FROM q WHERE r = 1) SELECT vec_id, c AS y FROM grown WHERE vec_id NOT IN (SELECT a.vec_id FROM f a JOIN f b ON a.nbr = b.vec_id AND b.nbr = a.vec_id WHERE a.ca <> b.ca)""")
def smote_tomek(spark, d):
    df = vectors(spark, d).select("vec_id", *VALUES, "y")
    sizes = {r[0]: r[1] for r in df.groupBy("y").count().collect()}
    return augment.smote_tomek(df, VALUES, "y", {c: max(sizes.values()) + 20 for c in sorted(sizes)}, 5, "vec_id").select("vec_id", "y")


@query("adasyn", f"""{VECTORS}, c AS (SELECT vec_id, (label < 3)::INT AS c, e FROM v), z AS (SELECT c, count(*) AS have FROM c GROUP BY 1), m AS (SELECT c, (SELECT max(have) FROM z) - have AS gap FROM z QUALIFY row_number() OVER (ORDER BY have, c) = 1), {_BASES},
w AS (SELECT a.vec_id, a.c AS ca, b.c AS cb, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r FROM c a JOIN m ON m.c = a.c JOIN c b ON a.vec_id <> b.vec_id),
r AS (SELECT vec_id, avg((ca <> cb)::INT) AS r FROM w WHERE r <= 5 GROUP BY 1), t AS (SELECT vec_id, round_even(r / sum(r) OVER () * gap, 0)::INT AS q FROM r, m),
i AS (SELECT o.c, base, base || '-' || unnest(range(1, q + 1)) AS job FROM t JOIN o USING (vec_id)), g AS (SELECT c, base, row_number() OVER (ORDER BY {u_sql('job', 'job:42')}, job) - 1 AS n, 0 AS skip FROM i),
{_BETWEEN} SELECT vec_id, c AS rare, {', '.join(f'round(e[{i + 1}], 5) + 0.0 AS e{i}' for i in range(64))} FROM grown""")
def adasyn(spark, d):
    df = vectors(spark, d).withColumn("rare", (F.col("label") < 3).cast("int")).select("vec_id", *VALUES, "rare")
    return rounded(augment.adasyn(df, VALUES, "rare", 5, "vec_id"), 5)


_TAIL = """CASE WHEN nu % 2 = 0 THEN 1 - sin(o) * list_sum([exp(lgamma(k + 0.5::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(k + 1) + 2 * k * ln(cos(o))) FOR k IN range(0, nu // 2)])
ELSE 1 - 2 / pi() * (o + sin(o) * cos(o) * coalesce(list_sum([exp(lgamma(k + 1) + lgamma(1.5::DOUBLE) - lgamma(k + 1.5::DOUBLE) + 2 * k * ln(cos(o))) FOR k IN range(0, (nu - 1) // 2)]), 0)) END"""


@query("augmentation_metrics", f"""{VECTORS}, f AS ({ranked_sql('vec_id', 'y', 'fold:42', 'v')}), d AS (SELECT v.*, (f.r % 5)::INT AS fold, v.vec_id % 5 <> 0 AS old FROM v JOIN f USING (vec_id)),
p AS (SELECT a.vec_id, b.vec_id AS nbr, list_distance(a.e, b.e) AS dist, a.y AS ya, b.y AS yb, a.fold AS fold, a.fold <> b.fold AS other, b.old AS old FROM d a, d b),
q AS (SELECT vec_id, ya, fold, (avg(yb) > 0.5)::INT AS yp FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr) AS r FROM p WHERE other) WHERE r <= 5 GROUP BY ALL),
g AS (SELECT fold, c, count(*) FILTER (WHERE ya = c) AS real, 2.0::DOUBLE * count(*) FILTER (WHERE ya = c AND yp = c) / (count(*) FILTER (WHERE ya = c) + count(*) FILTER (WHERE yp = c)) AS f1 FROM q, (SELECT unnest([0, 1]) AS c) GROUP BY ALL),
k AS (SELECT vec_id, ya, (avg(yb) > 0.5)::INT AS yp FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr) AS r FROM p WHERE old) WHERE r <= 5 GROUP BY ALL),
o AS (SELECT avg((ya = yp)::INT) AS po, avg(ya) * avg(yp) + (1 - avg(ya)) * (1 - avg(yp)) AS pe FROM k),
m AS (SELECT [{', '.join(f'avg(e[{i}])' for i in range(1, 65))}] AS now, [{', '.join(f'avg(e[{i}]) FILTER (WHERE old)' for i in range(1, 65))}] AS before FROM d),
c AS (SELECT y, count(*) AS n, [{', '.join(f'avg(e[{i}])' for i in range(1, 65))}] AS c, avg(list_inner_product(e, e)) AS q FROM d GROUP BY 1),
s AS (SELECT vec_id, d.y = c.y AS own, n, list_inner_product(e, e) - 2 * list_inner_product(e, c) + q AS m FROM d, c),
t AS (SELECT vec_id, max(m * n / greatest(n - 1, 1)) FILTER (own) AS a, min(m) FILTER (NOT own) AS b FROM s GROUP BY 1),
h AS (SELECT i, e[i] AS x, y FROM d, (SELECT unnest(range(1, 65)) AS i)), h1 AS (SELECT i, y, count(*) AS n, avg(x) AS mean, var_pop(x) AS v FROM h GROUP BY ALL), h2 AS (SELECT i, avg(x) AS g FROM h GROUP BY 1),
w AS (SELECT i, (sum(n) - 2)::BIGINT AS nu, atan(sqrt(sum(n * (mean - g) * (mean - g)) / sum(n * v))) AS o FROM h1 JOIN h2 USING (i) GROUP BY 1)
SELECT 'f1_weighted' AS metric, round(avg(f), 5) AS value FROM (SELECT fold, sum(real * f1) / sum(real) AS f FROM g GROUP BY 1)
UNION ALL SELECT 'kappa', round((po - pe) / (1 - pe), 5) FROM o UNION ALL SELECT 'silhouette', round(avg((b - a) / greatest(a, b)), 5) FROM t
UNION ALL SELECT 'cosine_similarity', round(list_cosine_similarity(now, before), 5) FROM m
UNION ALL SELECT 'avg_knn_distance', round(sum(dist) / (5.0 * (SELECT count(*) FROM v)), 5) FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr) AS r FROM p WHERE vec_id <> nbr) WHERE r <= 4
UNION ALL SELECT 'anova_p_value', round(avg({_TAIL}), 5) FROM w""")
def augmentation_metrics(spark, d):
    df = vectors(spark, d).select("vec_id", *VALUES, "y")
    figures = augment.augmentation_metrics(df, df.filter("vec_id % 5 <> 0"), VALUES, "y", "vec_id")
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in figures.items()], "metric string, value double"), 5)


# a day of shipments as a round: six averages in the places of the six figures
_DAILY = {
    "f1_weighted": "10 * avg(l_discount)", "silhouette": "12 * avg(l_tax)", "kappa": "avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END)",
    "cosine_similarity": "avg(l_quantity) / 50", "avg_knn_distance": "avg(l_extendedprice)", "anova_p_value": "avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END)",
}
_BROKEN = " + ".join(f"(round({f'a.{m} / b.{m} - 1' if m == 'avg_knn_distance' else f'b.{m} - a.{m}'}, 9) > {x}::DOUBLE)::INT" for m, x in augment.ALLOWED_DROP.items())


@query("accept_rule", f"""WITH f AS (SELECT l_shipdate::DATE AS day, {', '.join(f'round({x}, 9) AS {m}' for m, x in _DAILY.items())} FROM lineitem GROUP BY 1),
s AS (SELECT a.day, coalesce({_BROKEN}, 0) AS broken FROM f a LEFT JOIN f b ON a.day = b.day + 1)
SELECT day::VARCHAR AS day, CASE WHEN broken = 0 THEN 'good' WHEN broken <= 2 THEN 'tolerated' ELSE 'repeated' END AS status FROM s""")
def accept_rule(spark, d):
    """Every day of shipments judged against the day before by the rule of the growth loops."""
    days = read_table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(*[F.round(F.expr(x), 9).alias(m) for m, x in _DAILY.items()])
    before = days.select(F.date_add("day", 1).alias("day"), *[F.col(m).alias(f"old_{m}") for m in _DAILY])
    status = augment.accept_status({m: F.col(m) for m in _DAILY}, {m: F.col(f"old_{m}") for m in _DAILY})
    return days.join(before, "day", "left").select(F.col("day").cast("string").alias("day"), status.alias("status"))


@query("validate_batch", f"{LEVEL} SELECT unnest(['same', 'moved']) AS batch, (SELECT count(*) FROM lv) AS rows, {len(vocab.SCALED)} AS columns, unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS least_ks, unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS most_ks, unnest([true, false]) AS same_means, true AS sound")
def validate_batch(spark, d):
    """A batch equal to the table has no distance from it in any column and the same means; one moved beyond its range has the largest distance."""
    df = labelled(spark, d).select(ROW_ID, *FEATURES, vocab.TARGET)
    out = []
    for name, shift in (("same", 0.0), ("moved", 1000.0)):
        batch = df.withColumns({c: ref(c) + F.lit(shift) for c in vocab.SCALED})
        got = augment.validate_batch(df, batch)
        ks = [got["ks_distance"][c] for c in vocab.SCALED]
        sound = -1 <= got["cohen_kappa"] <= 1 and 0 <= got["f1_score"] <= 1 and (got["cohen_kappa"] > 0) == (name == "same")
        out.append((name, batch.count(), len(ks), round(min(ks), 6), round(max(ks), 6), got["cosine_similarity"] > 1 - 1e-9, sound))
    return spark.createDataFrame(out, "batch string, rows long, columns int, least_ks double, most_ks double, same_means boolean, sound boolean")


@query("expand_decoded", f"""{LEVEL}, z AS (SELECT y, count(*) AS n FROM lv GROUP BY 1), m AS (SELECT max(n) AS most FROM z)
SELECT y AS {vocab.TARGET}, most + floor(most * 5.5)::BIGINT AS n, z.n AS kept, 0 AS off_step, 0 AS unknown FROM z, m""")
def expand_decoded(spark, d):
    """Rows per class after balancing and multiplying; the given ones stay, amounts lie on their steps, answers are known ones."""
    answers = ["Impulse_Buying_Frequency", "Budget_Planning", "Savings_Goal_Vacation"]
    known = vocab.ORDINALS["Impulse_Buying_Frequency"]
    level = labelled(spark, d).select(ROW_ID, vocab.TARGET)
    df = survey_translated(spark, d).select(ROW_ID, *answers).join(encoded_table(spark, d).select(ROW_ID, "Age", "Income_Category"), ROW_ID).join(level, ROW_ID)
    layout = scale.fit_layout(df, ["Age", "Income_Category"], {answers[0]: list(known)}, [answers[1]], [answers[2]])
    out = augment.expand_decoded(df, layout)
    off = (ref("Age") != F.round("Age")) | (ref("Income_Category") % 100 != 0)
    strange = ~ref(answers[0]).isin(list(known)) | ~ref(answers[1]).isin(layout.nominal[answers[1]])
    return out.groupBy(vocab.TARGET).agg(F.count(F.lit(1)).alias("n"), F.count_if(ref(ROW_ID) >= 0).alias("kept"), F.count_if(off).alias("off_step"), F.count_if(strange).alias("unknown"))


@query("augment_smote")
def augment_smote(spark, d):
    """Two phases with one round each, on the embeddings."""
    df = vectors(spark, d).withColumn(vocab.TARGET, (F.col("label") < 4).cast("int")).select(F.col("vec_id").alias(ROW_ID), *VALUES, vocab.TARGET)
    out, history = augment.augment_smote(df, df.count() + 200, state=augment.GrowState(step_fraction=0.5, max_rounds=1))
    return out.groupBy(vocab.TARGET).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ROW_ID) < 0).alias("made"), F.lit(len(history)).alias("rounds"))


@query("generator_sample", f"{LEVEL}, z AS (SELECT count(*) AS total FROM lv) SELECT y AS {vocab.TARGET}, CASE WHEN y = 0 THEN total // 2 ELSE total - total // 2 END AS n, true AS means, true AS correlation FROM (SELECT DISTINCT y FROM lv), z")
def generator_sample(spark, d):
    """Rows made per class; their means lie within a quarter of a deviation of the class's own, and a correlation within 0.15."""
    df = labelled(spark, d).select(ROW_ID, *FEATURES, vocab.TARGET)

    def shape(rows):
        return {r[0]: r for r in rows.groupBy(vocab.TARGET).agg(F.count(F.lit(1)).alias("n"), F.corr("Age", "Income_Category").alias("corr"), *[f(ref(c)).alias(f"{n}_{c}") for c in FEATURES for f, n in ((F.avg, "m"), (F.stddev, "s"))]).collect()}

    own, made = shape(df), shape(augment.sample_per_class(df, df.count()))
    rows = [(c, m["n"], all(abs(m[f"m_{x}"] - own[c][f"m_{x}"]) <= 0.25 * own[c][f"s_{x}"] + 1e-9 for x in FEATURES), abs(m["corr"] - own[c]["corr"]) < 0.15) for c, m in made.items()]
    return spark.createDataFrame(rows, f"{vocab.TARGET} int, n long, means boolean, correlation boolean")


@query("generator_ranges", f"{LEVEL}, z AS (SELECT count(*) AS total FROM lv) SELECT y AS {vocab.TARGET}, CASE WHEN y = 0 THEN total // 2 ELSE total - total // 2 END AS n, CASE WHEN y = 0 THEN total // 2 ELSE total - total // 2 END AS inside, CASE WHEN y = 0 THEN total // 2 ELSE total - total // 2 END AS ids FROM (SELECT DISTINCT y FROM lv), z")
def generator_ranges(spark, d):
    """Rows made per class, how many of them lie within the range of every feature of their class, and how many ids they have."""
    df = labelled(spark, d).select(ROW_ID, *FEATURES, vocab.TARGET)
    limits = df.groupBy(vocab.TARGET).agg(*[f(ref(c)).alias(f"{n}_{c}") for c in FEATURES for f, n in ((F.min, "low"), (F.max, "high"))])
    made = augment.sample_per_class(df, df.count()).join(F.broadcast(limits), vocab.TARGET)
    # a value is drawn between two quantiles, so its last bits may leave the range
    inside = [ref(c).between(F.col(f"low_{c}") - 1e-9, F.col(f"high_{c}") + 1e-9) for c in FEATURES]
    every = inside[0]
    for x in inside[1:]:
        every = every & x
    return made.groupBy(vocab.TARGET).agg(F.count(F.lit(1)).alias("n"), F.count_if(every).alias("inside"), F.count_distinct(ref(ROW_ID)).alias("ids"))


@query("balance_batch")
def balance_batch(spark, d):
    df = labelled(spark, d).select(ROW_ID, *FEATURES, vocab.TARGET)
    made = augment.balance_batch(augment.TabularGenerator.fit(df), spark, df.count())
    return made.groupBy(vocab.TARGET).agg(F.count(F.lit(1)).alias("n"))


@query("relabel_confident")
def relabel_confident(spark, d):
    df = labelled(spark, d).select(ROW_ID, *FEATURES, vocab.TARGET)
    flipped = df.withColumn(vocab.TARGET, F.when(u(ROW_ID, "flip") < 0.3, F.lit(1) - F.col(vocab.TARGET)).otherwise(F.col(vocab.TARGET)))
    kept = augment.relabel_confident(df, flipped, drop=True)
    changed = augment.final_relabel(df, flipped)[1]
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.lit(changed).alias("changed"))


@query("augment_filtered", f"{LEVEL} SELECT floor(count(*) * 1.3::DOUBLE)::BIGINT AS size, count(*) AS kept, true AS adds_up, true AS funnel, {len(FEATURES)} AS ks_columns, true AS ks_within FROM lv")
def augment_filtered(spark, d):
    """All rounds, with the distribution test: the goal is reached, given rows stay, rounds add up to the size, no filter adds rows, and each round tests every column."""
    df = labelled(spark, d).select(ROW_ID, *FEATURES, vocab.TARGET)
    given = df.count()
    grown, history, funnel = augment.augment_filtered(df, int(given * 1.3))
    row = augment.augmentation_summary(grown, funnel).first()
    kept = grown.filter(ref(ROW_ID) >= 0).count()
    totals = [given, *[h["new_total"] for h in history]]
    adds_up = all(b - a == h["generated"] for a, b, h in zip(totals, totals[1:], history)) and totals[-1] == row["size"] == row["class_0"] + row["class_1"] and row["rounds"] == len(history)
    falling = row["generated"] >= row["kept_confident"] >= row["kept_consistent"] >= row["size"] - given
    tests = [h["metrics"]["ks_distance"] for h in history if h["generated"]]
    within = all(0 <= v <= 1 for t in tests for v in t.values())
    return spark.createDataFrame([(row["size"], kept, adds_up, falling, min(map(len, tests)), within)], "size long, kept long, adds_up boolean, funnel boolean, ks_columns int, ks_within boolean")


@query("top_up", f"{LEVEL}, z AS (SELECT y, count(*) AS n FROM lv GROUP BY 1) SELECT y AS {vocab.TARGET}, (SELECT min(n) + 30 FROM z) AS n FROM z")
def top_up(spark, d):
    df = labelled(spark, d).select(ROW_ID, *FEATURES, vocab.TARGET)
    sizes = models.class_sizes(df)
    out = augment.top_up(df, 2 * (min(sizes.values()) + 30))
    return out.groupBy(vocab.TARGET).agg(F.count(F.lit(1)).alias("n"))


@query("augment_incremental", f"{LEVEL} SELECT floor(count(*) * 1.2::DOUBLE)::BIGINT AS n, (floor(count(*) * 1.2::DOUBLE) - count(*))::BIGINT AS made, 1 AS rounds, true AS adds_up, count(*) AS unchanged FROM lv")
def augment_incremental(spark, d):
    """Rounds to the goal (a fifth more rows: one), each batch scored by the labelling run (with 20 boosting rounds); given rows keep their labels."""
    df = labelled(spark, d)
    given = df.count()
    out, history = augment.augment_incremental(df, int(given * 1.2), score_batch=lambda batch: label_risk(batch, ROW_ID, max_iter=20))
    totals = [given, *[h["new_total"] for h in history]]
    adds_up = all(b - a == h["generated"] for a, b, h in zip(totals, totals[1:], history))
    same = out.join(df.select(ROW_ID, ref(vocab.TARGET).alias("given")), ROW_ID).filter(ref(vocab.TARGET) == F.col("given")).count()
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ROW_ID) < 0).alias("made"), F.lit(len(history)).alias("rounds"), F.lit(adds_up).alias("adds_up"), F.lit(same).alias("unchanged"))


@query("fill_to", "SELECT count(*)::BIGINT AS kept, true AS within, 0::BIGINT AS broken FROM customer")
def fill_to(spark, d):
    """All original rows stay, rows made fill up at most to the total, and no row breaks the constraints."""
    df = constraint_input(spark, d).withColumn(vocab.TARGET, (u(ROW_ID, "risk") < 0.4).cast("int"))
    total = int(df.count() * 1.2)
    out = augment.fill_to(df, total)
    row = out.agg(F.count_if(ref(ROW_ID) >= 0).alias("kept"), F.count_if(ref(ROW_ID) < 0).alias("made"), F.count_if(~ref("Age").between(18, 70)).alias("broken")).first()
    return spark.createDataFrame([(row["kept"], 0 < row["made"] <= total - row["kept"], row["broken"])], "kept long, within boolean, broken long")
