"""Schema, translation, encoding, smoothing, constraint and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ENCODED, NUMBERS, ROW_ID, SCORED, SMOOTHED, SURVEY, choice_options, encoded, encoded_columns, encoded_table, ident, list_sql, numeric_survey,
    num_sql, ordinal_sql, q, query, read_table, rounded, smooth_lifetime_sql, smoothed, survey_raw, survey_translated, u_sql,
)
from sondage import vocab
from sondage.functions import draws, rules, text
from sondage.functions.draws import truncated_normal, u
from sondage.operators import encode, profile, scale, schema
from sondage.operators.schema import ref
from sondage.plans.prepare import split_branches

SINGLE = ["Age", "Family_Status", "Gender", "Income_Category", "Essential_Needs_Percentage", "Financial_Attitude", "Budget_Planning",
          "Save_Money", *vocab.LIFETIMES, "Impulse_Buying_Frequency", "Impulse_Buying_Category", "Impulse_Buying_Reason", "Debt_Level",
          "Financial_Investments", "Bank_Account_Analysis_Frequency"]
FLAGS = [f"{c}_{o}" for c in vocab.CHOICES for o in choice_options(c)]
SEGMENT_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4}


# ------------------------------------------------------------- translation


@query("survey_translate", f"{SURVEY} SELECT respondent_id, {', '.join(SINGLE)} FROM survey")
def survey_translate(spark, d):
    return survey_translated(spark, d).select(ROW_ID, *SINGLE)


@query("survey_choice_text", f"{SURVEY} SELECT respondent_id, {', '.join(vocab.MULTI_COLUMNS)} FROM survey")
def survey_choice_text(spark, d):
    return survey_translated(spark, d).select(ROW_ID, *vocab.MULTI_COLUMNS)


@query("survey_multi_hot", f"{SURVEY} SELECT respondent_id, {', '.join(ident(c) for c in FLAGS)} FROM survey")
def survey_multi_hot(spark, d):
    return survey_translated(spark, d).select(ROW_ID, *[ref(c) for c in FLAGS])


_HOT = [f"{c}_{v}" for c, values in vocab.NOMINALS.items() for v in values]
_HOT_SQL = ", ".join(f"(CASE WHEN {c} = {q(v)} THEN 1 ELSE 0 END)::INT AS {ident(f'{c}_{v}')}" for c, values in vocab.NOMINALS.items() for v in values)


@query("survey_one_hot", f"{SURVEY} SELECT respondent_id, {_HOT_SQL} FROM survey")
def survey_one_hot(spark, d):
    df = survey_translated(spark, d).select(ROW_ID, *vocab.NOMINALS)
    return encode.one_hot(df, list(vocab.NOMINALS), vocab.NOMINALS)


@query("survey_one_hot_inferred", f"{SURVEY} SELECT respondent_id, {_HOT_SQL} FROM survey")
def survey_one_hot_inferred(spark, d):
    df = survey_translated(spark, d).select(ROW_ID, *vocab.NOMINALS)
    return encode.one_hot(df, list(vocab.NOMINALS))


HOT = ["o_custkey", "o_orderpriority", "o_orderstatus"]
_LONG = f"""WITH a AS (SELECT o_orderkey, o_orderdate, unnest([{", ".join(q(c) for c in HOT)}]) AS "column", unnest([{", ".join(f"{c}::VARCHAR" for c in HOT)}]) AS value FROM orders),
l AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS position, row_number() OVER (ORDER BY "column", value) - 1 AS slot FROM (SELECT DISTINCT "column", value FROM a WHERE o_orderdate < TIMESTAMP '1996-01-01' AND value IS NOT NULL))"""


def _early_levels(spark, d):
    """Orders, and the answers of those before 1996: later ones bring answers that these lack."""
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate", *HOT)
    return df, encode.answer_levels(df.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")), HOT, "o_orderkey")


@query("one_hot_long", _LONG + """ SELECT o_orderkey, a."column", a.value, position, slot FROM a LEFT JOIN l ON a."column" = l."column" AND a.value = l.value WHERE a.value IS NOT NULL""")
def one_hot_long(spark, d):
    df, levels = _early_levels(spark, d)
    return encode.one_hot_long(df, HOT, "o_orderkey", levels)


@query("one_hot_sparse", _LONG + """, f AS (SELECT o_orderkey, string_agg(slot, ',' ORDER BY slot) AS slots, count(*) FILTER (WHERE slot IS NULL) AS unseen FROM a LEFT JOIN l ON a."column" = l."column" AND a.value = l.value WHERE a.value IS NOT NULL GROUP BY 1)
SELECT o.o_orderkey, coalesce(slots, '') AS slots, coalesce(unseen, 0) AS unseen FROM orders o LEFT JOIN f USING (o_orderkey)""")
def one_hot_sparse(spark, d):
    df, levels = _early_levels(spark, d)
    out = encode.one_hot_sparse(df, HOT, "o_orderkey", levels)
    return out.select("o_orderkey", F.array_join(F.transform("slots", lambda s: s.cast("string")), ",").alias("slots"), "unseen")


@query("segment_one_hot", "SELECT c_custkey, " + ", ".join(
    f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{s}" for s in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " FROM customer")
def segment_one_hot(spark, d):
    df = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return encode.one_hot(df, ["c_mktsegment"])


@query("survey_ordinal", f"{SURVEY} SELECT respondent_id, {', '.join(f'{ordinal_sql(c, m)} AS {c}' for c, m in vocab.ORDINALS.items())} FROM survey")
def survey_ordinal(spark, d):
    return encode.ordinal_encode(survey_translated(spark, d).select(ROW_ID, *vocab.ORDINALS))


@query("survey_binary", f"{SURVEY} SELECT respondent_id, {', '.join(f'{ordinal_sql(c, m)} AS {c}' for c, m in vocab.BINARIES.items())} FROM survey")
def survey_binary(spark, d):
    return encode.binary_encode(survey_translated(spark, d).select(ROW_ID, *vocab.BINARIES))


@query("translate_column", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS o_orderstatus,
o_orderpriority FROM orders""")
def translate_column(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return encode.translate_column(df, "o_orderstatus", {"O": "open", "F": "filled"})


@query("label_round_trip", f"""WITH v AS (SELECT c_custkey, floor({u_sql('c_custkey', 'level')} * 3)::INT - 1 AS level FROM customer)
SELECT c_custkey, level, CASE WHEN level = 1 THEN 'Risky' ELSE 'Beneficial' END AS label, CASE WHEN level = 1 THEN 1 ELSE 0 END AS code,
CASE level WHEN 0 THEN 'Beneficially' WHEN 1 THEN 'Risky' END AS shown FROM v""")
def label_round_trip(spark, d):
    df = read_table(spark, d, "customer").select("c_custkey", (F.floor(u(F.col("c_custkey"), "level") * 3) - 1).cast("int").alias("level"))
    df = df.withColumn("label", text.label_text(F.col("level")))
    return df.withColumns({"code": text.label_code(F.col("label")), "shown": text.label_display(F.col("level"))})


@query("encoded_survey", f"{ENCODED} SELECT respondent_id, {', '.join(ident(c) for c in encoded_columns())} FROM encoded")
def encoded_survey(spark, d):
    return encoded(spark, d).select(ROW_ID, *[ref(c) for c in encoded_columns()])


# ------------------------------------------------------------------ schema


@query("question_titles", f"{SURVEY} SELECT count(*) AS n, count(Age) AS ages, 23 AS columns, TRUE AS complete FROM survey")
def question_titles(spark, d):
    raw = survey_raw(spark, d)
    padded = raw.toDF(*[f" {c} " for c in raw.columns])
    df = schema.rename_questions(schema.drop_form_timestamp(schema.trim_names(padded)))
    complete = set(df.columns) == {*vocab.QUESTIONS.values(), ROW_ID}
    return df.agg(F.count(F.lit(1)).alias("n"), F.count("Age").alias("ages"), F.lit(len(df.columns)).alias("columns"), F.lit(complete).alias("complete"))


@query("schema_cleanup", f"{SURVEY} SELECT Age, Gender, Debt_Level, NULL::VARCHAR AS Region FROM survey")
def schema_cleanup(spark, d):
    df = survey_translated(spark, d).select("Debt_Level", "Gender", F.col("Age").alias("Age_encoded"), "Savings_Goal")
    df = schema.drop_if_present(schema.strip_suffix(df), ["Savings_Goal", "Cluster"])
    df = schema.ensure_columns(df, ["Region", "Age"])
    return schema.select_existing(df, ["Age", "Gender", "Missing", "Debt_Level", "Region"])


_GROUP_ROWS = []
for _g, (_names, _prefixes) in vocab.GROUPS.items():
    _cols = [c for c in encoded_columns() if c in _names or (_prefixes and c.startswith(tuple(_prefixes)))]
    _GROUP_ROWS.append(f"SELECT {q(_g)} AS \"group\", {len(_cols)} AS columns, {' + '.join(f'sum({ident(c)})' for c in _cols) or '0'} AS total FROM encoded")


@query("column_groups", f"{ENCODED} " + " UNION ALL ".join(f"SELECT \"group\", columns::BIGINT AS columns, total::DOUBLE AS total FROM ({r})" for r in _GROUP_ROWS))
def column_groups(spark, d):
    """Columns of each group, and what all their values add up to."""
    df = encoded_table(spark, d)
    groups = schema.group_map(df)
    sums = [F.struct(F.lit(g).alias("group"), F.lit(len(c)).cast("long").alias("columns"), F.sum(sum((ref(x).cast("double") for x in c), F.lit(0.0))).alias("total")) for g, c in groups.items()]
    return df.agg(F.array(*sums).alias("g")).select(F.inline("g"))


_NULLABLE = ["Age", "Income_Category", "Essential_Needs_Percentage", "Product_Lifetime_Cars", "Impulse_Buying_Reason", "Debt_Level"]


@query("null_profile", f"{SURVEY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM survey HAVING count(*) > count({c})" for c in SINGLE))
def null_profile(spark, d):
    return schema.null_profile(survey_translated(spark, d).select(ROW_ID, *SINGLE))


@query("null_examples", f"{SURVEY}, hits AS (" + " UNION ALL ".join(f"SELECT respondent_id, '{c}' AS \"column\" FROM survey WHERE {c} IS NULL" for c in SINGLE) +
       ") SELECT respondent_id, \"column\" FROM hits QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY respondent_id) <= 5")
def null_examples(spark, d):
    return schema.null_examples(survey_translated(spark, d).select(ROW_ID, *SINGLE), ROW_ID)


@query("infer_roles", """WITH s AS (SELECT count(DISTINCT l_linenumber) AS n, min(l_linenumber) AS lo, max(l_linenumber) AS hi,
count(DISTINCT l_orderkey) AS n2, min(l_orderkey) AS lo2, max(l_orderkey) AS hi2 FROM lineitem)
SELECT 'l_linenumber' AS "column", 'int' AS dtype, CASE WHEN lo >= 0 AND hi <= 1 THEN 'boolean' WHEN n < 20 THEN 'categorical' ELSE 'numerical' END AS role FROM s
UNION ALL SELECT 'l_orderkey', 'bigint', CASE WHEN lo2 >= 0 AND hi2 <= 1 THEN 'boolean' WHEN n2 < 20 THEN 'categorical' ELSE 'numerical' END FROM s
UNION ALL SELECT 'l_quantity', 'double', 'numerical' UNION ALL SELECT 'l_returnflag', 'string', 'categorical'
UNION ALL SELECT 'is_returned', 'int', 'boolean'""")
def infer_roles(spark, d):
    df = read_table(spark, d, "lineitem").select("l_linenumber", "l_orderkey", "l_quantity", "l_returnflag", (F.col("l_returnflag") == "R").cast("int").alias("is_returned"))
    return schema.roles_table(df)


@query("cast_roles", """SELECT sum((l_returnflag = 'R')::INT)::BIGINT AS returned, count(*) AS n, 1 AS booleans FROM lineitem""")
def cast_roles(spark, d):
    df = read_table(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("is_returned"))
    typed = schema.cast_roles(df, schema.infer_roles(df))
    booleans = sum(1 for _, t in typed.dtypes if t == "boolean")
    return schema.uncast_booleans(typed).agg(F.sum("is_returned").alias("returned"), F.count(F.lit(1)).alias("n"), F.lit(booleans).alias("booleans"))


@query("column_filters", """SELECT CAST(count(DISTINCT l_linestatus) > 1 AS INT) AS status_varies, 0 AS constant_varies, 0 AS empty_kept,
count(*) FILTER (l_quantity > 10) AS full_rows FROM lineitem""")
def column_filters(spark, d):
    df = read_table(spark, d, "lineitem").select(
        "l_linestatus", F.lit(3).alias("constant"), F.lit(None).cast("double").alias("empty"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("big"))
    vary = schema.non_constant(df, ["l_linestatus", "constant"])
    kept = schema.non_empty(df, ["empty", "big"])
    full = schema.drop_null_rows(df, ["big"])
    return full.agg(F.lit(int("l_linestatus" in vary)).alias("status_varies"), F.lit(int("constant" in vary)).alias("constant_varies"),
                    F.lit(int("empty" in kept)).alias("empty_kept"), F.count(F.lit(1)).alias("full_rows"))


@query("melt_factors", """SELECT o_orderkey, 'o totalprice' AS Factor, o_totalprice AS Value FROM orders
UNION ALL SELECT o_orderkey, 'o custkey', o_custkey::DOUBLE FROM orders""")
def melt_factors(spark, d):
    return schema.melt_factors(read_table(spark, d, "orders"), ["o_orderkey"], ["o_totalprice", "o_custkey"])


@query("labelled_split", f"""WITH v AS (SELECT c_custkey, floor({u_sql('c_custkey', 'level')} * 3)::INT - 1 AS level FROM customer)
SELECT count(*) FILTER (level <> -1) AS labelled, count(*) FILTER (level = -1) AS unlabelled, count(*) FILTER (level = 1) AS ones,
(count(DISTINCT level) > 1)::INT AS varies FROM v""")
def labelled_split(spark, d):
    df = read_table(spark, d, "customer").select("c_custkey", (F.floor(u(F.col("c_custkey"), "level") * 3) - 1).cast("int").alias("level"))
    known, unknown = schema.split_labelled(df, "level")
    ones = schema.class_subset(df, 1, "level")
    tagged = known.select(F.lit("k").alias("t")).unionByName(unknown.select(F.lit("u").alias("t"))).unionByName(ones.select(F.lit("o").alias("t")))
    return tagged.agg(F.count_if(F.col("t") == "k").alias("labelled"), F.count_if(F.col("t") == "u").alias("unlabelled"),
                      F.count_if(F.col("t") == "o").alias("ones"), F.lit(int(schema.has_variation(df, "level"))).alias("varies"))


# --------------------------------------------------------------- smoothing


@query("smooth_age", f"{SMOOTHED} SELECT respondent_id, Age FROM smoothed")
def smooth_age(spark, d):
    return smoothed(spark, d).select(ROW_ID, "Age")


@query("smooth_income", f"{SMOOTHED} SELECT respondent_id, Income_Category FROM smoothed")
def smooth_income(spark, d):
    return smoothed(spark, d).select(ROW_ID, "Income_Category")


@query("smooth_lifetime", f"{SMOOTHED} SELECT respondent_id, {', '.join(vocab.LIFETIMES)} FROM smoothed")
def smooth_lifetime(spark, d):
    return smoothed(spark, d).select(ROW_ID, *vocab.LIFETIMES)


_LIFE_TEXT = ", ".join(f"{smooth_lifetime_sql(c, False)} AS {c}" for c in vocab.LIFETIMES)


@query("smooth_lifetime_text", f"{SURVEY} SELECT respondent_id, {_LIFE_TEXT} FROM survey")
def smooth_lifetime_text(spark, d):
    return smoothed(spark, d, encoded=False).select(ROW_ID, *vocab.LIFETIMES)


@query("smooth_needs", f"{SMOOTHED} SELECT respondent_id, Essential_Needs_Percentage FROM smoothed")
def smooth_needs(spark, d):
    return smoothed(spark, d).select(ROW_ID, "Essential_Needs_Percentage")


def horner(coefficients: list[float], x: str) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for value in coefficients[1:]:
        text = f"({text} * {x} + {value!r}::DOUBLE)"
    return text


_FROM, _TO = draws.normal_cdf((18.0 - 40.0) / 12.0), draws.normal_cdf((70.0 - 40.0) / 12.0)


@query("truncated_normal", f"""WITH s AS (SELECT c_custkey, {_FROM!r}::DOUBLE + {u_sql('c_custkey', 'truncnorm')} * {_TO - _FROM!r}::DOUBLE AS p FROM customer),
w AS (SELECT *, p - 0.5::DOUBLE AS m, (p - 0.5::DOUBLE) * (p - 0.5::DOUBLE) AS r, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM s),
z AS (SELECT c_custkey, CASE WHEN least(p, 1 - p) >= {draws._TAIL}::DOUBLE THEN {horner(draws._A, 'r')} * m / ({horner(draws._B, 'r')} * r + 1)
ELSE sign(0.5::DOUBLE - p) * {horner(draws._C, 't')} / ({horner(draws._D, 't')} * t + 1) END AS z FROM w)
SELECT c_custkey, round(greatest(18, least(40 + 12 * z, 70)), 6) + 0.0 AS x FROM z""")
def truncated(spark, d):
    draw = truncated_normal(40.0, 12.0, 18.0, 70.0, F.col("c_custkey"))
    return rounded(read_table(spark, d, "customer").select("c_custkey", draw.alias("x")))


# ------------------------------------------- durations, gaps and rounding

_LIFE = f"SELECT respondent_id, {_LIFE_TEXT} FROM survey"


@query("lifetime_months", f"""{SURVEY}, t AS ({_LIFE}) SELECT respondent_id,
CASE WHEN Product_Lifetime_Cars = 'Not purchased yet' THEN NULL ELSE
regexp_extract(Product_Lifetime_Cars, '(\\d+)', 1)::DOUBLE * CASE WHEN Product_Lifetime_Cars LIKE '%year%' THEN 12 ELSE 1 END END AS months FROM t""")
def lifetime_months(spark, d):
    df = smoothed(spark, d, encoded=False)
    return df.select(ROW_ID, text.lifetime_months(F.col("Product_Lifetime_Cars")).alias("months"))


@query("duration_round_trip", f"""{SURVEY}, t AS ({_LIFE}), m AS (SELECT respondent_id, CASE WHEN Product_Lifetime_Tech LIKE '%month%' THEN regexp_extract(Product_Lifetime_Tech, '^(\\d+)', 1)::BIGINT
WHEN Product_Lifetime_Tech LIKE '%year%' THEN regexp_extract(Product_Lifetime_Tech, '^(\\d+)', 1)::BIGINT * 12 END AS months FROM t)
SELECT respondent_id, months, CASE WHEN months < 12 THEN months::VARCHAR || ' months' WHEN months >= 12 THEN (months // 12)::VARCHAR || ' years' END AS shown FROM m""")
def duration_round_trip(spark, d):
    df = smoothed(spark, d, encoded=False).select(ROW_ID, text.duration_months(F.col("Product_Lifetime_Tech")).alias("months"))
    return df.withColumn("shown", text.duration_text(F.col("months")))


@query("strip_units", "SELECT p_partkey, p_size::DOUBLE AS size FROM part")
def strip_units(spark, d):
    df = read_table(spark, d, "part")
    unit = F.when(F.col("p_size") % 2 == 0, F.lit(" months")).otherwise(F.lit(" years"))
    return df.select("p_partkey", text.strip_units(F.concat(F.col("p_size").cast("string"), unit)).alias("size"))


@query("safe_int_round_step", """SELECT c_custkey, trunc(c_acctbal)::INT AS whole, 0 AS none, (round_even(c_acctbal / 100, 0) * 100)::INT AS hundreds,
(round_even(c_acctbal / 5, 0) * 5)::INT AS fives FROM customer""")
def safe_int_round_step(spark, d):
    df = read_table(spark, d, "customer")
    return df.select("c_custkey", text.safe_int(F.col("c_acctbal").cast("decimal(18,4)").cast("string")).alias("whole"), text.safe_int(F.col("c_name")).alias("none"),
                     text.round_step(F.col("c_acctbal"), 100).alias("hundreds"), text.round_step(F.col("c_acctbal"), 5).alias("fives"))


@query("coerce_median_int", f"{ENCODED} SELECT respondent_id, {', '.join(vocab.SCALED)} FROM encoded")
def coerce_median_int(spark, d):
    return encode.coerce_median_int(smoothed(spark, d).select(ROW_ID, *vocab.SCALED), vocab.SCALED)


@query("impute_median_mode", f"""{NUMBERS}, f AS (SELECT quantile_cont(Age, 0.5) AS age, (SELECT Debt_Level FROM numbers WHERE Debt_Level IS NOT NULL
GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS debt FROM numbers)
SELECT respondent_id, coalesce(numbers.Age, f.age) AS Age, coalesce(Debt_Level, f.debt) AS Debt_Level, Essential_Needs_Percentage FROM numbers, f""")
def impute_median_mode(spark, d):
    df = numeric_survey(spark, d).select(ROW_ID, "Age", "Debt_Level", "Essential_Needs_Percentage")
    return encode.impute(df, ["Age", "Debt_Level", "Missing_Column"])


@query("impute_constant", f"""{NUMBERS} SELECT respondent_id, coalesce(Age, (SELECT quantile_cont(Age, 0.5) FROM numbers)) AS Age,
coalesce(Debt_Level, 'missing') AS Debt_Level, coalesce(Impulse_Buying_Reason, 'missing') AS Impulse_Buying_Reason FROM numbers""")
def impute_constant(spark, d):
    df = numeric_survey(spark, d).select(ROW_ID, "Age", "Debt_Level", "Impulse_Buying_Reason")
    return encode.impute_constant(df, ["Age"], ["Debt_Level", "Impulse_Buying_Reason"])


@query("fill_decoded", f"""{NUMBERS} SELECT respondent_id, coalesce(Age, (SELECT quantile_cont(Age, 0.5) FROM numbers)) AS Age, coalesce(Debt_Level, 'Absent') AS Debt_Level,
coalesce(Impulse_Buying_Reason, (SELECT Impulse_Buying_Reason FROM numbers WHERE Impulse_Buying_Reason IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS Impulse_Buying_Reason FROM numbers""")
def fill_decoded(spark, d):
    df = numeric_survey(spark, d).select(ROW_ID, "Age", "Debt_Level", "Impulse_Buying_Reason")
    return encode.fill_decoded(df, ["Age"], ["Debt_Level", "Impulse_Buying_Reason"])


@query("clean_generated", f"""{SMOOTHED} SELECT respondent_id, round_even(coalesce({num_sql('Age')}, 0), 0)::BIGINT AS Age,
round_even(coalesce({num_sql('Income_Category')}, 0), 0)::BIGINT AS Income_Category FROM smoothed""")
def clean_generated(spark, d):
    return encode.clean_generated(smoothed(spark, d).select(ROW_ID, "Age", "Income_Category"))


@query("generator_input", f"""{SMOOTHED}, n AS (SELECT respondent_id, {num_sql('Age')} AS Age, coalesce(Debt_Level, 'missing') AS Debt_Level FROM smoothed)
SELECT respondent_id, Age, Debt_Level, (SELECT (count(Age) > 0)::INT FROM n) AS usable FROM n""")
def generator_input(spark, d):
    df = smoothed(spark, d).select(ROW_ID, "Age", "Debt_Level", F.lit(None).cast("string").alias("Empty"))
    df, usable = encode.prepare_generator_input(df, ["Age", "Empty"], ["Debt_Level"])
    return df.drop("Empty").withColumn("usable", F.lit(len(usable)))


_MONTHS = {c: f"""CASE WHEN {c} = 'Not purchased yet' THEN NULL ELSE regexp_extract({c}, '(\\d+)', 1)::DOUBLE * CASE WHEN {c} LIKE '%year%' THEN 12 ELSE 1 END END""" for c in vocab.LIFETIMES}


@query("encode_decoded", f"""{SURVEY}, t AS (SELECT * EXCLUDE ({', '.join(vocab.LIFETIMES)}), {_LIFE_TEXT} FROM survey),
m AS (SELECT * EXCLUDE ({', '.join(vocab.LIFETIMES)}), {', '.join(f'{s} AS {c}' for c, s in _MONTHS.items())} FROM t),
f AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in vocab.LIFETIMES)} FROM m)
SELECT respondent_id, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in vocab.LIFETIMES)},
{', '.join(f'{ordinal_sql(c, mm)} AS {c}' for c, mm in vocab.ORDINALS.items())},
(Save_Money = 'Yes')::INT AS "Save_Money_Yes", (Gender = 'Male')::INT AS "Gender_Male", (CASE WHEN Impulse_Buying_Reason = 'Social pressure' THEN 1 ELSE 0 END)::INT AS "Impulse_Buying_Reason_Social pressure",
"Savings_Goal_Vacation", CASE WHEN respondent_id % 3 = 0 THEN 1 ELSE 0 END AS Behavior_Risk_Level FROM m, f""")
def encode_decoded(spark, d):
    df = smoothed(spark, d, encoded=False).drop(*FLAGS)
    df = df.withColumn(vocab.TARGET, text.label_text((F.col(ROW_ID) % 3 == 0).cast("int")))
    out = encode.encode_decoded(df)
    return out.select(ROW_ID, *vocab.LIFETIMES, *vocab.ORDINALS, "Save_Money_Yes", "Gender_Male", ref("Impulse_Buying_Reason_Social pressure"), "Savings_Goal_Vacation", vocab.TARGET)


# -------------------------------------------------------------- constraints


def constraint_input(spark, d):
    """Decoded rows with their flags, in the shape that the constraints repair."""
    df = smoothed(spark, d, encoded=False)
    credit = {f"Credit_{o}": ref(f"Credit_Usage_{o}") for o in choice_options("Credit_Usage")}
    return df.withColumns(credit).drop(*[f"Credit_Usage_{o}" for o in choice_options("Credit_Usage")])


_CREDIT = ", ".join(f's."Credit_Usage_{o}" AS "Credit_{o}"' for o in choice_options("Credit_Usage"))
_FIXED = f"""{SMOOTHED}, c AS (SELECT s.* EXCLUDE (Product_Lifetime_Cars), {_CREDIT}, {smooth_lifetime_sql('survey.Product_Lifetime_Cars', False, 'survey.respondent_id').replace("':survey.Product_Lifetime_Cars'", "':Product_Lifetime_Cars'")} AS Product_Lifetime_Cars
FROM smoothed s JOIN survey USING (respondent_id))"""


def _block_sql(columns: list[str], salt: str, clear: str, keep: str) -> str:
    total = " + ".join(columns)
    draw = f"floor({u_sql('respondent_id', salt)} * {len(columns)})"
    return ", ".join(f"CASE WHEN {clear} THEN 0 WHEN {keep.format(total=total)} THEN ({draw} = {i})::INT ELSE {c} END AS {c}" for i, c in enumerate(columns))


_GOALS = _block_sql(vocab.GOAL_FLAGS, "goal", "Save_Money = 'No'", "Save_Money = 'Yes' AND ({total}) < 1")
_OBSTACLES = _block_sql(vocab.OBSTACLE_FLAGS, "obstacle", "Save_Money = 'Yes'", "Save_Money = 'No' AND ({total}) <> 1")
_EXPENSES = _block_sql(vocab.EXPENSE_FLAGS, "expense", "FALSE", "({total}) <> 1")
_CREDITS = _block_sql(vocab.CREDIT_FLAGS, "credit", "FALSE", "({total}) <> 1")


@query("repair_savings", f"{_FIXED} SELECT respondent_id, {_GOALS}, {_OBSTACLES} FROM c")
def repair_savings(spark, d):
    df = constraint_input(spark, d).select(ROW_ID, "Save_Money", *vocab.GOAL_FLAGS, *vocab.OBSTACLE_FLAGS)
    return rules.repair_savings(df, ROW_ID).drop("Save_Money")


@query("repair_one_hot", f"{_FIXED} SELECT respondent_id, {_EXPENSES}, {_CREDITS} FROM c")
def repair_one_hot(spark, d):
    df = constraint_input(spark, d).select(ROW_ID, *vocab.EXPENSE_FLAGS, *vocab.CREDIT_FLAGS)
    df = rules.repair_one_hot(df, vocab.EXPENSE_FLAGS, ROW_ID, "expense")
    return rules.repair_one_hot(df, vocab.CREDIT_FLAGS, ROW_ID, "credit")


_AGE_N, _INCOME_N = num_sql("Age"), num_sql("Income_Category")
_REPAIRED = f"""respondent_id, greatest(18, least(100, coalesce(trunc({_AGE_N}), 18)))::INT AS Age,
round_even(greatest(0, least(100, coalesce(Essential_Needs_Percentage, 0))), 0)::INT AS Essential_Needs_Percentage,
round_even(coalesce({_INCOME_N}, r.lo + {u_sql('respondent_id', 'income')} * (r.hi - r.lo)), 0)::BIGINT AS Income_Category,
CASE WHEN Product_Lifetime_Cars LIKE '%months%' THEN greatest(1, round_even(regexp_extract(Product_Lifetime_Cars, '^(\\d+)', 1)::BIGINT / 12.0::DOUBLE, 0))::BIGINT::VARCHAR || ' years' ELSE Product_Lifetime_Cars END AS Product_Lifetime_Cars,
CASE WHEN Family_Status IN ({list_sql(vocab.ALLOWED['Family_Status'])[1:-1]}) THEN Family_Status ELSE {q(vocab.ALLOWED['Family_Status'][0])} END AS Family_Status,
CASE WHEN Financial_Attitude IN ({list_sql(vocab.ALLOWED['Financial_Attitude'])[1:-1]}) THEN Financial_Attitude ELSE {q(vocab.ALLOWED['Financial_Attitude'][0])} END AS Financial_Attitude,
CASE WHEN coalesce(Impulse_Buying_Reason, '') = 'Discounts or promotions' OR Impulse_Buying_Frequency = 'Very rarely' THEN 'Discounts or promotions' ELSE 'Self-reward' END AS Impulse_Buying_Reason,
CASE WHEN Debt_Level = 'Absent' AND Financial_Investments NOT IN ('Yes, occasionally', 'No, but interested')
THEN list_extract(['Yes, occasionally', 'No, but interested'], floor({u_sql('respondent_id', 'investments')} * 2)::INT + 1)
WHEN Debt_Level IN ('Low', 'Manageable') AND Financial_Investments = 'Yes, regularly' THEN 'No, but interested' ELSE Financial_Investments END AS Financial_Investments"""


@query("constraints_repair", f"""{_FIXED}, r AS (SELECT min({_INCOME_N}) AS lo, max({_INCOME_N}) AS hi FROM c)
SELECT {_REPAIRED}, {_GOALS}, {_OBSTACLES}, {_EXPENSES}, {_CREDITS} FROM c, r""")
def constraints_repair(spark, d):
    out = rules.apply_constraints(constraint_input(spark, d), ROW_ID)
    return out.select(ROW_ID, "Age", "Essential_Needs_Percentage", "Income_Category", "Product_Lifetime_Cars", "Family_Status", "Financial_Attitude",
                      "Impulse_Buying_Reason", "Financial_Investments", *vocab.GOAL_FLAGS, *vocab.OBSTACLE_FLAGS, *vocab.EXPENSE_FLAGS, *vocab.CREDIT_FLAGS)


@query("consistency_filter", f"""{SURVEY} SELECT respondent_id FROM survey WHERE NOT (Save_Money = 'No' AND ({' + '.join(vocab.GOAL_FLAGS)}) > 0)
AND NOT (Save_Money = 'Yes' AND ({' + '.join(vocab.OBSTACLE_FLAGS)}) > 0)""")
def consistency_filter(spark, d):
    df = survey_translated(spark, d).select(ROW_ID, "Save_Money", *vocab.GOAL_FLAGS, *vocab.OBSTACLE_FLAGS)
    return rules.filter_consistency(encode.one_hot(df, ["Save_Money"], vocab.DECODED_NOMINALS)).select(ROW_ID)


_POINTS = """(CASE WHEN Income_Category >= 15000 THEN 2.0::DOUBLE ELSE 0 END) - (CASE WHEN Debt_Level = 4 THEN 3 ELSE 0 END) - (CASE WHEN Debt_Level >= 2 AND Income_Category < 12000 THEN 2 ELSE 0 END)
+ (CASE WHEN "Financial_Investments_Yes, regularly" = 1 THEN 2 ELSE 0 END) + (CASE WHEN "Budget_Planning_Plan budget in detail" = 1 THEN 1 ELSE 0 END)
+ (CASE WHEN Income_Category >= 5000 THEN -1 ELSE -0.5::DOUBLE END)"""


@query("rule_vote", f"{ENCODED} SELECT respondent_id, {_POINTS} AS points, CASE WHEN {_POINTS} >= 2 THEN 0 WHEN {_POINTS} <= -2 THEN 1 ELSE -1 END AS Behavior_Risk_Level FROM encoded")
def rule_vote(spark, d):
    df = encoded_table(spark, d).withColumn(vocab.TARGET, F.lit(-1))
    return rules.apply_rules(df).select(ROW_ID, rules.rule_points(df).alias("points"), vocab.TARGET)


# ------------------------------------------------------------------ scaling

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("standardise", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in _LINE) + " FROM lineitem")
def standardise(spark, d):
    df = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_LINE)
    return rounded(scale.standardise(df, _LINE)[0])


@query("robust_scale", "WITH q AS (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in _LINE) + " FROM lineitem) SELECT l_orderkey, l_linenumber, " +
       ", ".join(f"round(({c} - q_{c}[2]) / (q_{c}[3] - q_{c}[1]), 6) + 0.0 AS {c}" for c in _LINE) + " FROM lineitem, q")
def robust_scale(spark, d):
    df = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_LINE)
    return rounded(scale.robust_scale(df, _LINE)[0])


@query("robust_scale_ranked", "WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS c FROM orders) SELECT o_orderkey, round((o_totalprice - c[2]) / (c[3] - c[1]), 6) + 0.0 AS o_totalprice FROM orders, q")
def robust_scale_ranked(spark, d):
    """The same through range buckets, the way that continuous columns take at scale."""
    df = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(scale.robust_scale(df, ["o_totalprice"], small=0)[0])


@query("linear_score", "SELECT l_orderkey, l_linenumber, round(0.25 * l_quantity - 0.2 * l_discount + 0.1 * l_tax, 6) + 0.0 AS score FROM lineitem")
def linear_score(spark, d):
    df = read_table(spark, d, "lineitem")
    score = scale.linear_score({"l_quantity": 0.25, "l_discount": -0.2, "l_tax": 0.1})
    return rounded(df.select("l_orderkey", "l_linenumber", score.alias("score")))


@query("min_max", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) + 0.0 AS p_retailprice FROM part")
def min_max(spark, d):
    return rounded(scale.min_max(read_table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]))


@query("risk_score", f"{SCORED} SELECT respondent_id, round(Risk_Score, 6) + 0.0 AS Risk_Score FROM scored")
def risk_score(spark, d):
    return rounded(scale.risk_score(encoded_table(spark, d)).select(ROW_ID, "Risk_Score"))


@query("features_round_trip", f"""{ENCODED}, m AS (SELECT respondent_id, Age, Income_Category FROM encoded)
SELECT m.respondent_id, m.Age, m.Income_Category, CASE WHEN s.Impulse_Buying_Frequency IN ('Rarely', 'Sometimes', 'Often', 'Very often') THEN s.Impulse_Buying_Frequency ELSE 'Very rarely' END AS Impulse_Buying_Frequency,
s.Budget_Planning, s."Savings_Goal_Vacation" FROM m JOIN survey s USING (respondent_id)""")
def features_round_trip(spark, d):
    df = survey_translated(spark, d).select(ROW_ID, "Impulse_Buying_Frequency", "Budget_Planning", "Savings_Goal_Vacation")
    df = df.join(encoded_table(spark, d).select(ROW_ID, "Age", "Income_Category"), ROW_ID)
    layout = scale.fit_layout(df, ["Age", "Income_Category"], {"Impulse_Buying_Frequency": list(vocab.ORDINALS["Impulse_Buying_Frequency"])}, ["Budget_Planning"], ["Savings_Goal_Vacation"])
    packed = scale.assemble(df, layout).select(ROW_ID, "features")
    back = scale.inverse_features(packed, layout)
    return back.withColumns({c: F.round(c).cast("int") for c in ["Age", "Income_Category", "Savings_Goal_Vacation"]})


@query("zero_nulls", f"{NUMBERS} SELECT respondent_id, coalesce(Age, 0.0::DOUBLE) AS Age FROM numbers")
def zero_nulls(spark, d):
    return scale.zero_nulls(numeric_survey(spark, d).select(ROW_ID, "Age"), ["Age"])


@query("risk_by_debt", f"""{SCORED} SELECT Debt_Level, count(*) AS count, round(avg(Risk_Score), 3) AS mean, round(stddev_samp(Risk_Score), 3) AS std, round(min(Risk_Score), 3) AS min,
round(quantile_cont(Risk_Score, 0.5), 3) AS median, round(max(Risk_Score), 3) AS max FROM scored GROUP BY 1""")
def risk_by_debt(spark, d):
    """Survey to translated, smoothed, encoded and scored rows, profiled per debt level."""
    return profile.score_stats(scale.risk_score(encoded(spark, d)), "Debt_Level")


@query("decoded_export", f"{SMOOTHED} SELECT Age, Income_Category, Gender, Savings_Goal, Debt_Level FROM smoothed")
def decoded_export(spark, d):
    decoded, _ = split_branches(survey_raw(spark, d), ROW_ID)
    return decoded.select("Age", "Income_Category", "Gender", "Savings_Goal", "Debt_Level")
