"""Hand-made rows for every text, smoothing and rule function."""

from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions import rules, smooth, text
from sondage.functions.draws import inverse_normal, truncated_normal, u, u_hash
from sondage.operators import encode, schema


def values(spark, cells, expr):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id long, c string")
    return [r[0] for r in df.orderBy("id").select(expr.alias("v")).collect()]


def test_age(spark):
    got = values(spark, ["20-30", ">50", ">40", "<20", "<25", "33", "abc", None, " 27 "], smooth.smooth_age(F.col("c"), F.col("id")))
    assert 20 <= int(got[0]) <= 30 and 50 <= int(got[1]) <= 70 and 18 <= int(got[3]) <= 20
    assert [got[2], got[4], got[5], got[6], got[7], got[8]] == [">40", "<25", "33", "abc", None, "27"]


def test_income(spark):
    got = values(spark, ["4.000-8.000 RON", ">16.000 RON", "<4.000 RON", "5321", "x", None], smooth.smooth_income(F.col("c"), F.col("id")))
    assert 4000 <= int(got[0]) <= 8000 and 16000 <= int(got[1]) <= 26000 and 3000 <= int(got[2]) <= 4000
    assert all(int(g) % 100 == 0 for g in got[:3]) and got[3:] == ["5300", "x", None]


def test_lifetime(spark):
    cells = ["<6 months", "6-12 months", "9 months", "1-3 years", ">15 years", "<5 years", "5 years", "Not purchased yet", None, "<1 months"]
    got = values(spark, cells, smooth.smooth_lifetime(F.col("c"), F.col("id"), "L", True))
    assert 3 <= int(got[0]) < 6 and 6 <= int(got[1]) <= 12 and got[2] == "9" and int(got[3]) in (12, 24, 36)
    assert 180 <= int(got[4]) <= 240 and 12 <= int(got[5]) <= 60 and got[6:] == ["5 years", "0", "0", "1"]
    shown = values(spark, cells, smooth.smooth_lifetime(F.col("c"), F.col("id"), "L"))
    assert shown[2] == "9 months" and shown[6:9] == ["5 years", "Not purchased yet", None] and shown[3].endswith(" years")


def test_needs(spark):
    got = values(spark, ["<50%", ">75%", "50-75%", "75-50", "60-60", "45", "62,5", "x", None, "-5", "90"], smooth.smooth_needs(F.col("c"), F.col("id")))
    assert 30 <= got[0] <= 50 and 75 <= got[1] <= 80 and 50 <= got[2] <= 75 and 50 <= got[3] <= 75 and got[4] == 60
    assert 30 <= got[5] <= 50 and 50 <= got[6] <= 75 and got[7:10] == [None, None, None] and 75 <= got[10] <= 80


def test_choices(spark):
    got = values(spark, ["A, B", "A (b, c), D", None, "Altceva, Venitul este insuficient, Rest"], text.normalise_choices(F.col("c")))
    assert got == ["A; B", "A (b, c); D", "", "Altceva; Venitul este insuficient; Rest"]
    cell = text.translate_choices(text.normalise_choices(F.col("c")), vocab.CHOICES["Savings_Obstacle"])
    assert values(spark, ["Altceva, Rest", None], cell) == ["Other; Rest", ""]
    assert values(spark, ["Other; Rest", "Another", ""], text.has_choice(F.col("c"), "Other")) == [1, 0, 0]


def test_durations(spark):
    got = values(spark, ["7 months", "4 years", "3", "Not purchased yet", None, "2 luni", "2 weeks", "x"], text.lifetime_months(F.col("c")))
    assert got == [7, 48, 36, None, None, 2, 2, None]
    assert values(spark, ["7 months", "4 years", "x"], text.duration_months(F.col("c"))) == [7, 48, None]
    assert values(spark, ["7", "12", "30"], text.duration_text(F.col("c").cast("double"))) == ["7 months", "1 years", "2 years"]
    assert values(spark, ["5 months", "x"], text.strip_units(F.col("c"))) == [5, None]
    assert values(spark, ["2.9", "-2.9", "x", None], text.safe_int(F.col("c"))) == [2, -2, 0, 0]
    assert values(spark, ["2.5", "7.5"], text.round_step(F.col("c").cast("double"), 5)) == [0, 10]


def test_numbers_are_plain(spark):
    assert values(spark, ["1d", " 2 ", "1e3", "nan", "."], text.number(F.col("c"))) == [None, 2, 1000, None, None]


def test_savings_repair(spark):
    flags = vocab.GOAL_FLAGS + vocab.OBSTACLE_FLAGS
    rows = [(0, "Yes", [0] * 6 + [1, 1, 0, 0]), (1, "No", [1] * 6 + [0, 0, 0, 0]), (2, "No", [0] * 6 + [0, 1, 0, 0]), (3, None, [1] * 10)]
    df = spark.createDataFrame([(i, s, *f) for i, s, f in rows], ["id", "Save_Money", *flags])
    got = {r["id"]: [r[c] for c in flags] for r in rules.repair_savings(df, "id").collect()}
    assert sum(got[0][:6]) == 1 and sum(got[0][6:]) == 0
    assert sum(got[1][:6]) == 0 and sum(got[1][6:]) == 1
    assert got[2] == [0] * 6 + [0, 1, 0, 0] and got[3] == [1] * 10


def test_one_hot_repair_and_clip(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, 0, 1)], "id long, a int, b int")
    got = rules.repair_one_hot(df, ["a", "b"], "id", "s").orderBy("id").collect()
    assert all(r["a"] + r["b"] == 1 for r in got) and got[2]["b"] == 1
    assert values(spark, ["17", "200", "x", "30.9"], rules.clip_range(F.col("c"), 18, 100, 18)) == [18, 100, 18, 30]
    assert values(spark, ["5 months", "30 months", "x months", "3 years"], rules.repair_car_lifetime(F.col("c"))) == ["1 years", "2 years", "5 years", "3 years"]


def test_consistency_filter(spark):
    df = spark.createDataFrame([(1, 0, 1, 1), (0, 1, 1, 0), (0, 1, 0, 1), (1, 0, 0, 0)], ["Save_Money_Yes", "Save_Money_No", "Savings_Goal_A", "Savings_Obstacle_B"])
    assert rules.filter_consistency(df).count() == 2
    assert rules.filter_consistency(df.drop("Save_Money_No")).count() == 4


def test_rules_on_raw_and_scaled_income(spark):
    df = spark.createDataFrame([(16000.0, 1, 1, -1), (4000.0, 4, 0, -1), (0.5, 1, 0, -1)], ["Income_Category", "Debt_Level", "Financial_Investments_Yes, regularly", vocab.TARGET])
    assert [r[vocab.TARGET] for r in rules.apply_rules(df).collect()] == [0, 1, -1]


def test_draws(spark):
    df = spark.range(2000)
    row = df.select(u(F.col("id"), "a").alias("a"), u("id", "a").alias("b"), u_hash(F.col("id"), "a").alias("h"), truncated_normal(0, 1, -1, 1, F.col("id")).alias("t"))
    got = row.agg(F.avg("a"), F.max(F.abs(F.col("a") - F.col("b"))), F.avg("h"), F.min("t"), F.max("t")).first()
    assert abs(got[0] - 0.5) < 0.03 and got[1] == 0 and abs(got[2] - 0.5) < 0.03 and got[3] >= -1 and got[4] <= 1
    z = [r[0] for r in spark.createDataFrame([(0.5,), (0.975,), (0.001,)], "p double").select(inverse_normal(F.col("p"))).collect()]
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1.959964) < 1e-5 and abs(z[2] + 3.090232) < 1e-5


def test_schema_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 5)], "a int, b string, c int")
    assert schema.non_constant(df, ["a", "b", "c"]) == ["a"] and schema.non_empty(df, ["a", "b"]) == ["a"]
    assert not schema.has_variation(df, "c") and schema.has_variation(df, "a")
    assert {r["column"]: r["nulls"] for r in schema.null_profile(df).collect()} == {"b": 2}


def test_one_hot_and_impute(spark):
    df = spark.createDataFrame([("x", 1.0), (None, None), ("y", 3.0), ("y", 8.0)], "n string, v double")
    hot = encode.one_hot(df.select("n"), ["n"])
    assert hot.columns == ["n_x", "n_y"] and [tuple(r) for r in hot.collect()] == [(1, 0), (0, 0), (0, 1), (0, 1)]
    got = encode.impute(df, ["n", "v", "zzz"]).collect()
    assert got[1]["n"] == "y" and got[1]["v"] == 3.0
