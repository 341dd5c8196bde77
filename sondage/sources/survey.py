"""Survey tables derived from the given tables.

Every row of the base table is one respondent. Answers are drawn by the row
id, so any engine that can compute md5 builds the same survey.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions.draws import pick, u
from sondage.functions.literals import list_literal
from sondage.operators.encode import translate_survey
from sondage.session import spread

ROW_ID = "respondent_id"

# Answer labels per single-choice question, as the form shows them.
LABELS = {
    "Age": ["Sub 20", "20-30", "30-40", "40-50", "Peste 50", "27"],
    "Family_Status": [
        "Altul", "Într-o relație sau căsătorit/ă, cu copii.",
        "Într-o relație (coabitare) sau căsătorit/ă, fără copii.",
        "Necăsătorit/ă, fără copii", "Necăsătorit/ă, cu copii",
    ],
    "Gender": ["Feminin", "Masculin", "Prefer să nu răspund"],
    "Income_Category": ["Sub 4000 RON", "4000-8000 RON", "8000-12.000 RON", "12.000-16 000 RON", "Peste 16.000 RON"],
    "Essential_Needs_Percentage": ["Sub 50%", "50-75%", "Peste 75%"],
    "Financial_Attitude": ["Sunt disciplinat/ă în economisire", "Încerc să găsesc un echilibru", "Cheltuiesc mai mult decât câștig"],
    "Budget_Planning": ["Nu planific deloc", "Planific bugetul în detaliu", "Planific doar lucrurile esențiale"],
    "Save_Money": ["Nu", "Da"],
    "Product_Lifetime_Clothing": ["Sub 6 luni", "6-12 luni", "1-3 ani", "3-5 ani", "5-10 ani", "10-15 ani", "Peste 15 ani", "Nu am achizitionat"],
    "Product_Lifetime_Tech": ["Sub 6 luni", "6-12 luni", "1-3 ani", "3-5 ani", "5-10 ani", "10-15 ani", "Peste 15 ani", "Nu am achizitionat"],
    "Product_Lifetime_Appliances": ["Sub 6 luni", "6-12 luni", "1-3 ani", "3-5 ani", "5-10 ani", "10-15 ani", "Peste 15 ani", "Nu am achizitionat"],
    "Product_Lifetime_Cars": ["Sub 6 luni", "6-12 luni", "1-3 ani", "3-5 ani", "5-10 ani", "10-15 ani", "Peste 15 ani", "Nu am achizitionat"],
    "Impulse_Buying_Frequency": ["Foarte rar", "Rar", "Uneori", "Des", "Foarte des"],
    "Impulse_Buying_Category": ["Alimentație", "Haine sau produse de îngrijire personală", "Electronice sau gadget-uri", "Divertisment și timp liber", "Altceva"],
    "Impulse_Buying_Reason": ["Recompensă personală („merit acest lucru”)", "Reduceri sau promoții", "Presiuni sociale („toți prietenii au acest lucru”)", "Altceva"],
    "Debt_Level": ["Inexistent", "Scăzut", "Gestionabil", "Dificil de gestionat"],
    "Financial_Investments": ["Nu, dar sunt interesat/ă", "Nu, nu sunt interesat/ă", "Da, ocazional", "Da, regulat"],
    "Bank_Account_Analysis_Frequency": ["Rar sau deloc", "Lunar", "Săptămânal", "Zilnic"],
}
NULLABLE = ["Age", "Income_Category", "Essential_Needs_Percentage", "Product_Lifetime_Cars", "Impulse_Buying_Reason", "Debt_Level"]
NULL_SHARE = 0.02
CHOICE_SHARE = 0.35

# Row id, and a number whose position in a fixed range stands for wealth, per base table.
BASES = {
    "customer": ("c_custkey", "c_acctbal", -1000.0, 11000.0),
    "orders": ("o_orderkey", "o_totalprice", 0.0, 500000.0),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice_labels(column: str) -> dict[str, str]:
    """Option -> first label of a multi-choice question."""
    labels: dict[str, str] = {}
    for label, option in vocab.CHOICES[column].items():
        labels.setdefault(option, label)
    return labels


def survey_raw(spark: SparkSession, sf_dir: str, base: str = "customer") -> DataFrame:
    """The form's export: a timestamp, 22 titled answers, and the respondent id."""
    key, wealth, low, span = BASES[base]
    # an answer costs far more than reading its row, so few large pieces of a file are dealt to all cores first
    table = spread(read_table(spark, sf_dir, base).select(key, wealth))
    row_id = F.col(key)
    answers = {}
    for column, labels in LABELS.items():
        if column == "Debt_Level":
            poor = F.lit(1.0) - F.least(F.greatest((F.col(wealth) - F.lit(low)) / F.lit(span), F.lit(0.0)), F.lit(0.999999))
            at = F.least(F.floor(F.lit(2.0) * u(key, column) + F.lit(2.0) * poor), F.lit(3)).cast("int")
            value = F.element_at(list_literal(labels), at + F.lit(1))
        else:
            value = pick(labels, u(key, column))
        if column in NULLABLE:
            value = F.when(u(key, f"{column}:null") >= NULL_SHARE, value)
        answers[column] = value
    for column in vocab.CHOICES:
        marks = [F.when(u(key, f"{column}:{option}") < CHOICE_SHARE, F.lit(label)) for option, label in choice_labels(column).items()]
        answers[column] = F.array_join(F.array(*marks), ", ")
    titles = [answers[name].alias(title) for title, name in vocab.QUESTIONS.items()]
    return table.select(F.lit("2024/05/01").alias("Marcaj de timp"), *titles, row_id.alias(ROW_ID))


def survey_translated(spark: SparkSession, sf_dir: str, base: str = "customer") -> DataFrame:
    return translate_survey(survey_raw(spark, sf_dir, base))
