"""Row rules: constraints that repair or drop rows, and the rule vote on risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions.draws import pick, u
from sondage.functions.text import integer, number, safe_int
from sondage.operators.schema import ref


def _total(columns: list[str]) -> Column:
    total = safe_int(ref(columns[0]))
    for name in columns[1:]:
        total = total + safe_int(ref(name))
    return total


def _chosen(columns: list[str], name: str, draw: Column) -> Column:
    """1 for the drawn column of a block, 0 for the others."""
    return (F.floor(draw * F.lit(len(columns))) == F.lit(columns.index(name))).cast("int")


def repair_savings(df: DataFrame, row_id: str, goals=None, obstacles=None, saver: str = "Save_Money") -> DataFrame:
    """Savers have a goal and no obstacle; the others no goal and exactly one obstacle."""
    goals, obstacles = goals or vocab.GOAL_FLAGS, obstacles or vocab.OBSTACLE_FLAGS
    saves, key = ref(saver), F.col(row_id)
    goal_draw, obstacle_draw = u(key, "goal"), u(key, "obstacle")
    goal_total, obstacle_total = _total(goals), _total(obstacles)
    changed = {}
    for name in goals:
        flag = safe_int(ref(name))
        changed[name] = (
            F.when((saves == "Yes") & (goal_total < 1), _chosen(goals, name, goal_draw))
            .when(saves == "No", F.lit(0))
            .otherwise(flag)
        )
    for name in obstacles:
        flag = safe_int(ref(name))
        changed[name] = (
            F.when(saves == "Yes", F.lit(0))
            .when((saves == "No") & (obstacle_total != 1), _chosen(obstacles, name, obstacle_draw))
            .otherwise(flag)
        )
    return df.withColumns(changed)


def repair_one_hot(df: DataFrame, columns: list[str], row_id: str, salt: str) -> DataFrame:
    """Exactly one flag of the block is set; any other block gets a drawn flag."""
    total, draw = _total(columns), u(F.col(row_id), salt)
    return df.withColumns(
        {c: F.when(total != 1, _chosen(columns, c, draw)).otherwise(safe_int(ref(c))) for c in columns}
    )


def clip_range(col: Column, low: int, high: int, default: int, rounded: bool = False) -> Column:
    """Number limited to [low, high]; cut to its whole part first, or rounded after."""
    value = F.coalesce(number(col), F.lit(float(default)))
    if not rounded:
        value = value.cast("long").cast("double")
    return F.bround(F.greatest(F.lit(float(low)), F.least(value, F.lit(float(high))))).cast("int")


def fill_income(col: Column, row_id: Column, low: float, high: float) -> Column:
    """Income as a whole number; a drawn value of the observed range where unusable."""
    drawn = F.lit(float(low)) + u(row_id, "income") * F.lit(float(high) - float(low))
    return F.bround(F.coalesce(number(col), drawn)).cast("long")


def repair_car_lifetime(col: Column) -> Column:
    """Car lifetimes given in months become whole years, at least one."""
    months = integer(F.split(F.trim(col), r"\s+")[0])
    years = F.greatest(F.lit(1), F.bround(months / F.lit(12)).cast("long"))
    text = F.coalesce(F.concat(years.cast("string"), F.lit(" years")), F.lit("5 years"))
    return F.when(col.contains("months"), F.when(months.isNull(), F.lit("5 years")).otherwise(text)).otherwise(col)


def allow_or_default(col: Column, allowed: list[str]) -> Column:
    """The answer if it is allowed, else the first allowed one."""
    return F.when(col.isin(allowed), col).otherwise(F.lit(allowed[0]))


def repair_investments(debt: Column, investments: Column, row_id: Column) -> Column:
    """Investment answers that fit the debt level."""
    allowed = vocab.DEBT_FREE_INVESTMENTS
    fits = F.coalesce(investments.isin(allowed), F.lit(False))
    return (
        F.when((debt == "Absent") & ~fits, pick(allowed, u(row_id, "investments")))
        .when(debt.isin("Low", "Manageable") & (investments == "Yes, regularly"), F.lit("No, but interested"))
        .otherwise(investments)
    )


def repair_impulse(frequency: Column, reason: Column) -> Column:
    """Very rare impulse buyers do not reward themselves."""
    clash = (frequency == "Very rarely") & (reason == "Self-reward")
    return F.when(clash, F.lit("Discounts or promotions")).otherwise(reason)


def income_range(df: DataFrame, column: str = "Income_Category") -> tuple[float, float]:
    """Smallest and largest usable income; 0 and 10000 when there is none."""
    value = number(ref(column))
    low, high = df.agg(F.min(value), F.max(value)).first()
    return (0.0, 10000.0) if low is None else (low, high)


def apply_constraints(df: DataFrame, row_id: str, incomes: tuple[float, float] | None = None) -> DataFrame:
    """Every constraint in order, as column expressions over one pass."""
    low, high = incomes or income_range(df)
    key = F.col(row_id)
    df = repair_savings(df, row_id)
    df = repair_one_hot(df, vocab.EXPENSE_FLAGS, row_id, "expense")
    df = repair_one_hot(df, vocab.CREDIT_FLAGS, row_id, "credit")
    df = df.withColumns({
        "Age": clip_range(F.col("Age"), 18, 100, 18),
        "Essential_Needs_Percentage": clip_range(F.col("Essential_Needs_Percentage"), 0, 100, 0, rounded=True),
        "Income_Category": fill_income(F.col("Income_Category"), key, low, high),
        "Product_Lifetime_Cars": repair_car_lifetime(F.col("Product_Lifetime_Cars")),
        **{name: allow_or_default(ref(name), allowed) for name, allowed in vocab.ALLOWED.items()},
    })
    return df.withColumns({
        "Financial_Investments": repair_investments(F.col("Debt_Level"), F.col("Financial_Investments"), key),
        "Impulse_Buying_Reason": repair_impulse(F.col("Impulse_Buying_Frequency"), F.col("Impulse_Buying_Reason")),
    })


def filter_consistency(df: DataFrame) -> DataFrame:
    """Drop non-savers with a goal and savers with an obstacle; no-op without both saver flags."""
    names = df.columns
    if "Save_Money_Yes" not in names or "Save_Money_No" not in names:
        return df

    def any_flag(prefix: str) -> Column:
        hit = F.lit(False)
        for name in names:
            if name.startswith(prefix):
                hit = hit | F.coalesce(ref(name).cast("int") != 0, F.lit(False))
        return hit

    def is_one(name: str) -> Column:
        return F.coalesce(ref(name).cast("int") == 1, F.lit(False))

    wrong = (is_one("Save_Money_No") & any_flag("Savings_Goal_")) | (is_one("Save_Money_Yes") & any_flag("Savings_Obstacle_"))
    return df.filter(~wrong)


def rule_points(df: DataFrame, income: str = "Income_Category") -> Column:
    """Points of the rule vote; a flag column that is absent counts as 0."""

    def flag(name: str) -> Column:
        return ref(name) == 1 if name in df.columns else F.lit(False)

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(float(value))).otherwise(F.lit(0.0))

    earned, debt = ref(income), F.col("Debt_Level")
    saving = F.when(flag("Save_Money_Yes"), F.lit(1.0)).when(earned >= 5000, F.lit(-1.0)).otherwise(F.lit(-0.5))
    return (
        points(earned >= 15000, 2)
        + points(debt == 4, -3)
        + points((debt >= 2) & (earned < 12000), -2)
        + points(flag("Financial_Investments_Yes, regularly"), 2)
        + points(flag("Budget_Planning_Plan budget in detail"), 1)
        + saving
        + points(flag("Relationship_Status_In a relationship/married with children"), 1)
    )


def apply_rules(df: DataFrame, income: str = "Income_Category", level: str = vocab.TARGET) -> DataFrame:
    """Risk level 0 from two points up, 1 from minus two down, unchanged between."""
    score = rule_points(df, income)
    return df.withColumn(level, F.when(score >= 2, F.lit(0)).when(score <= -2, F.lit(1)).otherwise(F.col(level)))
