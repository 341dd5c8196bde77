"""Translation, encoding and imputation of survey tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage import vocab
from sondage.functions import text
from sondage.functions.draws import u
from sondage.functions.smooth import smooth_age, smooth_income, smooth_lifetime, smooth_needs
from sondage.operators.order import medians
from sondage.operators.schema import drop_form_timestamp, numeric_columns, ref, rename_questions, trim_names
from sondage.session import cut_lineage

# Distinct answers per column that an inferred vocabulary may turn into columns; ``one_hot_long`` takes any number.
MAX_CATEGORIES = 1000


def translate_cells(df: DataFrame, mapping: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Exact whole-cell translation in every text column; unknown cells stay."""
    mapping = mapping or vocab.ANSWERS
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: text.lookup(ref(c), mapping, ref(c)) for c in columns})


def translate_column(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Translation in one column, if the table has it."""
    return translate_cells(df, mapping, [column]) if column in df.columns else df


def multi_hot(df: DataFrame, column: str, options: list[str]) -> DataFrame:
    """One 0/1 column per option of a multi-choice cell; the cell stays."""
    return df.withColumns({f"{column}_{o}": text.has_choice(ref(column), o) for o in options})


def translate_survey(df: DataFrame) -> DataFrame:
    """Raw answers to English text plus multi-choice flags, in one projection chain."""
    df = rename_questions(drop_form_timestamp(trim_names(df)))
    single = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    df = translate_cells(df, columns=single)
    for column, mapping in vocab.COLUMN_ANSWERS.items():
        df = translate_column(df, column, mapping)
    for column, mapping in vocab.CHOICES.items():
        if column in df.columns:
            df = df.withColumn(column, text.translate_choices(text.normalise_choices(ref(column)), mapping))
            df = multi_hot(df, column, list(dict.fromkeys(mapping.values())))
    return df


def ordinal_encode(df: DataFrame, mappings: dict[str, dict[str, int]] | None = None, default: int = 0) -> DataFrame:
    """Codes of ordered answers; anything unmapped or NULL gets ``default``."""
    mappings = mappings or vocab.ORDINALS
    return df.withColumns({c: text.lookup(ref(c), m, F.lit(default)) for c, m in mappings.items() if c in df.columns})


def binary_encode(df: DataFrame, mappings: dict[str, dict[str, int]] | None = None) -> DataFrame:
    return ordinal_encode(df, mappings or vocab.BINARIES)


def infer_vocabulary(df: DataFrame, columns: list[str], limit: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Distinct answers per column, from one job; fails beyond ``limit`` answers."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return {}
    seen = df.select(*[ref(c).cast("string").alias(c) for c in columns]).unpivot([], [ref(c) for c in columns], "column", "value")
    seen = seen.dropna().distinct()
    rows = seen.limit(limit * len(columns) + 1).collect()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        found[r["column"]].append(r["value"])
    if any(len(v) > limit for v in found.values()) or len(rows) > limit * len(columns):
        raise ValueError(f"more than {limit} distinct answers in a nominal column: one column each is too wide, use one_hot_long")
    return {c: sorted(v) for c, v in found.items()}


def one_hot(df: DataFrame, columns: list[str], vocabulary: dict[str, list[str]] | None = None, unseen: bool = False) -> DataFrame:
    """One 0/1 column per answer, named column_answer; the source column goes.

    ``vocabulary=None`` finds the answers that occur, by one bounded job. An
    answer outside the vocabulary sets no flag; with ``unseen`` it sets one of
    its own, column_unseen.
    """
    columns = [c for c in columns if c in df.columns]
    vocabulary = infer_vocabulary(df, columns) if vocabulary is None else vocabulary
    flags = {f"{c}_{v}": F.coalesce(ref(c) == F.lit(v), F.lit(False)).cast("int") for c in columns for v in vocabulary[c]}
    if unseen:
        flags.update({f"{c}_unseen": (ref(c).isNotNull() & ~F.coalesce(ref(c).isin(vocabulary[c]), F.lit(False))).cast("int") for c in columns})
    return df.withColumns(flags).drop(*columns)


def answers_long(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """(row id, column, value): one row per given answer."""
    picked = df.select(ref(row_id), *[ref(c).cast("string").alias(c) for c in columns])
    return picked.unpivot([ref(row_id)], [ref(c) for c in columns], "column", "value").dropna(subset=["value"])


def answer_levels(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """(column, value, position, slot) for every answer that occurs, any number of them.

    ``position`` counts a column's answers from 0 in the order of their bytes,
    ``slot`` those of all columns, in the order of the columns' names. Answers
    are sorted in ranges; only the number of answers per range and column
    reaches the driver.
    """
    seen = answers_long(df, columns, row_id).select("column", "value").distinct()
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # the written table fixes which range an answer lies in
    dealt = cut_lineage(seen.repartitionByRange("column", "value").sortWithinPartitions("column", "value").select("column", "value", F.spark_partition_id().alias("part"), within.alias("at")))
    runs = sorted(((r["part"], r["column"], r["n"]) for r in dealt.groupBy("part", "column").agg(F.count(F.lit(1)).alias("n")).collect()))
    starts, firsts, before = {}, {}, 0
    for part, column, n in runs:
        starts.setdefault(part, before)
        firsts.setdefault(column, before)
        before += n
    schema = "part int, column string, start long, first long"
    offsets = df.sparkSession.createDataFrame([(part, column, starts[part], firsts[column]) for part, column, _ in runs], schema)
    slot = F.col("start") + F.col("at")
    return dealt.join(F.broadcast(offsets), ["part", "column"]).select("column", "value", (slot - F.col("first")).alias("position"), slot.alias("slot"))


def one_hot_long(df: DataFrame, columns: list[str], row_id: str, levels: DataFrame | None = None) -> DataFrame:
    """(row id, column, value, position, slot): the flag that each answer sets, without a column per answer.

    ``levels`` are those of ``answer_levels``, of this table by default. An
    answer that they lack is kept, with NULL as its position and slot.
    """
    levels = answer_levels(df, columns, row_id) if levels is None else levels
    return answers_long(df, columns, row_id).join(levels, ["column", "value"], "left").select(ref(row_id), "column", "value", "position", "slot")


def one_hot_sparse(df: DataFrame, columns: list[str], row_id: str, levels: DataFrame | None = None) -> DataFrame:
    """Every row with ``slots``, the places of its ones in ascending order, and ``unseen``, how many of its answers have no place; the columns go.

    A row has at most one slot per column, so its array is short however many answers there are.
    """
    flags = one_hot_long(df, columns, row_id, levels).groupBy(ref(row_id)).agg(F.sort_array(F.collect_list("slot")).alias("slots"), F.count_if(F.col("slot").isNull()).alias("unseen"))
    out = df.drop(*columns).join(flags, row_id, "left")
    return out.withColumns({"slots": F.coalesce("slots", F.array().cast("array<bigint>")), "unseen": F.coalesce("unseen", F.lit(0).cast("long"))})


def range_smoothing(df: DataFrame, row_id: str, age: str = "Age", income: str = "Income_Category",
                    lifetimes: list[str] | None = None, needs: str = "Essential_Needs_Percentage",
                    lifetime_fn=None) -> DataFrame:
    """Ranges to values in the columns that exist.

    ``lifetime_fn(column, row_id, salt)`` builds the expression for lifetimes.
    """
    lifetime_fn = lifetime_fn or smooth_lifetime
    key, changed = F.col(row_id), {}
    if age in df.columns:
        changed[age] = smooth_age(ref(age), key, age)
    if income in df.columns:
        changed[income] = smooth_income(ref(income), key, income)
    for c in lifetimes or []:
        changed[c] = lifetime_fn(ref(c), key, c)
    if needs in df.columns:
        changed[needs] = smooth_needs(ref(needs), key, needs)
    return df.withColumns(changed)


def coerce_median_int(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to numbers, gaps to the median, then cut to whole numbers."""
    columns = [c for c in columns if c in df.columns]
    df = df.withColumns({c: text.number(ref(c)) for c in columns})
    middle = medians(df, columns)
    return df.withColumns({c: F.coalesce(ref(c), F.lit(middle[c]).cast("double")).cast("int") for c in columns})


def postprocess(df: DataFrame, vocabulary: dict[str, list[str]] | None = vocab.NOMINALS) -> DataFrame:
    """Translated and smoothed survey to an all-numeric table."""
    df = one_hot(ordinal_encode(df), list(vocab.NOMINALS), vocabulary)
    return coerce_median_int(binary_encode(df), vocab.SCALED)


def most_frequent(df: DataFrame, column: str):
    """Most frequent value; the smallest one of several."""
    counts = df.filter(ref(column).isNotNull()).groupBy(ref(column).alias("value")).count()
    row = counts.orderBy(F.desc("count"), "value").first()
    return None if row is None else row["value"]


def impute(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numbers by the median, text by the most frequent value, only where gaps exist."""
    columns = [c for c in (columns or vocab.REQUIRED) if c in df.columns]
    if not columns:
        return df
    gaps = df.agg(*[F.count_if(ref(c).isNull()) for c in columns]).first()
    gappy = [c for c, n in zip(columns, gaps) if n > 0]
    numeric = [c for c in gappy if c in numeric_columns(df)]
    fill = medians(df, numeric)
    fill.update({c: most_frequent(df, c) for c in gappy if c not in numeric})
    filled = {c: F.coalesce(ref(c).cast("double") if c in numeric else ref(c), F.lit(v)) for c, v in fill.items() if v is not None}
    return df.withColumns(filled)


def impute_constant(df: DataFrame, numeric: list[str], categorical: list[str], fill: str = "missing") -> DataFrame:
    """Numbers by the median, text by a constant."""
    middle = medians(df, numeric)
    changed = {c: F.coalesce(ref(c).cast("double"), F.lit(middle[c]).cast("double")) for c in numeric}
    changed.update({c: F.coalesce(ref(c).cast("string"), F.lit(fill)) for c in categorical})
    return df.withColumns(changed)


def fill_decoded(df: DataFrame, numeric: list[str], categorical: list[str], debt: str = "Debt_Level") -> DataFrame:
    """Decoded-table imputation: medians, most frequent answers, and 'Absent' debt."""
    others = [c for c in categorical if c != debt]
    df = impute(df, numeric + others)
    if debt in df.columns:
        df = df.withColumn(debt, F.coalesce(ref(debt), F.lit("Absent")))
    return df


def clean_generated(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Generated numbers to whole numbers; unusable ones to 0."""
    columns = [c for c in (columns or vocab.GENERATED_NUMERIC) if c in df.columns]
    return df.withColumns({c: F.bround(F.coalesce(text.number(ref(c)), F.lit(0.0))).cast("long") for c in columns})


def encode_decoded(df: DataFrame, scaler=None, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """Decoded survey (text lifetimes, text level) to the encoded table.

    ``scaler`` is a fitted ``ScalerParams``; without it numbers stay unscaled.
    """
    from sondage.operators.scale import apply_scaler

    months = df.withColumns({c: text.lifetime_months(ref(c)) for c in vocab.LIFETIMES})
    middle = medians(months, vocab.LIFETIMES)
    df = months.withColumns({c: F.coalesce(ref(c), F.lit(middle[c]).cast("double")) for c in vocab.LIFETIMES})
    df = ordinal_encode(df.withColumn(vocab.TARGET, text.label_code(ref(vocab.TARGET))))
    nominal = {**vocab.NOMINALS, **vocab.DECODED_NOMINALS}
    df = one_hot(df, list(nominal), nominal if vocabulary is None else vocabulary)
    for column, mapping in vocab.CHOICES.items():
        if column in df.columns:
            df = multi_hot(df, column, list(dict.fromkeys(mapping.values()))).drop(column)
    numbers = [c for c in vocab.SCALED if c in df.columns]
    df = df.withColumns({c: text.number(ref(c)) for c in numbers})
    return apply_scaler(df, scaler) if scaler is not None else df


def prepare_generator_input(df: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, list[str]]:
    """Unit words stripped, text gaps 'missing'; numeric columns that have values."""
    from sondage.operators.schema import non_empty

    df = df.withColumns({c: text.strip_units(ref(c)) for c in numeric})
    df = df.withColumns({c: F.coalesce(ref(c).cast("string"), F.lit("missing")) for c in categorical})
    return df, non_empty(df, numeric)


def shuffle_key(row_id: str, seed: int):
    return u(F.col(row_id), f"shuffle:{seed}")
