"""Registry, shared inputs, and the SQL that builds the same inputs in DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions.smooth import smooth_lifetime
from sondage.functions.text import number
from sondage.operators.encode import postprocess, range_smoothing
from sondage.operators.schema import ref
from sondage.session import Rounds, cut_lineage
from sondage.sources.survey import CHOICE_SHARE, LABELS, NULL_SHARE, NULLABLE, ROW_ID, read_table, survey_raw, survey_translated

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its checking SQL where there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Double columns rounded, so the last bit does not decide a comparison."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in skip]
    # adding 0.0 turns a negative zero into zero
    return df.withColumns({c: F.round(ref(c), digits) + F.lit(0.0) for c in doubles})


def smoothed(spark: SparkSession, d: str, base: str = "customer", encoded: bool = True) -> DataFrame:
    df = survey_translated(spark, d, base)
    if encoded:
        df = df.drop(*vocab.MULTI_COLUMNS)
    fn = partial(smooth_lifetime, encoded=encoded)
    return range_smoothing(df, ROW_ID, lifetimes=vocab.LIFETIMES, lifetime_fn=fn)


def encoded(spark: SparkSession, d: str, base: str = "customer") -> DataFrame:
    """Encoded survey with whole numbers, before scaling."""
    return postprocess(smoothed(spark, d, base))


_TABLES: dict[tuple, DataFrame] = {}


def encoded_table(spark: SparkSession, d: str, base: str = "customer") -> DataFrame:
    """The encoded survey, written once per session: queries that pass over it several times start here."""
    key = (spark.sparkContext.applicationId, d, base)
    if key not in _TABLES:
        rounds = Rounds(spark)
        # medians and the table itself start from the drawn answers, so these are made once
        with rounds.round():
            answers = cut_lineage(smoothed(spark, d, base))
            _TABLES[key] = rounds.hand_on(postprocess(answers).select(ROW_ID, *[ref(c) for c in encoded_columns()]))
    return _TABLES[key]


def numeric_survey(spark: SparkSession, d: str, base: str = "customer") -> DataFrame:
    """The seven range columns as numbers with gaps, the ordinals, and the choice flags."""
    df = smoothed(spark, d, base)
    return df.withColumns({c: number(ref(c)) for c in vocab.SCALED})


# ----------------------------------------------------------------- DuckDB side


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def u_sql(row_id: str, salt: str) -> str:
    return f"((('0x' || substr(md5(CAST({row_id} AS VARCHAR) || {q(':' + salt)}), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE)"


def facts_sql(cte: str, facts: dict[str, str]) -> str:
    """(fact, value) rows of scalar expressions, beside ``certify.facts``."""
    return cte + " " + " UNION ALL ".join(f"SELECT {q(k)} AS fact, ({v})::DOUBLE AS value" for k, v in facts.items())


def list_sql(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def map_sql(col: str, mapping: dict, default: str) -> str:
    keys, values = list_sql(mapping.keys()), list_sql(mapping.values())
    return f"coalesce(list_extract({values}, list_position({keys}, {col})), {default})"


def between_sql(low: str, high: str, draw: str) -> str:
    return f"({low} + floor({draw} * ({high} - {low} + 1)))::BIGINT"


def num_sql(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN TRY_CAST(trim({col}) AS DOUBLE) END"


def raw_column_sql(column: str) -> str:
    labels = LABELS[column]
    if column == "Debt_Level":
        poor = "(1.0::DOUBLE - least(greatest((c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE, 0.0::DOUBLE), 0.999999::DOUBLE))"
        value = f"list_extract({list_sql(labels)}, least(floor(2.0::DOUBLE * {u_sql('c_custkey', column)} + 2.0::DOUBLE * {poor}), 3)::INT + 1)"
    else:
        value = f"list_extract({list_sql(labels)}, floor({u_sql('c_custkey', column)} * {len(labels)})::INT + 1)"
    if column in NULLABLE:
        return f"CASE WHEN {u_sql('c_custkey', column + ':null')} >= {NULL_SHARE}::DOUBLE THEN {value} END"
    return value


def choice_options(column: str) -> list[str]:
    return list(dict.fromkeys(vocab.CHOICES[column].values()))


def choice_cell_sql(column: str) -> str:
    marks = ", ".join(f"CASE WHEN {u_sql('c_custkey', f'{column}:{o}')} < {CHOICE_SHARE}::DOUBLE THEN {q(o)} END" for o in choice_options(column))
    return f"array_to_string(list_filter([{marks}], lambda x: x IS NOT NULL), '; ')"


def survey_cte() -> str:
    """CTEs raw (labels) and survey (English answers plus choice flags)."""
    raw = ",\n".join(f"{raw_column_sql(c)} AS {c}" for c in LABELS)
    cells = ",\n".join(f"{choice_cell_sql(c)} AS {c}" for c in vocab.CHOICES)
    english = []
    for c in LABELS:
        mapping = {**vocab.ANSWERS, **vocab.COLUMN_ANSWERS.get(c, {})}
        mapping = {k: v for k, v in mapping.items() if k in LABELS[c]}
        english.append(f"{map_sql(c, mapping, c) if mapping else c} AS {c}")
    flags = [
        f"(CASE WHEN list_contains(string_split({c}, '; '), {q(o)}) THEN 1 ELSE 0 END)::INT AS {ident(f'{c}_{o}')}"
        for c in vocab.CHOICES for o in choice_options(c)
    ]
    return f"""raw AS (SELECT c_custkey AS respondent_id, {raw},\n{cells} FROM customer),
survey AS (SELECT respondent_id, {", ".join(english)}, {", ".join(vocab.CHOICES)},\n{", ".join(flags)} FROM raw)"""


def smooth_age_sql(col: str = "Age", row_id: str = "respondent_id") -> str:
    draw = u_sql(row_id, "Age")
    pair = f"regexp_extract({col}, '^(\\d+)\\s*-\\s*(\\d+)', %d)::BIGINT"
    return f"""CASE WHEN regexp_matches({col}, '^\\d+\\s*-\\s*\\d+') THEN {between_sql(pair % 1, pair % 2, draw)}::VARCHAR
WHEN regexp_matches({col}, '^>\\s*\\d+') AND TRY_CAST(regexp_extract({col}, '^>\\s*(\\d+)', 1) AS BIGINT) >= 50 THEN {between_sql('50', '70', draw)}::VARCHAR
WHEN regexp_matches({col}, '^<\\s*\\d+') AND TRY_CAST(regexp_extract({col}, '^<\\s*(\\d+)', 1) AS BIGINT) <= 20 THEN {between_sql('18', '20', draw)}::VARCHAR
ELSE {col} END"""


def smooth_income_sql(col: str = "Income_Category", row_id: str = "respondent_id") -> str:
    text, draw = f"trim(replace({col}, '.', ''))", u_sql(row_id, "Income_Category")

    def hundreds(low: str, high: str) -> str:
        return f"({between_sql(f'floor(({low}) / 100.0)', f'floor(({high}) / 100.0)', draw)} * 100)::VARCHAR"

    pair = f"regexp_extract({text}, '^(\\d+)[^\\d]+(\\d+)', %d)::BIGINT"
    above, below = f"regexp_extract({text}, '^>\\s*(\\d+)', 1)::BIGINT", f"regexp_extract({text}, '^<\\s*(\\d+)', 1)::BIGINT"
    return f"""CASE WHEN regexp_matches({text}, '^\\d+[^\\d]+\\d+') THEN {hundreds(pair % 1, pair % 2)}
WHEN regexp_matches({text}, '^>\\s*\\d+') THEN {hundreds(above, above + ' + 10000')}
WHEN regexp_matches({text}, '^<\\s*\\d+') THEN {hundreds('3000', below)}
ELSE {text} END"""


def smooth_lifetime_sql(col: str, encoded: bool, row_id: str = "respondent_id") -> str:
    draw = u_sql(row_id, col)

    def out(count: str, unit: str) -> str:
        if encoded:
            return f"(({count}) * {12 if unit == 'years' else 1})::VARCHAR"
        return f"(({count})::VARCHAR || ' {unit}')"

    few = f"regexp_extract({col}, '^<\\s*(\\d+)\\s*months', 1)::BIGINT"
    month = f"regexp_extract({col}, '^(\\d+)\\s*-\\s*(\\d+)\\s*months', %d)::BIGINT"
    year = f"regexp_extract({col}, '^(\\d+)\\s*-\\s*(\\d+)\\s*years', %d)::BIGINT"
    over = f"regexp_extract({col}, '^>\\s*(\\d+)\\s*years', 1)::BIGINT"
    nothing = "'0'" if encoded else col
    return f"""CASE WHEN {col} = 'Not purchased yet' THEN {nothing}
WHEN regexp_matches({col}, '^<\\s*\\d+\\s*months') THEN {out(between_sql(f'greatest(1, {few} - 3)', f'({few} - 1)', draw), 'months')}
WHEN regexp_matches({col}, '^\\d+\\s*-\\s*\\d+\\s*months') THEN {out(between_sql(month % 1, month % 2, draw), 'months')}
WHEN regexp_matches({col}, '^\\d+\\s*-\\s*\\d+\\s*years') THEN {out(between_sql(year % 1, year % 2, draw), 'years')}
WHEN regexp_matches({col}, '^>\\s*\\d+\\s*years') THEN {out(between_sql(over, f'({over} + 5)', draw), 'years')}
ELSE {nothing} END"""


def smooth_needs_sql(col: str = "Essential_Needs_Percentage", row_id: str = "respondent_id") -> str:
    draw = u_sql(row_id, "Essential_Needs_Percentage")

    def step(low: int, high: int) -> str:
        return f"greatest({low}.0::DOUBLE, least(round_even(({low}.0::DOUBLE + {draw} * {high - low}.0::DOUBLE) / 5.0::DOUBLE, 0) * 5.0::DOUBLE, {high}.0::DOUBLE))"

    return f"CASE {col} WHEN '<50%' THEN {step(30, 50)} WHEN '>75%' THEN {step(75, 80)} WHEN '50-75%' THEN {step(50, 75)} END"


def smoothed_cte() -> str:
    """CTE smoothed: survey with the range columns as drawn text (needs as a number)."""
    parts = [f"{smooth_age_sql()} AS Age", f"{smooth_income_sql()} AS Income_Category", f"{smooth_needs_sql()} AS Essential_Needs_Percentage"]
    parts += [f"{smooth_lifetime_sql(c, True)} AS {c}" for c in vocab.LIFETIMES]
    names = ", ".join(vocab.SCALED)
    return f"smoothed AS (SELECT * EXCLUDE ({names}), {', '.join(parts)} FROM survey)"


def numbers_cte() -> str:
    """CTE numbers: the range columns as doubles with gaps."""
    parts = [f"{num_sql(c + '::VARCHAR')} AS {c}" for c in vocab.SCALED]
    return f"numbers AS (SELECT * EXCLUDE ({', '.join(vocab.SCALED)}), {', '.join(parts)} FROM smoothed)"


def ordinal_sql(column: str, mapping: dict[str, int]) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in mapping.items())
    return f"(CASE {column} {cases} ELSE 0 END)::INT"


def encoded_columns() -> list[str]:
    names = [*vocab.SCALED, "Gender", "Save_Money", *vocab.ORDINALS]
    names += [f"{c}_{o}" for c in vocab.CHOICES for o in choice_options(c)]
    return names + [f"{c}_{v}" for c, values in vocab.NOMINALS.items() for v in values]


def encoded_cte() -> str:
    """CTE encoded: every column a whole number, gaps at the median."""
    medians = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in vocab.SCALED)
    parts = [f"trunc(coalesce({c}, m_{c}))::INT AS {c}" for c in vocab.SCALED]
    parts += [f"{ordinal_sql(c, m)} AS {c}" for c, m in {**vocab.BINARIES, **vocab.ORDINALS}.items()]
    parts += [ident(f"{c}_{o}") for c in vocab.CHOICES for o in choice_options(c)]
    parts += [f"(CASE WHEN {c} = {q(v)} THEN 1 ELSE 0 END)::INT AS {ident(f'{c}_{v}')}" for c, values in vocab.NOMINALS.items() for v in values]
    return f"middle AS (SELECT {medians} FROM numbers),\nencoded AS (SELECT respondent_id, {', '.join(parts)} FROM numbers, middle)"


SURVEY = "WITH " + survey_cte()
SMOOTHED = f"{SURVEY},\n{smoothed_cte()}"
NUMBERS = f"{SMOOTHED},\n{numbers_cte()}"
ENCODED = f"{NUMBERS},\n{encoded_cte()}"


def score_sql(source: str = "encoded", extra: str = "") -> str:
    """CTE scored: risk score from robust-scaled columns of ``source``."""
    names = list(vocab.RISK_WEIGHTS)
    cuts = ", ".join(f"quantile_cont({c}::DOUBLE, 0.25) AS a_{c}, quantile_cont({c}::DOUBLE, 0.5) AS m_{c}, quantile_cont({c}::DOUBLE, 0.75) AS b_{c}" for c in names)
    terms = " + ".join(
        f"(({c} - cuts.m_{c}) / (CASE WHEN cuts.b_{c} = cuts.a_{c} THEN 1.0::DOUBLE ELSE cuts.b_{c} - cuts.a_{c} END)) * ({w})::DOUBLE" for c, w in vocab.RISK_WEIGHTS.items()
    )
    return f"cuts AS (SELECT {cuts} FROM {source}),\nscored AS (SELECT {source}.*, {terms} AS Risk_Score{extra} FROM {source}, cuts)"


SCORED = f"{ENCODED},\n{score_sql()}"
