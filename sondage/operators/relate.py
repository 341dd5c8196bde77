"""Row matching, set operations, sorts and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions.draws import u
from sondage.operators.order import class_ranks
from sondage.operators.schema import ref


def attach(df: DataFrame, labels: DataFrame, on: str = "respondent_id", how: str = "left") -> DataFrame:
    """Labels to rows by row id; rows without a label keep NULL."""
    return df.join(labels, on, how)


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def remove_exact_duplicates(train: DataFrame, test: DataFrame, row_id: str | None = None) -> DataFrame:
    """Train rows whose exact content occurs once in train and test together; gaps are content too.

    ``row_id`` is no content: the rows that stay keep theirs.
    """
    columns = [c for c in train.columns if c != row_id]
    if row_id is not None:
        train, test = train.withColumn("__id", ref(row_id)), test.withColumn("__id", ref(row_id))
    kept = [ref(c) for c in columns] + ([F.col("__id")] if row_id is not None else [])
    both = train.select(*kept, F.lit(1).alias("__train")).unionByName(test.select(*kept, F.lit(0).alias("__train")))
    first = [F.min("__id").alias("__id")] if row_id is not None else []
    counts = both.groupBy(*[ref(c) for c in columns]).agg(F.count(F.lit(1)).alias("__n"), F.sum("__train").alias("__t"), *first)
    found = counts.filter((F.col("__n") == 1) & (F.col("__t") == 1))
    return found.select(*[F.col("__id").alias(c) if c == row_id else ref(c) for c in train.columns if c != "__id"])


def synthetic_only(augmented: DataFrame, original: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Augmented rows whose features do not occur in the original.

    The hash spreads rows evenly; the column comparison rules out false hits.
    Original rows are reduced to distinct ones first.
    """
    ignore = (vocab.EXCLUDED + [vocab.TARGET]) if ignore is None else ignore
    columns = [c for c in original.columns if c not in ignore and c in augmented.columns]
    known = original.select(*[ref(c).alias(f"__o{i}") for i, c in enumerate(columns)]).distinct()
    known = known.withColumn("__h", F.xxhash64(*[f"__o{i}" for i in range(len(columns))]))
    kinds = dict(original.dtypes)
    same = [ref(c).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(columns)]
    hashed = augmented.withColumn("__a", F.xxhash64(*[ref(c).cast(kinds[c]) for c in columns]))
    match = reduce(lambda a, b: a & b, same, F.col("__a") == F.col("__h"))
    return hashed.join(known, match, "left_anti").drop("__a")


def sort_all(df: DataFrame) -> DataFrame:
    """Global sort by every column, by range partitioning."""
    return df.orderBy(*[ref(c) for c in df.columns])


def limit_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def shuffle_rows(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    return df.orderBy(u(ref(row_id), f"shuffle:{seed}"), ref(row_id))


def balanced_sample(df: DataFrame, target: str, per_class: int, row_id: str, seed: int = 42, exact: bool = True) -> DataFrame:
    """``per_class`` rows of each class, without replacement, in shuffled order.

    The row limit per class is pushed below the shuffle, so a hot class sends
    at most ``per_class`` rows per task.
    """
    if exact:
        short = df.groupBy(ref(target)).count().filter(F.col("count") < per_class).limit(1).collect()
        if short:
            raise ValueError(f"class {short[0][0]} has only {short[0][1]} rows")
    order = Window.partitionBy(ref(target)).orderBy("__draw", ref(row_id))
    drawn = df.withColumn("__draw", u(ref(row_id), f"balanced:{seed}"))
    kept = drawn.withColumn("__row", F.row_number().over(order)).filter(F.col("__row") <= per_class)
    return shuffle_rows(kept.drop("__row", "__draw"), row_id, seed)


def sample_upto(df: DataFrame, n: int, row_id: str, seed: int = 42) -> DataFrame:
    """min(n, available) rows; no single task sorts or holds them."""
    keyed = df.withColumn("__all", F.lit(0))
    ranked = class_ranks(keyed, ["__all"], u(ref(row_id), f"sample:{seed}"), row_id, "__rank", "__total")
    return ranked.filter(F.col("__rank") <= n).drop("__all", "__rank", "__total")


def stratified_split(df: DataFrame, target: str, fraction: float = 0.25, row_id: str = "respondent_id", seed: int = 42) -> DataFrame:
    """Adds ``is_test``: ceil(fraction * n) rows of each class."""
    ranked = class_ranks(df, [target], u(ref(row_id), f"split:{seed}"), row_id, "__rank", "__total")
    cut = F.ceil(F.col("__total") * F.lit(fraction))
    return ranked.withColumn("is_test", (F.col("__rank") <= cut).cast("int")).drop("__rank", "__total")


def stratified_folds(df: DataFrame, target: str, k: int = 5, row_id: str = "respondent_id", seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1, spread evenly inside each class."""
    ranked = class_ranks(df, [target], u(ref(row_id), f"fold:{seed}"), row_id, "__rank", "__total")
    return ranked.withColumn("fold", F.pmod(F.col("__rank"), F.lit(k)).cast("int")).drop("__rank", "__total")


def trim_balanced(df: DataFrame, target: str, per_class: int, row_id: str, seed: int = 42) -> DataFrame:
    """At most ``per_class`` rows of each class."""
    ranked = class_ranks(df, [target], u(ref(row_id), f"trim:{seed}"), row_id, "__rank", "__total")
    return ranked.filter(F.col("__rank") <= per_class).drop("__rank", "__total")
