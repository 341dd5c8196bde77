"""Order statistics and running totals that no single task has to hold.

A table is first collapsed to its distinct values. Values then go to range
buckets, a pure function of the value, so a lost task recomputes the same
bucket. Totals per bucket give each bucket its start; inside a bucket a plain
window adds up. No bucket is hot: copies of one value are one row by then.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators.schema import ref
from sondage.session import shuffle_partitions

# Distinct values that one aggregation buffer may hold for an exact percentile.
SMALL_DISTINCT = 20_000


def range_edges(df: DataFrame, columns: list[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Inner edges of equal-count value ranges, from a mergeable sketch."""
    buckets = buckets or shuffle_partitions(df.sparkSession)
    if buckets < 2:
        return {c: [] for c in columns}
    shares = [i / buckets for i in range(1, buckets)]
    accuracy = max(10_000, 20 * buckets)
    row = df.agg(*[F.percentile_approx(ref(c).cast("double"), shares, accuracy) for c in columns]).first()
    return {c: sorted(set(edges or [])) for c, edges in zip(columns, row)}


def with_buckets(df: DataFrame, edges: dict[str, list[float]], prefix: str = "__b_") -> DataFrame:
    """Add the range bucket of each column, by binary search over its edges."""
    infinity = float("inf")
    cut = [c for c in edges if edges[c]]
    df = df.withColumns({f"{prefix}{c}": F.lit(0) for c in edges if c not in cut})
    if not cut:
        return df
    values, outputs = [f"__v{i}" for i in range(len(cut))], [f"__o{i}" for i in range(len(cut))]
    tool = Bucketizer(
        splitsArray=[[-infinity, *edges[c], infinity] for c in cut],
        inputCols=values, outputCols=outputs, handleInvalid="keep",
    )
    df = tool.transform(df.withColumns({v: ref(c).cast("double") for v, c in zip(values, cut)}))
    return df.withColumns({f"{prefix}{c}": F.col(o).cast("int") for o, c in zip(outputs, cut)}).drop(*values, *outputs)


def ranked_values(
    df: DataFrame, value: str, sums: dict[str, Column], by: list[str] | None = None,
    bucket: str | None = None, buckets: int | None = None,
) -> DataFrame:
    """Distinct (by, value) rows with totals, running totals and group totals.

    For each name in ``sums`` the result has the column itself (this value),
    ``<name>_before`` (all smaller values) and ``<name>_total`` (whole group).
    """
    by = by or []
    df = df.filter(ref(value).isNotNull())
    if bucket is None:
        bucket = "__bucket"
        edges = range_edges(df, [value], buckets)
        df = with_buckets(df, edges, "__r_").withColumnRenamed(f"__r_{value}", bucket)
    cells = df.groupBy(*[ref(c) for c in by], F.col(bucket).alias("__bucket"), ref(value)).agg(
        *[total.alias(name) for name, total in sums.items()]
    )
    starts = cells.groupBy(*[ref(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__bucket").alias("__kb")).agg(
        *[F.sum(name).alias(f"__s_{name}") for name in sums]
    )
    group = Window.partitionBy(*[f"__k{i}" for i in range(len(by))])
    before = group.orderBy("__kb").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        *[f"__k{i}" for i in range(len(by))], "__kb",
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__start_{n}") for n in sums],
        *[F.sum(f"__s_{n}").over(group).alias(f"{n}_total") for n in sums],
    )
    match = F.col("__bucket") == F.col("__kb")
    for i, c in enumerate(by):
        match = match & ref(c).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*[ref(c) for c in by], "__bucket").orderBy(ref(value)).rowsBetween(Window.unboundedPreceding, -1)
    joined = cells.join(starts, match)
    return joined.select(
        *[ref(c) for c in by], ref(value), *sums,
        *[(F.col(f"__start_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before") for n in sums],
        *[f"{n}_total" for n in sums],
    )


def _interpolated(ranked: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Linear-interpolated quantiles from ranked values; one row per group, ``q0``, ``q1``, ..."""
    picks = []
    for i, share in enumerate(shares):
        # the epsilon undoes products such as 0.07 * 100 that land just above a whole number
        at = F.lit(float(share)) * (F.col("__n_total") - F.lit(1))
        low = F.floor(at + F.lit(1e-9))
        high, part = low + F.lit(1), at - low
        part = F.when(part < 1e-9, F.lit(0.0)).otherwise(part)
        last = F.col("__n_before") + F.col("__n")

        def covers(rank):
            return (F.col("__n_before") <= rank) & (rank < last)

        lower = F.max(F.when(covers(low), ref(value).cast("double")))
        upper = F.max(F.when(covers(high), ref(value).cast("double")))
        share_up = F.max(part)
        picks.append(F.when(share_up == 0, lower).otherwise(lower + (upper - lower) * share_up).alias(f"q{i}"))
    return ranked.groupBy(*[ref(c) for c in by]).agg(*picks)


def group_quantiles(df: DataFrame, by: list[str], column: str, shares: list[float], names: list[str] | None = None,
                    buckets: int | None = None, small: int = SMALL_DISTINCT) -> DataFrame:
    """Exact quantiles of a column per group.

    With few distinct values one hash aggregation holds them; its state is
    checked first. Otherwise the ranks come from range buckets.
    """
    names = names or [f"q{i}" for i in range(len(shares))]
    distinct = df.agg(F.approx_count_distinct(ref(column))).first()[0]
    if distinct <= small:
        got = df.groupBy(*[ref(c) for c in by]).agg(F.percentile(ref(column).cast("double"), F.array(*[F.lit(float(s)) for s in shares])).alias("__q"))
        return got.select(*[ref(c) for c in by], *[F.get("__q", i).alias(n) for i, n in enumerate(names)])
    ranked = ranked_values(df, column, {"__n": F.count(F.lit(1))}, by, buckets=buckets)
    got = _interpolated(ranked, by, column, shares)
    return got.select(*[ref(c) for c in by], *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])


def quantiles(df: DataFrame, columns: list[str], shares: list[float], weight: str | None = None,
              buckets: int | None = None, small: int = SMALL_DISTINCT) -> dict[str, list[float]]:
    """Exact quantiles of several columns, as driver scalars."""
    columns = list(columns)
    if not columns:
        return {}
    row = df.agg(*[F.approx_count_distinct(ref(c)) for c in columns]).first()
    few = [c for c, n in zip(columns, row) if n <= small]
    many = [c for c in columns if c not in few]
    result: dict[str, list[float]] = {}
    if few:
        probs = F.array(*[F.lit(float(s)) for s in shares])
        freq = F.lit(1) if weight is None else ref(weight)
        got = df.agg(*[F.percentile(ref(c).cast("double"), probs, freq) for c in few]).first()
        result.update({c: list(v) if v is not None else [None] * len(shares) for c, v in zip(few, got)})
    if many:
        edges = range_edges(df, many, buckets)
        wide = with_buckets(df, edges)
        freq = F.lit(1) if weight is None else ref(weight)
        cells = F.array(*[
            F.struct(F.lit(c).alias("column"), ref(f"__b_{c}").alias("bucket"), ref(c).cast("double").alias("value")) for c in many
        ])
        long = wide.select(F.explode(cells).alias("c"), freq.alias("w")).select("c.*", "w")
        ranked = ranked_values(long, "value", {"__n": F.sum("w")}, ["column"], bucket="bucket")
        for r in _interpolated(ranked, ["column"], "value", shares).collect():
            result[r["column"]] = [r[f"q{i}"] for i in range(len(shares))]
    return {c: result.get(c, [None] * len(shares)) for c in columns}


def medians(df: DataFrame, columns: list[str], **kwargs) -> dict[str, float]:
    return {c: q[0] for c, q in quantiles(df, columns, [0.5], **kwargs).items()}


def distinct_ranks(df: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """(value, rank): position of each distinct value in ascending order, from 0."""
    one = df.select(ref(value)).distinct()
    ranked = ranked_values(one, value, {"__n": F.count(F.lit(1))}, buckets=buckets)
    return ranked.select(ref(value), F.col("__n_before").alias("rank"))


def class_ranks(df: DataFrame, by: list[str], draw: Column, row_id: str, rank: str = "rank", total: str = "total",
                rows_per_bucket: int = 500_000) -> DataFrame:
    """Rank of every row inside its class by a uniform draw, from 1, and the class size.

    The draw is uniform, so cutting [0, 1) into equal slices splits even a
    class with a third of all rows into even pieces.
    """
    slices = max(1, -(-df.count() // rows_per_bucket))
    df = df.withColumn("__draw", draw).withColumn("__slice", F.floor(F.col("__draw") * F.lit(slices)).cast("int"))
    counts = df.groupBy(*[ref(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__slice").alias("__ks")).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*[f"__k{i}" for i in range(len(by))])
    before = group.orderBy("__ks").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({
        "__start": F.coalesce(F.sum("__n").over(before), F.lit(0)),
        total: F.sum("__n").over(group),
    }).drop("__n")
    match = F.col("__slice") == F.col("__ks")
    for i, c in enumerate(by):
        match = match & ref(c).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*[ref(c) for c in by], "__slice").orderBy("__draw", ref(row_id))
    ranked = df.withColumn("__row", F.row_number().over(inside)).join(counts, match)
    return ranked.withColumn(rank, F.col("__row") + F.col("__start")).drop(
        "__draw", "__slice", "__row", "__start", "__ks", *[f"__k{i}" for i in range(len(by))]
    )
