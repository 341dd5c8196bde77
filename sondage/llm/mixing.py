"""Mixing sources to target weights by weighted sampling without replacement, in whole epochs and a last part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.draws import u
from sondage.llm.common import WORD, col
from sondage.session import cut_lineage

# Weights of the sources in order of their names, repeating; share of all words that the mix takes; most epochs of a source.
SOURCE_WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2.0
SALT = "mix"
# Buckets per doubling of the key: a source's order is cut there, so that no source is sorted in one task.
SUB_BUCKETS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Targets rise together in proportion to their weights until they reach ``most`` times their source; the rise is
    solved in one pass over the sources ordered by the level at which each is full.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").isNull(), F.col("source").cast("binary"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(share) * F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("level", (total - before) / rest)
    # the first source in this order that is not full at its own level sets the level of all that follow
    level = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("level", level["level"])
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weight: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", salt: str = SALT) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per document.

    ``weight`` has the columns (doc_id, weight): quality weights above 0; a document without one weighs 1. The key of a
    document is -ln(u) / weight with u drawn from its id; smaller keys come first within a source. A source's target is
    taken as whole epochs (every document once each) and a last part by a running sum over that order; the document at
    the edge gives the words that are still lacking, so a source's words reach its target to within one word.
    Null texts have size 0; documents without a source form one of their own, last in order; rows that repeat an
    id share a draw and follow one another by size; null ids are drawn alike. Extra columns are ignored; an empty
    table gives an empty result. Everything is built-in functions: no Python on the way.
    """
    base = docs.select(col(doc_id).alias("doc_id"), col(source).cast("string").alias("source"), word_count(col(text)).alias("size"))
    if weight is not None:
        base = base.join(weight.select("doc_id", "weight"), "doc_id", "left")
    else:
        base = base.withColumn("weight", F.lit(1.0))
    draw = F.greatest(u(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), salt), F.lit(2.0**-53))
    base = base.withColumn("key", -F.ln(draw) / F.coalesce("weight", F.lit(1.0)))
    octave = F.when(F.col("key") > 0, F.floor(F.log2("key"))).otherwise(F.lit(-1100)).cast("long")
    base = cut_lineage(base.withColumn("bucket", octave * SUB_BUCKETS + F.when(F.col("key") > 0, F.floor((F.col("key") / F.pow(F.lit(2.0), octave) - 1) * SUB_BUCKETS)).otherwise(F.lit(0)).cast("long")))

    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    places = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    places = places.select(F.col("o.source").alias("p_source"), F.col("o.bucket").alias("p_bucket"), "ahead", "source_size", "target")
    rows = base.join(places, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) DIV source_size")).otherwise(F.lit(0))
    left = goal - F.col("epochs") * F.col("source_size")
    rows = rows.withColumn("start", start).withColumn("epochs", epochs)
    part = F.least(F.greatest(left - F.col("start"), F.lit(0)), F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def with_mix(docs: DataFrame, weight: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", salt: str = SALT) -> DataFrame:
    """The rows of ``docs`` with all columns and size, source_size, target and taken of ``mix``; own columns of these names are replaced.

    Rows meet their share by id, source and size; where several rows agree in all three, the longest shares go to the
    texts of the smallest digests, so every row gets one share.
    """
    taken = mix(docs, weight, doc_id, text, source, salt)
    keys = ["__id", "__source", "__size"]
    shares = taken.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "source_size", "target", "taken")
    shares = shares.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("taken"))))
    rows = docs.select(F.struct(*[col(c) for c in docs.columns if c not in ("size", "source_size", "target", "taken")]).alias("row"), col(doc_id).alias("id"), col(source).cast("string").alias("s"), word_count(col(text)).alias("size"), F.md5(F.coalesce(col(text), F.lit("")).cast("binary")).alias("h"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "s", "size").orderBy("h")))
    match = F.col("id").eqNullSafe(F.col("__id")) & F.col("s").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")) & (F.col("nth") == F.col("__nth"))
    return rows.join(shares, match).select("row.*", "size", "source_size", "target", "taken")


def label_weights(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", good: float = 1.0, bad: float = 0.25) -> DataFrame:
    """(doc_id, weight): documents labelled 1 weigh ``good``, those labelled 0 ``bad``; the better of several labels counts."""
    marks = labels.where(col(doc_id).isNotNull() & col(label).isNotNull())
    return marks.groupBy(col(doc_id).alias("doc_id")).agg(F.max(F.when(col(label) == 1, good).otherwise(bad)).alias("weight"))
