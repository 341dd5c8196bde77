"""From raw documents to a training mix: language, quality, near copies, benchmark passages, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import decontaminate, langid, mixing, nearcopies, quality, simhash
from sondage.llm.common import drop_path, shared_path, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter go, and those further from every profile than its learning texts of that length."""
    profiles = langid.fit_profiles(docs)
    return langid.known(docs, profiles, langid.fit_limits(docs, profiles))


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labelled ones among them, does not reject."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where(F.col("score") >= quality.KEEP).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints that differ in 3 bits or fewer, or a five-word similarity of 0.8 or more on whole texts.

    SimHash links come from the inverted index over positional bytes of ``op5_simhash``. At a similarity of 0.8 a bit of a
    SimHash differs with probability 0.15, which no list of its bytes survives, so min-hashes find the pairs that it lacks.
    Components are formed over the links of both.
    """
    return nearcopies.keep_one(docs, further=simhash.hubs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, texts and all, with size, source_size, target and taken: how many of their words the mix takes; those of which it takes none go.

    A column of the documents that has one of these four names makes way for it.
    """
    return mixing.with_mix(docs, mixing.label_weights(table(spark, sf_dir, "labels"))).where("taken > 0")


STAGES = [
    ("language_id", language),
    ("quality_classifier", good_text),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", decontaminated),
    ("mixing", mixed),
]

# The stages learn models, so SQL cannot give their rows; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again, and go once the next stage's are complete."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            drop_path(spark, last)
        last = path
    return docs
