"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sondage.llm import decontaminate, hilbert, htmltext, langid, licenses, lmscore, lzprint, merkle, mixing, quality, ranked, simhash, urltree
from sondage.llm.common import crc_mod, table
from sondage.llm.registry import ORACLE, QUERIES, query
from sondage.llm.sql import LICENSES_SQL, MIXING_SQL
from sondage.llm.sql_tables import HILBERT_SQL, MERKLE_SQL, RANKED_SQL

__all__ = ["ORACLE", "QUERIES"]


@query("op1_quality")
def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, d, "labels"), where=crc_mod("doc_id", 5) != 0)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    out = quality.score_quality(docs, model).select("row.doc_id", "score")
    return out.select("doc_id", held, "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


@query("op2_mixing", MIXING_SQL)
def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    weights = mixing.label_weights(table(spark, d, "labels"))
    return mixing.mix(table(spark, d, "documents"), weights).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op3_licenses", LICENSES_SQL)
def op3_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, d, "documents").select("doc_id", "text")).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return lmscore.score(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.groups(table(spark, d, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_langid")
def op6_langid(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    profiles = langid.fit_profiles(docs, where=crc_mod("doc_id", 4) != 2)
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", "text"), profiles).select("row.doc_id", "lang_pred", "score").select("doc_id", held, "lang_pred", "score")


@query("op7_lz_fingerprint")
def op7_lz_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return lzprint.fingerprint_pairs(table(spark, d, "documents"))


# the rules of the query: verdict, host, path
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op8_url_filter")
def op8_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return urltree.judge(table(spark, d, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages, htmltext.fit_labeller(pages)).select("row.page_id", "row.url", "text", "n_chars")


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op11_ranked_search", RANKED_SQL)
def op11_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return ranked.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op12_merkle", MERKLE_SQL)
def op12_merkle(spark: SparkSession, d: str) -> DataFrame:
    found = merkle.manifest(table(spark, d, "documents"), now={"text": merkle.tampered()})
    folded = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.fold(F.col("present"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_hilbert_shards", HILBERT_SQL)
def op13_hilbert_shards(spark: SparkSession, d: str) -> DataFrame:
    rows = hilbert.shard(table(spark, d, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("pipeline")
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    return corpus_pipeline.run(spark, d)
