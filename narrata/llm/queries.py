"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import cotraining, html_text, langid, mixing, packing, pii, rules, secrets, simhash, sketches
from narrata.llm._work import table

#: The key of the surrogates; a deployment sets its own.
PII_KEY = "narrata-surrogates"
#: Weights of the sources in a window, repeating along their names.
PACK_TARGETS = (5, 2, 1)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), budget=2)
    return groups.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    return langid.identify(docs, model).select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"), "lang_pred", "score", "rejected")


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_refused")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cotraining.vectors(table(spark, sf_dir, "documents"))
    return cotraining.score(vectors, cotraining.fit(vectors, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), targets=PACK_TARGETS)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", packing.widened_crc32().alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_versions(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, count_col="n_entities")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.fit(secrets.labelled_findings(spark))
    found = secrets.find(table(spark, sf_dir, "documents"), model)
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.sha2("value", 256).alias("value_sha256"), "kind", "score", "secret")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_language, op3_rules, op4_quality, op5_packing, op6_sketch, op7_surrogates, op8_main_text, op9_mixing, op10_secrets)}

ORACLES: dict[str, str] = {"op3_rules": rules.ORACLE, "op9_mixing": mixing.ORACLE}
