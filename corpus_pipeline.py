"""From raw documents to packed training sequences, stage by stage.

Texts in no known language go, one document of each near-duplicate group stays, secrets are masked, sources are mixed to
their weights, and the mix is packed. Each stage takes the rows its predecessor kept; between stages they are a
written table. A document that the mix takes twice is packed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import langid, mixing, packing, secrets, simhash
from narrata.llm._work import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.fit(secrets.labelled_findings(spark)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select(F.col("id").alias("doc_id"), "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix", mix), ("pack", pack)]
#: Fingerprints, classifiers and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
