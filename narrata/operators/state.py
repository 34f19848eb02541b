"""State tables: sticky merges, text versions and deletions.

Plain files have no MERGE, so a merge is a full outer join whose result is written as a new version of the table; the last complete
version is the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_CACHE = (
    "chapter_key string, sentence_hash string, original_text string, transcription string, raw_transcription string, similarity double, reference_check_score double, "
    "reference_check_threshold double, reference_check_status string, reference_check_payload string, checked_at timestamp, status string"
)
VERSIONS = "sentence_hash string, sentence_text string, replaced_by_hash string, created_at timestamp"
DELETIONS = "chapter_key string, sentence_hash string, deleted_at timestamp, similarity double, threshold double"
STEPS = "chapter_key string, step_index int, step_name string, input_hash string, config_hash string, status string, output string, error_message string, updated_at timestamp"
UNITS = STEPS.replace("step_name string", "step_name string, unit_index int")
KEY = ["chapter_key", "sentence_hash"]


class Table:
    """A table in numbered versions below a path; readers see the last that was written whole."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        if not self._fs.exists(self._root):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._root)]
        done = [int(n[1:]) for n in names if n[1:].isdigit() and self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        """One writer at a time."""
        df.write.mode("overwrite").parquet(f"{self.path}/v{self.version() + 1}")


def sticky_merge(now: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """New results over stored ones. A chunk that was resolved stays so, unless forced; columns that the new rows lack keep their values."""
    a, b = now.alias("a"), new.alias("b")
    joined = a.join(b, KEY, "full_outer")
    cols = []
    for c in now.columns:
        if c in KEY:
            cols.append(F.col(c))
        elif c == "status" and not force:
            cols.append(F.when(F.col("a.status") == "resolved", F.col("a.status")).otherwise(F.coalesce("b.status", "a.status")).alias(c))
        else:
            cols.append((F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in new.columns else F.col(f"a.{c}")).alias(c))
    return joined.select(*cols)


def resolve(now: DataFrame, keys: DataFrame) -> DataFrame:
    """The given chunks are resolved."""
    hit = keys.select(*KEY).distinct().withColumn("hit", F.lit(True))
    return now.join(hit, KEY, "left").withColumn("status", F.when(F.col("hit"), "resolved").otherwise(F.col("status"))).drop("hit")


def reopen(now: DataFrame, deleted: DataFrame) -> DataFrame:
    """Chunks whose audio was deleted by hand are disputed again, resolved or not, and lose their check."""
    hit = deleted.select(*KEY).distinct().withColumn("hit", F.lit(True))
    rows = now.join(hit, KEY, "left")
    cleared = {c: F.when(F.col("hit"), F.lit(None).cast(now.schema[c].dataType)).otherwise(F.col(c)) for c in ("transcription", "similarity", "checked_at") if c in now.columns}
    return rows.withColumns({"status": F.when(F.col("hit"), "disputed").otherwise(F.col("status")), **cleared}).drop("hit")


def carry_status(now: DataFrame, edits: DataFrame) -> DataFrame:
    """After edits (chapter_key, old_hash, new_hash, new_text) a resolved chunk's successor is resolved too."""
    rows = now.join(edits.withColumnRenamed("old_hash", "sentence_hash"), KEY).where("status = 'resolved'")
    moved = rows.select("chapter_key", F.col("new_hash").alias("sentence_hash"), F.col("new_text").alias("original_text"), "status")
    return sticky_merge(now, moved)


def add_versions(now: DataFrame, new: DataFrame) -> DataFrame:
    """Texts by hash: known ones stay, and only a missing link to a successor is filled."""
    best = new.groupBy("sentence_hash").agg(F.min_by("sentence_text", "created_at").alias("sentence_text"), F.min("replaced_by_hash").alias("replaced_by_hash"), F.min("created_at").alias("created_at"))
    joined = now.alias("a").join(best.alias("b"), "sentence_hash", "full_outer")
    return joined.select("sentence_hash", *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("sentence_text", "replaced_by_hash", "created_at")])


def version_counts(now: DataFrame, new: DataFrame) -> DataFrame:
    """How many of the new texts are new and how many known; one row."""
    seen = new.select("sentence_hash").distinct().join(now.select("sentence_hash").withColumn("known", F.lit(True)), "sentence_hash", "left")
    return seen.agg(F.count_if(F.col("known").isNull()).alias("n_new"), F.count_if("known").alias("n_existing"))


def predecessors(versions: DataFrame) -> DataFrame:
    """Each text with the one it replaced, one step back."""
    old = versions.select(F.col("sentence_hash").alias("old_hash"), F.col("sentence_text").alias("old_text"), F.col("replaced_by_hash").alias("sentence_hash"), F.col("created_at").alias("old_created_at"))
    return versions.join(old, "sentence_hash")


def version_chain(spark: SparkSession, versions: DataFrame, most: int = 100) -> DataFrame:
    """(start_hash, sentence_hash, depth): every text with all its successors. A cycle ends at ``most`` steps."""
    return spark.sql(
        f"""
        WITH RECURSIVE chain MAX RECURSION LEVEL {most + 1} AS (
          SELECT sentence_hash AS start_hash, sentence_hash, replaced_by_hash, 0 AS depth FROM {{versions}}
          UNION ALL
          SELECT c.start_hash, v.sentence_hash, v.replaced_by_hash, c.depth + 1 FROM chain c JOIN {{versions}} v ON v.sentence_hash = c.replaced_by_hash WHERE c.depth < {most - 1})
        SELECT start_hash, sentence_hash, depth FROM chain""",
        versions=versions,
    )


def retry_counts(deletions: DataFrame) -> DataFrame:
    """Deletions of a text, in whatever chapter."""
    return deletions.groupBy("sentence_hash").agg(F.count(F.lit(1)).alias("auto_retry_count"))


def fresh(checked_at, mtime) -> F.Column:
    """Whether a stored check is no older than the audio; unreadable times are stale. Times without a zone are UTC."""
    return F.coalesce(F.try_to_timestamp(checked_at) >= mtime, F.lit(False))


def to_check(chunks: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """What a check does with each chunk that has audio (mtime): "skip" a resolved fresh one, "reuse" a fresh transcription, else "transcribe"."""
    rows = chunks.join(cache.select(*KEY, "status", "transcription", "checked_at"), KEY, "left")
    is_fresh = F.coalesce(F.col("checked_at") >= F.col("mtime"), F.lit(False))
    manual = F.startswith(F.coalesce("transcription", F.lit("")), F.lit("[manual]"))
    action = F.when((F.col("status") == "resolved") & is_fresh, "skip").when(is_fresh & F.col("transcription").isNotNull() & ~manual, "reuse").otherwise("transcribe")
    return rows.withColumn("action", F.lit("transcribe") if force else action)


def migrate_disputes(now: DataFrame, legacy: DataFrame) -> DataFrame:
    """Rows of the earlier table of disputes that aren't known yet: manual transcriptions and resolved ones are resolved."""
    status = F.when(F.startswith("transcription", F.lit("[manual]")) | (F.coalesce("resolved", F.lit(0)) == 1), "resolved").otherwise("disputed")
    add = legacy.withColumn("status", status).join(now.select(*KEY), KEY, "left_anti").dropDuplicates(KEY)
    return now.unionByName(add.select(*[c for c in add.columns if c in now.columns]), allowMissingColumns=True)


def rehash(chunks: DataFrame) -> DataFrame:
    """What a change of the hash would rename: (old_hash, new_hash), where they differ."""
    from narrata.operators.chunks import chunk_hash

    return chunks.select(F.col("sentence_hash").alias("old_hash"), chunk_hash(F.col("sentence_text")).alias("new_hash")).where("old_hash <> new_hash").distinct()


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(by)))).where("_n = 1").drop("_n")
