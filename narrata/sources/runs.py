"""Prepared chapters on disk: numbered runs of text files, title overrides and chapter audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrata.functions import clean

AUDIO_ORDER = ("wav", "mp3", "ogg", "m4a")
PACKAGE_ORDER = ("wav", "mp3", "ogg", "m4a", "aac", "opus", "flac")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_index, file_name, text) of ``path``/NNN/*.txt."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_index"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def latest_run(files: DataFrame) -> DataFrame:
    """Chapters of the last three-digit run: (run_index, chapter_idx, chapter_key, title, text)."""
    runs = files.where(F.regexp_like("run_index", F.lit("^[0-9]{3}$")))
    last = runs.agg(F.max("run_index").alias("last"))
    mine = runs.join(F.broadcast(last), F.col("run_index") == F.col("last")).drop("last")  # one row
    name = r"^([0-9]{4})_(.+)\.txt$"
    return mine.where(F.regexp_like("file_name", F.lit(name))).select(
        "run_index", F.regexp_extract("file_name", name, 1).cast("int").alias("chapter_idx"), F.regexp_replace("file_name", r"\.txt$", "").alias("chapter_key"),
        F.replace(F.regexp_extract("file_name", name, 2), F.lit("_"), F.lit(" ")).alias("title"), "text",
    )


def next_run(files: DataFrame) -> DataFrame:
    """The index that a new run gets: one after the last, 001 at first."""
    last = F.max(F.when(F.regexp_like("run_index", F.lit("^[0-9]{3}$")), F.col("run_index").cast("int")))
    return files.agg(F.lpad((F.coalesce(last, F.lit(0)) + 1).cast("string"), 3, "0").alias("run_index"))


def write_chapters(chapters: DataFrame, path: str) -> None:
    """The run as a table, partitioned so that the latest run is found by pruning."""
    chapters.write.mode("append").partitionBy("run_index").parquet(path)


def select_chapters(chapters: DataFrame, start: int = 1, end: int = -1, index: str = "chapter_idx") -> DataFrame:
    """Non-blank chapters from ``start`` to ``end`` (-1: the last), counted from 1."""
    kept = chapters.where(clean.has_content(F.col("text")))
    n = kept.count()
    if start < 1 or start > n:
        raise ValueError(f"start chapter {start} is not within 1 to {n}")
    if end < -1 or end == 0 or end > n:
        raise ValueError(f"end chapter {end} is not within 1 to {n}")
    if end != -1 and start > end:
        raise ValueError(f"start chapter {start} comes after end chapter {end}")
    place = F.row_number().over(W.partitionBy().orderBy(index))  # a book's chapters
    return kept.withColumn("number", place).where(F.col("number").between(start, n if end == -1 else end))


def override_titles(chapters: DataFrame, lines: DataFrame) -> DataFrame:
    """Line i, where it isn't blank, is the title of chapter i."""
    new = lines.select(F.col("line_no").alias("chapter_idx"), F.nullif(clean.strip(F.col("line")), F.lit("")).alias("override"))
    return chapters.join(new, "chapter_idx", "left").withColumn("title", F.coalesce("override", "title")).drop("override")


def extra_overrides(chapters: DataFrame, lines: DataFrame) -> DataFrame:
    return lines.join(chapters.select(F.col("chapter_idx").alias("line_no")), "line_no", "left_anti")


def prepared_text(wanted: DataFrame, chapters: DataFrame, detected: bool = True) -> DataFrame:
    """Wanted chapter keys with their prepared text. A missing one is an error, unless the folder was found by itself; a blank one always is."""
    rows = wanted.join(chapters.select("chapter_key", F.col("text").alias("prepared")), "chapter_key", "left")
    missing = F.lit(None).cast("string") if detected else F.raise_error(F.concat(F.lit("no prepared text for "), F.col("chapter_key")))
    blank = F.raise_error(F.concat(F.lit("blank prepared text for "), F.col("chapter_key")))
    return rows.withColumn("prepared", F.when(F.col("prepared").isNull(), missing).when(clean.has_content(F.col("prepared")), F.col("prepared")).otherwise(blank))


def list_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, chapter_key, stem, ext, mtime, size) of audio files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("chapter_key"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.substring_index(name, ".", -1)).alias("ext"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def extension_rank(ext: Column, order=AUDIO_ORDER) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), ext), F.lit(0))


def best_audio(files: DataFrame, order=AUDIO_ORDER) -> DataFrame:
    """One file for each (chapter_key, sentence_hash): the first extension in order; other extensions don't count."""
    rank = extension_rank(F.col("ext"), order)
    return files.withColumn("rank", rank).where("rank is not null").groupBy("chapter_key", F.col("stem").alias("sentence_hash")).agg(F.min_by(F.struct("path", "ext", "mtime"), "rank").alias("f")).select("chapter_key", "sentence_hash", "f.*")
