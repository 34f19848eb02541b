"""Review queries over chapters, chunks, audio and state: one plan each instead of a lookup a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrata.operators import checks, state
from narrata.operators.state import KEY


def audio_status(found: Column, wanted: Column) -> Column:
    return F.when((wanted == 0) | (found == 0), "none").when(found == wanted, "synthesized").otherwise("partial")


def chapters(run: DataFrame, chunks: DataFrame, audio: DataFrame) -> DataFrame:
    """(chapter_idx, chapter_key, title, audio_status, sentence_count)."""
    have = chunks.join(audio.select(*KEY, F.lit(1).alias("have")), KEY, "left").groupBy("chapter_key").agg(F.count(F.lit(1)).alias("sentence_count"), F.count("have").alias("found"))
    rows = run.join(have, "chapter_key", "left").fillna(0, ["sentence_count", "found"])
    return rows.select("chapter_idx", "chapter_key", "title", audio_status(F.col("found"), F.col("sentence_count")).alias("audio_status"), "sentence_count")


def chapter_chunks(chunks: DataFrame, audio: DataFrame, cache: DataFrame, deletions: DataFrame) -> DataFrame:
    """Chunks with audio, check and retries; retries count for a text in whatever chapter."""
    rows = chunks.join(audio.select(*KEY, "duration_s", "mtime"), KEY, "left").join(cache.select(*KEY, F.col("status").alias("check_status"), F.col("similarity").alias("check_similarity")), KEY, "left")
    rows = rows.join(state.retry_counts(deletions), "sentence_hash", "left")
    return rows.select("chapter_key", "pos", "text", "sentence_hash", F.col("mtime").isNotNull().alias("has_audio"), "voice", F.coalesce("auto_retry_count", F.lit(0)).alias("auto_retry_count"), "duration_s", "mtime", "check_status", "check_similarity")


def durations(chunks: DataFrame, audio: DataFrame) -> DataFrame:
    rows = chunks.join(audio.select(*KEY, "duration_s"), KEY, "left")
    return rows.groupBy("chapter_key").agg(F.round(F.coalesce(F.sum("duration_s"), F.lit(0.0)), 2).alias("total_s"))


def disputed(cache: DataFrame, results: DataFrame | None = None, checkers=checks.DEFAULT) -> DataFrame:
    """Disputed chunks, least alike first (those without a likeness before all), with each checker's verdict."""
    rows = cache.where("status = 'disputed'")
    if results is not None:
        rows = rows.join(checks.pivot_results(results, checkers), KEY, "left")
    return rows.orderBy(F.asc_nulls_first("similarity"), *KEY)


def failed(cache: DataFrame, audio: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """Disputed chunks by chapter and likeness; with files only those that have one; with a threshold only those below it."""
    rows = cache.where("status = 'disputed'")
    if threshold is not None:
        rows = rows.where(F.coalesce(F.col("similarity") < threshold, F.lit(True)))
    if audio is not None:
        rows = rows.join(audio.select(*KEY, "path"), KEY)
    return rows.orderBy("chapter_key", F.asc_nulls_first("similarity"), "sentence_hash")


def next_disputed(chunks: DataFrame) -> DataFrame:
    """For each chunk the place of the next disputed one after it."""
    w = W.partitionBy("chapter_key").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    return chunks.withColumn("next_pos", F.min(F.when(F.col("check_status") == "disputed", F.col("pos"))).over(w))


def history(versions: DataFrame, sentence_hash: str) -> DataFrame:
    """What a text has replaced, newest first."""
    rows = versions.where(F.col("replaced_by_hash") == sentence_hash)
    return rows.select("sentence_hash", "sentence_text", "replaced_by_hash", "created_at").orderBy(F.desc("created_at"), "sentence_hash")


def check_details(cache: DataFrame, results: DataFrame, checkers: list[str], threshold: float = checks.THRESHOLD) -> DataFrame:
    """A verdict of every checker on every chunk, from what is stored; the list of checkers is small."""
    names = F.explode(F.array(*[F.lit(c) for c in checkers]))
    rows = cache.withColumn("checker", names).join(results.select(*KEY, "checker", "passed"), [*KEY, "checker"], "left")
    passed = checks.evaluate(F.col("checker"), F.col("similarity"), F.lit(threshold), F.col("reference_check_status"), F.col("passed"))
    score = F.when(F.col("checker") == "whisper_similarity", F.col("similarity")).when(F.col("checker") == "reference", F.col("reference_check_score"))
    return rows.select(*KEY, "checker", passed.alias("passed"), score.alias("score"))


def save_title(titles: Column, index: Column, title: Column) -> Column:
    """A list of title lines with line ``index`` (from 1) set; lines up to it are filled with empty ones."""
    padded = F.concat(titles, F.array_repeat(F.lit(""), F.greatest(index - F.size(titles), F.lit(0))))
    return F.transform(padded, lambda t, i: F.when(i == index - 1, title).otherwise(t))


def rebuild_plan(chunks: DataFrame, audio: DataFrame, files: DataFrame) -> DataFrame:
    """What becomes of each chapter's file (files: chapter_key, file_mtime): "current" if it is no older than any of its chunks, "rebuild" if all
    chunks are there, "existing" if some are missing but a file stands, else "impossible"."""
    have = chunks.dropDuplicates(KEY).join(audio.select(*KEY, "mtime"), KEY, "left").groupBy("chapter_key").agg(F.count_if(F.col("mtime").isNull()).alias("missing"), F.max("mtime").alias("newest"))
    rows = have.join(files.select("chapter_key", "file_mtime"), "chapter_key", "left")
    plan = F.when((F.col("missing") == 0) & (F.col("file_mtime") >= F.col("newest")), "current").when(F.col("missing") == 0, "rebuild").when(F.col("file_mtime").isNotNull(), "existing").otherwise("impossible")
    return rows.select("chapter_key", "missing", "newest", "file_mtime", plan.alias("plan"))


def packing_marks(chapters: DataFrame, book: str = "book") -> DataFrame:
    """Start and end of each chapter in the packed book, in ms, and its title in metadata form."""
    from narrata.functions.clean import escape_metadata

    w = W.partitionBy(book).orderBy("chapter_idx").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum("duration_ms").over(w)
    return chapters.select(book, "chapter_idx", (end - F.col("duration_ms")).alias("start_ms"), end.alias("end_ms"), escape_metadata(F.replace("title", F.lit("_"), F.lit(" "))).alias("title"))


def recover_from_files(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Without a prepared run: the texts of audio files by their hash."""
    return files.join(versions.select("sentence_hash", F.col("sentence_text").alias("text")), "sentence_hash")


def unknown_files(files: DataFrame, versions: DataFrame) -> DataFrame:
    return files.join(versions.select("sentence_hash"), "sentence_hash", "left_anti")


def concat_lists(chunks: DataFrame, audio: DataFrame) -> DataFrame:
    """(chapter_key, n_files, files) for a tool that joins files of other formats than WAV: a line for each chunk's file, in order; a quote in a path is escaped."""
    quoted = F.concat(F.lit("file '"), F.replace("path", F.lit("'"), F.lit("'\\''")), F.lit("'"))
    rows = chunks.join(audio.select(*KEY, "path"), KEY).select("chapter_key", "pos", quoted.alias("line"))
    return rows.groupBy("chapter_key").agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("files"))


def tempo_plan(chunks: DataFrame, audio: DataFrame, tempos: DataFrame, primary: str) -> DataFrame:
    """(chapter_key, sentence_hash, path, tempo, filter) of the files whose voice (voice, tempo) isn't spoken at its own speed, with the filter for a tool that changes it."""
    from narrata.functions.clean import tempo_filter

    rows = chunks.withColumn("voice", F.coalesce("voice", F.lit(primary))).join(tempos, "voice").join(audio.select(*KEY, "path"), KEY)
    return rows.withColumn("filter", tempo_filter(F.col("tempo"))).where("filter is not null").select(*KEY, "path", "tempo", "filter")


def packing_file(marks: DataFrame, books: DataFrame, book: str = "book") -> DataFrame:
    """(book, metadata): the text that a muxer reads for a packed book, from ``packing_marks`` and the books' (book, title, author). A book's chapters come together."""
    from narrata.functions.clean import escape_metadata

    lines = ["[CHAPTER]", "TIMEBASE=1/1000", F.concat(F.lit("START="), F.col("start_ms").cast("string")), F.concat(F.lit("END="), F.col("end_ms").cast("string")), F.concat(F.lit("title="), F.col("title"))]
    one = F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    parts = marks.groupBy(book).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "chapter_idx", one.alias("text")))), lambda x: x["text"]), "\n").alias("chapters"))
    title, author = escape_metadata(F.col("title")), escape_metadata(F.col("author"))
    head = [F.lit(";FFMETADATA1"), F.concat(F.lit("title="), title), F.concat(F.lit("artist="), author), F.concat(F.lit("album="), title)]
    return books.join(parts, book).select(book, F.concat(F.concat_ws("\n", *head, F.col("chapters")), F.lit("\n")).alias("metadata"))
