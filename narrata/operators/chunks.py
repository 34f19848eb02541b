"""Chapters to chunks: sentences with their place, voice and content hash, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrata.functions import clean, splitting
from narrata.functions.patterns import strip


def chunk_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the stripped text; neither voice nor model counts."""
    return F.substring(F.sha2(strip(text), 256), 1, 16)


def chunks(chapters: DataFrame, key: str = "chapter_key", text: str = "text", voice: str | None = None) -> DataFrame:
    """(key, pos, text, voice, sentence_hash), one row a chunk. Without a second voice no Python runs."""
    if voice:
        rows = chapters.select(key, F.posexplode(splitting.voiced_chunks(F.col(text), voice)).alias("pos", "c")).select(key, "pos", "c.text", "c.voice")
    else:
        rows = chapters.select(key, F.posexplode(splitting.plain_chunks(F.col(text))).alias("pos", "text")).withColumn("voice", F.lit(None).cast("string"))
    return rows.withColumn("sentence_hash", chunk_hash(F.col("text")))


def profile(chunks: DataFrame, by: str) -> DataFrame:
    """Chunks, distinct chunks, duplicate share and characters of each group."""
    return chunks.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("sentence_hash").alias("n_distinct"), F.sum(F.length("text")).alias("n_chars"),
    ).withColumn("duplicate_share", F.round(1 - F.col("n_distinct") / F.col("n_chunks"), 6))


def cost(chars: Column, price: float) -> Column:
    """Price of begun thousands of characters."""
    return F.ceil(chars / 1000) * F.lit(price)


def neighbours(chunks: DataFrame, key: str = "chapter_key", reach: int = 2) -> DataFrame:
    """Each chunk with the text of up to ``reach`` chunks on either side."""
    w = W.partitionBy(key).orderBy("pos")
    before = F.array_join(F.collect_list("text").over(w.rowsBetween(-reach, -1)), " ")
    after = F.array_join(F.collect_list("text").over(w.rowsBetween(1, reach)), " ")
    return chunks.withColumn("context_before", before).withColumn("context_after", after)


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """The stretch between the sentence marks or line ends around a span (offsets from 0)."""
    left = F.regexp_extract(F.substring(text, F.lit(1), start), r"([^.!?\n]*)$", 1)
    right = F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^([^.!?\n]*[.!?]?)", 1)
    return strip(F.concat(left, F.substring(text, start + 1, end - start), right))


def with_settings(chunks: DataFrame, voices: DataFrame, primary: str) -> DataFrame:
    """Chunks with the settings of their voice (voice, ...); no voice means the primary one."""
    rows = chunks.withColumn("voice", F.coalesce("voice", F.lit(primary)))
    return rows.join(voices, "voice", "left")


def to_synthesize(chunks: DataFrame, audio: DataFrame) -> DataFrame:
    """Distinct chunks of a chapter that have no file yet: the work is addressed by content."""
    wanted = chunks.where(clean.meaningful(F.col("text"))).dropDuplicates(["chapter_key", "sentence_hash"])
    return wanted.join(audio.select("chapter_key", "sentence_hash"), ["chapter_key", "sentence_hash"], "left_anti")
