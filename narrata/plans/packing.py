"""Queries of what external tools are given: file lists, tempo filters, chapter marks, tags and book copies."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from narrata import conf
from narrata.functions import tags
from narrata.operators import review
from narrata.plans import fixtures as fx
from narrata.plans.base import query, read


@query(f"""SELECT c.chapter_key, count(*) AS n_files, string_agg('file ' || chr(39) || a.path || chr(39), chr(10) ORDER BY c.pos) AS files FROM {fx.CHUNKS.sql('c')}
JOIN {fx.AUDIO.sql('a')} ON a.chapter_key = c.chapter_key AND a.sentence_hash = c.sentence_hash GROUP BY 1""")
def joined_file_lists(spark, sf_dir):
    return review.concat_lists(fx.CHUNKS.df(spark), fx.AUDIO.df(spark))


@query("SELECT * FROM (VALUES ('c1', 'h2', 'c1/h2.wav', 1.5::DOUBLE, 'atempo=1.500000')) t(chapter_key, sentence_hash, path, tempo, filter)")
def tempo_plans(spark, sf_dir):
    """Only the second voice is spoken at another speed."""
    tempos = spark.createDataFrame([("v2", 1.5), ("main", 1.0)], "voice string, tempo double")
    return review.tempo_plan(fx.CHUNKS.df(spark), fx.AUDIO.df(spark), tempos, "main")


_MARK = "'[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms || chr(10) || 'title=' || lang || chr(10)"


@query(f"""SELECT source AS book, ';FFMETADATA1' || chr(10) || 'title=' || source || chr(10) || 'artist=A' || chr(92) || ';B' || chr(10) || 'album=' || source || chr(10) || string_agg({_MARK}, '' ORDER BY start_ms, doc_id) AS metadata FROM
(SELECT source, doc_id, lang, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS BIGINT) AS start_ms, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS end_ms FROM documents) GROUP BY source""")
def packing_files(spark, sf_dir):
    """Documents of each source as chapters that last as many milliseconds as they have characters."""
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("chapter_idx"), F.col("n_chars").alias("duration_ms"), F.col("lang").alias("title"))
    named = rows.select("book").distinct().select("book", F.col("book").alias("title"), F.lit("A;B").alias("author"))
    return review.packing_file(review.packing_marks(rows), named)


# the head and its size, then frames: name, size, flags, encoding, text
@query("""SELECT * FROM (VALUES
(1, '494433040000' || '0000001c' || '54495432' || '00000006' || '0000' || '03' || 'c38974c3a9' || '5452434b' || '00000002' || '0000' || '03' || '37' || 'ffab', true),
(2, '494433040000' || '00000011' || '54495432' || '00000007' || '0000' || '03' || '61626364c3a9' || 'fffb', true)) t(id, tagged, whole)""")
def sound_tags(spark, sf_dir):
    """A tag of title and track in front of two bytes, and a tag that takes the place of an earlier one."""
    earlier = b"ID3\x04\x00\x00\x00\x00\x00\x03abc\xff\xfb"
    rows = spark.createDataFrame([(1, bytearray(b"\xff\xab"), "Été", 7), (2, bytearray(earlier), "abcdé", None)], "id int, sound binary, title string, track int")
    made = tags.tagged(F.col("sound"), {"title": F.col("title"), "track": F.col("track")})
    return rows.select("id", F.lower(F.hex(made)).alias("tagged"), (tags.untagged(made) == tags.untagged(F.col("sound"))).alias("whole"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, true)) t(turn, copied)")
def copied_books(spark, sf_dir):
    """A book is copied once, and again when it has changed."""
    with tempfile.TemporaryDirectory(prefix="narrata-") as folder:
        book, shelf = Path(folder, "a.epub"), Path(folder, "books")
        book.write_text("one")
        turns = [(i, conf.copied_book(book, shelf)[1]) for i in (1, 2)]
        book.write_text("longer")
        turns.append((3, conf.copied_book(book, shelf)[1]))
    return spark.createDataFrame(turns, "turn int, copied boolean")
