"""Every query of the library, and the SQL that gives the same rows.

Queries over the driver's tables run over whole tables. Steps that those tables can't exercise (Russian text, table of contents, state)
run over inline rows that the SQL repeats; where SQL can't express a step, its rows carry the expected output.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import changes, clean, compare, russian, signal, splitting
from narrata.operators import checks, lexicon, review, state, steps
from narrata.operators import chunks as ch
from narrata.plans import fixtures as fx
from narrata.plans.base import ORACLES, QUERIES, literal, query, read
from narrata.sources import books, mappings, runs

# Chunking over documents -----------------------------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_REFS = r"regexp_replace({}, '\[\d+(\.\d+)?\]', '', 'g')"


def _sentences(text: str, least: int = 1) -> str:
    """SQL for (doc_id, pos, text) of documents with a text expression."""
    cut = f"string_split(regexp_replace({text}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))"
    parts = f"list_filter(list_transform({cut}, lambda x: {_STRIP.format('x')}), lambda x: length(x) >= {least})"
    return f"(SELECT doc_id, lang, source, unnest(range(0, len(p))) AS pos, unnest(p) AS text FROM (SELECT doc_id, lang, source, {parts} AS p FROM documents))"


def _chunks(spark: SparkSession, sf_dir: str, refs: bool = False) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = clean.remove_reference_numbers(F.concat("text", F.lit(" ["), F.col("doc_id").cast("string"), F.lit("]"))) if refs else F.col("text")
    rows = docs.select("doc_id", "lang", "source", F.posexplode(splitting.sentences(text, 3)).alias("pos", "text"))
    return rows.withColumn("sentence_hash", ch.chunk_hash(F.col("text")))


_MARKED = _REFS.format("text || ' [' || doc_id || ']'")


@query(f"""SELECT lang, count(*) AS n_chunks, count(DISTINCT left(sha256(text), 16)) AS n_distinct, CAST(sum(length(text)) AS BIGINT) AS n_chars,
round(1 - count(DISTINCT left(sha256(text), 16)) / count(*), 6) AS duplicate_share, round(ceil(sum(length(text)) / 1000) * 0.016, 6) AS cost FROM {_sentences(_MARKED, 3)} GROUP BY lang""")
def flagship_chunk_profile(spark, sf_dir):
    """References removed, sentences split and hashed, and what synthesis would cost, by language."""
    return ch.profile(_chunks(spark, sf_dir, refs=True), "lang").withColumn("cost", F.round(ch.cost(F.col("n_chars"), clean.PRICES["azure"]), 6))


@query(f"SELECT doc_id, {_MARKED} AS text FROM documents")
def remove_reference_numbers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", clean.remove_reference_numbers(F.concat("text", F.lit(" ["), F.col("doc_id").cast("string"), F.lit("]"))).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(text, '([\pL\pN_.,!?;:"'')])\d+', '\1', 'g') AS text FROM documents""")
def remove_endnotes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", clean.remove_endnotes(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(translate(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '«»“”„‟″‶‘’‚‛′‵‐‑‒–—―−⁃', '````````''''''''''''--------'), '…', '...'),
'[\x00-\x08\x0B-\x1F\x7F-\x9F]|\p{Cf}|\p{Co}', '', 'g'), '[^\n\t\x20-\x7E\pL\pN\x{301}]', ' ', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g') AS text FROM documents""")
def simple_symbols(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", clean.simple_symbols(F.col("text")).alias("text"))


def _mode(pattern: str, by: str, then: str = r"\s+") -> str:
    return f"regexp_replace(regexp_replace({_STRIP.format('text')}, '{pattern}', '{by}', 'g'), '{then}', ' ', 'g')"


@query(rf"""SELECT doc_id, {_mode(r'\n+', ' @BRK#')} AS single, {_mode(r'\n{2,}', ' @BRK#')} AS double, {_mode(r'\n+', ' ')} AS none, {_mode(r'\n+', '   ', ' +')} AS fb2 FROM documents""")
def newline_modes(spark, sf_dir):
    mode = lambda m, b=" @BRK#", c="all": clean.newline_mode(F.col("text"), m, b, c)
    return read(spark, sf_dir, "documents").select("doc_id", mode("single").alias("single"), mode("double").alias("double"), mode("none").alias("none"), mode("single", "   ", "spaces").alias("fb2"))


_TAGS = " ".join(rf"WHEN regexp_matches(html, '(?is)<{t}\b[^>]*>.*?</{t}\s*>') THEN regexp_extract(html, '(?is)<{t}\b[^>]*>(.*?)</{t}\s*>', 1)" for t in ("title", "h1", "h2", "h3"))
_TAG = f"regexp_replace(CASE {_TAGS} ELSE '' END, '(?s)<[^>]*>', '', 'g')"


@query(rf"""SELECT page_id, CASE WHEN {_STRIP.format('t')} = '' OR regexp_matches(t, '^[0-9]{{1,3}}$') THEN substr(html, 1, 60) ELSE t END AS auto_title, CASE WHEN {_STRIP.format('t')} = '' THEN '<blank>' ELSE t END AS tag_title,
substr(html, 1, 60) AS first_few, regexp_replace({_STRIP.format("regexp_replace(t, '[^\\pL\\pN_\\s]', '', 'g')")}, '\s+', '_', 'g') AS sanitized FROM (SELECT page_id, html, {_TAG} AS t FROM pages)""")
def title_modes_pages(spark, sf_dir):
    tag = clean.html_tag_title(F.col("html"))
    mode = lambda m: clean.document_title(tag, F.col("html"), m)
    return read(spark, sf_dir, "pages").select("page_id", mode("auto").alias("auto_title"), mode("tag_text").alias("tag_title"), mode("first_few").alias("first_few"), clean.sanitize_title(tag).alias("sanitized"))


_BARE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"
_PAGE = rf"regexp_replace(regexp_replace({_STRIP.format(_BARE)}, '\n+', ' @BRK#', 'g'), '\s+', ' ', 'g')"


@query(rf"""SELECT page_id, regexp_replace({_STRIP.format("regexp_replace(replace(CASE WHEN " + _STRIP.format("tag") + " = '' OR regexp_matches(tag, '^[0-9]{1,3}$') THEN substr(text, 1, 60) ELSE tag END, ' @BRK#', ' '), '[^" + chr(92) + "pL" + chr(92) + "pN_" + chr(92) + "s]', '', 'g')")}, '\s+', '_', 'g') AS title, text
FROM (SELECT page_id, {_TAG} AS tag, {_PAGE} AS text FROM pages)""")
def page_chapters(spark, sf_dir):
    return books.page_chapters(read(spark, sf_dir, "pages"))


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, text FROM {_sentences('text')}")
def sentence_split(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(splitting.sentences(F.col("text"))).alias("pos", "text"))


@query(f"SELECT left(sha256(text), 16) AS sentence_hash, min(text) AS text, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM {_sentences('text', 3)} GROUP BY 1")
def chunk_hash_dedup(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("sentence_hash").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("SELECT doc_id, CAST(n AS INTEGER) AS number FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE source = 'src3' AND length(trim(text)) > 0) WHERE n BETWEEN 3 AND 7")
def chapter_range_filter(spark, sf_dir):
    book = read(spark, sf_dir, "documents").where("source = 'src3'")
    return runs.select_chapters(book, 3, 7, index="doc_id").select("doc_id", "number")


@query("SELECT lang, CAST(sum(length(text)) AS BIGINT) AS n_chars, round(ceil(sum(length(text)) / 1000) * 0.016, 6) AS azure, round(ceil(sum(length(text)) / 1000) * 0.015, 6) AS openai, round(ceil(sum(length(text)) / 1000) * 0.0112, 6) AS qwen, 0.0 * count(*) AS edge FROM documents GROUP BY lang")
def cost_estimate(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("n_chars"))
    price = lambda b: F.round(ch.cost(F.col("n_chars"), clean.PRICES[b]), 6)
    return rows.select("lang", "n_chars", price("azure").alias("azure"), price("openai:tts-1").alias("openai"), price("qwen").alias("qwen"), (price("edge")).alias("edge"))


_WINDOW = "PARTITION BY doc_id ORDER BY pos ROWS BETWEEN"


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, coalesce(string_agg(text, ' ') OVER ({_WINDOW} 2 PRECEDING AND 1 PRECEDING), '') AS context_before, coalesce(string_agg(text, ' ') OVER ({_WINDOW} 1 FOLLOWING AND 2 FOLLOWING), '') AS context_after FROM {_sentences('text', 3)}")
def context_window_pm2(spark, sf_dir):
    rows = _chunks(spark, sf_dir).select("doc_id", F.col("pos"), "text")
    # positions follow the filter for short parts
    return ch.neighbours(rows, key="doc_id").select("doc_id", "pos", "context_before", "context_after")


@query("SELECT source, doc_id, CAST(sum(n_chars * 60) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars * 60 AS BIGINT) AS start_ms, CAST(sum(n_chars * 60) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_ms FROM documents")
def running_offsets(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("chapter_idx"), (F.col("n_chars") * 60).alias("duration_ms"), F.lit("t").alias("title"))
    return review.packing_marks(rows, "source").select("source", F.col("chapter_idx").alias("doc_id"), "start_ms", "end_ms")


@query(r"""SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY i) AS text FROM (SELECT doc_id, i, line, lag(trim(line, E' \t\n\r\f\v')) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM
(SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g'), '\n\s*\n+'), lambda x: length(trim(x, E' \t\n\r\f\v')) > 0) AS l FROM documents)))
WHERE before IS NULL OR trim(line, E' \t\n\r\f\v') <> before GROUP BY doc_id""")
def adjacent_paragraph_dedupe(spark, sf_dir):
    paragraphs = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return read(spark, sf_dir, "documents").select("doc_id", changes.collapse_repeated_paragraphs(clean.strip(paragraphs)).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(replace(text, '+', ''))), '[^\pL\pN_ ]|[0-9_]', ' ', 'g'), '\s+', ' ', 'g')) AS form FROM documents")
def compare_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", compare.comparison_form(F.col("text")).alias("form"))


@query(r"""SELECT CAST(step_index AS INTEGER) AS step_index, step_name, count(*) AS n_chapters, count(*) FILTER (a <> b) AS n_changed, CAST(sum(length(b) - length(a)) AS BIGINT) AS d_chars FROM (
SELECT doc_id, 0 AS step_index, 'remove_reference_numbers' AS step_name, text AS a, regexp_replace(text, '\[\d+(\.\d+)?\]', '', 'g') AS b FROM documents UNION ALL
SELECT doc_id, 1, 'remove_endnotes', regexp_replace(text, '\[\d+(\.\d+)?\]', '', 'g'), regexp_replace(regexp_replace(text, '\[\d+(\.\d+)?\]', '', 'g'), '([\pL\pN_.,!?;:"'')])\d+', '\1', 'g') FROM documents) GROUP BY 1, 2""")
def pipeline_trace_summary(spark, sf_dir):
    return steps.trace_summary(steps.trace(read(spark, sf_dir, "documents"), "remove_reference_numbers, remove_endnotes", key="doc_id"))


_SHA = "left(sha256(text), 16)"


@query(f"SELECT DISTINCT doc_id, {_SHA} AS sentence_hash FROM {_sentences('text', 3)} WHERE regexp_matches(text, '[\\pL\\pN]') AND {_SHA} >= 'c'")
def resume_anti_join(spark, sf_dir):
    rows = _chunks(spark, sf_dir).withColumnRenamed("doc_id", "chapter_key")
    audio = rows.where("sentence_hash < 'c'").select("chapter_key", "sentence_hash").distinct()
    return ch.to_synthesize(rows, audio).select(F.col("chapter_key").alias("doc_id"), "sentence_hash")


@query(f"SELECT doc_id, CASE WHEN count(*) FILTER (h < '8') = 0 THEN 'none' WHEN count(*) FILTER (h < '8') = count(*) THEN 'synthesized' ELSE 'partial' END AS audio_status, count(*) AS sentence_count FROM (SELECT doc_id, {_SHA} AS h FROM {_sentences('text', 3)}) GROUP BY doc_id UNION ALL SELECT doc_id, 'none', 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {_sentences('text', 3)})")
def audio_status(spark, sf_dir):
    rows = _chunks(spark, sf_dir).withColumnRenamed("doc_id", "chapter_key")
    audio = rows.where("sentence_hash < '8'").select("chapter_key", "sentence_hash").distinct()
    run = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_key"), F.col("doc_id").alias("chapter_idx"), F.lit("t").alias("title"))
    return review.chapters(run, rows, audio).select(F.col("chapter_key").alias("doc_id"), "audio_status", "sentence_count")


@query("SELECT CAST(user_id AS VARCHAR) AS sentence_hash, count(*) AS auto_retry_count FROM events WHERE event_type = 'error' GROUP BY 1")
def retry_count(spark, sf_dir):
    return state.retry_counts(read(spark, sf_dir, "events").where("event_type = 'error'").withColumn("sentence_hash", F.col("user_id").cast("string")))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def attempts_by_window(spark, sf_dir):
    from narrata.streaming.worker import attempts_by_window as windowed

    return windowed(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(r"""SELECT w.word AS surface_form, count(*) AS n, any_value(e.n_entries) AS n_entries FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents) w
JOIN (SELECT surface_form, count(*) AS n_entries FROM """ + fx.LEXICON.sql() + """ GROUP BY 1) e ON e.surface_form = w.word GROUP BY 1""")
def lexicon_join(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("word"))
    counted = words.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    found = lexicon.lookup(counted, fx.LEXICON.df(spark))
    return found.groupBy("surface_form").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("n_entries"))


_HEARD = r"regexp_replace(text, '\s+\S+$', '')"
_COMPARED = r"trim(regexp_replace(regexp_replace(strip_accents(lower(replace({}, '+', ''))), '[^\pL\pN_ ]|[0-9_]', ' ', 'g'), '\s+', ' ', 'g'))"


# a transcription that starts its text is one matching block
@query(f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, r AS similarity_orth, r AS similarity_phon FROM (SELECT doc_id, pos, CASE WHEN o = t THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * length(t) / (length(o) + length(t)), 6) END AS r FROM
(SELECT doc_id, pos, {_COMPARED.format('text')} AS o, {_COMPARED.format(_HEARD)} AS t FROM {_sentences('text', 3)}))""")
def similarity_ratio(spark, sf_dir):
    """Likeness of each chunk to itself without its last word; other pairs are held against the standard library in tests."""
    rows = _chunks(spark, sf_dir).select("doc_id", "pos", F.col("text").alias("original_text"), F.regexp_replace("text", r"\s+\S+$", "").alias("transcription"))
    return checks.similarities(rows).select("doc_id", "pos", F.round("similarity_orth", 6).alias("similarity_orth"), F.round("similarity_phon", 6).alias("similarity_phon"))


@query(f"SELECT doc_id, count(*) AS n_checked, count(*) FILTER (contains(lower(text), 'the')) AS n_disputed FROM {_sentences('text', 3)} GROUP BY doc_id")
def checker_artifacts(spark, sf_dir):
    rows = checks.check(_chunks(spark, sf_dir).withColumn("transcription", F.col("text")), ["transcription_artifacts"], artifacts="the, ")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_checked"), F.count_if("disputed").alias("n_disputed"))


_FORM = r"trim(regexp_replace(regexp_replace(strip_accents(lower(replace({}, '+', ''))), '[^\pL\pN_ ]|[0-9_]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, count(*) AS n, count(*) FILTER (f <> '' AND t <> '' AND NOT starts_with(t, split_part(f, ' ', 1))) AS n_first, count(*) FILTER (f <> '' AND t <> '' AND NOT suffix(t, split_part(f, ' ', -1))) AS n_last FROM (SELECT doc_id, {_FORM.format('text')} AS f, {_FORM.format('reverse(text)')} AS t FROM {_sentences('text', 3)}) GROUP BY doc_id")
def checker_first_last_word(spark, sf_dir):
    """Each chunk against its reversed text: Latin words only match as text."""
    rows = _chunks(spark, sf_dir).withColumn("o_form", compare.comparison_form(F.col("text"))).withColumn("t_form", compare.comparison_form(F.reverse("text")))
    word = lambda i: F.substring_index("o_form", " ", i)
    full = (F.col("o_form") != "") & (F.col("t_form") != "")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(full & ~compare.starts_with_word(word(1), F.col("t_form"))).alias("n_first"), F.count_if(full & ~compare.ends_with_word(word(-1), F.col("t_form"))).alias("n_last"))


_UNSPACED = _STRIP.format("left(rest, edge)")
_EDGE = "coalesce(" + ", ".join(f"CASE WHEN contains(left(rest, 400), '{c}') THEN 400 - length(split_part(left(rest, 400), '{c}', -1)) END" for c in splitting.CUTS) + ", 400)"
_WHOLE = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: length(x) >= 1)"


# sentences, the pieces of those over 400 characters, and the fold that joins what fits ("J" may join what is before it, "B" may not)
@query(f"""WITH RECURSIVE s AS (SELECT doc_id, unnest(range(0, len(p))) AS i, unnest(p) AS t FROM (SELECT doc_id, {_WHOLE} AS p FROM documents)),
c AS (SELECT doc_id, i, 0 AS k, '' AS piece, t AS rest FROM s WHERE length(t) > 400 UNION ALL SELECT doc_id, i, k + 1, {_UNSPACED}, substr(rest, edge + 1) FROM (SELECT *, {_EDGE} AS edge FROM c WHERE length(rest) > 400)),
tokens AS (SELECT doc_id, i, 0 AS k, 'J' || t AS x FROM s WHERE length(t) <= 400 UNION ALL SELECT doc_id, i, k, 'B' || piece FROM c WHERE k > 0 UNION ALL SELECT doc_id, i, k + 1, 'B' || rest FROM c WHERE length(rest) BETWEEN 1 AND 400),
units AS (SELECT doc_id, list_filter(list_transform(string_split(list_reduce(list(x ORDER BY i, k), lambda acc, x: CASE WHEN starts_with(x, 'J') AND length(split_part(acc, chr(2), -1)) + length(x) <= 400 + CASE WHEN contains(acc, chr(2)) THEN 0 ELSE 1 END THEN acc || ' ' || substr(x, 2) ELSE acc || chr(2) || substr(x, 2) END), chr(2)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS u FROM tokens GROUP BY doc_id)
SELECT doc_id, CAST(unnest(range(0, len(u))) AS INTEGER) AS pos, CASE WHEN unnest(range(0, len(u))) = 0 THEN substr(unnest(u), 2) ELSE unnest(u) END AS text FROM units""")
def split_text_size(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(splitting.sized_chunks(F.col("text"), 400)).alias("pos", "text"))


@query()
def safe_split_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", splitting.safely_split(F.col("text"), 180).alias("text"))


_SAID = f"list_filter(list_transform(string_split(regexp_replace(CASE WHEN role = 'user' THEN '«' || replace(replace(text, '«', ''), '»', '') || '».' ELSE text END, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: length(x) >= 3)"


@query(f"SELECT conv_id, turn, role, CAST(unnest(range(0, len(s))) AS INTEGER) AS pos, unnest(s) AS text, CASE WHEN role = 'user' THEN 'second' END AS voice FROM (SELECT conv_id, turn, role, {_SAID} AS s FROM conversations)")
def voiced_split(spark, sf_dir):
    """Turns of conversations; what users say is quoted and so has the second voice."""
    quoted = F.when(F.col("role") == "user", F.concat(F.lit("«"), F.replace(F.replace("text", F.lit("«"), F.lit("")), F.lit("»"), F.lit("")), F.lit("»."))).otherwise(F.col("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", quoted.alias("text"))
    return rows.select("conv_id", "turn", "role", F.posexplode(splitting.voiced_chunks(F.col("text"), "second")).alias("pos", "c")).select("conv_id", "turn", "role", "pos", "c.text", "c.voice")


@query()
def change_blocks(spark, sf_dir):
    """What the symbol and endnote steps change in each document."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"), clean.remove_endnotes(clean.simple_symbols(F.col("text"))).alias("b")).where("a <> b")
    return rows.select("doc_id", F.explode(changes.change_blocks("a", "b")).alias("c")).select("doc_id", "c.*")


# Literal pairs ---------------------------------------------------------------------------------------------


def _step(name: str, **conf) -> Callable:
    return lambda rows: steps.chain(F.col("input"), name, F.lit("ru-RU"), steps.Conf(**conf))


literal("initials_ru", fx.INITIALS, _step("ru_initials"))
literal("abbreviations_ru", fx.ABBREVIATIONS, lambda rows: russian.abbreviations(F.col("input")))
literal("acronyms_ru", fx.ACRONYMS, lambda rows: russian.acronyms(F.col("input")))
literal("time_ru", fx.CLOCK, _step("ru_time"))
literal("roman_ru", fx.ROMAN, _step("ru_roman_numerals"))
literal("numbers_ru", fx.NUMBERS, _step("ru_numbers"))
literal("safe_split", fx.SAFE_SPLIT, _step("tts_safe_split", safe_max_chars=60))
literal("cosy_voice", fx.COSY, _step("cosy_voice"))
literal("paradox_words", fx.PARADOX, _step("ru_proper_names", paradox_words=("бо́льшая", "замок")))
literal("hard_consonants", fx.HARD, _step("tts_hard_consonants", word_overrides=(("кофе-брейк", "кофе-брэйк"),)))
literal("plus_stress", fx.STRESS, lambda rows: clean.plus_to_stress(F.col("input")))
literal("chunk_mark_tidy", fx.MARKS, lambda rows: clean.tidy_chunk_marks(F.col("input")))
literal("chunk_mark_forced", fx.FORCED, lambda rows: clean.ensure_chunk_mark(F.col("input")))
literal("symbols_inline", fx.SYMBOLS, lambda rows: clean.simple_symbols(F.col("input")))
literal("tempo_filter", fx.TEMPO, lambda rows: clean.tempo_filter(F.col("input")))
literal("metadata_escape", fx.ESCAPES, lambda rows: clean.escape_metadata(F.col("input")))
literal("chapter_key", fx.KEYS, lambda rows: clean.chapter_key(F.col("input"), F.col("id")))
literal("delete_sentence", fx.DELETES, lambda rows: clean.delete_sentence(F.col("input"), F.col("sentence")))
literal("review_edit", fx.EDITS, lambda rows: changes.apply_edit(F.col("input"), F.col("old"), F.col("new")))
literal("similarity_inline", fx.SIMILAR, lambda rows: F.round(compare.similarity("a", "b"), 6))
literal("artifacts_inline", fx.ARTIFACTS, lambda rows: checks.artifacts(F.col("heard"), "субтитры, продолжение"), "ok")
literal("freshness_filter", fx.FRESH, lambda rows: state.fresh(F.col("checked_at"), F.col("mtime")), "fresh")


@query(f"SELECT id, first_ok, last_ok FROM {fx.BOUNDARY.sql()}")
def boundary_words(spark, sf_dir):
    rows = fx.BOUNDARY.df(spark).withColumn("o_form", compare.comparison_form(F.col("original"))).withColumn("t_form", compare.comparison_form(F.col("heard")))
    return rows.select("id", checks.first_word().alias("first_ok"), checks.last_word().alias("last_ok"))


@query("SELECT * FROM (VALUES (1, 'a' || chr(10) || '@BRK#b', 'a' || chr(10) || ' <break time=''1250ms'' /> b', 2, 'Tail'), (2, '@BRK# ... @BRK#<x>', ' <break time=''1250ms'' />  ...  <break time=''1250ms'' /> &lt;x&gt;', 1, 'Tail')) t(id, input, ssml, n_parts, stripped)")
def synthesis_text(spark, sf_dir):
    rows = spark.createDataFrame([(1, "a\n@BRK#b"), (2, "@BRK# ... @BRK#<x>")], "id int, input string")
    return rows.select("id", "input", clean.ssml(F.col("input")).alias("ssml"), F.size(clean.break_parts(F.col("input"))).alias("n_parts"), clean.strip_trailing(F.lit("Tail...")).alias("stripped"))


# Lexicon and mapping files ---------------------------------------------------------------------------------


@query(f"SELECT surface_form, array_to_string(list_sort(list(DISTINCT spoken_form)), '|') AS spoken_forms FROM {fx.LEXICON.sql()} GROUP BY 1 HAVING count(DISTINCT spoken_form) >= 2")
def lexicon_ambiguous(spark, sf_dir):
    return lexicon.ambiguous(fx.LEXICON.df(spark)).withColumn("spoken_forms", F.array_join("spoken_forms", "|"))


@query(f"SELECT count(*) AS n_entries, (SELECT count(*) FROM (SELECT surface_form FROM {fx.LEXICON.sql()} GROUP BY 1 HAVING count(DISTINCT spoken_form) > 1)) AS n_ambiguous, count(*) FILTER (is_proper_name) AS n_proper FROM {fx.LEXICON.sql()}")
def lexicon_stats(spark, sf_dir):
    return lexicon.stats(fx.LEXICON.df(spark))


@query(f"SELECT source, count(*) AS n_entries FROM {fx.LEXICON.sql()} GROUP BY 1")
def lexicon_sources(spark, sf_dir):
    return lexicon.per_source(fx.LEXICON.df(spark))


@query(f"SELECT surface_form, source, confidence FROM {fx.LEXICON.sql()} WHERE source <> 'other' UNION ALL SELECT 'the', 'other', 0.9 UNION ALL SELECT 'new', 'other', NULL")
def lexicon_replace_source(spark, sf_dir):
    new = spark.createDataFrame([("the", "the", None, None, None, False, 0.1), ("the", "the", None, None, None, False, 0.9), ("new", "new", None, None, None, False, None)], "surface_form string, spoken_form string, lemma string, pos string, grammemes string, is_proper_name boolean, confidence double")
    return lexicon.replace_source(fx.LEXICON.df(spark), "other", new).select("surface_form", "source", "confidence")


@query("SELECT * FROM (VALUES ('замок', 'за́мок', 'NOUN m1a'), ('замок', 'замо́к', 'NOUN m3b'), ('мука', 'му́ка', 'NOUN'), ('мука', 'мука́', 'NOUN'), ('москва', 'москва́', 'NOUN'), ('the', 'the', 'ART'), ('the', 'thee', 'ART'), ('and', 'and', 'CONJ'), ('que', 'que', 'CONJ')) t(surface_form, spoken_form, labels)")
def grammeme_labels(spark, sf_dir):
    return lexicon.grammeme_labels(fx.LEXICON.df(spark)).withColumn("labels", F.array_join("labels", "|"))


@query("SELECT * FROM (VALUES ('c1', 'замок', 2, 2), ('c1', 'мука', 1, 2)) t(chapter_key, surface_form, n, n_forms)")
def stress_candidates(spark, sf_dir):
    texts = spark.createDataFrame([("c1", "Замок и замок, мука; Москва и за́мок. Дом.")], "chapter_key string, text string")
    return lexicon.stress_candidates(texts, fx.LEXICON.df(spark)).select("chapter_key", "surface_form", F.col("n").cast("int").alias("n"), F.size("spoken_forms").alias("n_forms"))


@query("SELECT * FROM (VALUES ('тест', 'тЭст'), ('кафе', 'кафэ'), ('модель', 'модЭль')) t(surface_form, tts_form)")
def override_form(spark, sf_dir):
    return lexicon.override_form(fx.OVERRIDES.df(spark), ["own", "espeak"])


@query("SELECT * FROM (VALUES ('a', 'z'), ('c', 'd==e'), ('w', 'з+амок|зам+ок')) t(source, target)")
def mapping_file(spark, sf_dir):
    return mappings.mapping(fx.LINES.df(spark))


@query("SELECT 'w' AS source, 'за́мок|замо́к' AS variants")
def choice_mapping_file(spark, sf_dir):
    return mappings.choice_mapping(fx.LINES.df(spark).where("line_no = 6")).withColumn("variants", F.array_join("variants", "|"))


@query("SELECT * FROM (VALUES ('замок', 'за́мок', 'NOUN', '3*a'), ('замок', 'замо́к', 'NOUN', '3*b'), ('бежать', 'бежа́ть', 'VERB', '5b'), ('автобус', 'авто́бус', 'NOUN', '1a')) t(surface_form, spoken_form, pos, grammemes)")
def grammar_dictionary(spark, sf_dir):
    return mappings.grammar_entries(fx.GRAMMAR.df(spark)).select("surface_form", "spoken_form", "pos", "grammemes")


@query("SELECT * FROM (VALUES ('тест', 'тэст'), ('кафе', 'кафэ')) t(surface_form, tts_form)")
def phoneme_overrides(spark, sf_dir):
    return mappings.hard_consonant_overrides(fx.PHONEMES.df(spark)).select("surface_form", "tts_form")


# Books and runs --------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('b1', 0, 'Part_Two', 'Text 2 @BRK# @BRK#Text 3'), ('b1', 1, 'Part_Four', 'Text 4'), ('b2', 0, 'a', 'Text a')) t(book, chapter_idx, title, text)")
def toc_range_join(spark, sf_dir):
    entries = fx.TOC.df(spark).withColumn("hrefs", F.split("hrefs", r"\|"))
    return books.toc_chapters(fx.TOC_DOCS.df(spark), entries, " @BRK#")


def _books(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(pd.DataFrame({"path": ["x.EPUB", "y.fb2"], "content": [fx.epub(), fx.FB2]}), "path string, content binary")
    return rows.withColumn("format", books.book_format("path"))


@query("SELECT * FROM (VALUES ('x.EPUB', 0, 'b.xhtml', 'Beta', 'Beta!Beta @BRK#text.'), ('x.EPUB', 1, 'a.xhtml', '12Alpha_text', '12Alpha text.'), ('x.EPUB', 2, 'c.xhtml', 'Gamma', 'Gamma')) t(book, chapter_idx, href, title, text)")
def epub_chapters(spark, sf_dir):
    return books.document_chapters(books.epub_documents(_books(spark)), " @BRK#")


@query("SELECT * FROM (VALUES ('x.EPUB', 0, 'Start', 'b.xhtml#p'), ('x.EPUB', 1, 'End', 'c.xhtml')) t(book, entry_pos, title, href)")
def epub_contents(spark, sf_dir):
    return books.epub_entries(_books(spark)).select("book", "entry_pos", "title", F.get("hrefs", 0).alias("href"))


@query("SELECT * FROM (VALUES ('y.fb2', 0, 'One', 'First line.' || chr(10) || 'Second. @BRK#Third.'), ('y.fb2', 1, 'Two', 'Verse a' || chr(10) || 'Verse b'), ('y.fb2', 2, 'Untitled_text_here', 'Untitled text here.')) t(book, chapter_idx, title, text)")
def fb2_chapters(spark, sf_dir):
    return books.section_chapters(books.fb2_sections(_books(spark)), " @BRK#")


@query("SELECT * FROM (VALUES ('002', 1, '0001_First', 'First', 'One.'), ('002', 2, '0002_Second_Part', 'Second Part', 'Two.')) t(run_index, chapter_idx, chapter_key, title, text)")
def latest_run(spark, sf_dir):
    return runs.latest_run(fx.RUN.df(spark))


@query("SELECT '003' AS run_index")
def next_run(spark, sf_dir):
    return runs.next_run(fx.RUN.df(spark))


@query("SELECT doc_id, CASE doc_id WHEN 1 THEN 'First' WHEN 3 THEN 'Third' ELSE lang END AS title FROM documents")
def title_override_positional(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_idx"), F.col("lang").alias("title"))
    return runs.override_titles(rows, fx.TITLES.df(spark)).select(F.col("chapter_idx").alias("doc_id"), "title")


@query("SELECT * FROM (VALUES ('c1', 'h1', 'c1/h1.wav', 'wav'), ('c1', 'h2', 'c1/h2.ogg', 'ogg')) t(chapter_key, sentence_hash, path, ext)")
def best_audio(spark, sf_dir):
    return runs.best_audio(fx.AUDIO_FILES.df(spark)).select("chapter_key", "sentence_hash", "path", "ext")


# State and review ------------------------------------------------------------------------------------------


@query(f"""SELECT coalesce(a.chapter_key, b.chapter_key) AS chapter_key, coalesce(a.sentence_hash, b.sentence_hash) AS sentence_hash, coalesce(b.transcription, a.transcription) AS transcription, coalesce(b.similarity, a.similarity) AS similarity,
CASE WHEN a.status = 'resolved' THEN a.status ELSE coalesce(b.status, a.status) END AS status FROM {fx.CACHE.sql('a')} FULL JOIN {fx.CHECKED.sql('b')} ON a.chapter_key = b.chapter_key AND a.sentence_hash = b.sentence_hash""")
def sticky_upsert(spark, sf_dir):
    return state.sticky_merge(fx.CACHE.df(spark), fx.CHECKED.df(spark)).select("chapter_key", "sentence_hash", "transcription", "similarity", "status")


@query(f"SELECT chapter_key, sentence_hash, CASE WHEN sentence_hash = 'h3' THEN 'disputed' ELSE status END AS status FROM {fx.CACHE.sql()}")
def reopen_deleted(spark, sf_dir):
    return state.reopen(fx.CACHE.df(spark), fx.CACHE.df(spark).where("sentence_hash = 'h3'")).select("chapter_key", "sentence_hash", "status")


@query(f"SELECT row_number() OVER (ORDER BY chapter_key, similarity NULLS FIRST, sentence_hash) AS place, chapter_key, sentence_hash FROM {fx.CACHE.sql()} WHERE status = 'disputed'")
def failed_chunks_order(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = review.failed(fx.CACHE.df(spark))
    return rows.select(F.row_number().over(W.partitionBy().orderBy("chapter_key", F.asc_nulls_first("similarity"), "sentence_hash")).cast("long").alias("place"), "chapter_key", "sentence_hash")


@query(f"""SELECT c.chapter_key, c.sentence_hash, c.similarity, bool_and(r.passed) FILTER (r.checker = 'first_word') AS checker_first_word_passed, bool_and(r.passed) FILTER (r.checker = 'last_word') AS checker_last_word_passed
FROM {fx.CACHE.sql('c')} LEFT JOIN {fx.RESULTS.sql('r')} ON r.chapter_key = c.chapter_key AND r.sentence_hash = c.sentence_hash WHERE c.status = 'disputed' GROUP BY 1, 2, 3""")
def disputed_rollup(spark, sf_dir):
    return review.disputed(fx.CACHE.df(spark), fx.RESULTS.df(spark), ["first_word", "last_word"]).select("chapter_key", "sentence_hash", "similarity", "checker_first_word_passed", "checker_last_word_passed")


@query("SELECT * FROM (VALUES ('c1', 'h1', true, 0.9::DOUBLE, NULL::DOUBLE, 0.9::DOUBLE), ('c1', 'h2', false, 0.7, 0.3, 0.7)) t(chapter_key, sentence_hash, disputed, similarity, reference_check_score, similarity_or_one)")
def combine_checkers(spark, sf_dir):
    return checks.combine(fx.LONG.df(spark))


@query(f"""SELECT c.chapter_key, c.sentence_hash, k.checker, CASE k.checker WHEN 'whisper_similarity' THEN similarity >= 0.7 WHEN 'reference' THEN CASE WHEN reference_check_status IN ('ok', 'measured') THEN true WHEN reference_check_status = 'suspicious' THEN false END ELSE r.passed END AS passed,
CASE k.checker WHEN 'whisper_similarity' THEN similarity WHEN 'reference' THEN reference_check_score END AS score FROM {fx.CACHE.sql('c')} CROSS JOIN (VALUES ('whisper_similarity'), ('first_word'), ('reference')) k(checker)
LEFT JOIN {fx.RESULTS.sql('r')} ON r.chapter_key = c.chapter_key AND r.sentence_hash = c.sentence_hash AND r.checker = k.checker""")
def check_details(spark, sf_dir):
    return review.check_details(fx.CACHE.df(spark), fx.RESULTS.df(spark), ["whisper_similarity", "first_word", "reference"])


@query("SELECT * FROM (VALUES ('c1', 'h1', 'unchanged', 1.0::DOUBLE), ('c1', 'h2', 'updated', 1.0), ('c1', 'h3', 'skipped', NULL), ('c2', 'h1', 'unchanged', 0.2), ('c2', 'h4', 'skipped', NULL)) t(chapter_key, sentence_hash, action, new_similarity)")
def recalculate_similarity(spark, sf_dir):
    return checks.recalculate(fx.CACHE.df(spark)).select("chapter_key", "sentence_hash", "action", F.round("new_similarity", 6).alias("new_similarity"))


@query(f"SELECT v.sentence_hash, v.sentence_text, o.sentence_hash AS old_hash, o.sentence_text AS old_text FROM {fx.VERSIONS.sql('v')} JOIN {fx.VERSIONS.sql('o')} ON o.replaced_by_hash = v.sentence_hash")
def version_predecessors(spark, sf_dir):
    return state.predecessors(fx.VERSIONS.df(spark)).select("sentence_hash", "sentence_text", "old_hash", "old_text")


@query(f"WITH RECURSIVE v AS (SELECT * FROM {fx.VERSIONS.sql()}), c AS (SELECT sentence_hash AS start_hash, sentence_hash, replaced_by_hash, 0 AS depth FROM v UNION ALL SELECT c.start_hash, v.sentence_hash, v.replaced_by_hash, c.depth + 1 FROM c JOIN v ON v.sentence_hash = c.replaced_by_hash) SELECT start_hash, sentence_hash, depth FROM c")
def version_chain_recursive(spark, sf_dir):
    return state.version_chain(spark, fx.VERSIONS.df(spark))


@query(f"SELECT coalesce(a.sentence_hash, b.sentence_hash) AS sentence_hash, coalesce(a.sentence_text, b.sentence_text) AS sentence_text, coalesce(a.replaced_by_hash, b.replaced_by_hash) AS replaced_by_hash FROM {fx.VERSIONS.sql('a')} FULL JOIN {fx.NEW_VERSIONS.sql('b')} ON a.sentence_hash = b.sentence_hash")
def version_insert(spark, sf_dir):
    return state.add_versions(fx.VERSIONS.df(spark), fx.NEW_VERSIONS.df(spark)).select("sentence_hash", "sentence_text", "replaced_by_hash")


@query("SELECT 1::BIGINT AS n_new, 2::BIGINT AS n_existing")
def version_counts(spark, sf_dir):
    return state.version_counts(fx.VERSIONS.df(spark), fx.NEW_VERSIONS.df(spark))


@query(f"""SELECT c.chapter_key, c.pos, c.sentence_hash, a.path IS NOT NULL AS has_audio, coalesce(r.n, 0) AS auto_retry_count, a.duration_s, k.status AS check_status, k.similarity AS check_similarity FROM {fx.CHUNKS.sql('c')}
LEFT JOIN {fx.AUDIO.sql('a')} ON a.chapter_key = c.chapter_key AND a.sentence_hash = c.sentence_hash LEFT JOIN {fx.CACHE.sql('k')} ON k.chapter_key = c.chapter_key AND k.sentence_hash = c.sentence_hash
LEFT JOIN (SELECT sentence_hash, count(*) AS n FROM {fx.DELETIONS.sql()} GROUP BY 1) r ON r.sentence_hash = c.sentence_hash""")
def chunk_audio_left_join(spark, sf_dir):
    rows = review.chapter_chunks(fx.CHUNKS.df(spark), fx.AUDIO.df(spark), fx.CACHE.df(spark), fx.DELETIONS.df(spark))
    return rows.select("chapter_key", "pos", "sentence_hash", "has_audio", "auto_retry_count", "duration_s", "check_status", "check_similarity")


@query(f"SELECT c.chapter_key, round(coalesce(sum(a.duration_s), 0), 2) AS total_s FROM {fx.CHUNKS.sql('c')} LEFT JOIN {fx.AUDIO.sql('a')} ON a.chapter_key = c.chapter_key AND a.sentence_hash = c.sentence_hash GROUP BY 1")
def chapter_durations(spark, sf_dir):
    return review.durations(fx.CHUNKS.df(spark), fx.AUDIO.df(spark))


@query("SELECT * FROM (VALUES ('c1', 0, 'rebuild'), ('c2', 1, 'existing'), ('c3', 1, 'impossible')) t(chapter_key, missing, plan)")
def rebuild_plan(spark, sf_dir):
    return review.rebuild_plan(fx.CHUNKS.df(spark), fx.AUDIO.df(spark), fx.FILES.df(spark)).select("chapter_key", F.col("missing").cast("int").alias("missing"), "plan")


@query("SELECT * FROM (VALUES ('c1', 0, 1), ('c1', 1, -1), ('c2', 0, 1), ('c2', 1, -1), ('c3', 0, -1)) t(chapter_key, pos, next_pos)")
def next_disputed(spark, sf_dir):
    rows = review.chapter_chunks(fx.CHUNKS.df(spark), fx.AUDIO.df(spark), fx.CACHE.df(spark), fx.DELETIONS.df(spark))
    return review.next_disputed(rows).select("chapter_key", "pos", F.coalesce("next_pos", F.lit(-1)).alias("next_pos"))


@query("SELECT * FROM (VALUES ('c1', 'h1', 'reuse'), ('c1', 'h2', 'transcribe'), ('c2', 'h1', 'transcribe')) t(chapter_key, sentence_hash, action)")
def check_plan(spark, sf_dir):
    return state.to_check(fx.AUDIO.df(spark), fx.CACHE.df(spark)).select("chapter_key", "sentence_hash", "action")


@query("SELECT * FROM (VALUES ('c1', 0, 'reused'), ('c1', 1, 'to run'), ('c2', 0, 'reused'), ('c2', 0, 'to run')) t(chapter_key, step_index, what)")
def step_reuse(spark, sf_dir):
    done, todo = steps.reuse(fx.INPUTS.df(spark), fx.STEPS.df(spark))
    mark = lambda df, what: df.select("chapter_key", "step_index", F.lit(what).alias("what"))
    return mark(done, "reused").unionByName(mark(todo, "to run"))


@query("SELECT * FROM (VALUES ('c1', 'one' || chr(10) || chr(10) || 'two'), ('c2', 'only')) t(chapter_key, text)")
def merge_units(spark, sf_dir):
    return steps.merge_units(fx.UNITS.df(spark))


@query("SELECT * FROM (VALUES ('i1', 'accented', NULL), ('i2', 'original', NULL), ('i3', NULL, 'custom')) t(item_id, option_id, custom_text)")
def choice_defaults(spark, sf_dir):
    return steps.choose(fx.ITEMS.df(spark), fx.SELECTIONS.df(spark)).select("item_id", "option_id", "custom_text")


@query("SELECT * FROM (VALUES ('ctx b', 1, 2), ('ctx a', 2, 1)) t(context, place, n)")
def context_groups(spark, sf_dir):
    return steps.by_context(fx.ITEMS.df(spark)).select("context", "place", F.size("items").alias("n"))


@query("SELECT 'aXcYe' AS spliced, 'b@1-2 d@3-4' AS found")
def candidate_splice(spark, sf_dir):
    rows = spark.createDataFrame([("abcde",)], "t string").withColumn("c", steps.candidates(F.col("t"), "[bd]"))
    spans = F.transform("c", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["source_text"] == "b", "X").otherwise("Y").alias("by")))
    found = F.array_join(F.transform("c", lambda s: F.concat(s["source_text"], F.lit("@"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), " ")
    return rows.select(steps.splice(F.col("t"), F.reverse(spans)).alias("spliced"), found.alias("found"))


@query("SELECT 'c2' AS chapter_key, 'h9' AS sentence_hash")
def legacy_disputes(spark, sf_dir):
    legacy = spark.createDataFrame([("c1", "h2", "x", 0), ("c2", "h9", "[manual] y", 0)], "chapter_key string, sentence_hash string, transcription string, resolved int")
    now = fx.CACHE.df(spark)
    return state.migrate_disputes(now, legacy).join(now.select("chapter_key", "sentence_hash"), ["chapter_key", "sentence_hash"], "left_anti").where("status = 'resolved'").select("chapter_key", "sentence_hash")


# Sound -----------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (1, 0.5::DOUBLE), (2, 0.25), (3, NULL)) t(id, seconds)")
def wav_duration(spark, sf_dir):
    rows = spark.createDataFrame(pd.DataFrame({"id": [1, 2, 3], "content": [fx.wave(0.5), fx.wave(0.25, channels=2), b"no file"]}), "id int, content binary")
    return rows.select("id", signal.wave_seconds("content").alias("seconds"))


@query("SELECT * FROM (VALUES ('c1', 2, 0.72::DOUBLE), ('c2', 1, 0.25)) t(chapter_key, n_chunks, seconds)")
def chapter_merge(spark, sf_dir):
    """Two chunks of 0.5 and 0.25 s, crossed over 30 ms."""
    rows = spark.createDataFrame(pd.DataFrame({"chapter_key": ["c1", "c1", "c2"], "pos": [1, 0, 0], "content": [fx.wave(0.25), fx.wave(0.5), fx.wave(0.25)]}), "chapter_key string, pos int, content binary")
    return signal.merge_chapters(rows).select("chapter_key", F.col("n_chunks").cast("int").alias("n_chunks"), F.round("seconds", 6).alias("seconds"))


# Model steps and back ends ---------------------------------------------------------------------------------


@query("SELECT 'c1' AS chapter_key, 'proper_name_0001' AS item_id, 'Тест Кафе' AS source_text, 'В город пришёл Тест Кафе' AS context, 'original|phonetic' AS options")
def name_candidates(spark, sf_dir):
    from narrata.operators import models

    rows = spark.createDataFrame([("c1", "В город пришёл Тест Кафе. И он ушёл.")], "chapter_key string, text string")
    got = models.name_candidates(rows, {"тест": "тэст", "кафе": "кафэ"})
    return got.select("chapter_key", "item_id", "source_text", F.rtrim("context", F.lit(".")).alias("context"), F.array_join(F.transform("options", lambda o: o["option_id"]), "|").alias("options"))


@query("SELECT 'c1' AS chapter_key, 'Пришёл Тэст Кафэ и сел.' AS text")
def name_choices(spark, sf_dir):
    from narrata.operators import models

    rows = spark.createDataFrame([("c1", "Пришёл Тест Кафе и сел.")], "chapter_key string, text string")
    items = models.name_candidates(rows, {"тест": "тэст", "кафе": "кафэ"})
    return models.apply_choices(rows, items, items.select("chapter_key", "item_id", F.lit("phonetic").alias("option_id"), F.lit(None).cast("string").alias("custom_text"))).select("chapter_key", "text")


@query("SELECT * FROM (VALUES ('Старый замок и мука.', 1, 'Старый (1.1.за́мок|1.2.замо́к) и (2.1.му́ка|2.2.мука́).')) t(context, first_num, line)")
def stress_prompt(spark, sf_dir):
    from narrata.operators import models

    rows = [(1, "Старый замок и мука.", "замок", "за́мок|замо́к"), (2, "Старый замок и мука.", "мука", "му́ка|мука́")]
    items = spark.createDataFrame(rows, "num int, context string, source_text string, forms string")
    items = items.withColumn("options", F.transform(F.split("forms", r"\|"), lambda f, i: F.struct(F.concat(F.lit("variant_"), (i + 1).cast("string")).alias("option_id"), f.alias("text"))))
    return models.prompt_lines(items)


@query("SELECT * FROM (VALUES ('a', 'variant_2'), ('b', 'original')) t(item_id, option_id)")
def stress_answers(spark, sf_dir):
    from narrata.operators import models

    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "num int, item_id string").withColumn("options", F.array(*[F.struct(F.lit(f"variant_{i}").alias("option_id"), F.lit("x").alias("text")) for i in (1, 2)]))
    return models.selections(spark.createDataFrame([("1.2\nI choose 2.9 here",)], "response string"), items).select("item_id", "option_id")


@query("SELECT 'c1' AS chapter_key, 'Short. First half[chunk_eof] Second half. End.' AS text")
def long_sentence_stitch(spark, sf_dir):
    from narrata.operators import models

    rows = spark.createDataFrame([("c1", "Short. First half and then the second half. End.")], "chapter_key string, text string")
    asked = models.long_sentences(rows, 20)
    return models.stitch(rows, asked.select("chapter_key", "pos", F.array(F.lit("First half."), F.lit("Second half")).alias("parts"))).select("chapter_key", "text")


@query("SELECT * FROM (VALUES (1, 'Стоит за́мок.'), (2, 'Стоит замок.'), (3, 'Мука стоит.')) t(id, text)")
def homograph_stress(spark, sf_dir):
    from narrata.operators import models

    rows = spark.createDataFrame([(1, "Стоит замок.", "Сто+ит з+амок."), (2, "Стоит замок.", "Сто+ит."), (3, "Мука стоит.", "Мук+а сто+ит.")], "id int, t string, a string")
    return rows.select("id", models.stressed_homographs(F.col("t"), F.col("a"), ["замок"]).alias("text"))


@query("""SELECT 'Russian' AS language, '{"model":"m","voice":"v2"}' AS payload, 'b' AS found, 2 AS speakers""")
def backend_payload(spark, sf_dir):
    from narrata.functions import backends

    row = spark.createDataFrame([("ru-RU", '{"voice": "v2", "x": null}', '{"a": [{"k": "b"}]}', '{"A": "x", "B": "y"}')], "locale string, extra string, doc string, speakers string")
    fields = {"model": F.lit("m"), "voice": F.lit("v1"), "speed": F.lit(1.0), "instructions": F.lit(None)}
    return row.select(backends.language_name(F.lit(""), F.col("locale")).alias("language"), backends.payload(fields, "speed", F.col("extra")).alias("payload"), backends.json_path(F.col("doc"), "a.0.k").alias("found"), F.size(backends.speaker_map(F.col("speakers"))).alias("speakers"))

from narrata.plans import asking as _asking  # noqa: E402, F401  these register their queries
from narrata.plans import more as _more  # noqa: E402, F401
from narrata.plans import packing as _packing  # noqa: E402, F401
from narrata.plans import sound as _sound  # noqa: E402, F401
