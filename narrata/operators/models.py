"""Steps that a model decides, without the model: what it is asked and how its answers go back into the text.

Each step plans rows to be asked (candidates in their context), a caller answers them in whatever way, and the answers are joined
back. Without answers every text stays as it is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import clean, russian, splitting
from narrata.functions.patterns import ACUTE, lookup, preserve_case, strip
from narrata.operators import steps
from narrata.operators.chunks import sentence_around

_W = rf"[А-ЯЁ][а-яё{ACUTE}]+(?:-[А-ЯЁ][а-яё{ACUTE}]+)*"
#: Names in the order in which they are looked for: two words or more, in quotes, after initials.
NAMES = (rf"{_W}(?:\s+{_W})+", rf"(?<=[«\"]){_W}(?=[»\"])", rf"(?<!\p{{L}})(?:[А-ЯЁ]\.\s*){{1,3}}{_W}")


def options(text: Column, accent: Column, overrides: Mapping[str, str] = {}, stresses: Mapping[str, str] = {}) -> Column:
    """array<struct<option_id, text>>: the name as it stands, accented, by sound, and with given stresses; equal texts once, the first stays."""
    by_sound = russian.word_overrides(text, overrides)
    found = F.array(*[F.struct(F.lit(n).alias("option_id"), strip(clean.keep_last_stress(c)).alias("text")) for n, c in (("original", text), ("accented", accent), ("phonetic", by_sound), ("guided", russian.word_overrides(by_sound, stresses)))])
    return F.filter(F.transform(found, lambda o, i: F.struct(o["option_id"].alias("option_id"), o["text"].alias("text"), (F.array_position(F.transform(found, lambda p: p["text"]), o["text"]) == i + 1).alias("first"))), lambda o: o["first"] & (o["text"] != ""))


def name_candidates(chapters: DataFrame, overrides: Mapping[str, str] = {}, stresses: Mapping[str, str] = {}, key: str = "chapter_key", text: str = "text") -> DataFrame:
    """(key, item_id, start, end, source_text, context, options) of names that can be said in more than one way; of overlapping ones the
    earlier pattern's stays."""
    spans = F.concat(*[steps.candidates(F.col(text), p) for p in NAMES])
    rows = chapters.select(key, F.col(text).alias("t"), F.posexplode(steps.without_overlaps(spans)).alias("n", "s")).select(key, "t", "n", "s.*")
    rows = rows.withColumn("options", options(F.col("source_text"), F.col("source_text"), overrides, stresses)).where(F.size("options") > 1)
    return rows.select(key, F.format_string("proper_name_%04d", F.col("n") + 1).alias("item_id"), "start", "end", "source_text", sentence_around(F.col("t"), F.col("start"), F.col("end")).alias("context"), "options")


def apply_choices(chapters: DataFrame, items: DataFrame, selections: DataFrame, key: str = "chapter_key", text: str = "text") -> DataFrame:
    """Texts with each candidate as it was chosen: a text of one's own, an option, or unchanged."""
    rows = items.join(selections.select(key, "item_id", "option_id", "custom_text"), [key, "item_id"], "left")
    option = F.get(F.filter("options", lambda o: o["option_id"] == F.coalesce(F.col("option_id"), F.lit("original"))), 0)["text"]
    spans = rows.groupBy(key).agg(F.collect_list(F.struct("start", "end", F.coalesce(F.nullif("custom_text", F.lit("")), option, "source_text").alias("by"))).alias("spans"))
    return chapters.join(spans, key, "left").withColumn(text, F.when(F.col("spans").isNotNull(), steps.splice(F.col(text), F.col("spans"))).otherwise(F.col(text))).drop("spans")


def prompt_lines(items: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(by, context, first_num, line): each context once, its candidates replaced by their numbered options. ``items`` has num, context, source_text, options."""
    shown = F.filter("options", lambda o: o["option_id"] != "original")
    inline = F.concat(F.lit("("), F.array_join(F.transform(shown, lambda o, k: F.concat(F.col("num").cast("string"), F.lit("."), (k + 1).cast("string"), F.lit("."), o["text"])), "|"), F.lit(")"))
    each = items.select(*by, "context", "num", "source_text", inline.alias("inline"))
    grouped = each.groupBy(*by, "context").agg(F.min("num").alias("first_num"), F.array_sort(F.collect_list(F.struct("num", "source_text", "inline"))).alias("c"))

    def put(line: Column, x: Column) -> Column:
        at = F.instr(line, x["source_text"])
        replaced = F.concat(F.substring(line, F.lit(1), at - 1), x["inline"], F.substring(line, at + F.length(x["source_text"]), F.length(line)))
        return F.when(at > 0, replaced).otherwise(F.concat(line, F.lit(" ["), x["source_text"], F.lit("→"), x["inline"], F.lit("]")))

    return grouped.select(*by, "context", "first_num", F.aggregate("c", F.col("context"), put).alias("line"))


def selections(answers: DataFrame, items: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Answers (by, response) of ``N.K`` lines to (by, item_id, option_id, custom_text); an option that isn't there means the original."""
    picked = answers.select(*by, F.explode(steps.parse_choices(F.col("response"))).alias("p")).select(*by, F.col("p.item").alias("num"), "p.option").dropDuplicates([*by, "num"])
    shown = F.transform(F.filter("options", lambda o: o["option_id"] != "original"), lambda o: o["option_id"])
    return items.join(picked, [*by, "num"]).select(*by, "item_id", F.coalesce(F.when(F.col("option") > 0, F.get(shown, F.col("option") - 1)), F.lit("original")).alias("option_id"), F.lit(None).cast("string").alias("custom_text"))


def long_sentences(chapters: DataFrame, most: int = 180, key: str = "chapter_key", text: str = "text") -> DataFrame:
    """(key, pos, sentence, context_before, context_after) of sentences over the limit."""
    parts = splitting.sentences_and_separators(F.col(text))["sentences"]
    rows = chapters.select(key, parts.alias("s")).select(key, "s", F.posexplode("s").alias("pos", "sentence")).where(F.length("sentence") > most)
    around = lambda a, n: F.array_join(F.slice("s", a, n), " ")
    return rows.select(key, "pos", "sentence", around(F.greatest(F.col("pos") - 1, F.lit(1)), F.least(F.col("pos"), F.lit(2))).alias("context_before"), around(F.col("pos") + 2, F.lit(2)).alias("context_after"))


def stitch(chapters: DataFrame, parts: DataFrame, key: str = "chapter_key", text: str = "text") -> DataFrame:
    """Texts with long sentences replaced by their parts (key, pos, parts); all parts but the last end in a chunk mark."""
    done = parts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "parts"))).alias("new"))

    def sentence(p: Column, i: Column) -> Column:
        mine = F.filter(F.transform(F.element_at("new", i), strip), lambda x: x != "")
        closed = F.transform(mine, lambda x, k: F.when(k < F.size(mine) - 1, clean.ensure_chunk_mark(x)).otherwise(F.when(clean.ends_with_boundary(x), x).otherwise(F.concat(x, F.lit(".")))))
        return F.concat(F.coalesce(F.when(F.size(mine) > 0, F.array_join(closed, " ")), p["sentences"]), p["separators"])

    rows = chapters.join(done, key, "left").withColumn("split", splitting.sentences_and_separators(F.col(text)))
    put = F.array_join(F.transform(F.arrays_zip("split.sentences", "split.separators"), sentence), "")
    return rows.withColumn(text, F.when(F.col("new").isNotNull(), strip(put)).otherwise(F.col(text))).drop("new", "split")


_WORDS = rf"[А-Яа-яЁё][А-Яа-яЁё{ACUTE}\-]*"
_PLUS_WORDS = r"\+?[А-Яа-яЁё][А-Яа-яЁё+\-]*"


def stressed_homographs(text: Column, accented: Column, homographs: list[str], paradox: list[str] = ()) -> Column:
    """A sentence with the stresses that an accenting model gave (``+`` before the vowel) to homographs that have none; where the two don't have the same
    number of words it stays as it is."""
    mine, theirs = F.regexp_extract_all(text, F.lit(f"({_WORDS})"), F.lit(1)), F.regexp_extract_all(accented, F.lit(f"({_PLUS_WORDS})"), F.lit(1))
    known = {w.replace(ACUTE, "").lower(): "1" for w in homographs if w.replace(ACUTE, "").lower() not in {p.replace(ACUTE, "").lower() for p in paradox}}
    if not known:
        return text
    gaps = F.split(text, _WORDS, -1)
    word = lambda a, b: F.when(lookup(known, F.lower(a)).isNotNull() & ~F.contains(a, F.lit(ACUTE)), preserve_case(a, clean.plus_to_stress(b))).otherwise(a)
    put = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(mine)), F.zip_with(mine, theirs, word), lambda g, w: F.concat(g, w)), ""), F.element_at(gaps, -1))
    return F.when((F.size(mine) > 0) & (F.size(mine) == F.size(theirs)), put).otherwise(text)
