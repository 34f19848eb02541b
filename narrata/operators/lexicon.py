"""The pronunciation lexicon: what it holds, ambiguous forms, and replacement of a source's entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrata.functions.patterns import ACUTE
from narrata.functions.russian import WORD, monosyllable, stressed_already

KEY = ("surface_form", "spoken_form", "lemma", "pos", "grammemes", "is_proper_name", "source")


def lookup(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Words with their entries, in the lexicon's order. The lexicon side is broadcast by the planner while it is small."""
    key = F.lower(F.replace(F.col(word), F.lit(ACUTE), F.lit("")))
    rows = words.withColumn("surface_form", key).join(lexicon, "surface_form")
    return rows.withColumn("entry_rank", F.row_number().over(W.partitionBy(word).orderBy("source", "spoken_form", "lemma", "grammemes")))


def ambiguous(lexicon: DataFrame) -> DataFrame:
    """Surface forms with two or more distinct spoken forms, sorted."""
    forms = lexicon.where("spoken_form is not null").groupBy("surface_form").agg(F.array_sort(F.collect_set("spoken_form")).alias("spoken_forms"))
    return forms.where(F.size("spoken_forms") >= 2)


def stats(lexicon: DataFrame) -> DataFrame:
    """Entries, forms with more than one spoken form, and proper names; one row."""
    by = lexicon.groupBy("surface_form").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("spoken_form").alias("spoken"), F.count_if("is_proper_name").alias("proper"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"), F.count_if(F.col("spoken") > 1).alias("n_ambiguous"), F.coalesce(F.sum("proper"), F.lit(0)).alias("n_proper"))


def per_source(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("source").agg(F.count(F.lit(1)).alias("n_entries"))


def replace_source(lexicon: DataFrame, source: str, entries: DataFrame) -> DataFrame:
    """The lexicon with a source's entries replaced; of entries equal in all but confidence the surest stays. To be written
    with dynamic partition overwrite by source."""
    best = entries.withColumn("source", F.lit(source)).groupBy(*KEY).agg(F.max("confidence").alias("confidence"))
    return lexicon.where(F.col("source") != source).select(*KEY, "confidence").unionByName(best.select(*KEY, "confidence"))


def override_form(overrides: DataFrame, order: list[str]) -> DataFrame:
    """One form for each surface form: that of the first source in order, then of any other."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source")), F.lit(0)), F.lit(len(order) + 1))
    return overrides.groupBy("surface_form").agg(F.min_by("tts_form", F.struct(rank, "source")).alias("tts_form"))


def merged_overrides(*tables: DataFrame) -> DataFrame:
    """Tables of (surface_form, tts_form), later ones winning."""
    rows = None
    for i, t in enumerate(tables):
        t = t.select("surface_form", "tts_form").withColumn("rank", F.lit(i))
        rows = t if rows is None else rows.unionByName(t)
    return rows.groupBy("surface_form").agg(F.max_by("tts_form", "rank").alias("tts_form"))


def stress_candidates(chapters: DataFrame, lexicon: DataFrame, skip: list[str] = (), key: str = "chapter_key", text: str = "text") -> DataFrame:
    """Words of a text that the lexicon stresses in more than one way: not stressed yet, of two syllables or more, none of ``skip``.
    (key, word, n, spoken_forms)."""
    words = chapters.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))).alias("word"))
    words = words.where(~stressed_already(F.col("word")) & ~monosyllable(F.col("word"))).withColumn("surface_form", F.lower("word"))
    if skip:
        words = words.where(~F.col("surface_form").isin([s.replace(ACUTE, "").lower() for s in skip]))
    counted = words.groupBy(key, "surface_form").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(ambiguous(lexicon), "surface_form")


def grammeme_labels(lexicon: DataFrame) -> DataFrame:
    """The grammatical labels of each spoken form, once each, in the lexicon's order."""
    label = F.concat_ws(" ", "pos", "grammemes")
    ordered = F.array_sort(F.collect_list(F.struct("source", "lemma", label.alias("label"))))
    return lexicon.groupBy("surface_form", "spoken_form").agg(F.array_distinct(F.filter(F.transform(ordered, lambda x: x["label"]), lambda x: x != "")).alias("labels"))


def proper_name(word: Column, before: Column, stop_words: list[str] = (), quotes_start: bool = True) -> Column:
    """Whether a capitalised word is a name, from what stands before it: not stressed, two letters or more, not all capitals, no stop
    word; after initials always, at the start of a sentence never. A sentence starts after its mark and white space and, where ``quotes_start``, opening quotes and brackets
    (then also after an ellipsis sign)."""
    shaped = F.regexp_like(word, F.lit(r"^\p{Lu}\p{L}*\p{Ll}[\p{L}\-]*$")) & ~stressed_already(word) & ~F.lower(word).isin(list(stop_words) or [""])
    initials = F.regexp_like(before, F.lit(r"(?:^|[^\p{L}])\p{Lu}\.\s*$"))
    starts = F.regexp_like(before, F.lit(r"(?:^|[.!?…])[\s«“„\"'(\[]*$" if quotes_start else r"(?:^|[.!?])\s*$"))
    return shaped & (initials | ~starts)


def build_needed(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """Sources (source, content_hash) that the state table doesn't hold in this version."""
    return wanted.join(state.where("built"), ["source", "content_hash"], "left_anti")


def lemmas(words: DataFrame, parses: DataFrame, most: int = 4, word: str = "word") -> DataFrame:
    """Words with the distinct lemmas of their ``most`` likeliest parses (surface_form, place, lemma), likeliest first."""
    ranked = parses.withColumn("_n", F.row_number().over(W.partitionBy("surface_form").orderBy("place"))).where(F.col("_n") <= most)
    found = ranked.groupBy("surface_form").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_n", "lemma"))), lambda x: x["lemma"])).alias("lemmas"))
    return words.join(found, F.lower(F.col(word)) == F.col("surface_form"), "left").drop("surface_form")
