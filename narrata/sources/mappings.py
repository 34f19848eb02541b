"""Mapping files, dictionaries and the choice cache. Line formats are parsed in columns; a wrong line is an error with its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions.clean import plus_to_stress
from narrata.functions.patterns import ACUTE, GRAVE, strip

ENTRY = "surface_form string, spoken_form string, lemma string, pos string, grammemes string, is_proper_name boolean, source string, confidence double"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line), numbered from 1. A mapping file is small: its lines stay in one task."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).select((F.col("i") + 1).alias("line_no"), "line")


def _checked(bad: Column, what: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(f": {what}")))).otherwise(value)


def _pairs(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("line", strip(F.col("line"))).where("line <> '' and not startswith(line, '#')")
    parts = F.split("line", "==", 2)
    source = strip(parts[0])
    return rows.select("line_no", _checked(F.size(parts) < 2, "'==' is missing", _checked(source == "", "nothing stands before '=='", source)).alias("source"), strip(F.get(parts, 1)).alias("target"))


def mapping(lines: DataFrame) -> DataFrame:
    """``a==b`` lines to (source, target); of equal sources the last counts."""
    return _pairs(lines).groupBy("source").agg(F.max_by("target", "line_no").alias("target"))


def choice_mapping(lines: DataFrame) -> DataFrame:
    """``a==v1|v2`` lines to (source, variants), two variants or more; ``+а`` becomes ``а́``."""
    variants = F.filter(F.transform(F.split("target", "\\|"), strip), lambda v: v != "")
    rows = _pairs(lines).withColumn("variants", F.transform(variants, plus_to_stress))
    return rows.select("line_no", "source", _checked(F.size("variants") < 2, "two variants or more are needed", F.col("variants")).alias("variants")).groupBy("source").agg(F.max_by("variants", "line_no").alias("variants"))


def replacement_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``pattern==replacement`` lines in their order. As in the files' first reader the last character of a line is not part of the
    replacement (it is taken for the line end); lines that start with ``==`` or ``#`` don't count."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return [(p[0], p[1][:-1]) for line in text.splitlines(keepends=True) if "==" in line and not line.startswith(("==", "#")) and not line.endswith("==") for p in (line.split("=="),)]


# Marks of parts of speech in the grammatical dictionary, most specific first.
PARTS_OF_SPEECH = (
    ("мо-жо", "NOUN"), ("жо", "NOUN"), ("мо", "NOUN"), ("со", "NOUN"), ("ж", "NOUN"), ("м", "NOUN"), ("с", "NOUN"), ("мс-п", "PRON"), ("мс", "PRON"), ("п", "ADJ"), ("нар", "ADV"),
    ("св-нсв", "VERB"), ("св", "VERB"), ("нсв", "VERB"), ("межд", "INTJ"), ("союз", "CONJ"), ("предл", "PREP"), ("частица", "PART"), ("част", "PART"), ("числ", "NUM"), ("вводн", "INTRO"), ("предик", "PRED"),
)
_CLASS = r"(?U)\b(\d+[*]?[a-fA-F](?:''?)?(?://\d+[*]?[a-fA-F](?:''?)?)?—?)\b"


def grammar_entries(lines: DataFrame, proper: bool = False) -> DataFrame:
    """``[N/]lemma marks class`` lines of a grammatical dictionary to lexicon entries, distinct by surface and spoken form."""
    line = F.regexp_replace(strip(F.col("line")), r"^\d+(?:-\d+)?/", "")
    rows = lines.withColumn("word", F.regexp_extract(line, r"(?U)^(\S+)", 1)).withColumn("rest", F.regexp_replace(F.regexp_replace(line, r"(?U)^\S+\s*", ""), r"\[.*?\]|\(.*?\)", " "))
    pos = F.coalesce(*[F.when(F.regexp_like("rest", F.lit(rf"(?U)\b{mark}\b")), F.lit(name)) for mark, name in PARTS_OF_SPEECH])
    spoken = F.replace(F.col("word"), F.lit(GRAVE), F.lit(""))
    surface = F.lower(F.replace(spoken, F.lit(ACUTE), F.lit("")))
    out = rows.select(
        surface.alias("surface_form"), spoken.alias("spoken_form"), surface.alias("lemma"), pos.alias("pos"), F.nullif(F.regexp_extract("rest", _CLASS, 1), F.lit("")).alias("grammemes"),
        F.lit(proper).alias("is_proper_name"), F.lit("zalizniak").alias("source"), F.lit(0.95).alias("confidence"),
    )
    return out.where(F.regexp_like("surface_form", F.lit("[Ѐ-ӿ]"))).dropDuplicates(["surface_form", "spoken_form"])


def hard_consonant_overrides(lines: DataFrame, consonants: str = "бвгджзйклмнпрстфхцчшщ") -> DataFrame:
    """``word phonemes`` lines (comments start with //, ? or an opening parenthesis) to (surface_form, tts_form): where a hard consonant stands before E,
    every е after a consonant is written э."""
    rows = lines.where(~F.regexp_like(F.trim("line"), F.lit(r"^(?:$|//|\?|\()")))
    parts = F.split(strip(F.col("line")), r"(?U)\s+")
    rows = rows.where(F.size(parts) >= 2).select(F.lower(parts[0]).alias("surface_form"), parts[1].alias("phonemes"))
    hard = rows.where(F.regexp_like("phonemes", F.lit("[bdfgklmnprstvxz]E")))
    out = hard.select("surface_form", F.regexp_replace("surface_form", f"(?<=[{consonants}])е", "э").alias("tts_form"))
    return out.where("surface_form <> tts_form").dropDuplicates(["surface_form"]).withColumn("source", F.lit("espeak"))


def stressed_forms(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    """A dictionary of word forms (surface, forms array<struct<word_form, stress_pos, form_tags, lemma>>) and lemmas (lemma, pos
    array, rank) to lexicon entries."""
    from narrata.functions.russian import stress_at

    rows = words.select("surface", F.explode("forms").alias("f")).join(lemmas.select(F.col("lemma").alias("l"), F.get("pos", 0).alias("pos"), "rank"), F.col("f.lemma") == F.col("l"), "left")
    return rows.select(
        F.lower("surface").alias("surface_form"), stress_at(F.col("f.word_form"), F.col("f.stress_pos")).alias("spoken_form"), F.col("f.lemma").alias("lemma"), "pos", F.col("f.form_tags").alias("grammemes"),
        F.regexp_like(F.col("f.word_form"), F.lit(r"^\p{Lu}")).alias("is_proper_name"), F.lit("tsnorm").alias("source"), F.lit(None).cast("double").alias("confidence"),
    ).dropDuplicates()


def choice_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, selection) of a JSON-lines cache; rows that don't parse are left out."""
    rows = spark.read.schema("key string, selection struct<item_id:string,option_id:string,custom_text:string,cacheable:boolean,reason:string,source:string>, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null and key is not null").select("key", "selection")
