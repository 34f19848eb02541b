"""Queries of the steps that a model decides, with models that are plain functions."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from narrata.operators import asking
from narrata.plans import fixtures as fx
from narrata.plans.base import query, read


def shouted(prompt: str) -> str:
    """A model that answers with some letters as capitals and refuses what holds a row of three of the letter x."""
    if "xxx" in prompt:
        raise RuntimeError("refused")
    return prompt.translate(str.maketrans("aeiouаеиоу", "AEIOUАЕИОУ"))


def halved(prompt: str) -> str:
    """A model that cuts each sentence it is given at the first comma."""
    items = json.loads(prompt[prompt.index("[") :])
    return "```json\n" + json.dumps([{"id": i["id"], "parts": i["sentence"].split(", ", 1)} for i in items], ensure_ascii=False) + "\n```"


def second(prompt: str) -> str:
    """A model that takes the second option of every number it sees, and talks beside it."""
    return "So:\n" + "\n".join(f"{n}.2" for n in dict.fromkeys(re.findall(r"\((\d+)\.1\.", prompt)))


def accented(sentence: str) -> str:
    """A model that stresses the first vowel of every word."""
    return re.sub(r"[А-Яа-яЁё]+", lambda m: re.sub(r"([аеёиоуыэюяАЕЁИОУЫЭЮЯ])", r"+\1", m[0], count=1), sentence)


@query("SELECT doc_id, CASE WHEN contains(text, 'xxx') THEN text ELSE trim(translate(text, 'aeiouаеиоу', 'AEIOUАЕИОУ'), E' \\t\\n\\r\\f\\v') END AS text FROM documents")
def model_rewrite(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return asking.rewrite(docs, asking.Asked(complete=shouted), "doc_id")


@query("SELECT * FROM (VALUES ('c1', 'OnE sEntEncE. TwO sEntEncEs.'), ('c2', 'has xxx in it.')) t(chapter_key, text)")
def model_rewrite_units(spark, sf_dir):
    rows = spark.createDataFrame([("c1", "One sentence. Two sentences."), ("c2", "has xxx in it.")], "chapter_key string, text string")
    return asking.rewrite(rows, asking.Asked(complete=shouted, unit_chars=60))


@query("""SELECT * FROM (VALUES
('c1', 'Short one. This sentence is long enough to be cut[chunk_eof] it says so itself. End.' || chr(10) || chr(10) || 'Second paragraph is fine.'),
('c2', 'Nothing here is long.')) t(chapter_key, text)""")
def model_long_sentences(spark, sf_dir):
    rows = [("c1", "Short one. This sentence is long enough to be cut, it says so itself. End.\n\nSecond paragraph is fine."), ("c2", "Nothing here is long.")]
    return asking.split_long(spark.createDataFrame(rows, "chapter_key string, text string"), asking.Asked(complete=halved, most_chars=40))


@query("SELECT * FROM (VALUES ('c1', 'Старый замо́к стоит. Мука́ в мешке, и замо́к.'), ('c2', 'Дом.')) t(chapter_key, text)")
def model_stress(spark, sf_dir):
    from narrata.operators import lexicon

    rows = spark.createDataFrame([("c1", "Старый замок стоит. Мука в мешке, и замок."), ("c2", "Дом.")], "chapter_key string, text string")
    forms = lexicon.ambiguous(fx.LEXICON.df(spark)).where("surface_form rlike '^[а-я]'")
    return asking.stress_ambiguous(rows, asking.Asked(complete=second, ambiguous=forms, budget=300))


@query("SELECT * FROM (VALUES ('c1', 'Пришёл Тэ́ст Кафэ́ и сел.'), ('c2', 'Никого.')) t(chapter_key, text)")
def model_names(spark, sf_dir):
    rows = spark.createDataFrame([("c1", "Пришёл Тест Кафе и сел."), ("c2", "Никого.")], "chapter_key string, text string")
    return asking.pronounce_names(rows, asking.Asked(complete=second, overrides=(("тест", "тэст"), ("кафе", "кафэ")), stresses=(("тэст", "тэ́ст"), ("кафэ", "кафэ́"))))


@query("SELECT * FROM (VALUES ('c1', 'Стоит за́мок. Мука.'), ('c2', 'Дом.')) t(chapter_key, text)")
def model_homographs(spark, sf_dir):
    rows = spark.createDataFrame([("c1", "Стоит замок. Мука."), ("c2", "Дом.")], "chapter_key string, text string")
    return asking.stress_homographs(rows, asking.Asked(accent=accented, homographs=("замок",)))


@query("SELECT * FROM (VALUES ('c1', 'СтОИт зА́мОк.'), ('c2', 'В кАфЕ тэст.')) t(chapter_key, text)")
def model_chain(spark, sf_dir):
    """Column steps and model steps of one chain."""
    rows = spark.createDataFrame([("c1", "Стоит замок [1]."), ("c2", "В кафе тест.")], "chapter_key string, text string")
    asked = asking.Asked(complete=shouted, accent=accented, homographs=("замок",))
    got = asking.run(rows, "remove_reference_numbers, tts_hard_consonants, ru_silero_stress, openai", asked)
    return got.withColumn("text", F.regexp_replace("text", r" +\.", "."))


@query("SELECT * FROM (VALUES (1, 'anna', 1.25::DOUBLE), (2, 'boris', 1.0), (3, 'main', 1.0), (4, 'main', 1.0)) t(id, voice, speed)")
def voice_settings(spark, sf_dir):
    rows = spark.createDataFrame([(1, "anna"), (2, "boris"), (3, None), (4, "main")], "id int, v string")
    voice, speed = asking.settings_of({"anna": {"speed": 1.25}, "boris": {}, "main": {"speed": 3}}, F.col("v"), "main", 1.0)
    return rows.select("id", voice.alias("voice"), speed.alias("speed"))
