"""Steps that a model decides, run over tables: what is asked becomes rows, the rows are answered, the answers go back into the texts.

The model is a function from a prompt to an answer, given by the caller and called in Arrow UDFs with a retry policy. Without one, and where it fails, texts stay as
they are; a step's failures are columns of ``answered``, not exceptions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrata.functions import splitting
from narrata.functions.patterns import ACUTE, preserve_case, strip
from narrata.functions.patterns import russian as is_russian
from narrata.functions.remote import Retry
from narrata.operators import models, steps
from narrata.operators.chunks import sentence_around

Complete = Callable[[str], str]
PER_ITEM, PER_CALL = 80, 200  #: characters that a prompt adds for an item, and for itself


@dataclass(frozen=True)
class Asked:
    """What model steps need: ``complete`` answers prompts, ``accent`` puts ``+`` before stressed vowels."""

    complete: Complete | None = None
    accent: Complete | None = None
    retry: Retry = Retry(attempts=3, first=0.0)
    budget: int = 4000  #: characters of a prompt
    most_chars: int = 180  #: of a sentence that is left alone
    unit_chars: int = 0  #: of a unit of a whole text; 0 for the text as one
    ambiguous: DataFrame | None = None  #: (surface_form, spoken_forms)
    homographs: tuple[str, ...] = ()
    overrides: tuple[tuple[str, str], ...] = ()
    stresses: tuple[tuple[str, str], ...] = ()


def answered(rows: DataFrame, f: Complete, retry: Retry = Retry(attempts=3, first=0.0), prompt: str = "prompt") -> DataFrame:
    """``rows`` with ``response`` and ``error`` (one of them null), one call a row."""
    @F.pandas_udf("struct<response: string, error: string>")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for p in s:
            try:
                out.append((retry.call(lambda p=p: f(p)), None))
            except Exception as error:  # whatever the model raises
                out.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(out, columns=["response", "error"])

    return rows.withColumn("_a", run(F.col(prompt))).select(*[F.col(f"`{c}`") for c in rows.columns], "_a.response", "_a.error")


def batch_numbers(costs: Column, budget: int, per_item: int = PER_ITEM, per_call: int = PER_CALL) -> Column:
    """For each cost of an array the number of its batch, packed in order."""
    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        def one(costs):
            number = {i: k for k, batch in enumerate(splitting.batches(list(costs), budget, per_item, per_call)) for i in batch}
            return [number[i] for i in range(len(costs))]

        return s.map(one, na_action="ignore")

    return run(costs)


def batched(items: DataFrame, size: Column, budget: int, key: str, order: list[str]) -> DataFrame:
    """``items`` with ``batch`` and ``num``, their place in it from 1. A chapter's items are packed in one go; chapters apart."""
    place = F.struct(*order)
    packs = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), size.cast("int").alias("cost")))).alias("all"))
    packs = packs.select(key, F.explode(F.arrays_zip(F.transform("all", lambda x: x["at"]).alias("at"), batch_numbers(F.transform("all", lambda x: x["cost"]), budget).alias("batch"))).alias("x"))
    numbers = packs.select(F.col(key).alias("_k"), *[F.col(f"x.at.{o}").alias(f"_{o}") for o in order], F.col("x.batch").alias("batch"))
    same = F.col(key).eqNullSafe(F.col("_k"))
    for o in order:
        same = same & (F.col(o) == F.col(f"_{o}"))
    joined = items.join(numbers, same).drop("_k", *[f"_{o}" for o in order])
    return joined.withColumn("num", F.row_number().over(W.partitionBy(key, "batch").orderBy(*order)))


def rewrite(chapters: DataFrame, asked: Asked, key: str = "chapter_key", text: str = "text") -> DataFrame:
    """Whole texts, unit by unit, as the model answers them; units are joined by a blank line. A text with a unit that failed stays."""
    if asked.complete is None:
        return chapters

    @F.pandas_udf("array<string>")
    def units(s: pd.Series) -> pd.Series:
        most = asked.unit_chars
        return s.map(lambda t: [t] if most <= 0 else splitting.merged_small(splitting.sized(t, most), most), na_action="ignore")

    done = answered(steps.plan_units(chapters, units(F.col(text)), key), asked.complete, asked.retry, "payload").withColumn("output", strip(F.col("response")))
    bad = F.max(F.col("error").isNotNull()).alias("bad")
    merged = steps.merge_units(done, key).join(done.groupBy(key).agg(bad), key).where("not bad").select(F.col(key), F.col("text").alias("_new"))
    return chapters.join(merged, key, "left").withColumn(text, F.coalesce("_new", F.col(text))).drop("_new")


_BREAK = r"\n{2,}"


def split_long(chapters: DataFrame, asked: Asked, key: str = "chapter_key", text: str = "text") -> DataFrame:
    """Sentences over the limit as the parts that the model gives (JSON), paragraph by paragraph; others, and those without an answer, stay."""
    if asked.complete is None:
        return chapters
    parts = F.arrays_zip(F.split(text, _BREAK, -1).alias("text"), F.concat(F.regexp_extract_all(F.col(text), F.lit(f"({_BREAK})"), F.lit(1)), F.array(F.lit(""))).alias("sep"))
    rows = chapters.select(F.col(key).alias("_key"), F.posexplode(parts).alias("para", "p")).select("_key", "para", "p.text", "p.sep").withColumn("pkey", F.concat_ws(":", "_key", "para"))
    items = models.long_sentences(rows.select("pkey", "text"), asked.most_chars, "pkey").join(rows.select("pkey", "_key", "para"), "pkey")
    items = items.withColumn("id", F.format_string("p%ds%d", "para", "pos"))
    item = F.struct("id", "sentence", "context_before", "context_after")
    packed = batched(items, F.length(F.to_json(item)), asked.budget, "_key", ["para", "pos"])
    head = F.lit(f"Split the sentence of each object into parts of at most {asked.most_chars} characters. The contexts are for understanding only.\n")
    calls = packed.groupBy("_key", "batch").agg(F.array_sort(F.collect_list(F.struct("num", item.alias("item")))).alias("all"))
    calls = calls.withColumn("prompt", F.concat(head, F.to_json(F.transform("all", lambda x: x["item"]))))
    got = answered(calls.select("_key", "batch", "prompt"), asked.complete, asked.retry)
    found = got.select("_key", F.explode(steps.parse_parts(F.col("response"))).alias("a")).select("_key", F.col("a.id").alias("id"), F.col("a.parts").alias("parts")).where("parts is not null").dropDuplicates(["_key", "id"])
    done = items.join(found, ["_key", "id"]).select("pkey", "pos", "parts")
    stitched = models.stitch(rows, done, "pkey")
    whole = stitched.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("para", "text", "sep"))).alias("all"))
    whole = whole.select("_key", F.array_join(F.transform("all", lambda x: F.concat(x["text"], x["sep"])), "").alias("_new")).join(done.join(rows.select("pkey", "_key"), "pkey").select("_key").distinct(), "_key")
    return chapters.join(whole, F.col(key) == F.col("_key"), "left").withColumn(text, F.coalesce(strip(F.col("_new")), F.col(text))).drop("_new", "_key")


def stress_items(chapters: DataFrame, ambiguous: DataFrame, key: str = "chapter_key", text: str = "text") -> DataFrame:
    """(key, item_id, start, end, source_text, context, options) of words with more than one spoken form: the original and each form."""
    words = chapters.select(key, F.col(text).alias("t"), F.posexplode(steps.candidates(F.col(text), rf"[А-Яа-яЁё][А-Яа-яЁё{ACUTE}\-]*")).alias("n", "s")).select(key, "t", "n", "s.*")
    words = words.where(~F.contains("source_text", F.lit(ACUTE)))
    forms = ambiguous.select(F.col("surface_form").alias("_w"), "spoken_forms")
    rows = words.join(forms, F.lower("source_text") == F.col("_w"))
    variants = F.transform(F.col("spoken_forms"), lambda f, i: F.struct(F.concat(F.lit("variant_"), (i + 1).cast("string")).alias("option_id"), preserve_case(F.col("source_text"), f).alias("text")))
    rows = rows.withColumn("options", F.concat(F.array(F.struct(F.lit("original").alias("option_id"), F.col("source_text").alias("text"))), variants))
    return rows.select(key, F.format_string("stress_%04d", F.col("n") + 1).alias("item_id"), "start", "end", "source_text", sentence_around(F.col("t"), F.col("start"), F.col("end")).alias("context"), "options")


def choose(chapters: DataFrame, items: DataFrame, asked: Asked, key: str = "chapter_key", text: str = "text") -> DataFrame:
    """Texts with each item as the model chose it; what it leaves out, or chooses wrongly, stays as it is."""
    if asked.complete is None:
        return chapters
    size = F.length("context") + F.aggregate("options", F.lit(0), lambda a, o: a + F.length(o["text"]) + 5)
    packed = batched(items, size, asked.budget, key, ["start"])
    lines = models.prompt_lines(packed, [key, "batch"])
    calls = lines.groupBy(key, "batch").agg(F.array_sort(F.collect_list(F.struct("first_num", "line"))).alias("all"))
    calls = calls.withColumn("prompt", F.array_join(F.transform("all", lambda x: x["line"]), "\n"))
    got = answered(calls.select(key, "batch", "prompt"), asked.complete, asked.retry)
    return models.apply_choices(chapters, items, models.selections(got, packed, [key, "batch"]), key, text)


def stress_ambiguous(chapters: DataFrame, asked: Asked, key: str = "chapter_key", text: str = "text") -> DataFrame:
    if asked.complete is None or asked.ambiguous is None:
        return chapters
    return choose(chapters, stress_items(chapters, asked.ambiguous, key, text), asked, key, text)


def pronounce_names(chapters: DataFrame, asked: Asked, key: str = "chapter_key", text: str = "text") -> DataFrame:
    return choose(chapters, models.name_candidates(chapters, dict(asked.overrides), dict(asked.stresses), key, text), asked, key, text)


def stress_homographs(chapters: DataFrame, asked: Asked, key: str = "chapter_key", text: str = "text") -> DataFrame:
    """Sentences with the accents that the accenting model gives to homographs. Each distinct sentence with a homograph is asked once."""
    if asked.accent is None or not asked.homographs:
        return chapters
    found = splitting.sentences_and_separators(F.col(text))
    known = "|".join(sorted({h.replace(ACUTE, "").lower() for h in asked.homographs}))
    rows = chapters.select(key, F.posexplode(F.arrays_zip(found["sentences"].alias("s"), found["separators"].alias("sep"))).alias("pos", "p")).select(key, "pos", "p.*")
    has = F.regexp_like(F.lower("s"), F.lit(rf"(?<![а-яё])(?:{known})(?![а-яё])"))
    told = answered(rows.where(has).select("s").distinct(), asked.accent, asked.retry, "s").where("response is not null").select(F.col("s").alias("_s"), "response")
    put = models.stressed_homographs(F.col("s"), F.col("response"), list(asked.homographs))
    done = rows.join(told, F.col("s") == F.col("_s"), "left").withColumn("s", F.when(F.col("response").isNotNull(), put).otherwise(F.col("s")))
    new = done.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "s", "sep"))).alias("all")).select(key, F.array_join(F.transform("all", lambda x: F.concat(x["s"], x["sep"])), "").alias("_new"))
    touched = done.where("response is not null").select(key).distinct()
    return chapters.join(new.join(touched, key), key, "left").withColumn(text, F.coalesce("_new", F.col(text))).drop("_new")


#: Step name to what it does with a table of texts; all but the first two are for Russian texts.
FRAMES: dict[str, Callable[..., DataFrame]] = {
    "openai": rewrite,
    "tts_llm_safe_split": split_long,
    "ru_llm_stress_ambiguity": stress_ambiguous,
    "ru_llm_proper_nouns_pronunciation": pronounce_names,
    "ru_silero_stress": stress_homographs,
}


def run(chapters: DataFrame, names: str | list[str], asked: Asked, conf: steps.Conf = steps.Conf(), key: str = "chapter_key", text: str = "text", lang: str = "ru") -> DataFrame:
    """The chain over a table: column steps as expressions, model steps as plans of their own. The language is one of all the texts."""
    russian = chapters.sparkSession.range(1).select(is_russian(F.lit(lang))).first()[0]
    for name in steps.resolve(names):
        if name in FRAMES and name not in conf.models:
            if russian or not name.startswith("ru_"):
                chapters = FRAMES[name](chapters, asked, key, text)
        else:
            chapters = chapters.withColumn(text, steps.REGISTRY[name](F.col(text), F.lit(lang), conf))
    return chapters


def settings_of(overrides: Mapping[str, Mapping[str, object]], voice: Column, primary: str, speed: float | None) -> tuple[Column, Column]:
    """(voice, speed) of one call: the chunk's voice, or the primary one, and the speed set for that voice, or the general one."""
    name = F.coalesce(voice, F.lit(primary))
    speeds = {v: float(o["speed"]) for v, o in overrides.items() if o.get("speed") is not None and v != primary}
    found = F.lit(speed).cast("double")
    for v, x in speeds.items():
        found = F.when(name == v, F.lit(x)).otherwise(found)
    return name, found
