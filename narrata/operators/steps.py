"""The ordered chain of text steps: a registry, parameters, traces and reuse of earlier results."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrata.functions import clean, russian, splitting
from narrata.functions.patterns import russian as is_russian

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Conf:
    """All parameters of the steps; a step's signature holds every one of them."""

    safe_max_chars: int = 180
    comma_as_period: bool = False
    paradox_words: tuple[str, ...] = ()
    word_overrides: tuple[tuple[str, str], ...] = ()
    hard_consonant_rules: tuple[tuple[str, str], ...] = russian.HARD_CONSONANTS
    number_nouns: tuple[tuple[str, str, str], ...] = ()  #: noun form, gender, case
    replacements: tuple[tuple[str, str], ...] = ()
    models: dict[str, Callable] = field(default_factory=dict, compare=False)  #: step name to Column function; identity where there is none


def _only_russian(step: Callable[[Column, Conf], Column]) -> Callable[[Column, Column, Conf], Column]:
    """Texts of other languages pass unchanged."""
    return lambda text, lang, conf: F.when(is_russian(lang), step(text, conf)).otherwise(text)


def _any(step: Callable[[Column, Conf], Column]) -> Callable[[Column, Column, Conf], Column]:
    return lambda text, lang, conf: step(text, conf)


def _model(name: str) -> Callable[[Column, Column, Conf], Column]:
    """A step that a model does: the function given for it, else the text as it is."""
    return lambda text, lang, conf: conf.models[name](text) if name in conf.models else text


REGISTRY: dict[str, Callable[[Column, Column, Conf], Column]] = {
    "simple_symbols": _any(lambda t, c: clean.simple_symbols(t)),
    "remove_endnotes": _any(lambda t, c: clean.remove_endnotes(t)),
    "remove_reference_numbers": _any(lambda t, c: clean.remove_reference_numbers(t)),
    "ru_initials": _only_russian(lambda t, c: russian.initials(t)),
    "ru_abbreviations": _only_russian(lambda t, c: russian.acronyms(russian.abbreviations(t))),
    "ru_time": _only_russian(lambda t, c: russian.clock_times(t)),
    "ru_numbers": _only_russian(lambda t, c: russian.numbers(t, {n: (g, k) for n, g, k in c.number_nouns} or None)),
    "ru_roman_numerals": _only_russian(lambda t, c: russian.roman_numerals(t)),
    "tts_hard_consonants": _only_russian(lambda t, c: russian.pattern_overrides(t, c.hard_consonant_rules, russian.HARD_WORDS | {k.lower(): v for k, v in c.word_overrides})),
    "tts_safe_split": _any(lambda t, c: splitting.safely_split(t, c.safe_max_chars, c.comma_as_period)),
    "tts_llm_safe_split": _model("tts_llm_safe_split"),
    "ru_proper_names": lambda t, lang, c: F.when(is_russian(lang), russian.paradox_overrides(_model("ru_proper_names")(t, lang, c), list(c.paradox_words))).otherwise(t),
    "ru_tsnorm": lambda t, lang, c: F.when(is_russian(lang), clean.keep_last_stress(_model("ru_tsnorm")(t, lang, c))).otherwise(t),
    "ru_silero_stress": _model("ru_silero_stress"),
    "ru_llm_stress_ambiguity": _model("ru_llm_stress_ambiguity"),
    "ru_llm_proper_nouns_pronunciation": _model("ru_llm_proper_nouns_pronunciation"),
    "openai": _model("openai"),
    "cosy_voice": _any(lambda t, c: clean.single_letter_lead(t)),
    "search_and_replace": _any(lambda t, c: _replaced(t, c)),
}
ALIASES = {"abbreviations_ru": "ru_abbreviations", "initials_ru": "ru_initials", "numbers_ru": "ru_numbers", "tts_pronunciation_overrides": "tts_hard_consonants"}
#: Pairs that only work in this order.
BEFORE = (("ru_time", "ru_numbers"), ("ru_numbers", "ru_roman_numerals"))


def _replaced(text: Column, conf: Conf) -> Column:
    for pattern, by in conf.replacements:
        text = F.regexp_replace(text, pattern, by)
    return text


def resolve(names: str | list[str]) -> list[str]:
    """Step names, trimmed and in lower case, earlier names of steps replaced; unknown names and wrong orders are errors."""
    out = []
    for raw in names.split(",") if isinstance(names, str) else names:
        name = raw.strip().lower()
        if not name:
            continue
        if name in ALIASES:
            log.warning("step %r is now called %r", name, ALIASES[name])
            name = ALIASES[name]
        if name not in REGISTRY:
            raise ValueError(f"unknown step {raw!r}; there are {', '.join(sorted(REGISTRY))}")
        out.append(name)
    for first, then in BEFORE:
        if first in out and then in out and out.index(first) > out.index(then):
            raise ValueError(f"{first} comes before {then}")
    return out


def chain(text: Column, names: str | list[str], lang: Column | None = None, conf: Conf = Conf()) -> Column:
    """All steps, left to right, in one expression."""
    for name in resolve(names):
        text = REGISTRY[name](text, lang if lang is not None else F.lit("ru"), conf)
    return text


def signature(name: str, conf: Conf, version: int = 1) -> str:
    """A digest of the step, its version and all parameters. A model counts by its name and its ``signature``, if it has one: whoever changes
    a model behind one name says so there."""
    told = lambda f: f"{getattr(f, '__module__', '')}.{getattr(f, '__qualname__', type(f).__qualname__)}:{getattr(f, 'signature', '')}"
    values = {k: {n: told(f) for n, f in sorted(v.items())} if k == "models" else v for k, v in ((k, getattr(conf, k)) for k in asdict(Conf()))}
    return sha256(json.dumps({"step": name, "version": version, "conf": values}, sort_keys=True, default=str).encode()).hexdigest()


def trace(chapters: DataFrame, names: str | list[str], key: str = "chapter_key", text: str = "text", lang: Column | None = None, conf: Conf = Conf()) -> DataFrame:
    """One row a chapter and step: (key, step_index, step_name, before, after, changed, input_hash, config_hash). The chain runs once:
    each step reads the column of the one before it."""
    steps = resolve(names)
    rows = chapters.select(key, F.col(text).alias("t0"), (lang if lang is not None else F.lit("ru")).alias("lang"))
    for i, name in enumerate(steps):
        rows = rows.withColumn(f"t{i + 1}", REGISTRY[name](F.col(f"t{i}"), F.col("lang"), conf))
    each = [F.struct(F.lit(i).alias("step_index"), F.lit(n).alias("step_name"), F.col(f"t{i}").alias("before"), F.col(f"t{i + 1}").alias("after"), F.lit(signature(n, conf)).alias("config_hash")) for i, n in enumerate(steps)]
    out = rows.select(key, F.explode(F.array(*each)).alias("s")).select(key, "s.*")
    return out.withColumn("changed", ~F.col("before").eqNullSafe(F.col("after"))).withColumn("input_hash", F.sha2("before", 256))


def trace_summary(traced: DataFrame) -> DataFrame:
    """Steps with the chapters they saw and changed and the characters they added or took."""
    return traced.groupBy("step_index", "step_name").agg(F.count(F.lit(1)).alias("n_chapters"), F.count_if("changed").alias("n_changed"), F.sum(F.length("after") - F.length("before")).alias("d_chars"))


def reuse(traced_inputs: DataFrame, state: DataFrame, keys=("chapter_key", "step_index", "input_hash", "config_hash")) -> tuple[DataFrame, DataFrame]:
    """Inputs split into those whose result is in the state table with success, with it, and those still to be run."""
    done = state.where("status = 'success' and output is not null").select(*keys, "output")
    return traced_inputs.join(done, list(keys)), traced_inputs.join(done, list(keys), "left_anti")


def plan_units(chapters: DataFrame, units: Column, key: str = "chapter_key") -> DataFrame:
    """The units of a step's input (an array column), to be done one by one: (key, unit_index, payload, input_hash)."""
    return chapters.select(key, F.posexplode(units).alias("unit_index", "payload")).withColumn("input_hash", F.sha2("payload", 256))


def merge_units(done: DataFrame, key: str = "chapter_key", joiner: str = "\n\n") -> DataFrame:
    """Results of units in their order, joined by a blank line."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("unit_index", "output"))), lambda x: x["output"])
    return done.groupBy(key).agg(F.array_join(parts, joiner).alias("text"))


def resume_plan(state: DataFrame, names: str | list[str]) -> dict:
    """Whether the last run goes on: it has steps without success and the steps wanted start with those recorded. An empty
    table goes on as well; a complete run is followed by a new one that starts from its text."""
    rows = state.groupBy("step_name").agg(F.min("step_index").alias("at"), F.count_if(F.col("status") != "success").alias("open")).orderBy("at").collect()  # a row for each step
    recorded, wanted, unfinished = [r["step_name"] for r in rows], resolve(names), sum(r["open"] for r in rows)
    resume = not rows or (unfinished > 0 and wanted[: len(recorded)] == recorded)
    return {"resume": resume, "unfinished": unfinished, "recorded": recorded, "seed_from_previous": bool(rows) and not resume}


def candidates(text: Column, pattern: str) -> Column:
    """array<struct<start, end, source_text>> of a pattern's matches, offsets from 0."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    step = lambda a, p: F.struct((a["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(p["gap"])).alias("start"), (a["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"), p["hit"].alias("source_text")))).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,source_text:string>>").alias("out"))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, step, lambda a: a["out"])


def splice(text: Column, spans: Column) -> Column:
    """Spans array<struct<start, end, by>> put into a text, in whatever order they come; they must not overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["by"].alias("by"))))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["by"]).alias("out"))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def without_overlaps(spans: Column) -> Column:
    """Of spans in order of preference, those that meet none taken before them."""
    clash = lambda taken, s: F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    return F.aggregate(spans, F.slice(spans, 1, 0), lambda a, s: F.when(clash(a, s), a).otherwise(F.concat(a, F.array(s))))


def choose(items: DataFrame, selections: DataFrame, default: str = "original") -> DataFrame:
    """Candidates with the option selected for them, or the default."""
    return items.join(selections.select("item_id", "option_id", "custom_text"), "item_id", "left").withColumn("option_id", F.coalesce("option_id", F.when(F.col("custom_text").isNull(), F.lit(default))))


def cached_choices(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items split by whether the cache has their key (a digest of what decides the choice)."""
    keyed = items.withColumn("key", F.sha2(F.concat_ws("\x1f", "source_text", "context", F.to_json("options")), 256))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")


def by_context(items: DataFrame) -> DataFrame:
    """Items of one context together, contexts in the order in which they first appear."""
    return items.groupBy("context").agg(F.min("pos").alias("first_pos"), F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("items")).withColumn("place", F.row_number().over(W.partitionBy().orderBy("first_pos")))


def choice_counts(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("option_id", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("option_id") != "original").alias("n_changed"))


def parse_choices(response: Column) -> Column:
    """``1.2`` choices of a model's answer as array<struct<item, option>>; fences and other text don't matter."""
    hits = F.regexp_extract_all(response, F.lit(r"(?m)(?<![\d.])(\d+\.\d+)(?![\d.])"), F.lit(1))
    return F.transform(hits, lambda h: F.struct(F.substring_index(h, ".", 1).cast("int").alias("item"), F.substring_index(h, ".", -1).cast("int").alias("option")))


def parse_parts(response: Column) -> Column:
    """``[{"id": .., "parts": [..]}]`` in a model's answer, fenced or not; null if there is none."""
    body = F.regexp_extract(F.regexp_replace(response, r"(?s)```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    return F.from_json(F.nullif(body, F.lit("")), "array<struct<id:string,parts:array<string>>>")
