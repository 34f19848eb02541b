"""Checks of a chunk's transcription against its text, their combination and what review makes of stored results."""

from __future__ import annotations

import json
import subprocess
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import compare

DEFAULT = ("whisper_similarity", "first_word", "last_word")
THRESHOLD = 0.70


def similarities(rows: DataFrame, original: str = "original_text", transcription: str = "transcription") -> DataFrame:
    """Adds the comparison forms and both likenesses: of letters and of sounds."""
    rows = rows.withColumn("o_form", compare.comparison_form(F.col(original))).withColumn("t_form", compare.comparison_form(F.col(transcription)))
    rows = rows.withColumn("_op", compare.phonetic_form(F.col("o_form"))).withColumn("_tp", compare.phonetic_form(F.col("t_form")))
    rows = rows.withColumn("similarity_orth", compare.similarity("o_form", "t_form"))
    same = (F.col("_op") == F.col("o_form")) & (F.col("_tp") == F.col("t_form"))  # no sound differs from its letters
    heard = compare.similarity(F.when(~same, F.col("_op")), F.when(~same, F.col("_tp")))
    return rows.withColumn("similarity_phon", F.when(same, F.col("similarity_orth")).otherwise(heard)).drop("_op", "_tp")


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def first_word(form: str = "o_form", heard: str = "t_form") -> Column:
    """Whether the transcription starts with the text's first word, also with spaces left out; blank ones pass."""
    word, said = F.substring_index(form, " ", 1), F.col(heard)
    ok = compare.starts_with_word(word, said) | compare.starts_with_word(word, F.replace(said, F.lit(" "), F.lit("")))
    return F.when(_blank(heard) | _blank(form), True).otherwise(ok)


def last_word(form: str = "o_form", heard: str = "t_form") -> Column:
    word, said = F.substring_index(form, " ", -1), F.col(heard)
    ok = compare.ends_with_word(word, said) | compare.ends_with_word(word, F.replace(said, F.lit(" "), F.lit("")))
    return F.when(_blank(heard) | _blank(form), True).otherwise(ok)


def artifacts(transcription: Column, patterns: str | None) -> Column:
    """Whether a transcription holds none of the comma-separated pieces; without pieces it passes."""
    pieces = [p.strip().lower() for p in (patterns or "").split(",") if p.strip()]
    hit = F.lit(False)
    for p in pieces:
        hit = hit | F.contains(F.lower(F.coalesce(transcription, F.lit(""))), F.lit(p))
    return ~hit


def reference_status(score: Column, threshold: Column, error: Column | None = None) -> Column:
    """ok or suspicious by a threshold, measured without one, error where the measurement failed."""
    got = F.when(threshold.isNull(), "measured").when(score > threshold, "suspicious").otherwise("ok")
    failed = score.isNull() if error is None else score.isNull() | error.isNotNull()
    return F.when(failed, "error").otherwise(got)


#: Checker name to its verdict (true: passed) on rows that ``similarities`` has prepared. More can be added.
CHECKERS: dict[str, Callable[[dict], Column]] = {
    "whisper_similarity": lambda p: F.greatest("similarity_orth", "similarity_phon") >= F.lit(p.get("threshold", THRESHOLD)) if p.get("phonetic", True) else F.col("similarity_orth") >= F.lit(p.get("threshold", THRESHOLD)),
    "first_word": lambda p: first_word(),
    "last_word": lambda p: last_word(),
    "transcription_artifacts": lambda p: artifacts(F.col("transcription"), p.get("artifacts")),
    "reference": lambda p: F.coalesce(F.col("reference_check_status") != "suspicious", F.lit(True)),
}


def check(rows: DataFrame, names=DEFAULT, **params) -> DataFrame:
    """A column checker_<name>_passed for each known name, and ``disputed``: whether any failed. Verdicts that are null don't count."""
    known = [n for n in names if n in CHECKERS]
    out = rows.withColumns({f"checker_{n}_passed": CHECKERS[n](params) for n in known})
    failed = F.lit(False)
    for n in known:
        failed = failed | F.coalesce(~F.col(f"checker_{n}_passed"), F.lit(False))
    return out.withColumn("disputed", failed)


def combine(results: DataFrame, order=DEFAULT, keys=("chapter_key", "sentence_hash")) -> DataFrame:
    """Long results (key, checker, disputed, similarity, reference_check_score, error) to one row a key: disputed if any is, each measure the first
    that isn't null in the order of checkers; results with an error don't count."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in order]), F.col("checker")), F.lit(0)), F.lit(len(order) + 1))
    good = results.where("error is null").withColumn("rank", rank)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c)
    return good.groupBy(*keys).agg(F.bool_or("disputed").alias("disputed"), first("similarity"), first("reference_check_score")).withColumn("similarity_or_one", F.coalesce("similarity", F.lit(1.0)))


def evaluate(row_checker: Column, similarity: Column, threshold: Column, status: Column, passed: Column) -> Column:
    """A verdict from what is stored: by similarity, by reference status, or the stored pass; null where nothing is."""
    return (
        F.when(row_checker == "whisper_similarity", similarity >= threshold)
        .when(row_checker == "reference", F.when(status.isin("ok", "measured"), True).when(status == "suspicious", False))
        .otherwise(passed)
    )


def pivot_results(long: DataFrame, names) -> DataFrame:
    """(chapter_key, sentence_hash, checker, passed) to a column for each checker."""
    wide = long.groupBy("chapter_key", "sentence_hash").pivot("checker", list(names)).agg(F.bool_and("passed"))
    for n in names:
        wide = wide.withColumnRenamed(n, f"checker_{n}_passed")
    return wide


def recalculate(cache: DataFrame) -> DataFrame:
    """Stored rows with their new likeness and what becomes of them: "skipped" for manual and blank ones, "updated" where it moves by 1e-6 or
    more or was missing, else "unchanged". Status stays as it is."""
    skip = F.startswith("transcription", F.lit("[manual]")) | F.col("transcription").isNull() | (F.trim("transcription") == "") | F.col("original_text").isNull() | (F.trim("original_text") == "")
    rows = similarities(cache).withColumn("new_similarity", F.greatest("similarity_orth", "similarity_phon"))
    moved = F.col("similarity").isNull() | (F.abs(F.col("new_similarity") - F.col("similarity")) >= 1e-6)
    action = F.when(F.coalesce(skip, F.lit(True)), "skipped").when(moved, "updated").otherwise("unchanged")
    return rows.withColumn("action", action).withColumn("new_similarity", F.when(F.col("action") == "updated", F.col("new_similarity")).otherwise(F.col("similarity"))).drop("o_form", "t_form")


def action_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def check_counts(rows: DataFrame) -> DataFrame:
    """(checked, disputed, skipped) of rows (action, has_audio, text, error, disputed); one row. Skipped are resolved fresh ones, those without audio or text, and
    those whose transcription failed."""
    skipped = (F.col("action") == "skip") | ~F.col("has_audio") | _blank("text") | F.col("error").isNotNull()
    return rows.agg(F.count_if(~skipped).alias("checked"), F.count_if(~skipped & F.col("disputed")).alias("disputed"), F.count_if(skipped).alias("skipped"))


def command_score(audio: Column, text: Column, command: list[str], timeout: float = 600.0) -> Column:
    """struct<score, payload, error> of an external command, one call a row: it gets ``--audio`` and ``--text-file`` behind its own arguments, and the last line that it
    prints is a JSON object with a score. Another exit code than 0, no output and no score are errors of the row."""
    def one(path: str, words: str) -> tuple[float, str]:
        with tempfile.NamedTemporaryFile("w", encoding="utf-8", suffix=".txt") as f:  # read by the command on the same machine
            f.write(words)
            f.flush()
            done = subprocess.run([*command, "--audio", path, "--text-file", f.name], capture_output=True, text=True, errors="replace", timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"exit code {done.returncode}: {done.stderr.strip() or done.stdout.strip()}")
        if not done.stdout.strip():
            raise RuntimeError("no output")
        last = done.stdout.strip().splitlines()[-1]
        got = json.loads(last)
        if got.get("score") is None:
            raise RuntimeError("no score")
        return float(got["score"]), last

    @F.pandas_udf("struct<score: double, payload: string, error: string>")
    def run(paths: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for p, t in zip(paths, texts, strict=True):
            try:
                rows.append((*one(p, t), None) if p is not None and t is not None else (None, None, "nothing to compare"))
            except Exception as error:  # a row's failure is its own
                rows.append((None, None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(rows, columns=["score", "payload", "error"])

    return run(audio, text)


def reference_check(rows: DataFrame, command: list[str], threshold: float | None = None, audio: str = "path", text: str = "original_text") -> DataFrame:
    """``rows`` with reference_check_score, _threshold, _status and _payload from an external command."""
    limit = F.lit(threshold).cast("double")
    got = rows.withColumn("_r", command_score(F.col(audio), F.col(text), command))
    return got.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_r.score").alias("reference_check_score"), limit.alias("reference_check_threshold"), reference_status(F.col("_r.score"), limit, F.col("_r.error")).alias("reference_check_status"), F.col("_r.payload").alias("reference_check_payload"))
