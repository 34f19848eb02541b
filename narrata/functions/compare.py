"""Text against transcription: comparison form, likeness, sound keys and boundary words."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bases() -> tuple[str, str]:
    """Letters with marks, and what is left of each: all of the alphabetic planes up to U+2FFF, by canonical decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x3000),):
        full = unicodedata.normalize("NFD", chr(code))
        bare = "".join(c for c in full if unicodedata.category(c) != "Mn")
        if full != chr(code) and len(bare) == 1:
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _bases()


def comparison_form(text: Column) -> Column:
    """Lower-case letters and single spaces: marks, digits, underscores and all else go. "й" counts as "и", "ё" as "е"."""
    t = F.replace(text, F.lit("+"), F.lit(""))
    # in ASCII there are no marks; signs, digits and spaces next to each other become one space
    t = F.lower(F.when(F.octet_length(text) == F.length(text), t).otherwise(F.regexp_replace(F.translate(t, _MARKED, _BARE), r"\p{Mn}", "")))
    return F.trim(F.regexp_replace(t, r"[[^\p{L}\p{N}]0-9]+", " "))


def comparison_form_of(text: str) -> str:
    """The same for one string, by full decomposition."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.replace("+", "")) if unicodedata.category(c) != "Mn").lower()
    return " ".join(re.sub(r"[^\w ]|[0-9_]", " ", bare).split())


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column | str, b: Column | str) -> Column:
    """Matching-block ratio of two strings, 1 for two empty ones. In a second argument of 200 characters or more, frequent
    characters are no anchors, and the order of arguments matters; both belong to the measure.

    Equal strings, and a shorter one that stands whole in the other (it is the longest block; beyond 200 characters that is sure only where it
    starts the other, as every anchor off the diagonal has one on it that comes first) need no Python; the rest goes to one Arrow UDF.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n, m = F.length(a), F.length(b)
    whole = F.startswith(a, b) | F.startswith(b, a) | ((m < 200) & (F.contains(a, b) | F.contains(b, a)))
    plain = F.when(a == b, F.lit(1.0)).when(whole, 2.0 * F.least(n, m) / F.greatest(n + m, F.lit(1)))
    open_ = plain.isNull()
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.coalesce(plain, _ratio(F.when(open_, a), F.when(open_, b))))


_CYRILLIC = "[\u0400-\u04ff]"
_VOWELS, _CONSONANTS = "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ"


def sound_key(word: Column) -> Column:
    """How a word in comparison form sounds at its edges: э as е, signs before vowels silent, и before е silent after a
    vowel or at the start, б as п at the start, voiced consonants voiceless at the end or before a consonant."""
    k = F.replace(word, F.lit("э"), F.lit("е"))
    k = F.regexp_replace(k, f"[ьъ](?=[{_VOWELS}])", "")
    k = F.regexp_replace(k, f"(^|[{_VOWELS}])и(?=е)", "$1")
    k = F.regexp_replace(k, "^б", "п")
    for voiced, voiceless in zip("бвгджз", "пфктшс", strict=True):
        k = F.regexp_replace(k, f"{voiced}(?=[{_CONSONANTS}]|$)", voiceless)
    # the rules touch Cyrillic letters only
    return F.when(F.contains(word, F.lit(" ")) | ~F.regexp_like(word, F.lit(_CYRILLIC)), word).otherwise(k)


def phonetic_form(form: Column) -> Column:
    """Sound keys of the words of a text in comparison form. Only Cyrillic letters change."""
    return F.when(F.regexp_like(form, F.lit(_CYRILLIC)), F.array_join(F.transform(F.split(form, " "), sound_key), " ")).otherwise(form)


def boundary_words_match(a: Column, b: Column, lemmas_a: Column | None = None, lemmas_b: Column | None = None) -> Column:
    """Two words in comparison form: equal, a lemma in common (arrays of lemmas, where there is a dictionary), or the same sound."""
    same = (a == b) | (sound_key(a) == sound_key(b))
    if lemmas_a is not None and lemmas_b is not None:
        sounds = lambda xs: F.transform(xs, sound_key)
        same = same | F.coalesce(F.arrays_overlap(lemmas_a, lemmas_b) | F.arrays_overlap(sounds(lemmas_a), sounds(lemmas_b)), F.lit(False))
    return F.when((a == "") | (b == ""), a == b).otherwise(same)


def starts_with_word(word: Column, form: Column) -> Column:
    """Whether a transcription (comparison form) starts with a word: as text, by sound, or in its first word."""
    first = F.substring_index(form, " ", 1)
    hit = F.startswith(form, word) | F.startswith(phonetic_form(form), sound_key(word)) | boundary_words_match(word, first)
    return F.when((word == "") | (form == ""), word == form).otherwise(hit)


def ends_with_word(word: Column, form: Column) -> Column:
    last = F.substring_index(form, " ", -1)
    hit = F.endswith(form, word) | F.endswith(phonetic_form(form), sound_key(word)) | boundary_words_match(word, last)
    return F.when((word == "") | (form == ""), word == form).otherwise(hit)
