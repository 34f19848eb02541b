"""Small tools for regular expressions over columns.

Java's classes are ASCII unless ``(?U)`` is set, and Spark's ``regexp_replace`` has no callback; both gaps are closed here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ACUTE = "́"
GRAVE = "̀"
CHUNK_EOF = "[chunk_eof]"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (``trim`` drops spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def replace_each(text: Column, pattern: str, spoken: Callable[[Column], Column]) -> Column:
    """Every match of ``pattern`` replaced by ``spoken(match)``.

    Text between matches and matches alternate, so a split and an extraction by the same pattern are zipped. The
    pattern must not match an empty string; look-arounds are fine, groups must be non-capturing.
    """
    def spliced(parts: Column) -> Column:
        pieces = F.zip_with(F.slice(parts["gaps"], 1, F.size(parts["hits"])), parts["hits"], lambda gap, hit: F.concat(gap, spoken(hit)))
        return F.concat(F.array_join(pieces, ""), F.element_at(parts["gaps"], -1))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("hits"))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.transform(F.array(parts), spliced)[0]).otherwise(text)


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """The table's entry, null where there is none."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def preserve_case(source: Column, replacement: Column) -> Column:
    """Upper case for an upper-case source, a capital for a capitalised one, otherwise as it is."""
    letters = F.lower(source) != F.upper(source)
    first = F.substring(source, 1, 1)
    capital = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.length(replacement)))
    return F.when(letters & (F.upper(source) == source), F.upper(replacement)).when((F.upper(first) == first) & (F.lower(first) != first), capital).otherwise(replacement)


def russian(lang: Column) -> Column:
    """Whether a language tag is Russian; none counts as Russian."""
    return F.lower(F.substring_index(F.coalesce(F.nullif(lang, F.lit("")), F.lit("ru")), "-", 1)) == "ru"
