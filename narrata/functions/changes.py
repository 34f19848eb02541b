"""What a step changed, and edits made in review."""

from __future__ import annotations

import re
from difflib import Match, SequenceMatcher, unified_diff

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.functions.patterns import strip

BLOCK = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("operation", "before", "after", "before_context", "after_context")]]))
_TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
_AROUND = 6


class Matcher(SequenceMatcher):
    """The standard matcher without junk, whose longest blocks come from numbered stretches: its own search takes the square of the places of a frequent token (spaces).

    Level ``p`` numbers the stretches of 2 ** p tokens of both sides, equal ones alike, so two stretches of any length are equal if their first and last 2 ** p tokens are.
    """

    small = 4096  #: of pairs of tokens, below which the standard search is quicker

    def __init__(self, a: list[str], b: list[str]):
        super().__init__(None, a, b, autojunk=False)
        number: dict[str, int] = {}
        sides = [np.fromiter((number.setdefault(t, len(number)) for t in x), np.int64, len(x)) for x in (a, b)]
        self._levels = [sides]

    def _level(self, p: int) -> list[np.ndarray]:
        while len(self._levels) <= p:
            width = 1 << (len(self._levels) - 1)
            pairs = [x[: max(0, len(x) - width)] << 32 | x[width:] for x in self._levels[-1]]
            _, ids = np.unique(np.concatenate(pairs), return_inverse=True)
            self._levels.append([ids[: len(pairs[0])], ids[len(pairs[0]) :]])
        return self._levels[p]

    def _stretches(self, n: int, alo: int, ahi: int, blo: int, bhi: int) -> list[np.ndarray]:
        p = n.bit_length() - 1
        rest = n - (1 << p)
        return [x[lo : hi - n + 1] << 32 | x[lo + rest : hi - n + 1 + rest] for x, lo, hi in zip(self._level(p), (alo, blo), (ahi, bhi), strict=True)]

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        """The longest block; of those as long the first in ``a``, then the first in ``b``."""
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        most = min(ahi - alo, bhi - blo)
        if (ahi - alo) * (bhi - blo) <= self.small:
            i, j, n = SequenceMatcher(None, self.a[alo:ahi], self.b[blo:bhi], autojunk=False).find_longest_match()
            return Match(alo + i, blo + j, n)
        x, y = self._levels[0][0][alo:ahi], self._levels[0][1][blo:bhi]
        # the longest run from the starts or ends on is a lower bound, most often the answer
        least = 0
        for same in (x[:most] == y[:most], x[len(x) - most :] == y[len(y) - most :]):
            ends = np.flatnonzero(np.r_[True, ~same, True])
            least = max(least, int(np.diff(ends).max()) - 1)
        found = lambda n: n <= most and np.isin(*self._stretches(n, alo, ahi, blo, bhi)).any()
        step = 1
        while found(least + step):
            least, step = least + step, 2 * step
        while step > 1:
            step //= 2
            if found(least + step):
                least += step
        if not least:
            return Match(alo, blo, 0)
        ours, theirs = self._stretches(least, alo, ahi, blo, bhi)
        i = int(np.isin(ours, theirs).argmax())
        return Match(alo + i, blo + int((theirs == ours[i]).argmax()), least)


def blocks(before: str, after: str) -> list[dict]:
    """Changed stretches of words, white space and single signs, with six tokens around; unchanged stretches count in ``index``."""
    a, b = _TOKEN.findall(before), _TOKEN.findall(after)
    text = lambda tokens, lo, hi: "".join(tokens[max(0, lo) : hi]).strip()
    return [
        {"index": n, "operation": op, "before": text(a, i, j), "after": text(b, k, m), "before_context": text(a, i - _AROUND, j + _AROUND), "after_context": text(b, k - _AROUND, m + _AROUND)}
        for n, (op, i, j, k, m) in enumerate(Matcher(a, b).get_opcodes(), 1)
        if op != "equal"
    ]


@F.pandas_udf(BLOCK)
def change_blocks(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [] if x == y else blocks(x, y) for x, y in zip(before, after, strict=True)])


@F.pandas_udf(T.StringType())
def line_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """A unified diff by lines; empty without a change."""
    def one(x, y):
        if x is None or y is None:
            return None
        out = "".join(unified_diff(x.splitlines(keepends=True), y.splitlines(keepends=True), "before", "after", lineterm=""))
        return out + "\n" if out and not out.endswith("\n") else out

    return pd.Series([one(x, y) for x, y in zip(before, after, strict=True)])


def change_report(title: Column, before: Column, after: Column, found: Column) -> Column:
    """The blocks as Markdown."""
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), c, F.lit("\n"))
    quoted = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    head = F.concat(
        F.lit("# "), title, F.lit("\n\n"), line("changed", F.when(before == after, "no").otherwise("yes")), line("before_chars", F.length(before).cast("string")),
        line("after_chars", F.length(after).cast("string")), line("change_blocks", F.size(found).cast("string")), F.lit("\n"),
    )
    each = F.transform(found, lambda b: F.concat(F.lit("### "), b["index"].cast("string"), F.lit(". "), b["operation"], F.lit("\n\n"), *[line(k, quoted(b[k])) for k in ("before", "after", "before_context", "after_context")]))
    return F.concat(head, F.when(F.size(found) == 0, F.lit("No textual changes.\n")).otherwise(F.concat(F.lit("## Blocks\n\n"), F.array_join(each, "\n"))))


def collapse_repeated_paragraphs(text: Column) -> Column:
    """Of equal paragraphs next to each other one stays; blank ones go; a final line end stays."""
    parts = F.filter(F.split(strip(text), r"\n\s*\n+", -1), lambda p: strip(p) != "")
    kept = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.get(parts, i - 1).alias("before"))), lambda x: ~strip(x["p"]).eqNullSafe(strip(x["before"])))
    joined = F.array_join(F.transform(kept, lambda x: x["p"]), "\n\n")
    return F.when(text == "", text).otherwise(F.concat(joined, F.when(F.endswith(text, F.lit("\n")), "\n").otherwise("")))


_CLOSERS = "\"'»“”‘’)\\]{}"
_FINAL = re.compile(r"[\"'»“”‘’)\]}]*([.!?])$")


def edited(full: str, old: str, new: str) -> str | None:
    """``full`` with the first ``old`` replaced by ``new``; None where it isn't found.

    Closers that stand before the final mark in the text but not in ``old`` are found too and kept. Spaces that would
    meet at the seams become one.
    """
    at, length = full.find(old), len(old)
    if at < 0:
        m = _FINAL.search(old)
        if not m:
            return None
        body = old[: m.start()]
        got = re.search(f"{re.escape(body)}[{_CLOSERS}]*{re.escape(m[1])}", full)
        if not got:
            return None
        at, length = got.start(), len(got[0])
        extra = got[0][len(body) : -1]
        if extra:
            end = _FINAL.search(new)
            new = (new[: end.start()] if end else new) + extra + (end[1] if end else "")
    head, tail = full[:at], full[at + length :]
    if head[-1:] in (" ", "\t") and new[:1] in (" ", "\t"):
        new = new.lstrip(" \t")
    if tail[:1] in (" ", "\t") and new[-1:] in (" ", "\t"):
        new = new.rstrip(" \t")
    return head + new + tail


def collapsed(text: str) -> str:
    """``collapse_repeated_paragraphs`` of one string."""
    kept: list[str] = []
    for p in re.split(r"\n\s*\n+", text.strip()):
        if p.strip() and (not kept or p.strip() != kept[-1].strip()):
            kept.append(p)
    return "\n\n".join(kept) + ("\n" if text.endswith("\n") else "")


@F.pandas_udf(T.StringType())
def apply_edit(full: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """The edited text without repeated neighbours; null where the old text isn't found."""
    def one(f, o, n):
        got = None if None in (f, o, n) else edited(f, o, n)
        return None if got is None else collapsed(got)

    return pd.Series([one(*x) for x in zip(full, old, new, strict=True)])
