"""Sentences, voices and sizes: how a chapter becomes chunks.

Splitting at sentence marks is a column expression. Packing to a size, quoted voices and the safe split are folds over a text's
own sentences; each runs as one Arrow UDF over the text and returns an array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.functions.clean import CLOSERS
from narrata.functions.patterns import CHUNK_EOF, strip
from narrata.functions.slices import each

LEAST_CHARS = 3
_MARK = re.compile(r"\s*\[chunk_eof\]\s*", re.I)
_SENTENCE = re.compile(r"(?<=[.!?]) +")
_CUT = r"(?iU)\s*\[chunk_eof\]\s*|(?<=[.!?]) +"
CHUNK = T.StructType([T.StructField("text", T.StringType()), T.StructField("voice", T.StringType())])


def sentences(text: Column, least: int = 1) -> Column:
    """Parts between chunk marks and after sentence marks, stripped, of at least ``least`` characters."""
    return F.filter(F.transform(F.split(text, _CUT, -1), strip), lambda s: F.length(s) >= least)


def sentences_of(text: str) -> list[str]:
    parts = (s.strip() for part in _MARK.split(text) for s in _SENTENCE.split(part.strip()))
    return [s for s in parts if s]


def sentences_and_separators(text: Column) -> Column:
    """struct<sentences, separators>: what follows each sentence, a chunk mark or a space."""
    cuts = F.regexp_extract_all(text, F.lit(f"({_CUT})"), F.lit(1))
    kinds = F.transform(cuts, lambda c: F.when(F.contains(F.lower(c), F.lit(CHUNK_EOF)), F.lit(f" {CHUNK_EOF} ")).otherwise(F.lit(" ")))
    pieces = F.split(text, _CUT, -1)
    pairs = F.filter(F.arrays_zip(pieces.alias("s"), F.concat(kinds, F.array(F.lit(""))).alias("sep")), lambda p: strip(p["s"]) != "")
    return F.struct(pairs["s"].alias("sentences"), pairs["sep"].alias("separators"))


def rejoin_backticks(parts: list[str]) -> list[str]:
    """A back-tick that closes a sentence's own but opens the next part goes back to it."""
    out: list[str] = []
    held = None
    for p in parts:
        if held is not None and held.count("`") % 2 and re.match(r"`(?:[ \t\n]|$)", p):
            out.append(held + "`")
            held = None
            p = p[1:].lstrip()
            if p:
                out.append(p)
            continue
        if held is not None:
            out.append(held)
        held = p
    return out if held is None else [*out, held]


# Voices ----------------------------------------------------------------------------------------------------

PAIRS = {"«": "»", "“": "”", "‘": "’", '"': '"'}
_TAIL = r"[\s.,!?;:\-…]*"


def rejoin_closers(parts: list[str]) -> list[str]:
    """A part that is only a closing quote and marks belongs to the part before it."""
    out: list[str] = []
    for p in parts:
        if out and re.fullmatch(rf"[»”’\"]{_TAIL}", p.strip()):
            out[-1] = out[-1].rstrip() + p.strip()
        else:
            out.append(p)
    return out


def spoken_sentences(text: str, least: int = LEAST_CHARS) -> list[str]:
    return [s for s in rejoin_closers(sentences_of(text)) if len(s.strip()) >= least]


@dataclass(frozen=True)
class Quote:
    """Where a sentence's opening quote is closed: inside it, in a later sentence, or not at all."""

    last: int  #: index of the sentence that closes it
    inner: str | None = None  #: what is quoted, if one sentence is a quotation as a whole
    voiced: str | None = None  #: the closing sentence up to the quote, if more follows
    rest: str | None = None  #: what follows


def _quote(parts: list[str], at: int) -> Quote | None:
    t = parts[at].strip()
    if len(t) < 2 or t[0] not in PAIRS or t[1] in ".!?,;: \t":
        return None
    close = PAIRS[t[0]]
    if close in t[1:]:
        end = t.rfind(close)
        after = t[end + 1 :].strip()
        if not re.fullmatch(_TAIL, after):
            return None
        return Quote(at, t[1:end].strip() + (after[0] if after[:1] in tuple(".!?…") else ""))
    for k in range(at + 1, len(parts)):
        s = parts[k].strip()
        if close in s:
            end = s.index(close) + 1
            marks = re.match(_TAIL, s[end:])[0]
            rest = s[end + len(marks) :].strip()
            return Quote(k, None, s[:end] + marks.rstrip(), rest) if rest else Quote(k)
    return None


def voiced(text: str, voice: str | None) -> list[tuple[str, str | None]]:
    """Sentences with the voice that speaks them: quotations have ``voice``, everything else none."""
    parts = spoken_sentences(text)
    out: list[tuple[str, str | None]] = []
    at = 0
    while at < len(parts):
        q = _quote(parts, at) if voice else None
        if q is None:
            out.append((parts[at], None))
        elif q.inner is not None:
            inner = spoken_sentences(q.inner)
            out += [(s, voice) for s in (inner if len(inner) > 1 else [parts[at]])]
        else:
            out += [(s, voice) for s in parts[at : q.last]]
            out += [(q.voiced, voice), (q.rest, None)] if q.rest else [(parts[q.last], voice)]
        at = q.last + 1 if q else at + 1
    return out


def voiced_chunks(text: Column, voice: str | None) -> Column:
    """array<struct<text, voice>>. Without a second voice this needs no Python but for stray closing quotes."""
    @F.pandas_udf(T.ArrayType(CHUNK))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"text": a, "voice": b} for a, b in voiced(t, voice)], na_action="ignore")

    return run(text)


def display_chunks(text: Column) -> Column:
    """The sentences that a reader is shown: those of a text with a second voice, whether there is one or not."""
    return F.transform(voiced_chunks(text, "shown"), lambda c: c["text"])


def plain_chunks(text: Column) -> Column:
    """The same without a second voice, as an expression: parts of three characters or more, stray closers rejoined."""
    parts = sentences(text)
    stray = F.exists(parts, lambda p: F.regexp_like(p, F.lit(rf"^[»”’\"]{_TAIL}$")))
    fold = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, p: F.when((F.size(a) > 0) & F.regexp_like(p, F.lit(rf"^[»”’\"]{_TAIL}$")), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), p)))).otherwise(F.concat(a, F.array(p))),
    )
    return F.filter(F.when(stray, fold).otherwise(parts), lambda p: F.length(p) >= LEAST_CHARS)


# Sizes -----------------------------------------------------------------------------------------------------

# Where an over-long sentence is cut, best first; the rightmost in reach counts.
CUTS = ("。", "！", "？", ". ", "! ", "? ", "；", ";", "，", ",", "：", ":", "）", ")", "]", "】", "}", "」", "』", "、", "—", "-", "–", " ")


def _unmarked(text: str) -> str:
    return _MARK.sub(" ", text).strip()


def cut_sentence(text: str, most: int) -> Iterator[str]:
    """Pieces of at most ``most`` characters."""
    if most < 5:
        yield from (text[i : i + most] for i in range(0, len(text), most))
        return
    while len(text) > most:
        head = text[:most]
        at = next((head.rfind(c) + len(c) for c in CUTS if c in head), most)
        yield _unmarked(text[:at])
        text = text[at:]
    if text:
        yield text


def sized(text: str, most: int) -> list[str]:
    """Sentences packed into pieces of at most ``most`` characters; a chunk mark always ends one."""
    if most <= 0:
        raise ValueError("a size limit is positive")
    out: list[str] = []
    for part in [p for p in (_unmarked(p) for p in _MARK.split(text)) if p]:
        open_ = ""
        for s in sentences_of(part):
            joined = f"{open_} {s}" if open_ else s
            if len(joined) <= most:
                open_ = joined
                continue
            if open_:
                out.append(open_)
            *whole, open_ = list(cut_sentence(s, most)) if len(s) > most else [s]
            out += whole
        if open_:
            out.append(open_)
    return [p for p in map(_unmarked, out) if p]


def sized_chunks(text: Column, most: int) -> Column:
    return each(text, lambda t: sized(t, most), T.ArrayType(T.StringType()))


def packed(items: Column, most: int, joiner: str = " ") -> Column:
    """An array of strings packed greedily, in order, into strings of at most ``most`` characters, as an expression."""
    def add(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        fits = (F.size(a) > 0) & (F.length(F.coalesce(last, F.lit(""))) + len(joiner) + F.length(x) <= most)
        return F.when(fits, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(last, F.lit(joiner), x)))).otherwise(F.concat(a, F.array(x)))

    # element_at fails on an empty array, so the fold starts with the first item
    rest = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    return F.when(F.size(items) > 0, F.aggregate(rest, F.slice(items, 1, 1), add)).otherwise(F.array().cast("array<string>"))


def batches(costs: list[int], budget: int, per_item: int = 0, per_call: int = 0) -> list[list[int]]:
    """Positions packed in order so that ``per_call`` and each item's cost with ``per_item`` stay within a budget; a larger item goes alone."""
    out: list[list[int]] = []
    used = 0
    for i, c in enumerate(costs):
        c += per_item
        if out and used + c <= budget:
            out[-1].append(i)
            used += c
        else:
            out.append([i])
            used = per_call + c
    return out


def merged_small(parts: list[str], most: int) -> list[str]:
    """Neighbouring model chunks joined by a blank line while one is under 60 % of the limit (1,200 at least) and both fit in 135 % of it."""
    small, cap = max(1200, int(most * 0.6)), max(most, int(most * 1.35))
    out: list[str] = []
    for p in parts:
        if out and (len(out[-1]) < small or len(p) < small) and len(out[-1]) + 2 + len(p) <= cap:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


# Safe split ------------------------------------------------------------------------------------------------

# Where a long sentence may be parted, best first.
PARTINGS = tuple(
    re.compile(p, f)
    for p, f in (
        (r"(?<=[.!?])\s+(?=[А-ЯЁA-Z«\"])", 0),
        (r"[;:](?=\s|$)", 0),
        (r"(?<=[,;])\s+(?=(?:а|но|однако)\b)|(?<=[,;])\s+(?=и\s+(?!(?:более|даже|тем|при|всё|всего|ещё|только|притом|при этом)\b))", re.I),
        (r",\s+(?=(?:а также|однако|но|зато|поэтому|причем|притом|при этом|затем|потом)\b)", re.I),
        (r",\s+(?=(?:котор(?:ый|ая|ое|ые|ого|ому|ым|ых|ую|ой|ою)|обосновывающ\w*|существующ\w*|позволяющ\w*|делающ\w*|создающ\w*)\b)", re.I),
        (r",(?=\s|$)", 0),
        (r"\s-\s", 0),
        (r" ", 0),
    )
)
TRIM = " \t\r\n,;:-–—"
SHORTEST, FRAGMENT = 12, 24
_BOUNDARY = re.compile(rf"(?:[.!?]\s*[{re.escape(CLOSERS)}]*\s*|\[chunk_eof\]\s*)$", re.I)


def _sound(part: str) -> bool:
    return len(part) >= FRAGMENT or len(part.split()) >= 2


def may_part(left: str, right: str) -> bool:
    """Both sides long enough; the left doesn't end in a short word; the right doesn't go on in lower-case Cyrillic."""
    if not left or not right or not _sound(left) or not _sound(right):
        return False
    if not _BOUNDARY.search(left) and len(left.split()[-1].strip(".,!?;:'\"»«`")) <= 3:
        return False
    first = next((c for c in right if c.isalpha()), "")
    return not ("Ѐ" <= first <= "ӿ" and first.islower())


def _part(text: str, most: int) -> tuple[str, str] | None:
    """The two sides at the best place within the limit; None where no place will do."""
    least, reach = max(20, int(most * 0.45)), text[: most + 1]
    for pattern in PARTINGS:
        for at in sorted((m.end() for m in pattern.finditer(reach) if m.end() >= least), reverse=True):
            sides = text[:at].rstrip(TRIM), text[at:].lstrip(TRIM)
            if may_part(*sides):
                return sides
    sides = text[:most].rstrip(TRIM), text[most:].lstrip(TRIM)
    return sides if may_part(*sides) else None


def _capitalised(text: str) -> str:
    m = re.match(r"([^\W\d_])|[^\w]*?([^\W\d_])", text)
    at = m.end() - 1 if m else -1
    return text[:at] + text[at].upper() + text[at + 1 :] if at >= 0 else text


def _forced(text: str) -> str:
    """A forced end: chunk mark for a final period, also inside closers."""
    body = text.rstrip()
    tail = body[len(body.rstrip(CLOSERS)) :]
    body = body[: len(body) - len(tail)].rstrip()
    return f"{(body.removesuffix('.').rstrip() + tail).rstrip()}{CHUNK_EOF}"


def parted(sentence: str, most: int) -> list[str]:
    out, rest = [], sentence.strip()
    while len(rest) > most and (sides := _part(rest, most)):
        out.append(_forced(sides[0]))
        rest = _capitalised(sides[1].lstrip()).strip()
    return [*out, rest if _BOUNDARY.search(rest) else f"{rest}."] if rest else out


def join_short(parts: list[str], most: int) -> list[str]:
    """Sentences under 12 characters join the one before, if both fit, or else the one after."""
    out: list[str] = []
    queue = list(parts)
    while queue:
        s = queue.pop(0)
        bare = s if s[-1:] in ("!", "?") else _unmarked(s).rstrip(".").rstrip()
        if len(s) >= SHORTEST:
            out.append(s)
        elif out and len(out[-1]) + 1 + len(s) <= most:
            out[-1] += f" {s}" if bare is s else f" {bare}."
        elif queue:
            out.append(f"{bare} {queue.pop(0)}")
        else:
            out.append(s)
    return out


def safe_split(text: str, most: int = 180, comma_as_period: bool = False) -> str:
    """Sentences of at most ``most`` characters where they can be parted; paragraphs and their separators stay."""
    if most < 40:
        raise ValueError("a safe length is 40 or more")
    text = re.sub(r";\s*", ". ", text)
    if comma_as_period:
        text = re.sub(r",\s*", ". ", text)

    def paragraph(p: str) -> str:
        compact = " ".join(p.split())
        found = sentences_of(compact) if compact else []
        return " ".join(join_short([x for s in found or ([compact] if compact else []) for x in parted(s, most)], most)).strip()

    return "".join(p if re.fullmatch(r"\n\s*\n+", p) else paragraph(p) for p in re.split(r"(\n\s*\n+)", text) if p).strip()


def safely_split(text: Column, most: int = 180, comma_as_period: bool = False) -> Column:
    return each(text, lambda t: safe_split(t, most, comma_as_period), T.StringType())
