"""Cleaning, titles, chunk marks and synthesis text: expressions that stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions.patterns import ACUTE, CHUNK_EOF, lookup, replace_each, strip

# Characters that the symbol step maps, by what they become, and those it drops.
DOUBLE_QUOTES = "«»“”„‟″‶"
SINGLE_QUOTES = "‘’‚‛′‵"
DASHES = "‐‑‒–—―−⁃"
DROPPED = "﻿­​‌‍⁠"

# The break each synthesis back end uses between paragraphs, and its price for 1,000 characters.
BREAKS = {"azure": " @BRK#", "edge": " @BRK#", "gemini": " @BRK#", "qwen": " @BRK#", "openai": "   ", "kokoro": "   ", "piper": "."}
PRICES = {"azure": 0.016, "openai:tts-1": 0.015, "openai:tts-1-hd": 0.030, "openai:gpt-4o-mini-tts": 0.003, "qwen": 0.0112, "edge": 0.0, "gemini": 0.0, "kokoro": 0.0, "piper": 0.0}
MAX_CHARS = {"azure": 1800, "gemini": 1800, "qwen": 550, "kokoro": 2000}


def simple_symbols(text: Column) -> Column:
    """Typographic characters to plain ones; anything that is no letter, number, mark of stress or printable ASCII goes."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.translate(t, DOUBLE_QUOTES + SINGLE_QUOTES + DASHES + DROPPED, "`" * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + "-" * len(DASHES))
    t = F.replace(t, F.lit("…"), F.lit("..."))
    t = F.regexp_replace(t, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^\n\t]]", "")
    t = F.regexp_replace(t, r"[^\n\t\x20-\x7E\p{L}\p{N}́]", " ")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), " *\n *", "\n")


def remove_endnotes(text: Column) -> Column:
    """Digit runs that follow a word character or closing punctuation go. A digit is a word character too, so a free-standing
    number keeps its first digit only ("page 12" becomes "page 1"); that is the step's rule."""
    return F.regexp_replace(text, r"""(?U)(?<=[\p{L}\p{N}_.,!?;:"')])\d+""", "")


def remove_reference_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\d+(?:\.\d+)?\]", "")


def newline_mode(text: Column, mode: str, break_string: str, collapse: str = "all") -> Column:
    """Line breaks to ``break_string``: every run ("single"), runs of two or more ("double"), or to spaces ("none").

    ``collapse="all"`` then turns every run of white space into a space (documents of an EPUB, where it also undoes breaks
    made of line ends); ``"spaces"`` only runs of spaces (FB2).
    """
    patterns = {"single": (r"\n+", break_string), "double": (r"\n{2,}", break_string), "none": (r"\n+", " ")}
    if mode not in patterns:
        raise ValueError(f"newline mode {mode!r} is none of {', '.join(patterns)}")
    pattern, by = patterns[mode]
    broken = F.regexp_replace(strip(text), pattern, by.replace("\\", r"\\").replace("$", r"\$"))
    return F.regexp_replace(broken, r"(?U)\s+" if collapse == "all" else " +", " ")


def sanitize_title(title: Column, break_string: str | None = None) -> Column:
    t = F.replace(title, F.lit(break_string), F.lit(" ")) if break_string else title
    return F.regexp_replace(strip(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\s]", "")), r"(?U)\s+", "_")


def document_title(tag_title: Column, text: Column, mode: str) -> Column:
    """"auto": the tag, unless blank or a number of up to three digits, then the first 60 characters; "tag_text"; "first_few"."""
    first = F.substring(text, 1, 60)
    tag = F.coalesce(tag_title, F.lit(""))
    if mode == "auto":
        return F.when((strip(tag) == "") | F.regexp_like(tag, F.lit(r"^[0-9]{1,3}$")), first).otherwise(tag)
    if mode == "tag_text":
        return F.when(strip(tag) == "", F.lit("<blank>")).otherwise(tag)
    if mode == "first_few":
        return first
    raise ValueError(f"title mode {mode!r} is none of auto, tag_text, first_few")


def html_tag_title(html: Column) -> Column:
    """Text of the first of title, h1, h2, h3 that is present, even if it is empty; '' without any."""
    got = [F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1) for tag in ("title", "h1", "h2", "h3")]
    has = [F.regexp_like(html, F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>")) for tag in ("title", "h1", "h2", "h3")]
    chosen = F.when(has[0], got[0]).when(has[1], got[1]).when(has[2], got[2]).when(has[3], got[3]).otherwise("")
    return F.regexp_replace(chosen, r"(?s)<[^>]*>", "")


def has_content(text: Column) -> Column:
    return F.length(strip(text)) > 0


def long_enough(text: Column, least: int = 3) -> Column:
    return F.length(strip(text)) >= least


def meaningful(text: Column) -> Column:
    """Whether anything in the text can be spoken."""
    return F.regexp_like(text, F.lit(r"[\p{L}\p{N}]"))


def has_special_characters(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?U)[^\p{L}\p{N}_\s]"))


def single_letter_lead(text: Column) -> Column:
    """A lower-case first character is capitalised; a text whose first word is a single letter gets a leading dash."""
    first = F.substring(text, 1, 1)
    t = F.when((F.upper(first) != first) & F.regexp_like(first, F.lit(r"\p{Ll}")), F.concat(F.upper(first), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)
    return F.when(F.regexp_like(t, F.lit(r"(?U)^\s*\p{L}(?:\s|$)")), F.concat(F.lit("- "), t)).otherwise(t)


# Chunk marks -----------------------------------------------------------------------------------------------

_EOF = r"(?iU)\s*\[chunk_eof\]\s*"
CLOSERS = "\"'»”’`)]}"


def strip_chunk_marks(text: Column) -> Column:
    return strip(F.regexp_replace(text, _EOF, " "))


def ends_with_boundary(text: Column) -> Column:
    """Whether a text ends in a sentence mark, closers apart, or in the chunk mark."""
    return F.regexp_like(text, F.lit(r"(?iU)(?:[.!?]\s*[\"'»”’`)\]}]*\s*|\[chunk_eof\]\s*)$"))


def ensure_chunk_mark(text: Column) -> Column:
    """A forced end: the chunk mark instead of a final period (also one inside closers)."""
    t = strip(F.regexp_replace(strip(text), r"(?iU)\s*\[chunk_eof\]\s*$", ""))
    t = F.regexp_replace(t, r"(?U)\s*\.?\s*([\"'»”’`)\]}\s]*)$", "$1")
    return F.when(strip(t) == "", "").otherwise(F.concat(F.regexp_replace(t, r"(?U)\s+$", ""), F.lit(CHUNK_EOF)))


def tidy_chunk_marks(text: Column) -> Column:
    """After each chunk mark spaces go and the next character is capitalised."""
    def part(p: Column, i: Column) -> Column:
        t = F.ltrim(p)
        return F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))))

    return F.array_join(F.transform(F.split(text, r"\[chunk_eof\]", -1), part), CHUNK_EOF)


# Synthesis text --------------------------------------------------------------------------------------------


def strip_trailing(text: Column, chars: str = ".") -> Column:
    return F.rtrim(text, F.lit(chars))


def break_parts(text: Column, break_string: str = "@BRK#") -> Column:
    """The spoken parts between breaks; parts without a letter or number are left out."""
    return F.filter(F.transform(F.split(text, "@BRK#" if break_string == "@BRK#" else break_string, -1), strip), meaningful)


def ssml(text: Column, pause_ms: int = 1250, break_string: str = "@BRK#") -> Column:
    escaped = F.replace(F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    return F.replace(escaped, F.lit(break_string), F.lit(f" <break time='{pause_ms}ms' /> "))


def break_string_of(backend: Column) -> Column:
    return lookup(BREAKS, backend)


def tempo_filter(tempo: Column) -> Column:
    """A tempo factor as stages between a half and two, e.g. 3 as ``atempo=2.0,atempo=1.500000``; null for 1 or less than or equal to 0."""
    halves = F.ceil(F.greatest(F.lit(0.0), -F.log2(tempo) - 1e-9)) - 1
    twos = F.ceil(F.greatest(F.lit(0.0), F.log2(tempo) - 1e-9)) - 1
    n = F.greatest(F.lit(0), F.when(tempo < 1, halves).otherwise(twos)).cast("int")
    step = F.when(tempo < 1, 0.5).otherwise(2.0)
    rest = tempo / F.pow(step, n)
    stages = F.concat(F.array_repeat(F.concat(F.lit("atempo="), F.format_string("%.6f", step)), n), F.array(F.concat(F.lit("atempo="), F.format_string("%.6f", rest))))
    return F.when((tempo > 0) & (tempo != 1), F.array_join(stages, ","))


def escape_metadata(text: Column) -> Column:
    r"""Chapter metadata: ``\ ; # =`` escaped, line ends to spaces."""
    return F.replace(F.regexp_replace(text, r"([\\;#=])", r"\\$1"), F.lit("\n"), F.lit(" "))


def chapter_key(title: Column, index: Column) -> Column:
    """``NNNN_Title``; characters that no file system takes become underscores. One builder for all uses."""
    t = F.regexp_replace(title, r"[<>:\"/\\|?*\n\r\t]", "_")
    t = F.replace(strip(F.regexp_replace(t, r"(?U)\s+", " ")), F.lit(" "), F.lit("_"))
    t = F.regexp_replace(t, r"^[ .]+|[ .]+$", "")
    prefix = F.concat(F.lpad(index.cast("string"), 4, "0"), F.lit("_"))
    return F.when(F.coalesce(title, F.lit("")) == "", F.rtrim(prefix, F.lit("_"))).otherwise(F.concat(prefix, F.when(t == "", "untitled").otherwise(t)))


def smb_path(url: Column, mount: str) -> Column:
    """``smb://host/share/path`` under a mount point; null for anything else."""
    rest = F.regexp_extract(url, r"(?i)^smb://[^/]+/(.+)$", 1)
    return F.when(rest != "", F.concat(F.lit(mount.rstrip("/") + "/"), rest))


def delete_sentence(full: Column, sentence: Column) -> Column:
    """The first occurrence goes; three line ends or more become two; null where it isn't found."""
    at = F.instr(full, sentence)
    without = F.concat(F.substring(full, F.lit(1), at - 1), F.substring(full, at + F.length(sentence), F.length(full)))
    return F.when(at > 0, strip(F.regexp_replace(without, "\n{3,}", "\n\n")))


def keep_last_stress(text: Column) -> Column:
    """In every Cyrillic word only the last acute stays."""
    word = rf"[А-Яа-яЁё\-]+(?:{ACUTE}[А-Яа-яЁё\-]*)+"
    return replace_each(text, word, lambda w: F.concat(F.replace(F.substring(w, F.lit(1), F.length(w) - F.length(F.substring_index(w, ACUTE, -1)) - 1), F.lit(ACUTE), F.lit("")), F.lit(ACUTE), F.substring_index(w, ACUTE, -1)))


def plus_to_stress(text: Column) -> Column:
    """``+а`` to ``а́``; other plus signs go; one stress a word stays."""
    t = F.replace(F.regexp_replace(text, r"\+([А-Яа-яЁё])", f"$1{ACUTE}"), F.lit("+"), F.lit(""))
    return keep_last_stress(t)


def strip_stress(text: Column) -> Column:
    return F.replace(text, F.lit(ACUTE), F.lit(""))
