"""Plain-Python parts against models and invariants, and expressions against the standard library."""

import random
import re
import unicodedata
from difflib import SequenceMatcher
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from narrata.functions import changes, clean, compare, numerals, russian, signal, splitting
from narrata.operators import chunks as ch
from narrata.operators import steps
from narrata.plans import fixtures as fx

TEXTS = ["", " ", "Hello. World!", "a [12] b[3.4].", "page 12 x9 (3)", "«Да» — он…", "A. B! C? [chunk_eof] d", "\r\n x \x0b y", "Ёлка й é ñ Å ß Ǖ", "!!! ???", "1\n2\n\n3\n\n\n4", "tab\tx  y", "x" * 300 + ". " + "y z " * 90]


def column(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in rows.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


def test_reference_numbers_and_endnotes_as_in_re(spark):
    assert column(spark, TEXTS, clean.remove_reference_numbers) == [re.sub(r"\[\d+(?:\.\d+)?\]", "", t) for t in TEXTS]
    assert column(spark, TEXTS, clean.remove_endnotes) == [re.sub(r"""(?<=[\w.,!?;:"')])\d+""", "", t) for t in TEXTS]


def test_symbols_as_by_category(spark):
    def one(t):
        out = []
        for c in t.replace("\r\n", "\n").replace("\r", "\n"):
            if c in clean.DROPPED:
                continue
            c = "`" if c in clean.DOUBLE_QUOTES else "'" if c in clean.SINGLE_QUOTES else "-" if c in clean.DASHES else "..." if c == "…" else c
            kind = unicodedata.category(c[0])
            keep = len(c) > 1 or c in "\n\t́" or " " <= c <= "~" or kind[0] in "LN"
            out.append(c if keep else " " if kind[0] not in "C" else "")
        return re.sub(" *\n *", "\n", re.sub("[ \t]+", " ", "".join(out)))

    texts = [*TEXTS, "".join(map(chr, range(0x20, 0x500))), "  　x﻿​̀́"]
    assert column(spark, texts, clean.simple_symbols) == [one(t) for t in texts]


def test_hash_is_of_the_stripped_text(spark):
    assert column(spark, TEXTS, ch.chunk_hash) == [sha256(t.strip().encode()).hexdigest()[:16] for t in TEXTS]


def test_sentences_expression_and_function_agree(spark):
    assert column(spark, TEXTS, splitting.sentences) == [splitting.sentences_of(t) for t in TEXTS]
    assert column(spark, TEXTS, splitting.plain_chunks) == [[a for a, _ in splitting.voiced(t, None)] for t in TEXTS]


def test_comparison_form_expression_and_function_agree(spark):
    texts = [*TEXTS, "".join(map(chr, range(0x20, 0x600))), "Αθήνα ἀρχή"]
    assert column(spark, texts, compare.comparison_form) == [compare.comparison_form_of(t) for t in texts]


def test_similarity_is_the_matching_block_ratio(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("abc d") for _ in range(r.randrange(260))), "".join(r.choice("abc d") for _ in range(r.randrange(260)))) for _ in range(40)]
    got = [x["s"] for x in spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "i int, a string, b string").select("i", compare.similarity("a", "b").alias("s")).orderBy("i").collect()]
    assert got == pytest.approx([1.0 if not a and not b else SequenceMatcher(None, a, b).ratio() for a, b in rows])


@given(st.text(alphabet="abc .!?,;\n«»[]", max_size=300), st.integers(1, 80))
@settings(max_examples=200, deadline=None)
def test_sized_pieces_keep_everything_and_stay_in_size(text, most):
    pieces = splitting.sized(text, most)
    assert all(0 < len(p) <= most for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())


@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=9), max_size=12), st.integers(9, 30))
@settings(max_examples=25, deadline=None)
def test_batches_keep_order_and_budget(items, budget):
    costs = [len(i) for i in items]
    got = splitting.batches(costs, budget)
    assert [i for b in got for i in b] == list(range(len(items)))
    assert all(sum(costs[i] for i in b) <= budget for b in got)


def test_packed_expression(spark):
    rows = spark.createDataFrame([(["aa", "bb", "cccc", "d"],), ([],)], "x array<string>")
    assert [r["p"] for r in rows.select(splitting.packed(F.col("x"), 5).alias("p")).collect()] == [["aa bb", "cccc", "d"], []]


def test_voices():
    assert splitting.voiced("«Да. Нет.» Он ушёл.", "v") == [("«Да.", "v"), ("Нет.»", "v"), ("Он ушёл.", None)]
    assert splitting.voiced('"Quite so." She left.', None) == [('"Quite so." She left.', None)]
    assert splitting.voiced("«Куда идёшь? Домой иду!»", "v") == [("«Куда идёшь?", "v"), ("Домой иду!»", "v")]
    assert splitting.voiced('". Narrator goes on.', "v")[0][1] is None
    got = splitting.voiced('«Начало речи. [chunk_eof] Конец речи» и рассказ дальше.', "v")
    assert [v for _, v in got] == ["v", "v", None] and got[-1][0] == "и рассказ дальше."
    assert splitting.rejoin_closers(["Кто там?", "»."]) == ["Кто там?»."]
    assert splitting.rejoin_backticks(["a `b.", "` c"]) == ["a `b.`", "c"]


def test_safe_split_keeps_paragraphs_and_limits():
    text = ("word " * 60).strip() + ".\n\nShort one here."
    out = splitting.safe_split(text, 80)
    assert "\n\n" in out and all(len(s) <= 80 + len("[chunk_eof]") for s in splitting.sentences_of(out))
    with pytest.raises(ValueError):
        splitting.safe_split("x", 10)


@pytest.mark.parametrize(("n", "words"), [(0, "ноль"), (21, "двадцать один"), (100, "сто"), (1000, "одна тысяча"), (2002, "две тысячи два"), (1_000_001, "один миллион один"), (-5, "минус пять")])
def test_cardinals(n, words):
    assert numerals.cardinal(n) == words


@pytest.mark.parametrize(("n", "form", "words"), [
    (3, dict(case="g"), "третьего"), (40, {}, "сороковой"), (100, {}, "сотый"), (200, {}, "двухсотый"), (1000, {}, "тысячный"), (21000, {}, "двадцатиоднотысячный"), (1917, dict(case="p"), "тысяча девятьсот семнадцатом"),
    (2, dict(number="pl", case="g"), "вторых"), (7, dict(gender="f", case="a"), "седьмую"), (0, {}, "нулевой"), (6, {}, "шестой"), (90, {}, "девяностый"), (1_000_000, {}, "миллионный"),
])
def test_ordinals(n, form, words):
    assert numerals.ordinal(n, **form) == words


def test_decimals_and_agreement():
    assert numerals.decimal("3.14") == "три целых четырнадцать сотых"
    assert numerals.decimal("-1.5") == "минус одна целая пять десятых"
    assert russian.speak_numbers("2 главы и 5 домов", {"главы": ("f", "n")}) == "две главы и пять домов"
    assert russian.speak_numbers("1 глава") == "первая глава"
    assert russian.speak_numbers("1" * 30) == "1" * 30


def test_roman_values_of_all_numerals(spark):
    def roman(n):
        out = ""
        for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
            out += s * (n // v)
            n %= v
        return out

    numbers = list(range(1, 4000, 7))
    assert column(spark, [roman(n) for n in numbers], russian.roman_value) == numbers
    two = [n for n in numbers if len(roman(n)) > 1]
    assert column(spark, [roman(n) for n in two], russian.roman_numerals) == [numerals.ordinal(n) for n in two]


def test_inline_overrides_and_stress(spark):
    assert column(spark, ["Тест=тэст, b = c,bad"], russian.inline_overrides) == [{"тест": "тэст", "b": "c"}]
    rows = spark.createDataFrame([("замок", [1])], "w string, p array<int>")
    assert rows.select(russian.stress_at(F.col("w"), F.col("p")).alias("o")).first()["o"] == f"за{fx.A}мок"


def test_steps_registry(spark):
    assert steps.resolve(" RU_time , numbers_ru") == ["ru_time", "ru_numbers"]
    with pytest.raises(ValueError):
        steps.resolve("tts_pronounce")
    with pytest.raises(ValueError):
        steps.resolve("ru_numbers,ru_time")
    assert steps.signature("ru_numbers", steps.Conf()) != steps.signature("ru_numbers", steps.Conf(safe_max_chars=99))
    rows = spark.createDataFrame([("3 дома", "ru"), ("3 houses", "en")], "t string, l string")
    assert [r["o"] for r in rows.select(steps.chain(F.col("t"), "ru_numbers", F.col("l")).alias("o")).collect()] == ["три дома", "3 houses"]


def test_change_blocks_and_report(spark):
    got = changes.blocks("one two three", "one 2 three")
    assert [(b["index"], b["operation"], b["before"], b["after"]) for b in got] == [(2, "replace", "two", "2")]
    rows = spark.createDataFrame([("a b", "a c"), ("x", "x")], "a string, b string").withColumn("c", changes.change_blocks("a", "b"))
    out = [r["r"] for r in rows.select(changes.change_report(F.lit("T"), F.col("a"), F.col("b"), F.col("c")).alias("r")).collect()]
    assert "- change_blocks: 1" in out[0] and "No textual changes." in out[1]


@given(st.lists(st.sampled_from(["a", "b", " a ", "", "c d"]), max_size=8))
@settings(max_examples=50, deadline=None)
def test_collapsed_is_idempotent(parts):
    once = changes.collapsed("\n\n".join(parts))
    assert changes.collapsed(once).strip() == once.strip()


def test_collapse_expression_and_function_agree(spark):
    texts = ["a\n\na\n\nb", "a\n \n\na\n", "", "x", "a\n\nb\n\na", "\n\n"]
    assert column(spark, texts, changes.collapse_repeated_paragraphs) == [changes.collapsed(t) if t else t for t in texts]


# Sound


def tone(seconds, rate=8000, hz=220, level=8000):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.int16)[:, None]


def test_wave_round_trip_and_formats():
    import struct

    w = signal.read_wave(fx.wave(0.5))
    assert w.seconds == 0.5 and (signal.samples_of(w) == tone(0.5)).all()
    head = lambda kind, bits, data: b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, kind, 1, 8000, 8000 * bits // 8, bits // 8, bits) + b"LIST\x03\0\0\0abc\0data" + struct.pack("<I", len(data)) + data
    assert signal.samples_of(signal.read_wave(head(3, 32, struct.pack("<3f", 0.5, 2.0, -2.0)))).ravel().tolist() == [16383, 32767, -32768]
    assert signal.samples_of(signal.read_wave(head(1, 32, struct.pack("<2i", 1 << 20, -1)))).ravel().tolist() == [16, -1]
    assert signal.samples_of(signal.read_wave(head(1, 24, b"\0\0\1"))) is None
    assert signal.read_wave(b"RIFFxxxxWAVE") is None and signal.read_wave(None) is None


def test_offset_fades_and_silence():
    x = tone(0.1) + np.int16(500)
    assert abs(signal.remove_offset(x).mean()) < 1
    y = signal.fade(x, 100, True, True)
    assert y[0, 0] == 0 and y[-1, 0] == 0 and (y[200:400] == x[200:400]).all()
    quiet = np.concatenate([tone(0.2), np.zeros((8000, 1), np.int16)])
    assert len(signal.trim_silence(quiet, 8000)) == 1600 + 1600
    assert len(signal.trim_silence(np.zeros((100, 1), np.int16), 8000)) == 100


def test_crossfade_and_join_lengths():
    a, b = tone(0.5), tone(0.25)
    assert len(signal.crossfade(a, b, 240)) == len(a) + len(b) - 240
    assert len(signal.join([a, b, a], 8000)) == 2 * len(a) + len(b) - 2 * 240
    assert (signal.join([a], 8000, signal.Join(offset=False)) == a).all()
    assert len(signal.join([a, b], 8000, signal.Join(crossfade_ms=0, gap_ms=100))) == len(a) + len(b) + 800
    assert signal.join([], 8000).shape == (0, 1)


def test_preambles():
    rate = 24000
    hum = (3000 * np.sin(2 * np.pi * 60 * np.arange(int(rate * 0.06)) / rate)).astype(np.int16)[:, None]
    speech = tone(0.5, rate, 1500, 12000)
    n = signal.low_preamble_frames(np.concatenate([hum, speech]), rate)
    assert 0 < n <= rate * 0.08
    assert signal.low_preamble_frames(speech, rate) == 0
    silence = np.zeros((int(rate * 0.4), 1), np.int16)
    n = signal.gap_preamble_frames(np.concatenate([speech[: rate // 10], silence, speech]), rate)
    assert abs(n - rate * 0.5) <= rate * 0.01
    assert signal.gap_preamble_frames(speech, rate) == 0
    click = np.concatenate([np.full((int(rate * 0.004), 1), 20000, np.int16), np.zeros((int(rate * 0.01), 1), np.int16), speech])
    assert len(signal.remove_click(click, rate)) < len(click)
