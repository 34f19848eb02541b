"""Russian number words from the grammar: cardinals by gender and case, ordinals by gender, case and number, decimals."""

from __future__ import annotations

# Stems of the numerals. Cases are n g d a i p; genders m f n.
UNITS = ("ноль", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять", "десять", "одиннадцать", "двенадцать", "тринадцать", "четырнадцать", "пятнадцать", "шестнадцать", "семнадцать", "восемнадцать", "девятнадцать")
TENS = ("", "", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто")
HUNDREDS = ("", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот", "семьсот", "восемьсот", "девятьсот")
SCALES = (None, ("f", "тысяча", "тысячи", "тысяч"), ("m", "миллион", "миллиона", "миллионов"), ("m", "миллиард", "миллиарда", "миллиардов"), ("m", "триллион", "триллиона", "триллионов"), ("m", "квадриллион", "квадриллиона", "квадриллионов"), ("m", "квинтиллион", "квинтиллиона", "квинтиллионов"))
SCALE_ORDINALS = (None, "тысячн", "миллионн", "миллиардн", "триллионн", "квадриллионн", "квинтиллионн")
ORDINAL_STEMS = ("нулев", "перв", "втор", "трет", "четвёрт", "пят", "шест", "седьм", "восьм", "девят", "десят", "одиннадцат", "двенадцат", "тринадцат", "четырнадцат", "пятнадцат", "шестнадцат", "семнадцат", "восемнадцат", "девятнадцат")
TENS_STEMS = ("", "", "двадцат", "тридцат", "сороков", "пятидесят", "шестидесят", "семидесят", "восьмидесят", "девяност")
HUNDREDS_STEMS = ("", "сот", "двухсот", "трёхсот", "четырёхсот", "пятисот", "шестисот", "семисот", "восьмисот", "девятисот")
STRESSED_ENDING = {0, 2, 6, 7, 8, 40}  #: ordinals in -ой
ENDINGS = {
    "m": dict(n="ый", g="ого", d="ому", a="ый", i="ым", p="ом"),
    "f": dict(n="ая", g="ой", d="ой", a="ую", i="ой", p="ой"),
    "n": dict(n="ое", g="ого", d="ому", a="ое", i="ым", p="ом"),
    "pl": dict(n="ые", g="ых", d="ым", a="ые", i="ыми", p="ых"),
}
THIRD = {
    "m": dict(n="ий", g="ьего", d="ьему", a="ий", i="ьим", p="ьем"),
    "f": dict(n="ья", g="ьей", d="ьей", a="ью", i="ьей", p="ьей"),
    "n": dict(n="ье", g="ьего", d="ьему", a="ье", i="ьим", p="ьем"),
    "pl": dict(n="ьи", g="ьих", d="ьим", a="ьи", i="ьими", p="ьих"),
}
ONE = {
    "m": dict(n="один", g="одного", d="одному", a="один", i="одним", p="одном"),
    "f": dict(n="одна", g="одной", d="одной", a="одну", i="одной", p="одной"),
    "n": dict(n="одно", g="одного", d="одному", a="одно", i="одним", p="одном"),
}
TWO = dict(n="два", g="двух", d="двум", a="два", i="двумя", p="двух")
THREE = dict(n="три", g="трёх", d="трём", a="три", i="тремя", p="трёх")
FOUR = dict(n="четыре", g="четырёх", d="четырём", a="четыре", i="четырьмя", p="четырёх")
#: Genitive of what stands before "-тысячный", "-миллионный", ...
GENITIVE_UNITS = ("", "одно", "двух", "трёх", "четырёх", "пяти", "шести", "семи", "восьми", "девяти", "десяти", "одиннадцати", "двенадцати", "тринадцати", "четырнадцати", "пятнадцати", "шестнадцати", "семнадцати", "восемнадцати", "девятнадцати")
GENITIVE_TENS = ("", "", "двадцати", "тридцати", "сорока", "пятидесяти", "шестидесяти", "семидесяти", "восьмидесяти", "девяноста")
GENITIVE_HUNDREDS = ("", "ста", "двухсот", "трёхсот", "четырёхсот", "пятисот", "шестисот", "семисот", "восьмисот", "девятисот")
#: Names of decimal places.
PLACES = (("десятая", "десятых"), ("сотая", "сотых"), ("тысячная", "тысячных"), ("десятитысячная", "десятитысячных"), ("стотысячная", "стотысячных"), ("миллионная", "миллионных"))


def plural(n: int, one: str, few: str, many: str) -> str:
    """The noun after a number: 1 (not 11), 2-4 (not 12-14), other."""
    if n % 100 in range(11, 15):
        return many
    return one if n % 10 == 1 else few if n % 10 in (2, 3, 4) else many


def _unit(n: int, gender: str, case: str) -> str:
    if n == 1:
        return ONE[gender][case]
    if n == 2:
        return "две" if gender == "f" and case in "na" else TWO[case]
    if n in (3, 4):
        return (THREE if n == 3 else FOUR)[case]
    if case in "na":
        return UNITS[n]
    if case == "i":
        return UNITS[n] + "ю"
    return "восьми" if n == 8 else UNITS[n][:-1] + "и"


def _group(n: int, gender: str, case: str) -> list[str]:
    """Words of a number under a thousand."""
    out = []
    h, rest = divmod(n, 100)
    if h:
        out.append(HUNDREDS[h] if case in "na" else GENITIVE_HUNDREDS[h] if case == "g" or h == 1 else HUNDREDS[h])
    if rest >= 20:
        t, rest = divmod(rest, 10)
        out.append(TENS[t] if case in "na" else GENITIVE_TENS[t])
    if rest:
        out.append(_unit(rest, gender, case))
    return out


def cardinal(n: int, gender: str = "m", case: str = "n") -> str:
    """Thousands and more stay in the nominative but for the last group, which takes gender and case."""
    if n < 0:
        return "минус " + cardinal(-n, gender, case)
    if n == 0:
        return "ноль"
    groups, words = [], []
    while n:
        n, g = divmod(n, 1000)
        groups.append(g)
    if len(groups) > len(SCALES):
        raise ValueError("number too large for words")
    for k in range(len(groups) - 1, -1, -1):
        g = groups[k]
        if not g:
            continue
        if k == 0:
            words += _group(g, gender, case)
        else:
            sex, one, few, many = SCALES[k]
            words += _group(g, sex, "n") + [plural(g, one, few, many)]
    return " ".join(words)


def _adjective(stem: str, number: int, gender: str, case: str) -> str:
    if number == 3:
        return stem + THIRD[gender][case]
    ending = ENDINGS[gender][case]
    if gender == "m" and case in "na" and number in STRESSED_ENDING:
        ending = "ой"
    return stem + ending


def _joined(n: int) -> str:
    """What stands before a scale's ordinal, in one word: 2 in "двухтысячный"; nothing for 1."""
    if n == 1:
        return ""
    h, rest = divmod(n, 100)
    out = "сто" if h == 1 else GENITIVE_HUNDREDS[h]
    if rest >= 20:
        t, rest = divmod(rest, 10)
        out += "девяносто" if t == 9 else GENITIVE_TENS[t]
    return out + (GENITIVE_UNITS[rest] if rest else "")


def ordinal(n: int, gender: str = "m", case: str = "n", number: str = "s") -> str:
    """Only the last word is inflected. ``number="pl"`` for plural."""
    if n < 0:
        return "минус " + ordinal(-n, gender, case, number)
    form = "pl" if number == "pl" else gender
    if n == 0:
        return _adjective(ORDINAL_STEMS[0], 0, form, case)
    scale = 0
    while n % 1000 == 0:
        n //= 1000
        scale += 1
    upper, last = divmod(n, 1000)
    lead: list[str] = [spoken(upper * 1000 ** (scale + 1))] if upper else []
    if scale:
        return " ".join([*lead, _adjective(_joined(last) + SCALE_ORDINALS[scale], 1000, form, case)])
    h, rest = divmod(last, 100)
    if h and not rest:
        return " ".join([*lead, _adjective(HUNDREDS_STEMS[h], 100, form, case)])
    if h:
        lead.append(HUNDREDS[h])
    t, unit = divmod(rest, 10)
    if rest >= 20 and not unit:
        return " ".join([*lead, _adjective(TENS_STEMS[t], rest, form, case)])
    if rest >= 20:
        lead.append(TENS[t])
        rest = unit
    return " ".join([*lead, _adjective(ORDINAL_STEMS[rest], rest, form, case)])


def decimal(text: str) -> str:
    """``-3.14`` as "минус три целых четырнадцать сотых"; more than six places are read digit by digit."""
    sign = "минус " if text.startswith("-") else ""
    whole, _, part = text.lstrip("-").partition(".")
    n = int(whole)
    head = f"{cardinal(n, 'f')} {'целая' if plural(n, 'a', 'b', 'b') == 'a' else 'целых'}"
    if len(part) > len(PLACES):
        return f"{sign}{head} {' '.join(cardinal(int(d)) for d in part)}"
    m = int(part)
    one, many = PLACES[len(part) - 1]
    return f"{sign}{head} {cardinal(m, 'f')} {one if plural(m, 'a', 'b', 'b') == 'a' else many}"


def spoken(n: int, gender: str = "m", case: str = "n") -> str:
    """A cardinal as it is read: a leading "одна" before "тысяча" is left out."""
    words = cardinal(n, gender, case)
    return words.removeprefix("одна ") if words.startswith("одна тысяча") else words
