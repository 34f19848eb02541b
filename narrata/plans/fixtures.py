"""Small inline tables, the same literals for Spark and for SQL."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from narrata.functions.signal import write_wave


@dataclass(frozen=True)
class Fixture:
    schema: str  #: "name type, ..." of simple types
    rows: tuple[tuple, ...]

    def df(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in self.schema.split(", ")]
        text = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in self.rows], ", ".join(f"{n} string" for n in names))
        return text.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in self.schema.split(", ")])

    def sql(self, alias: str = "t", columns: str | None = None) -> str:
        """``(SELECT ...) alias`` with DuckDB's types."""
        cols = [c.split() for c in self.schema.split(", ")]
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}

        def lit(v):
            return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"

        body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in self.rows)
        casts = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in cols)
        return f"(SELECT {casts} FROM (VALUES {body}) v({', '.join(n for n, _ in cols)})) {alias}"


def pairs(*rows: tuple[str, str]) -> Fixture:
    """Input and expected output of a step."""
    return Fixture("id int, input string, output string", tuple((i, a, b) for i, (a, b) in enumerate(rows, 1)))


A = "́"
INITIALS = pairs(("А. С. Пушкин писал.", "А Эс Пушкин писал."), ("Встретил Л.Н.Толстого.", "Встретил Эл Эн Толстого."), ("К. Маркс и Ф. Энгельс", "Ка Маркс и Эф Энгельс"), ("Глава А. начало", "Глава А. начало"), ("без имён", "без имён"))
ABBREVIATIONS = pairs(("и т. д.", "и так далее"), ("Книги и т.п. вещи", "Книги и тому подобное вещи"), ("т.е. так", "то есть так"), ("5 тыс. рублей", "5 тысяч рублей"), ("см. напр. главу", "смотрите например главу"), ("12 л.", "12 листов"), ("Самуил.", "Самуил."))
ACRONYMS = pairs(("США и СССР", "эс-ша-а и эс-эс-эс-эр"), ("Он из ФБР.", "Он из эф-бэ-эр."), ("ГЛАВА ПЕРВАЯ", "ГЛАВА ПЕРВАЯ"), (f"ТО{A}МАС ушёл", "тэ-о-эм-а-эс ушёл"), ("АМЕРИКА", "АМЕРИКА"), ("нет", "нет"))
CLOCK = pairs(("в 0:00 и 12:00", "в полночь и полдень"), ("1:15", "четверть второго"), ("3:30", "половина четвёртого"), ("5:45", "без четверти шесть"), ("0:45", "без четверти час"), ("20:15", "четверть двадцать первого"), ("09:30", "половина десятого"), ("23:15", "23:15"), ("7:20", "7:20"), ("24:00", "24:00"))
ROMAN = pairs(("Людовик XIV правил", "Людовик четырнадцатый правил"), ("XX век", "двадцатый век"), ("MCMXC", "тысяча девятьсот девяностый"), ("MM", "двухтысячный"), ("CD", "четырёхсотый"), ("VV и LCD", "VV и LCD"), ("I. Введение", "первый. Введение"), ("I am", "I am"), ("ТомIV", "ТомIV"))
NUMBERS = pairs(
    ("У меня 3 яблока.", "У меня три яблока."), ("Смотри №5.", "Смотри номер пять."), ("17 век", "семнадцатый век"), ("XVII век", "семнадцатый век"), ("17-й век", "семнадцатый век"),
    ("1917 год", "тысяча девятьсот семнадцатый год"), ("до 1917 года", "до тысяча девятьсот семнадцатого года"), ("в 1917 году", "в тысяча девятьсот семнадцатом году"), ("в 1793.", "в тысяча семьсот девяносто третьем."),
    ("1917 годом", "тысяча девятьсот семнадцатым годом"), ("1794-1796 год", "тысяча семьсот девяносто четвёртый - тысяча семьсот девяносто шестой годы"), ("2000 год", "двухтысячный год"), ("в 2017-м году", "в две тысячи семнадцатом году"),
    ("14.04.2026", "четырнадцатого апреля две тысячи двадцать шестого года"), ("14 апреля 2026 года", "четырнадцатого апреля две тысячи двадцать шестого года"), ("5 мая", "пятого мая"), ("31 декабря", "тридцать первого декабря"),
    ("9:05", "девять ноль пять"), ("23:00", "двадцать три ноль-ноль"), ("1/2", "половина"), ("3/7", "три седьмых"), ("5/13", "пять / тринадцать"), ("x7/0", "x7/0"), ("$100", "сто долларов"), ("€1", "один евро"), ("₽22", "двадцать два рубля"),
    ("5-10", "пять - десять"), ("-4", "минус четыре"), ("1. Начало", "Первое. Начало"), ("к 3 сезону", "к третьему сезону"), ("1000000", "один миллион"), ("1001", "тысяча один"), ("без чисел", "без чисел"),
)
SAFE_SPLIT = pairs(
    ("Короткое предложение. Второе.", "Короткое предложение. Второе."),
    ("one; two words here to keep", "one two words here to keep."),
    ("A" * 10 + " first part of the sentence goes on and on, However the second part of it is just as long as that.", "AAAAAAAAAA first part of the sentence goes[chunk_eof] On and on, However the second part of it is just as long[chunk_eof] As that."),
    ("Первый абзац тут.\n\nВторой абзац тут.", "Первый абзац тут.\n\nВторой абзац тут."),
)
COSY = pairs(("привет", "Привет"), ("я", "- Я"), ("a b", "- A b"), ("Да", "Да"), ("1 раз", "1 раз"))
PARADOX = pairs(("большая часть", "бо́льшая часть"), ("Большая игра", "Бо́льшая игра"), ("замо́к стоит", "замок стоит"), ("БОЛЬШАЯ", "БО́ЛЬШАЯ"), ("ничего", "ничего"))
HARD = pairs(
    ("доступ в интернет есть", "доступ в интэрнэт есть"), ("Интернете", "Интэрнэте"), ("ИНТЕРНЕТ", "ИНТЭРНЭТ"), ("зинтернет", "зинтэрнет"), ("Менеджер", "Мэнэджер"), ("суперменеджер", "суперменеджер"), ("менеджмент", "мэнэджмент"),
    ("модем и модель", "модэм и модэль"), ("индекс", "индэкс"), ("шедевр", "шэдэвр"), ("тенденция", "тэндэнция"), ("тендерный", "тэндэрный"), ("мегатендер", "мегатендер"), ("стюардесса", "стюардэсса"), ("демпинг", "дэмпинг"), ("дедукция", "дэдукция"),
    ("компьютер, принтер", "компьютэр, принтэр"), ("контент", "контэнт"), ("мегаконтент", "мегаконтент"), ("бактерия", "бактэрия"), ("альтернатива", "альтэрнатива"), ("антенна", "антэнна"), ("роутер", "роутэр"), ("бартер", "бартэр"),
    ("синтез", "синтэз"), ("синтетика", "синтэтика"), ("протез", "протэз"), ("эстет", "эстэт"), ("интенсивный", "интэнсивный"), ("теннис", "тэннис"), ("тент", "тэнт"), ("экстент", "экстент"), ("Тестирование", "Тэстирование"), ("протест", "протест"),
    ("тезис", "тэзис"), ("тембр", "тэмбр"), ("термос", "тэрмос"), ("термин", "термин"), ("бультерьер", "бультэрьер"), ("артерия", "артэрия"), ("критерий", "критэрий"), ("партер", "партэр"), ("пантера", "пантэра"), ("потенциал", "потэнциал"),
    ("бижутерия", "бижутэрия"), ("бифштекс", "бифштэкс"), ("коктейль", "коктэйль"), ("свитер", "свитэр"), ("бизнес", "бизнэс"), ("кларнет", "кларнэт"), ("суперкларнет", "суперкларнет"), ("энергия", "энэргия"), ("майонезный", "майонэзный"),
    ("панель", "панэль"), ("тоннель", "тоннэль"), ("туннель", "туннэль"), ("тунель", "тунэль"), ("портмоне", "портмонэ"), ("турне", "турнэ"), ("турнепс", "турнепс"), ("плеер", "плэер"), ("отелей", "отэлей"), ("ОТЕЛЬ", "ОТЭЛЬ"), ("мотель", "мотель"),
    ("телефон", "телефон"), ("тема", "тема"), ("деревня", "деревня"), ("energy", "energy"), ("эссе у шоссе", "эссэ у шоссэ"), ("пюре", "пюрэ"), ("тире", "тирэ"), ("ДЕТЕКТИВ", "ДЭТЭКТИВ"), ("супердетектив", "супердетектив"), ("Несессер", "Нэсэссэр"),
    ("резюме", "рэзюмэ"), ("резюмировать", "резюмировать"), ("Супермен", "Супермэн"), ("псевдосупермен", "псевдосупермен"), ("модное ателье мод", "модное атэлье мод"), ("диспансерный", "диспансэрный"), ("сервис", "сэрвис"), ("сервер", "сервер"),
    ("регби", "рэгби"), ("кафедра и кафе", "кафедра и кафе"), ("Слово Кофе-брейк", "Слово Кофе-брэйк"),
)
STRESS = pairs(("з+амок", "за" + A + "мок"), ("a+b", "ab"), (f"за{A}мо{A}к", f"замо{A}к"), ("нет", "нет"))
MARKS = pairs(("лет,[chunk_eof] вы", "лет,[chunk_eof]Вы"), ("a[chunk_eof] b[chunk_eof]  c", "a[chunk_eof]B[chunk_eof]C"), ("без", "без"))
FORCED = pairs(("Конец.", "Конец[chunk_eof]"), ("Он сказал «да.»", "Он сказал «да»[chunk_eof]"), ("так?", "так?[chunk_eof]"), ("уже [chunk_eof]", "уже[chunk_eof]"), ("  ", ""))
SYMBOLS = pairs(("«Да» — он…", "`Да` - он..."), ("a b\r\n c", "a b\nc"), ("со­фт​", "софт"), ("x★y", "x y"), (f"за{A}мок", f"за{A}мок"), ("tab\t\tх", "tab х"))
TEMPO = Fixture("id int, input double, output string", ((1, "1.0", None), (2, "1.5", "atempo=1.500000"), (3, "3.0", "atempo=2.000000,atempo=1.500000"), (4, "0.25", "atempo=0.500000,atempo=0.500000"), (5, "0.0", None), (6, "4.0", "atempo=2.000000,atempo=2.000000")))
ESCAPES = pairs(("a;b=c#d", r"a\;b\=c\#d"), ("x\ny", "x y"), ("back\\slash", "back\\\\slash"), ("plain", "plain"))
KEYS = Fixture("id int, input string, output string", ((1, "Глава 1: Начало", "0001_Глава_1__Начало"), (2, "a/b\\c", "0002_a_b_c"), (3, "  spaced   out ", "0003_spaced_out"), (4, "...", "0004_untitled")))
DELETES = Fixture("id int, input string, sentence string, output string", ((1, "Один. Два. Три.", "Два. ", "Один. Три."), (2, "Один.\n\nДва.\n\nТри.", "Два.", "Один.\n\nТри."), (3, "Один.", "Два.", None)))
EDITS = Fixture("id int, input string, old string, new string, output string", (
    (1, "Он пришёл. Она ушла.", "Она ушла.", "Она осталась.", "Он пришёл. Она осталась."), (2, "мы не можем\". Дальше.", "мы не можем.", "мы можем.", "мы можем\". Дальше."),
    (3, "Раз. Два.", "Раз.", "Раз. ", "Раз. Два."), (4, "А.\n\nБ.", "Б.", "А.", "А."), (5, "Раз.", "Нет.", "Да.", None),
))
BOUNDARY = Fixture("id int, original string, heard string, first_ok boolean, last_ok boolean", (
    (1, "под мрачным небом", "подмрачным небом", True, True), (2, "век назад", "вег назат", True, True), (3, "бог есть", "пох есть", False, True), (4, "Ёлка стоит", "елка стоит", True, True),
    (5, "один два", "три четыре", False, False), (6, "слово", "", True, True), (7, "Тест теста", "тэст тэста", True, True),
))
ARTIFACTS = Fixture("id int, heard string, ok boolean", ((1, "Субтитры сделал", False), (2, "обычный текст", True), (3, None, True), (4, "ПРОДОЛЖЕНИЕ следует", False)))
SIMILAR = Fixture("id int, a string, b string, output double", ((1, "tide", "diet", 0.25), (2, "diet", "tide", 0.5), (3, "", "", 1.0), (4, "abc", "abc", 1.0), (5, "abcd", "", 0.0), (6, "век", "вег", 0.666667)))
FRESH = Fixture("id int, checked_at string, mtime timestamp, fresh boolean", ((1, "2024-01-02T00:00:00", "2024-01-01 00:00:00", True), (2, "2024-01-01T00:00:00", "2024-01-01 00:00:00", True), (3, "2023-12-31T00:00:00", "2024-01-01 00:00:00", False), (4, "soon", "2024-01-01 00:00:00", False), (5, None, "2024-01-01 00:00:00", False)))
LEXICON = Fixture("surface_form string, spoken_form string, lemma string, pos string, grammemes string, is_proper_name boolean, source string, confidence double", (
    ("замок", f"за{A}мок", "замок", "NOUN", "m1a", False, "own", 0.9), ("замок", f"замо{A}к", "замок", "NOUN", "m3b", False, "own", 0.9), ("мука", f"му{A}ка", "мука", "NOUN", None, False, "own", None), ("мука", f"мука{A}", "мука", "NOUN", None, False, "other", 0.5),
    ("москва", f"москва{A}", "москва", "NOUN", None, True, "own", 0.8), ("the", "the", "the", "ART", None, False, "other", 0.7), ("the", "thee", "the", "ART", None, False, "own", 0.2), ("and", "and", "and", "CONJ", None, False, "own", 0.9), ("que", "que", "que", "CONJ", None, False, "own", 0.9),
))
OVERRIDES = Fixture("surface_form string, tts_form string, source string", (("тест", "тэст", "espeak"), ("тест", "тЭст", "own"), ("кафе", "кафэ", "espeak"), ("модель", "модэль", "zz"), ("модель", "модЭль", "yy")))
TOC = Fixture("book string, entry_pos int, title string, hrefs string", (("b1", 0, "", "Text/two.xhtml#x"), ("b1", 1, "Part Two", "two.xhtml"), ("b1", 2, "Part Four", "none.xhtml|FOUR.xhtml"), ("b1", 3, "Lost", "gone.xhtml")))
TOC_DOCS = Fixture("book string, chapter_idx int, href string, title string, text string", (("b1", 0, "Text/one.xhtml", "one", "Text 1"), ("b1", 1, "Text/two.xhtml", "two", "Text 2"), ("b1", 2, "Text/three.xhtml", "three", " Text 3 "), ("b1", 3, "Text/four.xhtml", "four", "Text 4"), ("b2", 0, "a.xhtml", "a", "Text a")))
CACHE = Fixture("chapter_key string, sentence_hash string, original_text string, transcription string, similarity double, reference_check_score double, reference_check_status string, checked_at timestamp, status string", (
    ("c1", "h1", "один два", "один два", 1.0, None, None, "2024-01-02 00:00:00", "checked"), ("c1", "h2", "век назад", "вег назат", 0.5, 0.9, "suspicious", "2024-01-02 00:00:00", "disputed"), ("c1", "h3", "три", "[manual] три", None, 0.1, "ok", "2024-01-03 00:00:00", "resolved"),
    ("c2", "h1", "четыре", "пять", 0.2, None, "measured", "2024-01-01 00:00:00", "disputed"), ("c2", "h4", "шесть", None, None, None, None, None, "disputed"),
))
CHECKED = Fixture("chapter_key string, sentence_hash string, transcription string, similarity double, status string", (("c1", "h1", "один", 0.4, "disputed"), ("c1", "h3", "три", 0.1, "disputed"), ("c3", "h9", "девять", 0.9, "checked")))
RESULTS = Fixture("chapter_key string, sentence_hash string, checker string, passed boolean", (("c1", "h2", "first_word", True), ("c1", "h2", "last_word", False), ("c2", "h1", "first_word", False), ("c2", "h4", "last_word", None)))
LONG = Fixture("chapter_key string, sentence_hash string, checker string, disputed boolean, similarity double, reference_check_score double, error string", (
    ("c1", "h1", "whisper_similarity", False, 0.9, None, None), ("c1", "h1", "first_word", True, None, None, None), ("c1", "h2", "whisper_similarity", True, 0.1, None, "broken"), ("c1", "h2", "last_word", False, None, None, None), ("c1", "h2", "reference", False, 0.7, 0.3, None),
))
VERSIONS = Fixture("sentence_hash string, sentence_text string, replaced_by_hash string, created_at timestamp", (("v1", "Один", "v2", "2024-01-01 00:00:00"), ("v2", "Один.", "v3", "2024-01-02 00:00:00"), ("v3", "Один!", None, "2024-01-03 00:00:00"), ("w1", "Два", "v3", "2024-01-02 12:00:00")))
NEW_VERSIONS = Fixture("sentence_hash string, sentence_text string, replaced_by_hash string, created_at timestamp", (("v3", "Другой", "v4", "2024-02-01 00:00:00"), ("v2", "x", "v9", "2024-02-01 00:00:00"), ("v4", "Четыре", None, "2024-02-01 00:00:00")))
STEPS = Fixture("chapter_key string, step_index int, step_name string, input_hash string, config_hash string, status string, output string", (("c1", 0, "simple_symbols", "i1", "k1", "success", "o1"), ("c1", 1, "ru_numbers", "i2", "k2", "failed", None), ("c2", 0, "simple_symbols", "i3", "k1", "success", "o3")))
INPUTS = Fixture("chapter_key string, step_index int, input_hash string, config_hash string", (("c1", 0, "i1", "k1"), ("c1", 1, "i2", "k2"), ("c2", 0, "i3", "k9"), ("c2", 0, "i3", "k1")))
AUDIO = Fixture("chapter_key string, sentence_hash string, path string, duration_s double, mtime timestamp", (("c1", "h1", "c1/h1.wav", 1.5, "2024-01-01 00:00:00"), ("c1", "h2", "c1/h2.wav", 2.255, "2024-01-03 00:00:00"), ("c2", "h1", "c2/h1.wav", 0.75, "2024-01-02 00:00:00")))
CHUNKS = Fixture("chapter_key string, pos int, text string, voice string, sentence_hash string", (("c1", 0, "один два", None, "h1"), ("c1", 1, "век назад", "v2", "h2"), ("c2", 0, "четыре", None, "h1"), ("c2", 1, "шесть", None, "h4"), ("c3", 0, "семь", None, "h7")))
DELETIONS = Fixture("chapter_key string, sentence_hash string, similarity double, threshold double", (("c1", "h1", 0.3, 0.7), ("c2", "h1", 0.4, 0.7), ("c2", "h4", 0.1, 0.7)))
RUN = Fixture("run_index string, file_name string, text string", (("001", "0001_Old.txt", "x"), ("002", "0002_Second_Part.txt", "Two."), ("002", "0001_First.txt", "One."), ("002", "notes.md", "no"), ("tmp", "0001_T.txt", "t")))
FILES = Fixture("chapter_key string, file_mtime timestamp", (("c1", "2024-01-02 00:00:00"), ("c2", "2024-01-05 00:00:00")))
AUDIO_FILES = Fixture("path string, chapter_key string, stem string, ext string, mtime timestamp", (("c1/h1.mp3", "c1", "h1", "mp3", "2024-01-01 00:00:00"), ("c1/h1.wav", "c1", "h1", "wav", "2024-01-02 00:00:00"), ("c1/h2.ogg", "c1", "h2", "ogg", "2024-01-01 00:00:00"), ("c1/h3.txt", "c1", "h3", "txt", "2024-01-01 00:00:00")))
LINES = Fixture("line_no int, line string", ((1, " a == b "), (2, "# note"), (3, ""), (4, "c==d==e"), (5, "a==z"), (6, "w==з+амок|зам+ок")))
TITLES = Fixture("line_no int, line string", ((1, "First"), (2, "  "), (3, "Third"), (9999999, "Extra")))
GRAMMAR = Fixture("line_no int, line string", ((1, f"1/за{A}мок м 3*a (крепость)"), (2, f"2/замо{A}к м 3*b"), (3, f"бежа{A}ть нсв 5b [x]"), (4, "—"), (5, f"а̀вто{A}бус м 1a")))
PHONEMES = Fixture("line_no int, line string", ((1, "// comment"), (2, "тест tEst"), (3, "кафе kafE"), (4, "лес lʲes"), (5, "(x) y")))
SELECTIONS = Fixture("item_id string, option_id string, custom_text string", (("i1", "accented", None), ("i3", None, "custom")))
ITEMS = Fixture("item_id string, pos int, context string, source_text string", (("i1", 0, "ctx b", "замок"), ("i2", 1, "ctx a", "мука"), ("i3", 2, "ctx b", "полки")))
UNITS = Fixture("chapter_key string, unit_index int, output string", (("c1", 1, "two"), ("c1", 0, "one"), ("c2", 0, "only")))


def wave(seconds: float, rate: int = 8000, channels: int = 1, level: int = 8000) -> bytes:
    """A tone of 220 Hz."""
    t = np.arange(int(seconds * rate)) / rate
    return write_wave(np.repeat((level * np.sin(2 * np.pi * 220 * t)).astype(np.int16)[:, None], channels, axis=1), rate)


def epub() -> bytes:
    page = lambda title, body: f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{title}</title></head><body>{body}</body></html>'
    parts = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
        "OPS/book.opf": '<package xmlns:dc="x"><metadata><dc:title>A Book</dc:title><dc:creator>An Author</dc:creator></metadata><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "OPS/toc.ncx": '<ncx><navMap><navPoint><navLabel><text>Start</text></navLabel><content src="b.xhtml#p"/></navPoint><navPoint><navLabel><text>End</text></navLabel><content src="c.xhtml"/></navPoint></navMap></ncx>',
        "OPS/a.xhtml": page("12", "<p>Alpha text.</p>"),
        "OPS/b.xhtml": page("Beta!", "<p>Beta\n\ntext.</p>"),
        "OPS/c.xhtml": page("", "<h1>Gamma</h1>"),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


FB2 = (
    '<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><author><first-name>Ann</first-name><last-name>Other</last-name></author><book-title>Tales</book-title></title-info></description>'
    "<body><section><title><p>Part</p></title><section><title><p>One</p></title><p>First  line.</p><p>Second.</p><empty-line/><p>Third.</p></section><section><title><p>Two</p></title><poem><stanza><v>Verse a</v><v>Verse b</v></stanza></poem></section></section>"
    '<section><p>Untitled text here.</p></section><section><title><p>Empty</p></title></section></body><body name="notes"><section><p>note</p></section></body></FictionBook>'
).encode()
