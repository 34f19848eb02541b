"""Personal data replaced by surrogates. DataFrame functions only.

Mail addresses, telephone numbers, network addresses, card, account and social security numbers, and names after a
title are found by pattern. In a text that names persons, their full names and surnames are also found without a title, and mentions are
resolved before they are keyed: a surname is the person of the full name before it (or else the next one) unless the titles' genders differ, and
a person's gender is that of any titled mention. Short forms get the surname of the full name's surrogate. Each distinct entity of the whole corpus gets one surrogate, a keyed digest of it turned into the
same type and form: digits for digits, letters for letters, octets in range, card and account numbers that pass the check digits
where the original does, names of the title's gender and the original's script. Numbers with other
punctuation, and addresses or names in other case, are the same entity.

Surrogates of two entities never agree and none is an entity of the corpus: what collides is drawn
again, all but the first of a group, until nothing does. The space grows with the draws where a form is narrow: names get more
syllables, octets more digits, addresses more letters, numbers another first digit. Surrogates are joined to mentions by entity and put
into texts in the place of the mention, in its own case and punctuation.

Defined results: a name after a title is one to five capitalised words, a surname that could be two persons' is the nearest one's before it; a null text stays null; a text without entities is unchanged and never shuffled; rows
repeated under one id are treated alike; an empty table gives an empty result; other columns are kept by ``surrogates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm._work import fresh, let, materialize

# Titles by gender, and names of each gender and script from which surrogates are drawn.
MALE_TITLES = "Mr|MR|Herr|HERR|Monsieur|MONSIEUR|Señor|SEÑOR|Sr|SR|господин|г-н"
FEMALE_TITLES = "Mrs|MRS|Ms|MS|Miss|MISS|Frau|FRAU|Madame|MADAME|Mme|Mademoiselle|Señora|SEÑORA|Sra|SRA|Señorita|госпожа|г-жа"
OTHER_TITLES = "Dr|DR|Prof|PROF|Доктор|доктор|профессор"
NAMES = {
    "m": "Adam Alan Albert Bruno Carl Daniel David Erik Felix Frank Georg Henri Hugo Ivan Jacob Jonas Karl Lars Leon Louis Lucas Marco Martin Max Miguel Nils Noel Oscar Otto Paul Pedro Peter Ralf Rene Robert Simon Thomas Victor Walter Xavier",
    "f": "Ada Alice Amelia Anna Beatriz Carla Clara Diana Doris Elena Elisa Emma Eva Flora Gina Greta Hanna Helena Ida Irene Jana Julia Karin Laura Lea Lena Lucia Maria Marta Nina Nora Olga Paula Petra Rita Rosa Sara Sofia Vera Zoe",
    "u": "Alex Andrea Chris Dana Jean Jo Kim Lee Lou Max Nicky Pat Rene Robin Sam Sascha Sidney Taylor Toni Val",
    "cm": "Алексей Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Максим Никита Олег Павел Роман Сергей Юрий",
    "cf": "Алла Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лариса Мария Нина Ольга Полина Софья Юлия",
    "cu": "Женя Саша Валя Слава Шура",
}
SYLLABLES = "ba be bo da de do fa fe ga go ha hi ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve wa".split()
CYRILLIC = "ба ва га да ди за ка ки ла ли ло ма ми мо на не но па пе ра ри ро са се со та те то ха ча".split()

# A name is one to five capitalised words. Loops are possessive: they take no stack, however long a mention is.
_NAME = r"(?:\s+(?=\p{Lu}[\p{L}'’\-])\p{Lu}\p{L}*+(?:['’\-](?![sS](?!\p{L}))\p{L}++)*+){1,5}+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}_%+][\p{L}\p{N}._%+\-]*+@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}(?:[ .\-]?\d{2,4}){1,2}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<![\d.\-])\d{3}([ .\-])\d{3}\1\d{4}(?![\d.\-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])",
    "person": rf"(?<!\p{{L}})(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.?{_NAME}",
}
#: One pattern for all; a look at the first character keeps most places from trying most types.
_FIRST = {"ip": r"(?=\d)", "ssn": r"(?=\d)", "phone": r"(?=[\d+(])", "account": r"(?=[A-Z]{2}\d)", "card": r"(?=\d)", "person": "(?=[DFHMPSДгдп])"}
ENTITY = "|".join(f"{_FIRST.get(k, '')}(?:{p})" for k, p in ((k, p.replace(r"([ .\-])\d{3}\1", r"(?:[ .\-])\d{3}(?:[ .\-])")) for k, p in PATTERNS.items()))
_TITLED = rf"(?=[DFHMPSДгдп])(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.?\s"
_NUMERIC = ("phone", "card", "ssn")
_NARROW = 4  #: draws in the entity's own form before the space grows


def has_entity(text) -> F.Column:
    """Whether a text has an entity. No entity is without an at sign, a digit or a title, which is quickly seen."""
    maybe = F.contains(text, F.lit("@")) | F.regexp_like(text, F.lit("[0-9]")) | F.regexp_like(text, F.lit(_TITLED))
    return F.coalesce(maybe & F.regexp_like(text, F.lit(ENTITY)), F.lit(False))


def _kind(hit) -> F.Column:
    """Type of a mention; the first pattern that covers the whole of it."""
    got = F.when(F.contains(hit, F.lit("@")), "email")
    for name, shape in (("ip", r"^\d{1,3}(\.\d{1,3}){3}$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("account", r"^[A-Z]{2}\d{2}"), ("person", r"^\p{L}"), ("phone", r"^[+(]|^\d{3}[ .\-]\d{3}[ .\-]\d{4}$")):
        got = got.when(F.regexp_like(hit, F.lit(shape)), name)
    return got.otherwise("card")


def _title(hit) -> F.Column:
    return F.regexp_extract(hit, rf"^(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.?\s+", 0)


def _name(hit) -> F.Column:
    return F.regexp_replace(F.substring(hit, F.length(_title(hit)) + 1, F.length(hit)), r"\s+", " ")


def _entity(kind, hit) -> F.Column:
    """What mentions of one entity have in common; for a person, the gender's letter comes first."""
    title = _title(hit)
    male, female = F.regexp_like(title, F.lit(rf"^(?:{MALE_TITLES})\.?\s")), F.regexp_like(title, F.lit(rf"^(?:{FEMALE_TITLES})\.?\s"))
    name = F.lower(_name(hit))
    return (
        F.when(kind.isin(*_NUMERIC), F.regexp_replace(hit, "[^0-9]", ""))
        .when(kind == "account", F.regexp_replace(hit, " ", ""))
        .when(kind == "person", F.concat(F.when(male, "m:").when(female, "f:").otherwise("u:"), name))
        .otherwise(F.lower(hit))
    )


def _pattern(text) -> F.Column:
    """ENTITY, and for a text that names persons also their full names and surnames without a title."""
    def also(hits):
        names = F.transform(F.filter(hits, lambda h: _kind(h) == "person"), _name)
        forms = F.flatten(F.transform(names, lambda n: F.array(n, F.regexp_extract(n, r"\S+$", 0))))
        forms = F.array_distinct(F.flatten(F.transform(forms, lambda n: F.array(n, F.upper(n), F.initcap(n)))))
        longest = F.reverse(F.array_sort(F.transform(forms, lambda n: F.struct(F.length(n).alias("n"), n.alias("form")))))
        quoted = F.transform(longest, lambda x: F.replace(x["form"], F.lit(" "), F.lit(r"\s+")))  # letters, apostrophes and hyphens only
        names_only = F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}_@.])(?<!\p{L}[\-'’])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}_@]|\.[\p{L}\p{N}]|[\-'’](?![sS](?!\p{L}))\p{L})"))
        return F.when(F.size(names) > 0, names_only).otherwise(F.lit(ENTITY))

    titled = F.when(F.regexp_like(text, F.lit(_TITLED)), F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1)))
    return F.coalesce(let(titled, also), F.lit(ENTITY))


def _resolved(hits) -> F.Column:
    """array<struct<kind, entity, hit>> of a text's hits, the mentions of one person under one entity."""
    plain = F.transform(hits, lambda h: let(_kind(h), lambda k: F.struct(k.alias("kind"), _entity(k, h).alias("entity"), h.alias("hit"))))

    def person(x, i):
        name = F.substring(x["entity"], F.lit(3), F.length(x["entity"]))
        return F.struct(i.alias("i"), F.substring(x["entity"], 1, 1).alias("g"), name.alias("name"), F.regexp_extract(name, r"\S+$", 0).alias("last"))

    sure = lambda ps: F.filter(ps, lambda q: q["g"] != "u")
    gender = lambda ps: F.get(sure(ps), F.lit(0))["g"]
    is_full = lambda p: p["name"] != p["last"]

    def with_gender(ps):
        def one(p):
            own = gender(F.filter(ps, lambda q: q["name"] == p["name"]))
            short = F.when(is_full(p), gender(F.filter(ps, lambda q: q["name"] == p["last"])))
            return F.struct(p["i"].alias("i"), F.when(p["g"] != "u", p["g"]).otherwise(F.coalesce(own, short, F.lit("u"))).alias("g"), p["name"].alias("name"), p["last"].alias("last"), p["g"].alias("said"))

        return F.transform(ps, one)

    def linked(ps):
        full = F.filter(ps, is_full)

        def one(p):
            same = F.filter(full, lambda q: (q["last"] == p["name"]) & ((p["said"] == "u") | (q["g"] == "u") | (p["said"] == q["g"])))
            near = let(same, lambda s: F.coalesce(F.try_element_at(F.filter(s, lambda q: q["i"] < p["i"]), F.lit(-1)), F.get(s, F.lit(0))))
            got = F.when(is_full(p), F.concat(p["g"], F.lit(":"), p["name"])).otherwise(let(near, lambda q: F.when(q.isNotNull(), F.concat(q["g"], F.lit(":"), q["name"])).otherwise(F.concat(p["g"], F.lit(":"), p["name"]))))
            return F.struct(p["i"].alias("i"), got.alias("entity"))

        return F.map_from_entries(F.transform(ps, one))

    def joined(xs):
        people = F.filter(F.transform(xs, lambda x, i: F.when(x["kind"] == "person", person(x, i))), lambda p: p.isNotNull())
        names = let(let(people, with_gender), linked)
        return let(names, lambda m: F.transform(xs, lambda x, i: F.struct(x["kind"].alias("kind"), F.coalesce(F.try_element_at(m, i), x["entity"]).alias("entity"), x["hit"].alias("hit"))))

    return let(plain, lambda xs: F.when(F.exists(xs, lambda x: x["kind"] == "person"), joined(xs)).otherwise(xs))


def _found(text) -> F.Column:
    """struct<gaps, hits> of a text; hits as ``_resolved`` gives them."""
    return let(_pattern(text), lambda p: F.struct(F.split(text, p, -1).alias("gaps"), _resolved(F.regexp_extract_all(text, F.concat(F.lit("("), p, F.lit(")")), F.lit(1))).alias("hits")))


def _stream(kind, entity, attempt, key: str) -> F.Column:
    """128 hexadecimal digits fixed by key, entity and attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f")), 256))


def _draw(stream, i, below) -> F.Column:
    """A number under ``below`` from the i-th place of the stream."""
    return F.conv(F.substring(stream, (i * 4) % 124 + 1, F.lit(4)), 16, 10).cast("int") % below


def _letters(x, stream) -> F.Column:
    """The same form with other digits and letters; letters keep case, those outside A-Z become Latin."""
    def one(c, i):
        return (
            F.when(F.regexp_like(c, F.lit("[0-9]")), _draw(stream, i, 10).cast("string"))
            .when(F.regexp_like(c, F.lit(r"\p{Lu}")), F.char(_draw(stream, i, 26) + 65))
            .when(F.regexp_like(c, F.lit(r"\p{L}")), F.char(_draw(stream, i, 26) + 97))
            .otherwise(c)
        )

    return F.concat_ws("", F.transform(F.split(x, ""), one))


def _checksum(digits) -> F.Column:
    """Sum of a card number's digits, every second from the right doubled; 0 modulo 10 if it is well formed."""
    def add(c, i):
        d = c.try_cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), add), F.lit(0), lambda a, x: a + x)


def _remainder(account) -> F.Column:
    """An account number modulo 97, its first four characters last and letters as 10 to 35; 1 if its check digits are right."""
    def add(a, c):
        digit = F.when(F.regexp_like(c, F.lit("[0-9]")), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return (a * F.when(digit > 9, 100).otherwise(10) + digit) % 97

    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def _surrogate(kind, entity, attempt, key: str) -> F.Column:
    more = F.greatest(attempt - (_NARROW - 1), F.lit(0))  # draws beyond those in the entity's own form

    def made(s):
        number = F.concat_ws("", F.transform(F.split(entity, ""), lambda c, i: F.when((i == 0) & (more == 0), c).otherwise(_draw(s, i, 10).cast("string"))))
        fixed = lambda n: F.concat(F.substring(n, F.lit(1), F.length(n) - 1), ((10 - _checksum(F.concat(F.substring(n, F.lit(1), F.length(n) - 1), F.lit("0"))) % 10) % 10).cast("string"))
        card = let(number, lambda n: F.when(_checksum(entity) % 10 == 0, fixed(n)).otherwise(n))
        octet = lambda o, i: F.when(more > 0, _draw(s, i, 256)).when(F.length(o) == 3, _draw(s, i, 156) + 100).when(F.length(o) == 2, _draw(s, i, 90) + 10).otherwise(_draw(s, i, 10)).cast("string")
        ip = F.concat_ws(".", F.transform(F.split(entity, r"\."), octet))
        top = F.regexp_extract(entity, r"\.[^.@]*$", 0)
        longer = F.concat_ws("", F.transform(F.slice(F.array(*[F.lit(k) for k in range(1, 21)]), F.lit(1), more + F.when(more > 0, 3).otherwise(0)), lambda k: F.char(_draw(s, k + 10, 26) + 97)))
        email = F.concat(longer, _letters(F.substring(entity, F.lit(1), F.length(entity) - F.length(top)), s), top)
        rest = let(_letters(F.substring(entity, F.lit(5), F.length(entity)), s), lambda r: F.struct(r.alias("r"), _remainder(F.concat(F.substring(entity, 1, 2), F.lit("00"), r)).alias("m")))
        checked = let(rest, lambda x: F.concat(F.substring(entity, 1, 2), F.lpad((98 - x["m"]).cast("string"), 2, "0"), x["r"]))
        account = F.when(_remainder(entity) == 1, checked).otherwise(F.concat(F.substring(entity, 1, 2), _letters(F.substring(entity, F.lit(3), F.length(entity)), s)))
        words = F.split(F.substring(entity, F.lit(3), F.length(entity)), " ")
        cyrillic = F.regexp_like(entity, F.lit(r"\p{IsCyrillic}"))
        gender = F.substring(entity, 1, 1)
        lists = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.split(F.lit(v), " "))])

        def name(w, i):
            pool = let(F.element_at(lists, F.concat(F.when(cyrillic, F.lit("c")).otherwise(F.lit("")), gender)), lambda p: F.get(p, _draw(s, i * 4, F.size(p))))
            parts = F.when(cyrillic, F.array(*[F.lit(x) for x in CYRILLIC])).otherwise(F.array(*[F.lit(x) for x in SYLLABLES]))
            family = let(parts, lambda p: F.initcap(F.concat_ws("", F.transform(F.sequence(F.lit(1), more + 3), lambda k: F.get(p, _draw(s, i * 4 + k, F.size(p)))))))
            return F.when((i == 0) & (F.size(words) > 1), pool).otherwise(family)

        person = F.concat_ws(" ", F.transform(words, name))
        return F.when(kind == "card", card).when(kind.isin(*_NUMERIC), number).when(kind == "ip", ip).when(kind == "email", email).when(kind == "account", account).otherwise(person)

    return let(_stream(kind, entity, attempt, key), made)


def _own_form(surrogate) -> F.Column:
    """A surrogate as an entity, to hold it against entities."""
    return F.lower(surrogate)


def draw_surrogates(entities: DataFrame, key: str, most_rounds: int = 20) -> DataFrame:
    """(kind, entity) to (kind, entity, surrogate), one surrogate to an entity and none of them an entity."""
    real = entities.select("kind", F.lower(F.when(F.col("kind") == "person", F.substring("entity", 3, 1 << 20)).otherwise(F.col("entity"))).alias("form"), F.lit(True).alias("real")).distinct()
    now = entities.withColumn("attempt", F.lit(0))
    for _ in range(most_rounds):
        now = materialize(now.withColumn("surrogate", _surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key)).withColumn("form", _own_form(F.col("surrogate"))), "surrogates")
        first = now.groupBy("kind", "form").agg(F.min("entity").alias("first"), F.count(F.lit(1)).alias("n"))
        clash = first.join(real, ["kind", "form"], "left").where("n > 1 or real").select("kind", "form", F.when(F.col("real"), F.lit(None).cast("string")).otherwise(F.col("first")).alias("first"))
        clash = materialize(clash, "clashes")
        if clash.isEmpty():
            return now.select("kind", "entity", "surrogate")
        hit = F.col("clash") & ~F.col("entity").eqNullSafe(F.col("first"))
        again = now.join(clash.withColumn("clash", F.lit(True)), ["kind", "form"], "left").withColumn("clash", F.coalesce("clash", F.lit(False)))
        now = again.select("kind", "entity", F.when(hit, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {most_rounds} rounds; the space of a type is too small")


def _render(kind, hit, surrogate) -> F.Column:
    """The surrogate in the mention's punctuation and case."""
    digits = F.aggregate(
        F.split(hit, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(F.regexp_like(c, F.lit("[0-9]")), F.struct(F.concat(a["out"], F.substring(surrogate, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: a["out"],
    )
    spaced = F.aggregate(
        F.split(hit, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c != " ", F.struct(F.concat(a["out"], F.substring(surrogate, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: a["out"],
    )
    own = F.when(kind == "person", _name(hit)).otherwise(hit)
    short = F.when((kind == "person") & ~F.contains(own, F.lit(" ")), F.regexp_extract(surrogate, r"\S+$", 0)).otherwise(surrogate)
    shouted = (F.upper(own) == own) & (F.lower(own) != own)
    cased = F.when(shouted, F.upper(short)).otherwise(short)
    return F.when(kind.isin(*_NUMERIC), digits).when(kind == "account", spaced).when(kind == "person", F.concat(_title(hit), cased)).otherwise(cased)


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, entity) of every mention."""
    hits = docs.where(has_entity(F.col(text_col))).select(F.col(id_col).alias("id"), F.explode(_found(F.col(text_col))["hits"]).alias("x"))
    return hits.select("id", "x.kind", "x.entity")


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its texts; ``count_col`` adds the mentions of each. Texts with entities are scanned once and kept
    with what was found, under a number of their own, so that ids may repeat or be null."""
    i, f, m, r, q = fresh(docs, "_row", "_found", "_map", "_mapped", "_made")
    text = F.col(text_col)
    has = has_entity(text)
    busy = materialize(docs.where(has).withColumn(f, _found(text)).withColumn(i, F.monotonically_increasing_id()), "entities")
    found = busy.select(F.col(i).alias("row"), F.explode(F.col(f)["hits"]).alias("x")).select("row", "x.kind", "x.entity").distinct()
    drawn = draw_surrogates(found.select("kind", "entity").distinct(), key)
    pair = F.struct(F.concat_ws("\x1f", "kind", "entity"), "surrogate")
    mine = found.join(drawn, ["kind", "entity"]).groupBy("row").agg(F.map_from_entries(F.collect_list(pair)).alias(m)).withColumnRenamed("row", r)

    def put(x):
        def one(hit, at):
            got = let(F.element_at(F.col(m), F.concat_ws("\x1f", hit["kind"], hit["entity"])), lambda y: _render(hit["kind"], hit["hit"], y))
            return F.concat(F.get(x["gaps"], at), got)

        return F.struct(F.concat(F.concat_ws("", F.transform(x["hits"], one)), F.element_at(x["gaps"], -1)).alias("text"), F.size(x["hits"]).cast("long").alias("n"))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    done = busy.join(mine, F.col(i) == F.col(r)).withColumn(q, put(F.col(f))).select(*[F.col(f"{q}.text").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *([F.col(f"{q}.n").alias(count_col)] if count_col else []))
    rest = docs.where(~has).select(*columns, *([F.lit(0).cast("long").alias(count_col)] if count_col else []))
    return done.unionByName(rest)
