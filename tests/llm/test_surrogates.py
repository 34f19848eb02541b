"""The surrogates query against a plain search for entities, and mentions of any length."""

import pytest
import regex

from narrata.llm import pii, queries

ORDER = ("email", "ip", "ssn", "phone", "account", "card", "person")


def _mentions(text):
    """(start, end, kind) by trying every type at every place; the first that fits counts."""
    kinds = {k: regex.compile(pii.PATTERNS[k]) for k in ORDER}

    def sweep(forms=()):
        out, at = [], 0
        names = [regex.compile(r"(?<![\p{L}\p{N}_@.])(?<!\p{L}[\-'’])" + r"\s+".join(map(regex.escape, f.split(" "))) + r"(?![\p{L}\p{N}_@]|\.[\p{L}\p{N}]|[\-'’](?![sS](?!\p{L}))\p{L})") for f in forms]
        while at < len(text):
            hit = next(((m, k) for k in ORDER if (m := kinds[k].match(text, at))), None) or next(((m, "person") for n in names if (m := n.match(text, at))), None)
            if hit and hit[0].end() > at:
                out.append((at, hit[0].end(), hit[1]))
                at = hit[0].end()
            else:
                at += 1
        return out

    found = sweep()
    people = [_name(text[a:b]) for a, b, k in found if k == "person"]
    forms = {x for n in people for f in (n, n.split(" ")[-1]) for x in (f, f.upper(), " ".join(w[:1].upper() + w[1:].lower() for w in f.split(" ")))}
    return sweep(sorted(forms, key=len, reverse=True)) if people else found


def _name(hit):
    return regex.sub(r"\s+", " ", regex.sub(rf"^(?:{pii.MALE_TITLES}|{pii.FEMALE_TITLES}|{pii.OTHER_TITLES})\.?\s+", "", hit))


def _same(kind, hit):
    if kind in ("phone", "card", "ssn"):
        return regex.sub("[^0-9]", "", hit)
    return _name(hit).lower() if kind == "person" else hit.replace(" ", "") if kind == "account" else hit.lower()


def _shape(t):
    return "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in t)


def test_query_against_a_plain_search(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op7_surrogates(spark, sf).collect()}
    assert set(got) == set(docs)
    forward, back, kinds = {}, {}, set()
    for key, text in docs.items():
        hits = _mentions(text)
        assert got[key].n_entities == len(hits)
        ends = [0, *(b for _, b, _ in hits)]
        gaps = [text[a:b] for a, b in zip(ends, [*(a for a, _, _ in hits), len(text)], strict=True)]
        m = regex.fullmatch("(.+?)".join(map(regex.escape, gaps)), got[key].text, regex.S)
        assert m, key
        for (a, b, kind), new in zip(hits, m.groups(), strict=True):
            kinds.add(kind)
            old, own = _same(kind, text[a:b]), _same(kind, new)
            assert old != own and own not in text.lower()
            if kind in ("phone", "card", "ssn", "account"):
                assert _shape(new) == _shape(text[a:b])
            if kind != "person":  # one surrogate to an entity, and no entity's surrogate twice
                assert forward.setdefault((kind, old), own) == own and back.setdefault((kind, own), old) == old
    assert len(kinds) >= 3 and not {(k, v) for (k, _), v in forward.items()} & set(forward)


@pytest.mark.parametrize(
    ("before", "hit", "after"),
    [
        ("write to ", "x" * 140 + "@example.org", " now"),
        ("write to ", "a@" + ".".join(["sub"] * 40) + ".example.org", ". Then"),
        ("write to ", "b" * 50000 + "@" + "c" * 50000 + ".org", ""),
        ("so ", "Mr Juan Carlos Alfonso Victor Maria", " left"),
        ("pay ", "DE89 3704 0044 0532 0130 00", " at once"),
    ],
)
def test_whole_mentions_are_replaced(spark, before, hit, after):
    got = pii.surrogates(spark.createDataFrame([(1, before + hit + after)], "doc_id long, text string"), "k", count_col="n").first()
    assert got.n == 1 and got.text.startswith(before) and got.text.endswith(after)
    new = got.text[len(before) : len(got.text) - len(after)]
    assert new != hit and not any(w in new for w in hit.replace("@", ".").split(".") if len(w) > 3)
    if hit.startswith("DE89"):
        assert _shape(new)[2:4] == "99" and int("".join(str(int(c, 36)) for c in (new[4:] + new[:4]).replace(" ", ""))) % 97 == 1


def test_rows_without_an_id_keep_their_own_entities(spark):
    rows = [(None, f"mail a{i}@example.org or b{i}@example.org") for i in range(50)] + [(3, "x@y.org"), (3, "z@y.org")]
    got = [r.text for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    found = [m for t in got for m in regex.findall(r"\S+@\S+", t)]
    assert len(found) == len(set(found)) == 102
