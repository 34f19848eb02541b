"""The secret scan's query against a plain scan, and findings of other kinds than the made ones."""

import hashlib
import random

import pytest
import regex

from narrata.llm import queries, secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.fit(secrets.labelled_findings(spark))


def _features(before, value, after, assigned):
    n = max(1, len(value))
    flat = lambda x: regex.sub("[\t\n\r\x0b\x0c]", " ", x)
    around = " ".join([*flat(before).rstrip(" ").split(" ")[-4:], *flat(after).lstrip(" ").split(" ")[:4]])
    near = lambda names: float(bool(regex.search(rf"(?i)(?<![A-Za-z])(?:{names})(?![a-z])", around, regex.ASCII)))
    kind = lambda c: "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c
    classes = [kind(c) if kind(c) in "aA0" else "." for c in value]
    count = lambda lo, hi: sum(lo <= c <= hi for c in value) / n
    bare = regex.sub("|".join(sorted(secrets.DICTIONARY, key=len, reverse=True)), "", value.lower())
    path = regex.search(r"://|www\.|[\w.]/", flat(before).split(" ")[-1], regex.ASCII) or regex.search(r"[a-z]{2,}/[a-z]|\.[a-z]{2,4}$", value)
    return {
        "length": n, "transitions": sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n, "digits": count("0", "9"), "upper": count("A", "Z"), "lower": count("a", "z"), "distinct": len(set(value)) / n,
        "dictionary": (n - len(bare)) / n, "path": float(bool(path)), "assigned": float(assigned), "near_for": near(secrets.FOR), "near_against": near(secrets.AGAINST), "hexadecimal": float(bool(regex.fullmatch("[0-9a-fA-F]+", value))),
    }


def _score(model, features):
    def walk(node):
        if not isinstance(node, tuple):
            return node
        name, threshold, left, right = node
        return walk(left if features[name] <= threshold else right)

    return sum(map(walk, model["trees"])) / len(model["trees"])


def _plain(text, model):
    out, hits = [], list(regex.finditer(secrets.CANDIDATE, text, regex.ASCII))
    for i, m in enumerate(hits):
        lead = regex.match(secrets._ASSIGN, m[0])
        lead = lead[0] if lead else ""
        value = m[0][len(lead) :]
        block = m[0].startswith("-----BEGIN")
        before = text[hits[i - 1].end() if i else 0 : m.start()] + lead
        after = text[m.end() : hits[i + 1].start() if i + 1 < len(hits) else len(text)]
        score = 1.0 if block else _score(model, _features(before, value, after, bool(lead)))
        out.append((m.start() + len(lead), len(value), hashlib.sha256(value.encode()).hexdigest(), "private_key" if block else "assigned" if lead else "run", round(score, 9), score >= 0.5))
    return out


def test_query_against_a_plain_scan(spark, sf, forest):
    got = {}
    for r in queries.op10_secrets(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.value_sha256, r.kind, round(r.score, 9), r.secret))
    want = {r.doc_id: x for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if (x := _plain(r.text or "", forest))}
    assert {k: sorted(v) for k, v in got.items()} == want and want


def test_scan_of_made_texts_against_a_plain_one(spark, forest):
    r = random.Random(11)
    texts = []
    for row in secrets.labelled_findings(spark, rows=300, seed=5).collect():
        texts.append(f"{row.before}{row.value}{row.after} {'w ' * r.randrange(3)}\tsha1\n{row.before}{row.value}")
    got = {}
    for x in secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), forest).collect():
        got.setdefault(x.id, []).append((x.start, x.length, hashlib.sha256(x.value.encode()).hexdigest(), x.kind, round(x.score, 9), x.secret))
    assert {k: sorted(v) for k, v in got.items()} == {i: x for i, t in enumerate(texts) if (x := _plain(t, forest))}


def test_verdicts_on_findings_made_from_another_seed(spark, forest):
    rows = secrets.labelled_findings(spark, rows=1000, seed=99).collect()
    right = [(_score(forest, _features(x.before, x.value, x.after, x.assigned)) >= 0.5) == (x.secret == 1) for x in rows]
    assert sum(right) / len(right) > 0.95


@pytest.mark.parametrize(
    ("text", "secret"),
    [
        ("password: correcthorsebattery and more", True),
        ("login with QwErTzUiOpAsDfGhJkLyXcVbNmqWeRtZuI at once", True),
        ("the class DefaultServiceConfigurationUtilsModuleFactory is here", False),
        ("see https://www.example.org/Docs/Guide/Module/Service/Config/ for it", False),
        ("the uuid 123e4567-e89b-12d3-a456-426614174000 of the row", False),
        ("secret_key = os.environ.secret_key", False),
    ],
)
def test_single_findings(spark, forest, text, secret):
    got = secrets.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), forest).collect()
    assert any(x.secret for x in got) == secret, got


def test_neighbouring_words_of_any_length_count(spark, forest):
    far = "checksum " + "x" * 5000 + " "
    h = hashlib.sha1(b"y").hexdigest()
    got = secrets.find(spark.createDataFrame([(1, far + h), (2, "x " * 50 + h)], "doc_id long, text string"), forest).collect()
    assert {x.id: round(x.score, 9) for x in got if x.value == h} == {1: _plain(far + h, forest)[-1][4], 2: _plain("x " * 50 + h, forest)[-1][4]}
