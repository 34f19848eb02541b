"""Document frequencies over all training rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from narrata.llm import langid, queries


def test_frequencies_cover_all_training_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    x, letters = langid.counts([r.text for r in docs.where(~langid.held_out() & F.col("lang").isNotNull()).collect()])
    want = np.log((1 + (letters > 0).sum()) / (1 + (x[letters > 0] > 0).sum(0))) + 1
    model = langid.fit(docs.repartition(7), ~langid.held_out(), per_lang=10)
    assert np.allclose(model.idf, want, atol=1e-5)


def _grams(text):
    """Buckets of the letter n-grams of a text, one character at a time."""
    m = (1 << 32) - 1
    out, t = {}, " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    t = [ord(c) for c in f" {t} "] if t else []
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if n == 1 and g[0] == 32:
                continue
            h = g[0] * 2654435761 & m
            if n == 2:
                h ^= g[1] * 2246822519 & m
            if n == 3:
                h ^= (g[1] * 3266489917 & m) ^ (g[2] * 668265263 & m)
            h = (h ^ (h >> 15)) * 2654435769 & m
            out[h >> 19] = out.get(h >> 19, 0) + 1
    return out


def test_query_against_plain_cosines(spark, sf):
    """Every text's distance to every centroid, one n-gram at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    got = {r.doc_id: r for r in queries.op2_language(spark, sf).collect()}
    rows = docs.collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        letters = sum(c.isalpha() for c in (r.text or "").lower())
        if not letters:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score, got[r.doc_id].rejected) == ("und", 0, True)
            continue
        x = {k: math.log1p(n) * float(model.idf[k]) for k, n in _grams(r.text).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        near = [sum(v * float(c[k]) for k, v in x.items()) / size for c in model.centroids]
        best = max(near)
        assert got[r.doc_id].lang_pred in {a for a, b in zip(model.langs, near, strict=True) if b > best - 1e-5} and abs(got[r.doc_id].score - min(1.0, max(0.0, best))) < 1e-4
        limit = model.nearest(np.array([letters]))[0]
        assert got[r.doc_id].rejected == (best < limit) or abs(best - limit) < 1e-4


def test_long_texts_lose_no_gram(monkeypatch):
    text = "Ünder lying  text, with 12 spaces -- and more of it. " * 40
    whole, letters = langid.counts([text, "short"])
    monkeypatch.setattr(langid, "_PART", 64)
    cut, again = langid.counts([text, "short"])
    assert np.array_equal(whole, cut) and np.array_equal(letters, again)
    want = _grams(text)
    assert {int(k): int(whole[0][k]) for k in np.flatnonzero(whole[0])} == want
