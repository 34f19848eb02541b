"""Co-training against a plain version over lists, and on labels left out."""

import math
import zlib

import numpy as np

from narrata.llm import cotraining, queries


def test_quality_of_labels_left_out(spark, sf):
    """Half of the labels are learnt; the other half is judged."""
    sf = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    vectors = cotraining.vectors(docs)
    model = cotraining.fit(vectors, labels.where("doc_id % 2 = 0"))
    got = cotraining.score(vectors, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "id"), "id").toPandas()
    assert len(got) > 100 and (got.kept == (got.quality == 1)).mean() > 0.97 and got.quality_score.between(0, 1).all()


def _plain(x, y, other, rounds=5, step=0.05, sure=0.9, z=2.58):
    """Every row of ``other`` is looked at in every round; what is named is kept in dictionaries."""
    out = cotraining.left_out(y)
    told = [{}, {}]
    for turn in range(rounds + 1):
        fitted = []
        for v in range(2):
            at = list(told[v])
            rows = np.concatenate([x[v][~out], other[v][np.array(at, int)]])
            fitted.append(cotraining._train(rows, np.r_[y[~out], [told[v][i] for i in at]], np.r_[np.ones((~out).sum()), np.full(len(at), 0.5)]))
        if turn == rounds:
            break
        new = [{}, {}]
        for v in range(2):
            odds = [float(o) for o in fitted[v].raw(other[v])]
            place = [min(max(int((o + 30) * 100), 0), 5999) for o in odds]
            free = [i for i in range(len(odds)) if i not in told[1 - v]]
            tried = [(min(max(int((float(o) + 30) * 100), 0), 5999), z) for o, z in zip(fitted[v].raw(x[v][out if out.any() else ~out]), y[out if out.any() else ~out], strict=True)]

            def limits(good, tried=tried):
                """The first place, coming from the far end, beyond which the left-out rows are right often enough."""
                for edge in range(6000) if good else range(5999, -1, -1):
                    there = [w for p, w in tried if (p >= edge if good else p <= edge)]
                    n, k = len(there), sum(w == good for w in there)
                    if n and (k / n + z * z / (2 * n) - z * math.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n) >= sure:
                        return edge
                return 6000 if good else -1

            for good, want in ((True, math.ceil(step * len(odds) * y.mean())), (False, math.ceil(step * len(odds) * (1 - y.mean())))):
                ranked = sorted((place[i] for i in free), reverse=good)
                if not ranked:
                    continue
                cut = ranked[min(want, len(ranked)) - 1]
                cut = max(cut, limits(good)) if good else min(cut, limits(good))
                for i in free:
                    if (place[i] >= cut) if good else (place[i] <= cut):
                        new[1 - v].setdefault(i, 1.0 if good else 0.0)
        for v in range(2):
            told[v] |= {i: z for i, z in new[v].items() if i not in told[v]}
    cotraining.calibrated(fitted, [z[out] for z in x] if out.any() else x, y[out] if out.any() else y)
    return fitted, told


def test_rounds_and_query_against_a_plain_version(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels.setdefault(r.doc_id, []).append(r.quality)
    half = lambda v: v.astype("<f2").astype(float)
    ids = sorted(docs)
    both = [half(v) for v in cotraining.views([docs[i].text.encode() for i in ids], [docs[i].lang for i in ids], [docs[i].source for i in ids])]
    known = [k for k, i in enumerate(ids) if i in labels]
    rest = [k for k, i in enumerate(ids) if i not in labels]
    y = np.array([float(np.mean(labels[ids[k]]) >= 0.5) for k in known])
    fitted, told = _plain([v[known] for v in both], y, [v[rest] for v in both])
    assert sum(map(len, told)) > 10
    odds = [v.odds(x) for v, x in zip(fitted, both, strict=True)]
    prior = math.log(y.mean() / (1 - y.mean()))
    want = dict(zip(ids, 1 / (1 + np.exp(-(odds[0] + odds[1] - prior))), strict=True))
    got = {r.doc_id: r.quality_score for r in queries.op4_quality(spark, sf).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in ids) < 1e-6


def test_a_view_that_tells_nothing_names_nothing():
    r = np.random.default_rng(4)
    y = (r.random(500) < 0.85).astype(float)
    assert cotraining.sure_bins(r.normal(0, 1, 500) + 3, y, 0.9, 2.58) == (cotraining._BINS, -1)
    good, bad = cotraining.sure_bins(np.where(y == 1, 2.0, -2.0) + r.normal(0, 0.1, 500), y, 0.9, 2.58)
    middle = int(cotraining._bin(np.array([0.0]))[0])
    assert cotraining._bin(np.array([-2.4]))[0] < good < cotraining._bin(np.array([1.7]))[0] and bad < cotraining._bin(np.array([2.0]))[0] and bad > cotraining._bin(np.array([-2.0]))[0] and middle > 0
    assert cotraining.sure_bins(np.zeros(0), np.zeros(0), 0.9, 2.58) == (cotraining._BINS, -1)


def test_every_word_counts():
    a, b = (cotraining.content_view(f"some text with {w} in it".encode()) for w in ("incomprehensible", "acknowledgements"))
    at = [cotraining._SHARES + zlib.crc32(w) % (cotraining.CONTENT - cotraining._SHARES) for w in (b"incomprehensible", b"acknowledgements")]
    assert a[at[0]] > b[at[0]] and b[at[1]] > a[at[1]]


def test_views_teach_each_other(spark):
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 2000).astype(float)
    c, m = (np.c_[y[:, None] * 2 + r.normal(0, 1, (2000, 1)), r.normal(0, 1, (2000, 3))] for _ in range(2))
    x, other = [c[:20], m[:20]], [c[20:], m[20:]]

    def histograms(rounds, views):
        told = cotraining.named(rounds, other)
        return np.stack([np.bincount(cotraining._bin(views[v].raw(other[v]))[told[1 - v] < 0], minlength=cotraining._BINS) for v in range(2)])

    def taught(rounds, parts):
        told = cotraining.named(rounds, other)
        return [(other[v][told[v] >= 0], told[v][told[v] >= 0].astype(float)) for v in range(2)]

    model = cotraining.cotrain(x, y[:20], 1980, histograms, taught, doubt=0.0)
    assert ((model.score(c, m)[0] > 0.5) == y).mean() > 0.85
    one = cotraining.cotrain([c[:5], m[:5]], np.ones(5), 1980, histograms, taught)
    assert one.score(c, m)[0].tolist() == [1.0] * 2000
