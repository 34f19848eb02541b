"""The pipeline's near duplicates against brute-force Jaccard."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from narrata.llm import simhash


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _texts():
    r = random.Random(8)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for k in range(40):
        base = [word() for _ in range(r.randrange(60, 200))]
        texts.append(" ".join(base))
        for _ in range(3):  # similarities from about 0.55 to 1
            new = list(base)
            for at in r.sample(range(len(new)), r.randrange(1 + len(new) // 20)):
                new[at] = word()
            texts.append(" ".join(new))
    hot = [word() for _ in range(150)]
    for _ in range(60):
        new = list(hot)
        for at in r.sample(range(150), r.randrange(8)):
            new[at] = word()
        texts.append(" ".join(new))
    return [*texts, "a b", "A  b", "", None, " \n", texts[0].upper()]


def _want(texts):
    sets, root = [_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both and both >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("leaf", [8192, 6])
def test_groups_are_those_of_all_pairs(spark, leaf):
    texts = _texts()
    want = _want(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.component_id for r in simhash.near_copies(docs, leaf_rows=leaf).collect()} == want
    if leaf > 6:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_candidates_at_the_threshold_reach_the_planned_recall():
    """Pairs of sets with a Jaccard similarity of 0.8 exactly: how many share a block and stay within the budget after it."""
    width, count, budget = simhash.plan(1000)
    r = np.random.default_rng(1)
    wide, found = -(-width * count // 64), 0
    for _ in range(300):
        h = r.integers(0, 1 << 63, 180, np.uint64)
        a, b = (np.unpackbits(simhash.majority(x, wide)) for x in (h[:162], h[18:]))  # 144 of 180 are shared
        a, b = (np.concatenate([x, x[: width + 64]]) for x in (a, b))
        found += any((a[i * width : (i + 1) * width] == b[i * width : (i + 1) * width]).all() and (a[(i + 1) * width :][:64] != b[(i + 1) * width :][:64]).sum() <= budget for i in range(count))
    assert found / 300 >= 0.99


def test_plan_keeps_units_small_at_every_size():
    for n in (10, 10**6, 10**8, 5 * 10**10):
        width, count, _ = simhash.plan(n)
        assert n / 2**width <= 16 and width * count / 8 < 8192


def test_rows_of_one_id_are_told_apart_by_text(spark):
    docs = spark.createDataFrame([(1, "one text of a few words here", 1), (1, "quite another text with other words", 2), (1, "one text of a few words here", 1), (None, "no id for these words at all", 3), (None, "no id for these words at all", 3), (2, "ONE text of a few words here", 4)], "doc_id long, text string, kid long")
    got = sorted((r.doc_id or 0, r.text, r.kid) for r in simhash.one_of_each(docs).collect())
    assert got == [(0, "no id for these words at all", 3), (1, "one text of a few words here", 1), (1, "quite another text with other words", 2)]


def test_stage_on_the_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = _want([r.text for r in rows])
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows), sf)
    assert {r.doc_id for r in kept.collect()} == {rows[k].doc_id for k in set(want.values())}


def test_rows_that_are_seen_end_the_walk_and_none_is_missed():
    r = np.random.default_rng(5)
    v = np.concatenate([(1 << 40) ^ np.packbits((r.random((600, 64)) < 0.12).astype(np.uint8), axis=1).view("<u8")[:, 0], r.integers(0, 1 << 63, 600, np.uint64)])
    unit, side = np.zeros(len(v), np.int64), np.zeros(len(v), np.int32)
    every = {int(i) for a, b in simhash.trie_pairs(unit, side, v, 12, most=500) for i in np.r_[a, b]}
    seen, walked = np.zeros(len(v), bool), 0
    for a, b in simhash.trie_pairs(unit, side, v, 12, most=500, skip=seen):
        walked += len(a)
        seen[a] = seen[b] = True
    assert set(np.flatnonzero(seen).tolist()) == every and 0 < walked < sum(len(a) for a, b in simhash.trie_pairs(unit, side, v, 12, most=500))


def test_a_pair_is_given_by_the_first_block_in_which_it_meets():
    width, count, budget = simhash.plan(1000)
    wide = -(-width * count // 64)
    whole = simhash.Whole(width, count, budget, simhash.whole_budget(wide * 64))
    r = np.random.default_rng(2)
    differ = np.packbits((r.random((400, wide * 64)) < 0.13).astype(np.uint8), axis=1)
    given = np.zeros(400, int)
    for row, bytes_ in enumerate(differ):
        bits = np.unpackbits(bytes_)
        bits = np.concatenate([bits, bits[: width + 64]])
        meets = [i for i in range(count) if not bits[i * width : (i + 1) * width].any() and bits[(i + 1) * width :][:64].sum() <= budget]
        for i in meets:
            kept = whole.keeps(differ[row : row + 1], np.array([i], np.int32))[0]
            assert kept == (i == meets[0] and np.unpackbits(bytes_).sum() <= whole.bits)
            given[row] += kept
    assert given.max() == 1 and given.mean() > 0.9
    far = np.packbits((r.random((50, wide * 64)) < 0.3).astype(np.uint8), axis=1)
    assert not whole.keeps(far, np.zeros(50, np.int32)).any()


def test_equal_values_of_two_components_are_walked_in_bounded_memory():
    """A unit of texts that agree in the block and the 64 bits after it, one of them in another component: its pairs are some 4 million, which held at once took 209 MB."""
    n, zero = 2048, np.zeros(2048, np.int64)
    comp = zero.copy()
    comp[n // 2] = 1
    tracemalloc.start()
    got = [set(zip(a.tolist(), b.tolist())) for a, b in simhash.trie_pairs(zero, zero.astype(np.int32), zero.view(np.uint64), 16, comp)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set().union(*got) == {(min(i, n // 2), max(i, n // 2)) for i in range(n) if i != n // 2} and sum(map(len, got)) == n - 1
    assert peak < 40e6


def test_products_are_those_of_all_ranges_in_parts_of_any_size():
    ranges = np.array([[0, 3, 0, 3], [0, 3, 3, 8], [8, 9, 8, 9], [9, 10, 10, 14], [14, 18, 14, 18]]).T
    want = [(a, b) for alo, ahi, blo, bhi in ranges.T.tolist() for a in range(alo, ahi) for b in range(blo, bhi) if alo != blo or a < b]
    for most in (1, 4, 7, 1000):
        parts = list(simhash._products(ranges, most))
        assert [(int(x), int(y)) for a, b in parts for x, y in zip(a, b)] == want and max(len(a) for a, _ in parts) <= most
