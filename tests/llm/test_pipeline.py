"""The pipeline, stage by stage, against plain versions of the stages."""

import duckdb
import numpy as np
import pytest
import test_findings
import test_packing
import test_similar
from pyspark.sql import functions as F

import corpus_pipeline
from narrata.llm import langid, mixing, packing, secrets


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Name to (rows before, rows after), with the rows of run() as those of the last stage."""
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        out[name] = before, docs.collect()
    out["pack"] = docs.collect(), corpus_pipeline.run(spark, sf)
    return out


def test_language_keeps_what_is_near(spark, sf, steps):
    before, after = steps["language"]
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"), ~langid.held_out())
    want = [r for r in before if not model.predict([r.text])[2][0]]  # the model itself is held against plain cosines elsewhere
    assert sorted(after) == sorted(want) and len(want) > 0.97 * len(before)
    unlabelled = spark.createDataFrame([(1, "some words", None), (2, "123", None)], "doc_id long, text string, lang string")
    assert langid.keep_known(unlabelled).count() == 2


def test_one_of_each_group_stays(steps):
    before, after = steps["near_duplicates"]
    rows = sorted(before, key=lambda r: r.doc_id)
    groups = test_similar._want([r.text for r in rows])
    assert sorted(after) == sorted(rows[k] for k in set(groups.values())) and len(after) < len(before)


def test_secrets_are_masked_and_nothing_else(spark, steps):
    before, after = steps["secret_scan"]
    model = secrets.fit(secrets.labelled_findings(spark))
    want = {}
    for r in before:
        text = r.text
        for start, length, _, _, _, secret in reversed(test_findings._plain(text, model)):
            text = text[:start] + secrets.MARK + text[start + length :] if secret else text
        want[r.doc_id] = (text, len(text), r.lang, r.source)
    assert {r.doc_id: (r.text, r.n_chars, r.lang, r.source) for r in after} == want
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    one = spark.createDataFrame([(1, f'so token = "{token}" it is', "en", "s", 60)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.secret_scan(spark, one, "").first().text == f'so token = "{secrets.MARK}" it is'


def test_the_mix_is_that_of_its_sql(spark, steps):
    before, after = steps["mix"]
    con = duckdb.connect()
    documents = spark.createDataFrame(before).toPandas()
    con.register("documents", documents)
    taken = {i: t // size for i, size, t in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE})").fetchall() if size}
    assert sorted(r.doc_id for r in after) == sorted(i for i, n in taken.items() for _ in range(n))
    rows = {r.doc_id: r for r in before}
    assert all(r == rows[r.doc_id] for r in after)


def test_packing_of_the_mix(spark, steps):
    before, packed = steps["pack"]
    got = packed.toPandas()
    tokens = packing.tokenizer(None)
    texts, copies = {r.doc_id: r.text for r in before}, {}
    for r in before:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(got.doc_id) == set(copies)
    for key, n in copies.items():
        ids = np.array([*tokens.whole.encode(texts[key], add_special_tokens=False).ids, 2], tokens.kind)
        mine = got[got.doc_id == key]
        assert mine.length.sum() == n * len(ids) and all(p.ids == ids[p.start : p.start + p.length].tobytes() for p in mine.itertuples())
    by = got.sort_values("offset").groupby("sequence_id")
    assert all((g.offset.values == np.r_[0, g.length.cumsum()[:-1]]).all() for _, g in by) and (by.length.sum().iloc[:-1] == packing.WINDOW).all()
    once = spark.createDataFrame([r for r in before if copies[r.doc_id] == 1])
    alone = packing.pack(once).withColumnRenamed("id", "doc_id").toPandas()
    weights = alone.groupby("source").length.sum().to_dict()
    test_packing._held_against(spark, once, alone, lambda q: weights, packing.WINDOW, packing.LEAST_PIECE)
    assert packed.where(F.col("length") > packing.WINDOW).count() == 0
