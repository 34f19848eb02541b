"""Cases of a review that failed once."""

import random
import time
import tracemalloc
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from narrata.functions import changes, compare, signal, slices, splitting
from narrata.plans import registry


def test_a_table_that_is_a_folder_is_listed_once_by_its_name(spark, tmp_path):
    rows = spark.range(8)
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows.withColumn("lang", rows["id"] % 2).write.partitionBy("lang").parquet(str(tmp_path / "pages.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("part-*.parquet")).rename(tmp_path / "orders.parquet")
    assert sorted(r["stem"] for r in registry.QUERIES["listed_files"](spark, str(tmp_path)).collect()) == ["documents", "orders", "pages"]


@pytest.mark.parametrize("small", [0, 30])
def test_matcher_gives_the_opcodes_of_the_standard_one(monkeypatch, small):
    monkeypatch.setattr(changes.Matcher, "small", small)
    r = random.Random(5)
    for _ in range(300):
        signs = "ab cde"[: r.randint(1, 6)]
        a = r.choices(signs, k=r.randint(0, 60))
        b = r.choices(signs, k=r.randint(0, 60)) if r.random() < 0.4 else [y for x in a if r.random() < 0.9 for y in ((x,) if r.random() < 0.9 else (x, r.choice(signs)))]
        assert changes.Matcher(a, b).get_opcodes() == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_change_blocks_of_a_long_text_do_not_take_the_square_of_its_spaces():
    text = "".join(f"word{i % 977} " for i in range(20_000))
    start = time.perf_counter()
    found = changes.blocks(text, text.replace("word500 ", "word500", 3))
    assert len(found) == 3
    assert time.perf_counter() - start < 10


def test_slices_hold_about_their_bytes_and_all_rows():
    batch = pa.array(["a" * 600_000, None, "é" * 300_000, "", "b" * 3_000_000, "c", None] + ["d" * 100_000] * 25)
    parts = list(slices.slices(batch))
    assert pa.concat_arrays(parts).equals(batch) and all(p[:-1].nbytes <= slices.SLICE + 64 for p in parts) and len(parts) > 4
    lists = pa.array([[1.0] * 90_000, None, [], [2.0] * 90_000])
    assert [len(p) for p in slices.slices(lists)] == [4] and [len(p) for p in slices.slices(lists, 1 << 19)] == [1, 3] and list(slices.slices(lists[:0])) == []


def _held(run):
    tracemalloc.start()
    run()
    return tracemalloc.get_traced_memory()[1]


def test_sized_chunks_hold_objects_of_a_slice(monkeypatch):
    taken = {}
    monkeypatch.setattr(slices.F, "arrow_udf", lambda kind: lambda f: lambda column: taken.setdefault("f", f))
    splitting.sized_chunks(None, 400)
    text = "Some words that make a sentence of their own. " * 40
    batch = pa.array([text] * 8_000)
    got = []
    assert _held(lambda: got.extend(len(x) for x in taken["f"](iter([batch])))) < 8 << 20
    assert sum(got) == 8_000 and len(got) > 8


def test_safe_split_holds_objects_of_a_slice(monkeypatch):
    taken = {}
    monkeypatch.setattr(slices.F, "arrow_udf", lambda kind: lambda f: lambda column: taken.setdefault("f", f))
    splitting.safely_split(None)
    batch = pa.array(["Some words that make a sentence of their own. " * 20] * 4_000)
    got = []
    assert _held(lambda: got.extend(len(x) for x in taken["f"](iter([batch])))) < 8 << 20
    assert sum(got) == 4_000 and len(got) > 3


def test_window_stats_stay_arrays(monkeypatch):
    taken = {}
    monkeypatch.setattr(signal.F, "arrow_udf", lambda kind: lambda f: lambda column: taken.setdefault("f", f))
    signal.window_stats(None, 100)
    batch = pa.array([[float(i % 7) for i in range(100)]] * 200 + [None, []])
    got = []
    assert _held(lambda: got.extend(taken["f"](iter([batch])))) < 4 << 20
    rows = pa.concat_arrays(got).to_pylist()
    assert [len(x) if x is not None else None for x in rows] == [100] * 200 + [None, 0] and rows[0][99] == {"start": 99, "zcr": 0.0, "lfr": 0.0, "rms": 0.0}


def test_comparison_form_and_sound_key_take_few_passes(spark):
    form = compare.comparison_form(F.col("x"))
    assert str(form).count("regexp_replace") <= 2
    texts = ["", " ", "a+b  c_d 12 e", "Ёж, й\u0306 — É\u00a0z\t\n9", "...", "½ a\U0001f600b", "x" + " -1" * 20_000 + "y"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", form.alias("f"), compare.sound_key(F.col("x")).alias("s")).collect()
    assert [r["f"] for r in rows] == [compare.comparison_form_of(t) for t in texts] and [r["s"] for r in rows][:3] == texts[:3]
