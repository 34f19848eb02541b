"""Sources on disk, state tables, streams and loops."""

import os

import pytest
from pyspark.sql import functions as F

from narrata.operators import state
from narrata.operators.chunks import chunks
from narrata.plans import fixtures as fx
from narrata.sources import books, mappings, runs
from narrata.streaming import worker


def test_runs_on_disk(spark, tmp_path):
    for run, name, text in (("001", "0001_Old.txt", "old"), ("002", "0001_New_Title.txt", "new\nline"), ("002", "x.txt", "no")):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_text(text)
    got = runs.latest_run(runs.read_runs(spark, str(tmp_path))).collect()
    assert [(r.run_index, r.chapter_idx, r.title, r.text) for r in got] == [("002", 1, "New Title", "new\nline")]


def test_books_on_disk(spark, tmp_path):
    (tmp_path / "a.EPUB").write_bytes(fx.epub())
    (tmp_path / "b.fb2").write_bytes(fx.FB2)
    found = books.read_books(spark, str(tmp_path))
    assert {r["format"] for r in found.collect()} == {"epub", "fb2"}
    assert {r.title for r in books.epub_documents(found).collect()} == {"A Book"}
    assert {(r.title, r.author) for r in books.fb2_sections(found).collect()} == {("Tales", "Ann Other")}
    assert books.covers(found).where("cover is not null").count() == 0
    chapters = books.document_chapters(books.epub_documents(found), " @BRK#")
    assert [r.title for r in books.toc_chapters(chapters, books.epub_entries(found), " @BRK#").orderBy("chapter_idx").collect()] == ["Start", "End"]


def test_broken_book_names_its_path(spark, tmp_path):
    (tmp_path / "bad.epub").write_bytes(b"PK nothing")
    with pytest.raises(Exception, match="bad.epub"):
        books.epub_documents(books.read_books(spark, str(tmp_path))).collect()


def test_wrong_mapping_line_is_named(spark):
    with pytest.raises(Exception, match="line 2"):
        mappings.mapping(spark.createDataFrame([(1, "a==b"), (2, "nothing")], "line_no int, line string")).collect()
    with pytest.raises(Exception, match="two variants"):
        mappings.choice_mapping(spark.createDataFrame([(1, "a==b")], "line_no int, line string")).collect()


def test_files_of_rules_and_choices(spark, tmp_path):
    (tmp_path / "r.txt").write_text("a+==b\n# c==d\n==e\nx==y\n")
    assert mappings.replacement_rules(spark, str(tmp_path / "r.txt")) == [("a+", "b"), ("x", "y")]
    (tmp_path / "c.json").write_text('{"key": "k", "selection": {"option_id": "o"}}\nnot json\n')
    assert [r["key"] for r in mappings.choice_cache(spark, str(tmp_path / "c.json")).collect()] == ["k"]


def test_chapter_ranges(spark):
    rows = spark.createDataFrame([(i, "x" if i != 2 else "  ") for i in range(1, 6)], "chapter_idx int, text string")
    assert [r.chapter_idx for r in runs.select_chapters(rows, 2, 3).collect()] == [3, 4]
    for bad in ((0, -1), (5, -1), (1, 0), (1, 9), (3, 2), (1, -2)):
        with pytest.raises(ValueError):
            runs.select_chapters(rows, *bad)


def test_state_table_versions(spark, tmp_path):
    t = state.Table(spark, str(tmp_path / "t"), state.CHUNK_CACHE)
    assert t.version() == 0 and t.read().count() == 0
    first = fx.CACHE.df(spark).select(*[F.col(c) if c in fx.CACHE.df(spark).columns else F.lit(None).cast("string").alias(c) for c in [x.split()[0] for x in state.CHUNK_CACHE.split(", ")]])
    t.write(state.sticky_merge(t.read(), first.select("chapter_key", "sentence_hash", "original_text", "transcription", "similarity", "status")))
    assert t.version() == 1 and t.read().count() == 5
    os.makedirs(tmp_path / "t" / "v2")  # a version that was never finished
    assert t.version() == 1


def test_sticky_status_lattice(spark):
    for was, comes, forced, want in (("resolved", "disputed", False, "resolved"), ("resolved", "disputed", True, "disputed"), ("checked", "disputed", False, "disputed"), (None, "checked", False, "checked")):
        now = spark.createDataFrame([("c", "h", was)] if was else [], "chapter_key string, sentence_hash string, status string")
        new = spark.createDataFrame([("c", "h", comes)], "chapter_key string, sentence_hash string, status string")
        assert state.sticky_merge(now, new, forced).first()["status"] == want


def test_chunks_share_a_hash_whatever_the_voice(spark):
    rows = chunks(spark.createDataFrame([("c", "«Да, конечно.» Да, конечно.")], "chapter_key string, text string"), voice="v")
    assert rows.count() >= 1 and rows.where("length(sentence_hash) <> 16").count() == 0


def test_followed_folder_is_synthesized_once(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "chapter_key string, text string"
    done = worker.Log(spark, str(tmp_path / "done"))
    seen = []

    def synthesize(df):
        seen.append(df.count())
        return df.withColumn("status", F.lit("success"))

    def step(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        worker.follow_chapters(spark, source, schema, done, synthesize, str(tmp_path / "cp")).awaitTermination(120)

    step([("c1", "One here. Two here.")])
    step([("c1", "Two here. Three here.")])
    assert seen == [2, 1] and done.read().count() == 3
    done.append(1, spark.createDataFrame([("c1", "x", "success")], worker.DONE))  # the batch runs again
    assert done.read().count() == 3 and done.read(but=1).count() == 2
    done.compact()
    assert done.read().count() == 3 and os.listdir(tmp_path / "done") == ["batch=-1"]


def test_chains_of_two_tables_do_not_meet(spark):
    rows = lambda *v: spark.createDataFrame([(a, a, b, None) for a, b in v], state.VERSIONS)
    one, two = state.version_chain(spark, rows(("a", "b"), ("b", None))), state.version_chain(spark, rows(("x", None)))
    assert one.count() == 3 and two.count() == 1


def test_retry_loop(spark):
    left, recorded = [2, 1, 0], []
    out = worker.retry_until_good(lambda i: spark.range(left[i]), lambda df: recorded.append(df.count()))
    assert out == {"rounds": 3, "left": 0} and recorded == [2, 1]
    assert worker.retry_until_good(lambda i: spark.range(1), lambda df: None, most_retries=2) == {"rounds": 3, "left": 1}


def test_configuration_layers(tmp_path):
    from narrata import conf

    (tmp_path / "user.ini").write_text("[a]\nx = 1\ny = yes\nz =\n[b]\nname = one\n")
    (tmp_path / "book.ini").write_text("[a]\nx = 2.5\n")
    files = conf.layers(book=tmp_path / "book.epub", user=tmp_path / "user.ini", project=tmp_path / "none.ini")
    assert conf.merged(files, {"name": "two", "other": None}) == {"x": 2.5, "y": True, "name": "two"}
    with pytest.raises(FileNotFoundError):
        conf.layers(explicit=tmp_path / "no.ini")
    conf.snapshot({"a": 1, "b": None, "c": False}, tmp_path / "s.ini")
    assert conf.load(tmp_path / "s.ini") == {"a": 1}


def test_resume_plan(spark):
    from narrata.operators import steps

    rows = fx.STEPS.df(spark)
    assert steps.resume_plan(rows, "simple_symbols,ru_numbers,cosy_voice")["resume"]
    assert not steps.resume_plan(rows, "ru_numbers")["resume"]
    assert not steps.resume_plan(rows.where("status = 'success'"), "simple_symbols")["resume"]
    assert steps.resume_plan(rows.limit(0), "simple_symbols")["resume"]
