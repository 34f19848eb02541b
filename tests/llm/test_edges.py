"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from narrata.llm import _work, cotraining, html_text, langid, mixing, packing, pii, rules, secrets, simhash, sketches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the long text goes on and on " * 4000
#: One token of 300,000 characters, then 400,000 letters of short words on one line.
WIDE = "x1" * 150_000 + " " + "ab cd " * 100_000
ROWS = [
    (1, "a short text of some words", "en", "s", 26),
    (1, "a short text of some words", "en", "s", 26),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (None, "no id at all but the words are there", "en", None, 36),
    (4, "   \n\t ", None, "s", 6),
    (5, LONG, "en", "hot", len(LONG)),
    (6, "123 456 !!! ...", "fr", "s", 15),
    (7, "un texte court de quelques mots", "fr", "t", 31),
    (8, "𝒳 ǘ é\x00 \x85 � <|endoftext|> 中文", "en", "t", 20),
]
CLASH = ("id", "row", "fp", "component_id", "size", "copies", "_id", "_map", "_copy", "_keep", "rank", "h", "found", "n", "key", "t")


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.fit(secrets.labelled_findings(spark, rows=400), trees=4)


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 0), (7, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "simhash": lambda d, s, f: simhash.near_duplicate_groups(d),
    "language": lambda d, s, f: langid.identify(d, langid.fit(d, ~langid.held_out())),
    "rules": lambda d, s, f: rules.judge(d),
    "quality": lambda d, s, f: (lambda v: cotraining.score(v, cotraining.fit(v, _labels(s))))(cotraining.vectors(d)),
    "sketch": lambda d, s, f: sketches.fingerprint_versions(d),
    "surrogates": lambda d, s, f: pii.surrogates(d, "k", count_col="n_entities"),
    "mixing": lambda d, s, f: mixing.mix(d),
    "main_text": lambda d, s, f: html_text.extract(d.withColumn("url", F.col("source")).withColumn("html", F.col("text")), id_col="doc_id"),
    "redact": lambda d, s, f: secrets.redact(d, f),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, odd, empty, forest, name):
    assert len(OPERATORS[name](odd, spark, forest).collect()) == len(ROWS)
    assert OPERATORS[name](empty, spark, forest).collect() == []


def test_packing_holds_every_token_once(odd, empty):
    got = packing.pack(odd).collect()
    assert packing.pack(empty).collect() == []
    whole = {r.id: r.doc_tokens for r in got}
    for key, n in whole.items():
        copies = 2 if key == 1 else 1
        assert sum(r.length for r in got if r.id == key) == n * copies
    assert whole[2] == whole[3] == whole[4] == 1


def test_findings_on_odd_rows(odd, empty, forest):
    assert not any(r.secret for r in secrets.find(odd, forest).collect())
    assert secrets.find(empty, forest).collect() == []


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, sf, odd, empty, name, stage):
    out = stage(spark, odd, sf)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd.columns
    out.collect()
    assert stage(spark, empty, sf).collect() == []


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="did not settle in 2 rounds"):
        simhash.components(chain, most_rounds=2, small=0)
    for small in (0, 100):
        assert {(r.node, r.root) for r in simhash.components(chain, small=small).collect()} == {(i, 0) for i in range(1, 41)}
    assert simhash.components(chain.where("a < 0")).collect() == []


def test_a_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        _work.shared_dir(Session)


def test_defined_results(spark, odd):
    comp = {(r.id, r.fp): r.component_id for r in simhash.near_duplicate_groups(odd).collect()}
    assert comp[2, 0] == comp[3, 0] == comp[4, 0] == 2
    lang = {r.id: r for r in langid.identify(odd, langid.fit(odd, ~langid.held_out())).collect()}
    assert all(lang[k].lang_pred == "und" and lang[k].score == 0 for k in (2, 3, 4, 6)) and lang[5].lang_pred == "en"
    kept = simhash.one_of_each(odd)
    assert kept.where("doc_id = 1").count() == 1 and kept.where("trim(coalesce(text, '')) in ('', '\n')").count() <= 1
    taken = mixing.mix(odd).collect()
    assert all(r.copies == 0 for r in taken if r.source_size == 0)
    again = mixing.mixed(odd)
    assert again.count() == sum(r.copies for r in taken)


def test_release_takes_the_written_tables_away(spark):
    kept = _work.materialize(spark.range(3), "some")
    assert kept.count() == 3
    _work.release(spark)
    with pytest.raises(Exception, match=r"(?i)path|file"):
        spark.read.parquet(*kept.inputFiles()).count()
    assert _work.materialize(spark.range(2), "again").count() == 2
