"""Queries of the sound functions: cleaning steps on short signals, windows over numbers of the event table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import signal
from narrata.plans.base import query, read

RATE = 8000


def _tone(ms: int, hertz: float = 300, level: float = 0.4) -> list[int]:
    t = np.arange(RATE * ms // 1000) / RATE
    return (level * 32767 * np.sin(2 * np.pi * hertz * t)).astype(int).tolist()


def _quiet(ms: int) -> list[int]:
    return [0] * (RATE * ms // 1000)


def _rows(spark: SparkSession, *signals: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(signals, 1)), "id int, samples array<int>")


def _text(name: str = "samples"):
    return F.concat_ws(",", F.transform(name, lambda x: x.cast("string")))


@query("SELECT * FROM (VALUES (1, '-100,0,100'), (2, '1,-1,0'), (3, '0,0'), (4, '-20922,-20922,32767'), (5, '')) t(id, samples)")
def sound_offset(spark, sf_dir):
    """The mean goes; one under a step stays; what leaves the range is held."""
    rows = _rows(spark, [100, 200, 300], [1, -1, 0], [32767, 32767], [-30000, -30000, 32767], [])
    return rows.select("id", signal.cleaned(F.col("samples"), RATE, lambda x, r: signal.remove_offset(x)).alias("samples")).withColumn("samples", _text())


@query("SELECT * FROM (VALUES (1, '0,250,500,750,1000,1000'), (2, '1000,1000,750,500,250,0'), (3, '0,1000')) t(id, samples)")
def sound_fades(spark, sf_dir):
    """Ramps over five frames at the start or the end; a signal shorter than its ramp is ramp only."""
    rows = _rows(spark, [1000] * 6, [1000] * 6, [1000] * 2)
    start = signal.cleaned(F.col("samples"), RATE, lambda x, r: signal.fade(x, 5, True, False))
    end = signal.cleaned(F.col("samples"), RATE, lambda x, r: signal.fade(x, 5, False, True))
    return rows.select("id", F.when(F.col("id") == 2, F.concat_ws(",", F.transform(end, lambda x: x.cast("string")))).otherwise(F.concat_ws(",", F.transform(start, lambda x: x.cast("string")))).alias("samples"))


@query("SELECT * FROM (VALUES (1, 800, true), (2, 800, false), (3, 776, true)) t(id, n, quiet_start)")
def sound_click(spark, sf_dir):
    """A quiet start and a start without a burst stay; a burst goes up to the quiet after it (the first 3 ms are looked at whole)."""
    rows = _rows(spark, _quiet(100), [500] * 800, [9000] * 8 + _quiet(99))
    out = signal.cleaned(F.col("samples"), RATE, lambda x, r: signal.remove_click(x, r))
    return rows.withColumn("s", out).select("id", F.size("s").alias("n"), (F.abs(F.get("s", 0)) < 100).alias("quiet_start"))


@query("""SELECT * FROM (VALUES (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 4800), (9, 4000)) t(id, frames)""")
def sound_gap_preamble(spark, sf_dir):
    """Speech only, silence first, too short a gap, nothing after it, a gap that begins too late, too little sound, silence only; then 200 and 100 ms of stray sound and 400 ms of gap."""
    rows = _rows(
        spark, _tone(500) + _tone(500, 200, 0.3), _quiet(200) + _tone(400), _tone(200) + _quiet(50) + _tone(400), _tone(200) + _quiet(800), _tone(800) + _quiet(300) + _tone(400), [3000] * 4, _quiet(500),
        _tone(200) + _quiet(400) + _tone(400, 200), _tone(100) + _quiet(400) + _tone(400, 200),
    )
    return rows.select("id", signal.measured(F.col("samples"), RATE, signal.gap_preamble_frames).alias("frames"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false)) t(id, found)")
def sound_low_preamble(spark, sf_dir):
    """A hum of 60 ms before sound with many sign changes is found (not beyond 80 ms); sound alone and silence have none."""
    r = np.random.default_rng(3)
    speech = (r.normal(0, 6000, RATE // 2)).astype(int).tolist()
    rows = _rows(spark, _tone(60, 60, 0.3) + speech, speech, _quiet(500))
    frames = signal.measured(F.col("samples"), RATE, signal.low_preamble_frames)
    return rows.withColumn("f", frames).select("id", ((F.col("f") > 0) & (F.col("f") <= RATE * 80 // 1000)).alias("found"))


@query("SELECT * FROM (VALUES (1, 4000), (2, 2400), (3, 800)) t(id, n)")
def sound_trailing_silence(spark, sf_dir):
    """After the last loud 10 ms 200 ms stay; a shorter end stays whole; silence stays as it is."""
    rows = _rows(spark, [8000] * (RATE * 300 // 1000) + _quiet(900), [8000] * (RATE * 250 // 1000) + _quiet(50), _quiet(100))
    return rows.select("id", F.size(signal.cleaned(F.col("samples"), RATE, lambda x, r: signal.trim_silence(x, r))).alias("n"))


@query("SELECT * FROM (VALUES (1, 4800), (2, 800)) t(id, n)")
def sound_preambles(spark, sf_dir):
    rows = _rows(spark, _tone(200) + _quiet(400) + _tone(600, 200), _tone(100))
    return rows.select("id", F.size(signal.cleaned(F.col("samples"), RATE, lambda x, r: signal.remove_preambles(x, r, low=False))).alias("n"))


@query("""WITH s AS (SELECT user_id, list(value - 50 ORDER BY event_id) AS v FROM events GROUP BY user_id), p AS (SELECT user_id, v, greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-9) AS top FROM s),
w AS (SELECT user_id, top, i, v[i + 1] AS a, v[i + 2] AS b FROM (SELECT user_id, top, v, unnest(range(0, len(v))) AS i FROM p))
SELECT user_id, CAST(i AS INTEGER) AS start, CASE WHEN b IS NULL THEN 0.0 ELSE CASE WHEN (a >= 0) <> (b >= 0) THEN 0.25 ELSE 0.0 END END AS zcr,
round(CASE WHEN b IS NULL THEN 0.0 ELSE sqrt((a / top * (a / top) + b / top * (b / top)) / 2) END, 9) AS rms FROM w""")
def sound_windows(spark, sf_dir):
    """Windows of two samples at every sample over each user's values: sign changes and level."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"] - 50)
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(ordered.alias("v"))
    return rows.select("user_id", F.explode(signal.window_stats(F.col("v"), 100)).alias("w")).select("user_id", "w.start", "w.zcr", F.round("w.rms", 9).alias("rms"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)), 6) AS peak FROM events GROUP BY user_id")
def sound_levels(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    return rows.select("user_id", signal.levels(F.col("v")).alias("s")).select("user_id", "s.n", F.round("s.mean", 6).alias("mean"), F.round("s.rms", 6).alias("rms"), F.round("s.peak", 6).alias("peak"))


@query("SELECT * FROM (VALUES ('a', '616263'), ('b', '78')) t(key, content)")
def sound_segments(spark, sf_dir):
    rows = spark.createDataFrame([("a", 1, "bc"), ("a", 0, "a"), ("b", 0, "x")], "key string, pos int, t string").withColumn("content", F.col("t").cast("binary")).drop("t")
    return signal.segment_merge(rows).select("key", F.lower(F.hex("content")).alias("content"))


@query("SELECT * FROM (VALUES (0, 1000), (1, 1000), (2, 1000), (3, 750), (4, 250), (5, 0), (6, 0)) t(pos, value)")
def sound_crossfade(spark, sf_dir):
    """The last four frames of a constant over the first four of silence: cosine ramps that sum to one."""
    both = signal.crossfade(np.full((6, 1), 1000, np.int16), np.zeros((5, 1), np.int16), 4)
    rows = spark.createDataFrame([(both.ravel().tolist(),)], "v array<int>")
    return rows.select(F.posexplode("v").alias("pos", "value"))


@query("SELECT * FROM (VALUES ('c1', 5760, true), ('c2', 2000, true)) t(chapter_key, n_frames, same)")
def sound_pieces(spark, sf_dir):
    """Chapters merged in pieces hold what they hold merged whole: 4,000 and 2,000 frames crossed over 240."""
    import pandas as pd

    from narrata.plans import fixtures as fx

    rows = pd.DataFrame({"chapter_key": ["c1", "c1", "c2", "c2"], "pos": [1, 0, 0, 1], "content": [fx.wave(0.25), fx.wave(0.5), fx.wave(0.25), b"no file"]})
    chunks = spark.createDataFrame(rows, "chapter_key string, pos int, content binary")
    pieces = signal.merge_pieces(chunks)
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "data"))), lambda x: F.hex(x["data"])), "")
    merged = pieces.groupBy("chapter_key").agg(F.sum("n_frames").cast("int").alias("n_frames"), data.alias("data"))
    whole = signal.merge_chapters(chunks).select("chapter_key", F.hex(F.expr("substring(content, 45)")).alias("whole"))  # behind the head of a file
    return merged.join(whole, "chapter_key").select("chapter_key", "n_frames", (F.col("data") == F.col("whole")).alias("same"))
