"""Sample arrays of speech: reading, cleaning and joining. Everything works on (frames, channels) arrays of 16-bit samples.

The merge of a chapter runs over its chunks in order, as a grouped map, or in pieces as a stream that holds a crossfade tail only.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.functions.slices import slices

PCM = T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("nchannels", "sampwidth", "framerate")], T.StructField("data", T.BinaryType())])


@dataclass(frozen=True)
class Wave:
    channels: int
    width: int
    rate: int
    kind: int  #: 1 whole numbers, 3 floats
    data: bytes

    @property
    def seconds(self) -> float:
        return len(self.data) / (self.channels * self.width * self.rate)


def read_wave(content: bytes | None) -> Wave | None:
    """The format and the samples of a RIFF file; None for anything else. Chunks of odd size are padded."""
    if not content or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt " and size >= 16:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if kind == 0xFFFE and size >= 26:
                kind = struct.unpack_from("<H", content, at + 32)[0]
            fmt = kind, channels, rate, bits // 8
        elif name == b"data" and fmt and all(fmt):
            data = content[at + 8 : at + 8 + size]
            return Wave(fmt[1], fmt[3], fmt[2], fmt[0], data)
        at += 8 + size + size % 2
    return None


def write_wave(samples: np.ndarray, rate: int) -> bytes:
    data = samples.astype("<i2").tobytes()
    channels = samples.shape[1]
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def samples_of(w: Wave) -> np.ndarray | None:
    """16-bit samples: 32-bit whole numbers lose their lower half, floats are scaled and held in range. None for other widths."""
    if w.width == 2 and w.kind == 1:
        x = np.frombuffer(w.data[: len(w.data) // 2 * 2], "<i2")
    elif w.width == 4 and w.kind == 1:
        x = (np.frombuffer(w.data[: len(w.data) // 4 * 4], "<i4") >> 16).astype(np.int16)
    elif w.width == 4 and w.kind == 3:
        x = np.clip(np.trunc(np.frombuffer(w.data[: len(w.data) // 4 * 4], "<f4") * 32767), -32768, 32767).astype(np.int16)
    else:
        return None
    return x[: len(x) // w.channels * w.channels].reshape(-1, w.channels)


@F.pandas_udf(T.DoubleType())
def wave_seconds(content: pd.Series) -> pd.Series:
    return content.map(lambda c: w.seconds if (w := read_wave(c)) else None).astype("float64")


@F.pandas_udf(PCM)
def wave_frames(content: pd.Series) -> pd.DataFrame:
    rows = []
    for c in content:
        w = read_wave(c)
        x = samples_of(w) if w else None
        rows.append((None,) * 4 if w is None else (w.channels, w.width, w.rate, w.data) if x is None else (w.channels, 2, w.rate, x.tobytes()))
    return pd.DataFrame(rows, columns=["nchannels", "sampwidth", "framerate", "data"])


# Cleaning --------------------------------------------------------------------------------------------------


def remove_offset(x: np.ndarray, per_channel: bool = False) -> np.ndarray:
    """Without the mean; the mean of all samples unless ``per_channel``. A mean under one step stays."""
    mean = x.astype(np.float32).mean(axis=0 if per_channel else None) if x.size else np.float32(0)
    if np.all(np.abs(mean) < 1):
        return x
    return np.clip(x - mean, -32768, 32767).astype(np.int16)


def fade(x: np.ndarray, frames: int, at_start: bool, at_end: bool) -> np.ndarray:
    """Linear ramps from and to silence."""
    n = min(frames, len(x))
    if n <= 0:
        return x
    y = x.astype(np.float32)
    if at_start:
        y[:n] *= np.linspace(0, 1, n, dtype=np.float32)[:, None]
    if at_end:
        y[-n:] *= np.linspace(1, 0, n, dtype=np.float32)[:, None]
    return y.astype(np.int16)


def _cut_start(x: np.ndarray, frames: int, rate: int, fade_ms: float) -> np.ndarray:
    """Without the first frames; what is left comes in over ``fade_ms``."""
    y = x[frames:]
    n = min(len(y), int(rate * fade_ms / 1000))
    if n:
        y = np.concatenate([(y[:n] * (np.arange(1, n + 1) / n)[:, None]).astype(np.int16), y[n:]])
    return y


def remove_click(x: np.ndarray, rate: int, trim_ms: float = 10, fade_ms: float = 3, peak: float = 0.03) -> np.ndarray:
    """A loud burst in the first 3 ms goes, up to the first 1.5 ms of quiet within ``trim_ms``, else 5 ms of it."""
    most = min(len(x) - 1, int(rate * trim_ms / 1000))
    if most <= 0:
        return x
    loud = np.abs(x.astype(np.int32)).max(axis=1)
    if loud[: min(most, max(1, int(rate * 0.003)))].max() < int(32767 * peak):
        return x
    quiet, span = int(32767 * min(peak / 2, 0.015)), max(1, int(rate * 0.0015))
    start = min(most, max(1, int(rate * 0.003)))
    frames = next((f for f in range(start, most - span + 1) if loud[f : f + span].max() <= quiet), min(most, max(1, int(rate * 0.005))))
    return _cut_start(x, frames, rate, fade_ms)


def _window_stats(v: np.ndarray, smooth: int) -> tuple[float, float, float]:
    """Sign changes, share of low frequencies (moving average against the whole) and level of a window."""
    n = len(v)
    if n < 2:
        return 0.0, 0.0, 0.0
    level = float(np.sqrt((v * v).mean()))
    crossings = np.count_nonzero((v[1:] >= 0) != (v[:-1] >= 0)) / (2 * n)
    sums = np.r_[0, np.cumsum(v)]
    at = np.arange(1, n + 1)
    low = (sums[at] - sums[np.maximum(0, at - smooth)]) / np.minimum(at, smooth)
    return crossings, float(np.sqrt((low * low).mean())) / (level + 1e-9), level


def low_preamble_frames(x: np.ndarray, rate: int, crossings_most=0.040, low_least=0.60, level_least=0.012, speech=0.030, zone_ms=60, look_ms=350, window_ms=20, hop_ms=10, smooth_ms=2.0, most_ms=80) -> int:
    """Frames of a low hum before speech: few sign changes, low frequencies and some level in the first 60 ms, then, no later than
    80 ms, a window with the sign changes of speech. 0 if there is none."""
    ms = lambda t: int(rate * t / 1000)
    look, window, hop = min(len(x), ms(look_ms)), max(2, ms(window_ms)), max(1, ms(hop_ms))
    if look < 2 * window:
        return 0
    mono = x[: min(look + window, len(x))].astype(float).mean(axis=1)
    top = np.abs(mono).max(initial=0)
    if top < 327.67:
        return 0
    mono /= top
    stats = lambda at: _window_stats(mono[at : at + window], max(1, ms(smooth_ms)))
    zone = min(look, ms(zone_ms))
    seen = np.array([stats(at) for at in range(0, zone, hop)])
    if not len(seen) or seen[:, 2].mean() < level_least or seen[:, 0].mean() >= crossings_most or seen[:, 1].max() < low_least:
        return 0
    onset = next((at for at in range(max(hop, zone - window), look, hop) if stats(at)[0] >= speech), 0)
    return onset if 0 < onset <= ms(most_ms) else 0


def gap_preamble_frames(x: np.ndarray, rate: int, search_ms=700, gap_ms=300, silence=0.04, window_ms=10, most_ms=1200) -> int:
    """Frames of a stray sound before speech: sound at once, then within 700 ms a silence of 300 ms or more, then sound by 1,200 ms."""
    ms = lambda t: int(rate * t / 1000)
    window = max(1, ms(window_ms))
    if len(x) < 3 * window:
        return 0
    mono = x[: min(len(x), ms(most_ms) + window)].astype(float).mean(axis=1)
    top = np.abs(mono).max(initial=0)
    if top < 163.835:
        return 0
    levels = np.array([np.sqrt((w * w).mean()) / top for w in (mono[i : i + window] for i in range(0, len(mono), window))])
    quiet = levels < silence
    if quiet[0]:
        return 0
    start = next((k for k in range(1, len(levels)) if quiet[k] and k * window < min(len(x), ms(search_ms))), None)
    if start is None:
        return 0
    end = next((k for k in range(start, len(levels)) if not quiet[k]), None)
    if end is None or (end - start) * window < max(window, ms(gap_ms)) or end * window > ms(most_ms):
        return 0
    return end * window


def remove_preambles(x: np.ndarray, rate: int, low: bool = True, gap: bool = True, fade_ms: float = 5) -> np.ndarray:
    for wanted, frames in ((gap, gap_preamble_frames), (low, low_preamble_frames)):
        if wanted and (n := frames(x, rate)):
            x = _cut_start(x, n, rate, fade_ms)
    return x


def trim_silence(x: np.ndarray, rate: int, dbfs: float = -45, tail_ms: int = 200, step_ms: int = 10) -> np.ndarray:
    """Without what follows the last 10 ms that are louder than ``dbfs``, but for 200 ms. All silence stays as it is."""
    step = max(1, rate * step_ms // 1000)
    levels = [np.sqrt((w.astype(float) ** 2).mean()) for w in (x[i : i + step] for i in range(0, len(x), step))]
    loud = [i for i, v in enumerate(levels) if v > 32768 * 10 ** (dbfs / 20)]
    return x[: min(len(x), (loud[-1] + 1) * step + rate * tail_ms // 1000)] if loud else x


# Joining ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Join:
    """One set of options for every place where chunks are joined."""

    crossfade_ms: float = 30
    gap_ms: float = 0
    offset: bool = True
    click_ms: float = 0
    preambles: bool = False


def crossfade(a: np.ndarray, b: np.ndarray, frames: int) -> np.ndarray:
    """The end of ``a`` over the start of ``b``, by cosine ramps that sum to one."""
    n = min(frames, len(a), len(b))
    if n <= 0:
        return np.concatenate([a, b])
    down = (0.5 * (1 + np.cos(np.pi * np.linspace(0, 1, n))))[:, None]
    mixed = np.clip(a[-n:] * down + b[:n] * (1 - down), -32768, 32767).astype(np.int16)
    return np.concatenate([a[:-n], mixed, b[n:]])


def joined(chunks: Iterable[np.ndarray], rate: int, how: Join = Join()) -> Iterator[np.ndarray]:
    """Chunks in order, cleaned, with silence and crossfades between them, piece by piece: only a tail is held between chunks."""
    frames = int(rate * how.crossfade_ms / 1000)
    tail: np.ndarray | None = None
    for x in chunks:
        if how.offset:
            x = remove_offset(x)
        if how.click_ms:
            x = remove_click(x, rate, how.click_ms)
        if how.preambles:
            x = remove_preambles(x, rate)
        parts = [x] if tail is None or not how.gap_ms else [np.zeros((int(rate * how.gap_ms / 1000), x.shape[1]), np.int16), x]
        for p in parts:
            if tail is not None:
                p = crossfade(tail, p, frames)
            keep = min(frames, len(p)) if frames else 0
            yield p[: len(p) - keep]
            tail = p[len(p) - keep :]
    if tail is not None:
        yield tail


def join(chunks: Iterable[np.ndarray], rate: int, how: Join = Join()) -> np.ndarray:
    """All pieces of ``joined`` as one."""
    done = list(joined(chunks, rate, how))
    return np.concatenate(done) if done else np.zeros((0, 1), np.int16)


def merge_pieces(chunks: DataFrame, how: Join = Join()) -> DataFrame:
    """(chapter_key, pos, content) to (chapter_key, piece, framerate, nchannels, n_frames, data): the samples of each chapter's file in pieces, for chapters that
    no task holds. Chunks stream through in order; a task holds one batch of them and a crossfade tail. Chunks that can't be read, or have another form than the chapter's first, are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((k, c) for b in batches for k, c in zip(b.chapter_key, b.content, strict=True))
        for key, mine in groupby(rows, key=lambda r: r[0]):
            waves = (w for w in (read_wave(c) for _, c in mine) if w and samples_of(w) is not None)
            first = next(waves, None)
            if first is None:
                continue
            same = (samples_of(w) for w in chain((first,), waves) if w.channels == first.channels)
            for i, x in enumerate(joined(same, first.rate, how)):
                yield pd.DataFrame({"chapter_key": [key], "piece": [i], "framerate": [first.rate], "nchannels": [first.channels], "n_frames": [len(x)], "data": [x.astype("<i2").tobytes()]})

    ordered = chunks.select("chapter_key", "pos", "content").repartition("chapter_key").sortWithinPartitions("chapter_key", "pos").select("chapter_key", "content")
    return ordered.mapInPandas(run, "chapter_key string, piece long, framerate int, nchannels int, n_frames long, data binary")


def merge_chapters(chunks: DataFrame, how: Join = Join()) -> DataFrame:
    """(chapter_key, pos, content) to (chapter_key, n_chunks, seconds, content): one file a chapter, in the order of ``pos``. Chunks
    that can't be read are left out and counted; a chapter is as large as a task holds (``merge_pieces`` has no such bound)."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        waves = [w for w in map(read_wave, g.sort_values("pos").content) if w]
        got = [x for x in map(samples_of, waves) if x is not None and x.shape[1] == waves[0].channels]
        rate = waves[0].rate if waves else 0
        x = join(got, rate, how) if got else None
        return pd.DataFrame({"chapter_key": [g.chapter_key.iloc[0]], "n_chunks": [len(got)], "n_unread": [len(g) - len(got)], "seconds": [len(x) / rate if got else None], "content": [write_wave(x, rate) if got else None]})

    return chunks.groupBy("chapter_key").applyInPandas(run, "chapter_key string, n_chunks long, n_unread long, seconds double, content binary")


def segment_merge(segments: DataFrame) -> DataFrame:
    """(key, pos, content) to (key, content): bytes one after the other."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    return segments.groupBy("key").agg(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x)).alias("content"))


def window_stats(samples: Column, rate: int, window_ms: int = 20, hop_ms: int = 10) -> Column:
    """array<struct<start, zcr, lfr, rms>> of a mono signal's sliding windows."""
    w, h, smooth = max(2, rate * window_ms // 1000), max(1, rate * hop_ms // 1000), max(1, rate * 2 // 1000)

    def one(v: np.ndarray) -> np.ndarray:
        v = v / max(np.abs(v).max(initial=0), 1e-9)
        return np.array([_window_stats(v[at : at + w], smooth) for at in range(0, len(v), h)], float).reshape(-1, 3)

    # the results stay arrays, as objects of every window would take many times the samples
    @F.arrow_udf("array<struct<start:int,zcr:double,lfr:double,rms:double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                flat = part.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))
                found = [one(v) for v in np.split(flat, ends[:-1])]
                starts = np.concatenate([np.arange(len(f)) * h for f in found])
                stats = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), *map(pa.array, np.concatenate(found).T)], ["start", "zcr", "lfr", "rms"])
                at = np.cumsum([0, *map(len, found)])
                yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), stats, mask=part.is_null())

    return run(samples)


def cleaned(samples: Column, rate: int, step: Callable[[np.ndarray, int], np.ndarray], channels: int = 1) -> Column:
    """A cleaning step on a column of samples (array<int>, channels interleaved)."""
    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: step(np.asarray(x, np.int16).reshape(-1, channels), rate).ravel().astype(int).tolist(), na_action="ignore")

    return run(samples)


def measured(samples: Column, rate: int, frames: Callable[[np.ndarray, int], int], channels: int = 1) -> Column:
    """What a function of a signal counts, as a column."""
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: frames(np.asarray(x, np.int16).reshape(-1, channels), rate), na_action="ignore")

    return run(samples)


def levels(samples: Column) -> Column:
    """struct<n, mean, rms, peak> of a signal, as an expression."""
    total = lambda f: F.aggregate(F.transform(samples, f), F.lit(0.0), lambda a, x: a + x)
    n = F.size(samples)
    whole = F.nullif(n, F.lit(0)).cast("double")
    return F.struct(n.cast("long").alias("n"), (total(lambda x: x.cast("double")) / whole).alias("mean"), F.sqrt(total(lambda x: x.cast("double") * x) / whole).alias("rms"), F.array_max(F.transform(samples, lambda x: F.abs(x))).alias("peak"))
