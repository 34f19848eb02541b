"""Quality scores by co-training of two views of a document.

One classifier sees the text's content (shares of character classes, word forms, repetition, all its words hashed), the other the
record around it (language, source, length, layout of its lines). Both start from the labelled documents; in each round each
view names the unlabelled documents it is surest of, as many good ones to bad ones as among the labels, and the other view learns
them as if they were labelled. How sure a view may be is seen on labelled documents left out of training: it names only where 90 % of those, beyond doubt, are what it says, so that a view
that knows little teaches little. At the end each view is calibrated on them (logistic scaling), and the sum of the calibrated log-odds, less
the prior's that both hold, scores every document.

The vectors of all documents are made once and kept (``vectors``, 640 bytes a document). Every round runs over all unlabelled documents: each view's log-odds are
counted in a histogram of fixed size, which gives the round's thresholds; whether a document was named in an earlier round is known by
replaying the models and thresholds of those rounds, so that no state is kept and a lost executor loses nothing. Only what is fitted is bounded: logistic regressions
on the driver, from about ``labelled`` labelled documents and about ``taught`` of those named to a view (expected numbers, picked by a hash of the row).

Defined results: a null text counts as empty; null metadata is a value of its own; several labels of one
document count by majority, a tie as good; documents of equal log-odds at a threshold are all named; without both classes among the labels every score is the share of good
ones (0.5 without labels); rows repeated under one id are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm._work import hash_unit, materialize

CONTENT, RECORD = 256, 64
_SHARES = 16
_BANDS = 12
_SYMBOL = bytes(c for c in range(128) if not chr(c).isalnum() and not chr(c).isspace())
_STRANGE = b"#*$%&|<>{}[]\\^~=_@"
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_ENDS = re.compile(rb"[.!?]+")


def content_view(data: bytes) -> np.ndarray:
    """Shares of the text and the densities of its hashed words."""
    x = np.zeros(CONTENT)
    n, words = max(1, len(data)), data.split()
    w = max(1, len(words))
    gone = lambda chars: (n - len(data.translate(None, chars))) / n if data else 0.0
    distinct = len(set(words))
    x[0], x[1], x[2], x[3], x[4] = gone(_UPPER), gone(_LOWER), gone(_DIGIT), gone(_SYMBOL), gone(_STRANGE)
    x[5], x[6] = gone(b"!"), gone(b"|")
    x[7] = min(2.0, (n / w) / 10)
    x[8] = distinct / w
    x[9] = min(2.0, len(_ENDS.findall(data)) * 10 / w)
    x[10] = sum(len(v) > 12 for v in words) / w
    x[11] = sum(v.isupper() for v in words) / w
    x[12] = sum(v[-1:] in b"#*$%&!|" for v in words) / w
    x[13] = sum(len(v) <= 3 for v in words) / w
    x[14] = float(not words)
    x[15] = len(words) - distinct > w / 2
    if words:
        h = np.fromiter(map(zlib.crc32, data.lower().split()), np.int64, len(words)) % (CONTENT - _SHARES)
        x[_SHARES:] = np.sqrt(np.bincount(h, minlength=CONTENT - _SHARES) / w)
    return x


def record_view(lang: str | None, source: str | None, n_chars: int, lines: np.ndarray) -> np.ndarray:
    """Language and source (hashed), length and the layout of lines."""
    x = np.zeros(RECORD)
    size = np.log1p(max(0, n_chars))
    x[0], x[1] = size / 12, min(1.0, n_chars / 300)
    if len(lines):
        x[2], x[3], x[4] = np.log1p(len(lines)) / 8, np.log1p(lines.mean()) / 8, np.log1p(lines.max()) / 8
        x[5], x[6] = (lines < 20).mean(), lines.std() / (lines.mean() + 1)
    x[8 + min(_BANDS - 1, int(size))] = 1
    x[20 + zlib.crc32(f"l{lang}".encode()) % 12] = 1
    x[32 + zlib.crc32(f"s{source}".encode()) % 32] = 1
    return x


def views(texts: list[bytes | None], lang: list, source: list) -> tuple[np.ndarray, np.ndarray]:
    content, record = np.zeros((len(texts), CONTENT)), np.zeros((len(texts), RECORD))
    for i, (t, a, s) in enumerate(zip(texts, lang, source, strict=True)):
        t = t or b""
        content[i] = content_view(t)
        record[i] = record_view(a, s, len(t), np.array([len(x) for x in t.split(b"\n")]))
    return content, record


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    a: float = 1.0  #: calibration: a * log-odds + b
    b: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[1:] + self.w[0]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.raw(x) + self.b, -12, 12)


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    return Logistic(mean, scale, _newton((x - mean) / scale, y, weight, ridge=2.0))


@dataclass
class Model:
    views: list[Logistic]
    share: float  #: of good ones among the labels

    def score(self, content: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        if not self.views:
            same = np.full(len(content), self.share)
            return same, [same, same]
        odds = [v.odds(x) for v, x in zip(self.views, (content, record), strict=True)]
        prior = np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds[0] + odds[1] - prior, -30, 30))), [1 / (1 + np.exp(-o)) for o in odds]


_EDGE, _BINS = 30.0, 6000  #: histograms of log-odds: range and bins


def _bin(odds: np.ndarray) -> np.ndarray:
    return np.clip(((odds + _EDGE) * (_BINS / (2 * _EDGE))).astype(int), 0, _BINS - 1)


@dataclass
class Round:
    """The views' models in a round, and the bins from which on, and up to which, each view is sure."""

    views: list[Logistic]
    good: list[int]
    bad: list[int]


def named(rounds: list[Round], x: list[np.ndarray]) -> np.ndarray:
    """(2, rows): what each view has been told of each row by the other, 1 good, 0 bad, -1 nothing; the first round counts."""
    told = np.full((2, len(x[0])), -1, np.int8)
    for r in rounds:
        for v in range(2):
            at, free = _bin(r.views[v].raw(x[v])), told[1 - v] < 0
            told[1 - v][free & (at >= r.good[v])] = 1
            told[1 - v][free & (at <= r.bad[v]) & (at < r.good[v])] = 0
    return told


def at_least(right: np.ndarray, n: np.ndarray, doubt: float) -> np.ndarray:
    """The share that is right at least, ``right`` of ``n`` being seen: Wilson's lower bound, ``doubt`` standard deviations below."""
    n = np.maximum(n, 1e-9)
    p, z = right / n, doubt * doubt / n
    return (p + z / 2 - np.sqrt(z * (p * (1 - p) + z / 4))) / (1 + z)


def sure_bins(odds: np.ndarray, y: np.ndarray, sure: float, doubt: float) -> tuple[int, int]:
    """(lowest bin from which on, highest up to which) a view may name: of the labelled rows left out that lie there, ``sure`` at least are good, or bad, beyond ``doubt``.
    A view that tells nothing names nothing."""
    at = _bin(odds)
    good, bad = (np.cumsum(np.bincount(at, y == k, _BINS)) for k in (1, 0))
    n = good + bad
    up, above = good[-1] - np.r_[0, good[:-1]], n[-1] - np.r_[0, n[:-1]]  # from each bin on
    may = (above > 0) & (at_least(up, above, doubt) >= sure)
    low = (n > 0) & (at_least(bad, n, doubt) >= sure)
    return int(np.argmax(may)) if may.any() else _BINS, int(_BINS - 1 - np.argmax(low[::-1])) if low.any() else -1


def thresholds(counts: np.ndarray, total: int, share: float, step: float, may: tuple[int, int]) -> tuple[int, int]:
    """(first good bin, last bad bin) of a view, from the counts of the rows that are free to be named."""
    good, bad = int(np.ceil(step * total * share)), int(np.ceil(step * total * (1 - share)))
    top, low = np.cumsum(counts[::-1])[::-1], np.cumsum(counts)
    return max(may[0], int(np.searchsorted(-top, -good, "right")) - 1), min(may[1], int(np.searchsorted(low, bad, "left")))


def calibrated(views: list[Logistic], x: list[np.ndarray], y: np.ndarray) -> None:
    for v, one in enumerate(views):
        one.b, one.a = _newton(one.raw(x[v])[:, None], y, np.ones(len(y)), ridge=1e-2)


def left_out(y: np.ndarray) -> np.ndarray:
    """Every fifth labelled row, for calibration; none if that leaves a side without both classes."""
    out = np.arange(len(y)) % 5 == 4
    return out if len(set(y[~out].tolist())) == len(set(y[out].tolist())) == 2 else np.zeros(len(y), bool)


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, pick, c, r) for every row: both views as half-precision numbers, and a number in [0, 1) for picking samples. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                c, r = views(*(part.column(i).to_pylist() for i in (1, 2, 3)))
                held = [pa.array([x.tobytes() for x in v.astype("<f2")], pa.binary()) for v in (c, r)]
                yield pa.RecordBatch.from_arrays([part.column(0), *held], ["id", "c", "r"])

    made = _rows(docs, id_col, text_col, lang_col, source_col).mapInArrow(run, "id long, c binary, r binary")
    return materialize(made.select("id", hash_unit(F.lit("cotrain"), F.col("id"), F.col("c")).alias("pick"), "c", "r"), "vectors")


def _unpacked(c: pa.Array, r: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x.to_pylist()), "<f2").reshape(len(x), n).astype(float) for x, n in ((c, CONTENT), (r, RECORD))]


def _histograms(pool: DataFrame, rounds: list[Round], views: list[Logistic]) -> np.ndarray:
    """(2, _BINS): how many rows that the other view hasn't been told of have each log-odds; partitions send sums of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _BINS), np.int64)
        for b in batches:
            x = _unpacked(b.column(0), b.column(1))
            told = named(rounds, x)
            for v in range(2):
                total[v] += np.bincount(_bin(views[v].raw(x[v]))[told[1 - v] < 0], minlength=_BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["at", "n"])

    out = np.zeros(2 * _BINS, np.int64)
    for row in pool.select("c", "r").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out.reshape(2, _BINS)


def _taught(pool: DataFrame, rounds: list[Round], parts: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view, the vectors and labels of the rows named to it, of each view's rows the given part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = named(rounds, _unpacked(b.column(1), b.column(2)))
            pick = b.column(0).to_numpy()
            for v in range(2):
                keep = (told[v] >= 0) & (pick < parts[v])
                if keep.any():
                    mine = b.filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(mine.num_rows, v)), mine.column(0), mine.column(1 + v), pa.array(told[v][keep].astype(float))], ["view", "pick", "x", "y"])

    got = pool.select("pick", "c", "r").mapInArrow(run, "view long, pick double, x binary, y double").toArrow()
    view, pick, y = (got.column(k).to_numpy() for k in ("view", "pick", "y"))
    x = got.column("x").to_pylist()
    out = []
    for v, n in ((0, CONTENT), (1, RECORD)):
        at = np.flatnonzero(view == v)
        at = at[np.lexsort(([x[i] for i in at], pick[at]))]  # the same model in whatever order rows arrive
        out.append((np.frombuffer(b"".join(x[i] for i in at), "<f2").reshape(-1, n).astype(float), y[at]))
    return out


def cotrain(labelled: list[np.ndarray], y: np.ndarray, total: int, histograms: Callable, taught: Callable, rounds: int = 5, step: float = 0.05, sure: float = 0.9, doubt: float = 2.58, most: int = 4000) -> Model:
    """``labelled`` holds the two views of the labelled rows; ``histograms(rounds, views)`` and ``taught(rounds, parts)`` look at the ``total`` unlabelled ones."""
    if len(set(y.tolist())) < 2:
        return Model([], float(y.mean()) if len(y) else 0.5)
    out = left_out(y)
    learn, share = ~out, float(y.mean())
    done: list[Round] = []
    more = [(np.zeros((0, x.shape[1])), np.zeros(0)) for x in labelled]
    count = np.zeros(2)
    for turn in range(rounds + 1):
        fitted = [_train(np.r_[x[learn], z], np.r_[y[learn], t], np.r_[np.ones(learn.sum()), np.full(len(t), 0.5)]) for x, (z, t) in zip(labelled, more, strict=True)]
        if turn == rounds or not total:
            break
        counts = histograms(done, fitted)
        tried = out if out.any() else learn
        cuts = [thresholds(counts[v], total, share, step, sure_bins(fitted[v].raw(labelled[v][tried]), y[tried], sure, doubt)) for v in range(2)]
        done.append(Round(fitted, [g for g, _ in cuts], [b for _, b in cuts]))
        for v, (g, b) in enumerate(cuts):
            count[1 - v] += counts[v][g:].sum() + counts[v][: max(0, min(b + 1, g))].sum()
        more = taught(done, [min(1.0, most / n) if n else 1.0 for n in count])
    calibrated(fitted, [x[out] if out.any() else x for x in labelled], y[out] if out.any() else y)
    return Model(fitted, share)


def fit(vectors: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled: int = 4000, taught: int = 4000, rounds: int = 5, step: float = 0.05, sure: float = 0.9, doubt: float = 2.58) -> Model:
    """Learn from the vectors of all documents and the labels of some."""
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("lid")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    n = told.count()
    some = told.where(hash_unit(F.lit("labelled"), F.col("lid")) < min(1.0, labelled / max(1, n)))
    known = vectors.join(some, F.col("id") == F.col("lid")).groupBy("id").agg(F.first("y").alias("y"), F.min_by(F.struct("c", "r"), "pick").alias("x")).select("id", "y", "x.c", "x.r").toArrow()
    order = np.argsort(known.column("id").to_numpy(), kind="stable")
    x = [v[order] for v in _unpacked(known.column("c").combine_chunks(), known.column("r").combine_chunks())]
    y = known.column("y").to_numpy()[order]
    pool = materialize(vectors.join(told.select("lid"), F.col("id") == F.col("lid"), "left_anti"), "unlabelled")
    return cotrain(x, y, pool.count(), lambda *a: _histograms(pool, *a), lambda *a: _taught(pool, *a), rounds, step, sure, doubt, taught)


def score(vectors: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(id, quality_score, content_score, record_score, kept) for every row of ``vectors``."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # two weight vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, (c, r) = shared.value.score(*_unpacked(b.column(1), b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(float)) for x in (s, c, r)), pa.array(s >= least)], ["id", "quality_score", "content_score", "record_score", "kept"])

    return vectors.select("id", "c", "r").mapInArrow(run, "id long, quality_score double, content_score double, record_score double, kept boolean")
