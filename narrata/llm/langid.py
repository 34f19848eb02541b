"""Language identification by nearest centroid.

A text becomes a unit vector of hashed letter n-grams (1 to 3, words set apart by a space), weighted
``log(1 + count) * idf``. Each language has several centroids, found by spherical k-means over its own training vectors.
A text gets the language of the nearest centroid by cosine; the cosine is the score. A text that lies
further from every centroid than texts of its length did in training, with slack, is rejected; the fewer letters a text has, the more slack it gets.

Document frequencies are counted over all training rows, by bucket. The centroids are fitted on a bounded sample: at most about ``per_lang`` documents of a language (expected number,
picked by a hash of the id), which the driver receives as sparse vectors. Scoring runs over all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected; with nothing to
learn from, every text is ``und``; rows repeated under one id are scored alike; an empty table gives an
empty result; other columns are ignored. Characters count as letters by their Unicode category; of equally near centroids the first in the order of the languages counts. A text of more than
``_PART`` characters is counted in parts that overlap by two characters, so that every n-gram counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm._work import hash_unit

DIMS = 1 << 13
_PART = 1 << 18
_SMALL = 24  #: length classes: powers of two of the letters
UNDETERMINED = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIMS counts, letters in each text)."""
    table = _letters()
    out = np.zeros((len(texts), DIMS), np.float32)
    letters = np.zeros(len(texts), np.int64)
    flat = out.reshape(-1)

    def add(codes: list[np.ndarray], rows: list[int], old: list[int]) -> None:
        """Parts of texts; the first ``old`` characters of each were in the part before it."""
        c = np.concatenate(codes)
        sizes = [len(x) for x in codes]
        part = np.repeat(np.arange(len(codes)), sizes)
        seen = np.concatenate([np.arange(n) < k for n, k in zip(sizes, old, strict=True)])
        row = np.array(rows)[part]
        is_letter = c != 32
        np.add.at(letters, row[is_letter & ~seen], 1)
        two, three = part[1:] == part[:-1], part[2:] == part[:-2]
        h1 = c * np.uint32(2654435761)
        h2 = (h1[:-1] ^ (c[1:] * np.uint32(2246822519)))[two & ~seen[1:]]
        h3 = (h1[:-2] ^ (c[1:-1] * np.uint32(3266489917)) ^ (c[2:] * np.uint32(668265263)))[three & ~seen[2:]]
        own = is_letter & ~seen
        for h, r in ((h1[own], row[own]), (h2, row[1:][two & ~seen[1:]]), (h3, row[2:][three & ~seen[2:]])):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(2654435769)
            where, n = np.unique(r * DIMS + (h >> np.uint32(19)), return_counts=True) if len(h) < 4096 else (None, None)
            if where is None:
                full = np.bincount(r * DIMS + (h >> np.uint32(19)) - r[0] * DIMS, minlength=1)
                flat[r[0] * DIMS : r[0] * DIMS + len(full)] += full
            else:
                flat[where] += n

    codes, rows, old, size = [], [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        c = np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), "<u4")
        c = np.where(table[np.minimum(c, 0x10FFFF)], c, 32).astype(np.uint32)
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]  # one space for a run
        for at in range(0, len(c), _PART):
            first = max(0, at - 2)
            codes.append(c[first : at + _PART])
            rows.append(i)
            old.append(at - first)
            size += len(codes[-1])
            if size >= _PART:
                add(codes, rows, old)
                codes, rows, old, size = [], [], [], 0
    if codes:
        add(codes, rows, old)
    return out, letters


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _length(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), _SMALL - 1)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  #: of each centroid
    least: np.ndarray = field(default_factory=lambda: np.zeros(_SMALL))  #: cosine below which a long text of that length class is rejected

    def nearest(self, letters: np.ndarray) -> np.ndarray:
        """The cosine below which texts of so many letters are rejected."""
        return self.least[_length(letters)] * (1 - 1 / np.sqrt(1.0 + letters))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        x, letters = counts(texts)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        near = _unit(np.log1p(x, out=x) * self.idf) @ self.centroids.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(texts)), best], 0, 1).astype(float)
        known = letters > 0
        score[~known] = 0
        return [self.langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], score, ~known | (score < self.nearest(letters))


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centers = [_unit(x.mean(0, keepdims=True))[0]]
    while len(centers) < min(k, len(x)):  # the text furthest from what there is
        centers.append(x[(x @ np.array(centers).T).max(1).argmin()])
    c = np.array(centers)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))], np.float32))
    return c


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(texts that have each bucket, texts with letters) over all rows of one text column; partitions send sums of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                x, letters = counts(b.slice(at, 128).column(0).to_pylist())
                total[:DIMS] += (x[letters > 0] > 0).sum(0)
                total[DIMS] += (letters > 0).sum()
        at_ = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at_.astype(np.int32)), pa.array(total[at_])], ["bucket", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out[:DIMS], int(out[DIMS])


def fit(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, clusters: int = 4, slack: float = 0.5) -> Model:
    """Learn from the rows for which ``train`` holds and the language is not null."""
    labelled = docs.where(train & F.col(lang_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [])
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_lang / n))])
    picked = labelled.where(hash_unit(F.lit("langid"), F.col(id_col)) < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                x, letters = counts(part.column(1).to_pylist())
                row, at_ = np.nonzero(x)
                cuts = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (at_.astype(np.int32), x[row, at_])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(letters), *lists], ["lang", "letters", "at", "n"])

    got = picked.mapInArrow(vectors, "lang string, letters long, at array<int>, n array<float>").toArrow()
    lang, letters = np.array(got.column("lang").to_pylist(), object), got.column("letters").to_numpy()
    x = np.zeros((len(lang), DIMS), np.float32)
    if len(lang):
        at, n = (got.column(k).combine_chunks() for k in ("at", "n"))
        x[np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = n.flatten().to_numpy()
    del got
    has = letters > 0
    lang, letters, x = lang[has], letters[has], x[has]
    if not len(lang):
        return Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [])
    order = np.lexsort((x.sum(1), letters, lang.astype(str)))  # the same model in whatever order rows arrive
    lang, letters, x = lang[order], letters[order], x[order]
    having, total = frequencies(labelled.select(F.col(text_col).alias("text")))
    idf = np.log((1 + total) / (1 + having)).astype(np.float32) + 1
    x = _unit(np.log1p(x, out=x) * idf)
    found = {name: _spherical_kmeans(x[lang == name], clusters) for name in sorted(set(lang))}
    model = Model(idf, np.concatenate(list(found.values())).astype(np.float32), [k for k, c in found.items() for _ in c])
    near, size = (x @ model.centroids.T).max(1), _length(letters)
    for k in range(_SMALL):  # texts at most as long are the yardstick; what is longer lies nearer
        model.least[k] = slack * near[size >= k].min() if (size >= k).any() else model.least[k - 1]
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: DIMS x clusters x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lang, score, rejected = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose text isn't rejected, all columns kept. The model is learnt from those not held out; with nothing to learn from, nothing is rejected."""
    model = fit(docs, ~held_out(id_col), id_col, text_col, **options)
    if not model.langs:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                rejected = shared.value.predict(part.column(at).to_pylist())[2]
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
