"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraphs.

A text is a set of paragraph digests: lines, cut at sentence ends and at most ``BLOCK`` words long, the k-th
repeat of a paragraph counting as one of its own. Each digest goes to one cell in each of three subtables; a cell holds
a count, the XOR of digests and the XOR of their check sums. Subtracting one sketch from another cancels what
the texts share, and peeling cells that hold a single digest recovers what they don't. Where peeling gets
stuck, both texts are sketched again with more cells (sized by the counts seen, at least fourfold).

The likeness of two texts is their shared digests over all their digests (Jaccard), 1 for two empty texts.

``neighbours`` pairs each document with the next one in descending id: rows are dealt to ranges of ids that
hold about ``range_rows`` rows, and each range also gets a copy of the first row of the range after it, so that texts
are shuffled once and no task sees more than its ranges. Ranges are of equal width at first; what holds too many rows is divided again, by id or, where all share one, by a hash of
the text. The driver sees three numbers; what there is of each range is a table, and the pass that orders the ranges has a row for each ``range_rows`` rows.

Defined results: a null text counts as empty and has the fingerprint of an empty text; null ids come after all
others; rows that share an id follow in the order of a hash of their texts; a single row is its own next; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrata.llm._work import materialize

BASE = 8  #: cells in each of the three subtables of a fingerprint
BLOCK = 32
_SENTENCE = re.compile(r"(?<=[.!?]) +|\n")
_U = np.uint64


def digests(text: str) -> np.ndarray:
    """Sorted distinct 64-bit digests of the paragraphs of a text."""
    from xxhash import xxh64_intdigest as xxh

    out, seen = [], {}
    for part in _SENTENCE.split(text):
        words = part.split()
        for at in range(0, len(words), BLOCK):
            p = " ".join(words[at : at + BLOCK]).encode("utf-8", "surrogatepass")
            k = seen[p] = seen.get(p, -1) + 1
            out.append(xxh(p, k))
    return np.unique(np.array(out, _U))


_SALTS = np.array([[0x9E37], [0x9E38], [0x9E39], [0xC0DE]], _U)  #: of the three subtables and of the check sums


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _check(items: np.ndarray) -> np.ndarray:
    return _mix(items ^ _SALTS[3, 0])


class Sketch:
    """Three subtables of ``width`` cells each."""

    __slots__ = ("width", "count", "key", "check")

    def __init__(self, width: int):
        self.width = width
        self.count, self.key, self.check = np.zeros(3 * width, np.int64), np.zeros(3 * width, _U), np.zeros(3 * width, _U)

    @classmethod
    def of(cls, items: np.ndarray, width: int = BASE) -> Sketch:
        s = cls(width)
        if len(items):
            s._put(items, np.ones(len(items), np.int64))
        return s

    def _put(self, items: np.ndarray, sign: np.ndarray) -> None:
        mixed = _mix(items ^ _SALTS)
        at = (mixed[:3] % _U(self.width)).astype(np.int64)
        at += np.array([[0], [self.width], [2 * self.width]])
        at = at.reshape(-1)
        np.add.at(self.count, at, np.concatenate((sign, sign, sign)))
        np.bitwise_xor.at(self.key, at, np.concatenate((items, items, items)))
        np.bitwise_xor.at(self.check, at, np.concatenate((mixed[3], mixed[3], mixed[3])))

    def minus(self, other: Sketch) -> Sketch:
        s = Sketch.__new__(Sketch)
        s.width, s.count, s.key, s.check = self.width, self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return s

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests only in the first text and only in the second; None if some can't be recovered. Uses up the sketch."""
        first, second = [], []
        for _ in range(3 * self.width):
            at = np.flatnonzero(np.abs(self.count) == 1)
            if not len(at):
                break
            at = at[_check(self.key[at]) == self.check[at]]
            if not len(at):
                break
            items, where = np.unique(self.key[at], return_index=True)
            sign = self.count[at[where]]
            first.append(items[sign > 0])
            second.append(items[sign < 0])
            self._put(items, -sign)
        if self.count.any() or self.key.any():
            return None
        empty = np.zeros(0, _U)
        return np.concatenate([empty, *first]), np.concatenate([empty, *second])

    def hex(self) -> str:
        cells = zip(self.count.tolist(), self.key.tolist(), self.check.tolist(), strict=True)
        return (struct.pack("<I", self.width) + b"".join(struct.pack("<HQI", c & 0xFFFF, k, x & 0xFFFFFFFF) for c, k, x in cells)).hex()


def difference(a: np.ndarray, b: np.ndarray, sa: Sketch | None = None, sb: Sketch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in ``a`` and only in ``b``, by subtracting and peeling; sketches grow until it works."""
    width, sa, sb = BASE, sa or Sketch.of(a), sb or Sketch.of(b)
    while True:
        left = sa.minus(sb)
        # a digest adds 1 to the squares of its cell in each subtable, besides what the surplus of one text adds to all
        guess = (left.count @ left.count) / 3 - (len(a) - len(b)) ** 2 / width
        # a cell gives one digest at most, so a surplus beyond the cells can't be peeled, and a guess far beyond them hardly
        if abs(len(a) - len(b)) <= 3 * width and guess <= 4 * width and (got := left.peel()) is not None:
            return got
        need = min(max(guess, 1), len(a) + len(b)) * 0.6
        width = max(4 * width, 1 << math.ceil(math.log2(max(1, need))))
        sa, sb = Sketch.of(a, width), Sketch.of(b, width)


def likeness(a: np.ndarray, b: np.ndarray, sa: Sketch | None = None, sb: Sketch | None = None) -> float:
    only_a, only_b = difference(a, b, sa, sb)
    union = len(b) + len(only_a)
    return (union - len(only_a) - len(only_b)) / union if union else 1.0


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _divide(keys: DataFrame, range_rows: int, most_rounds: int = 16) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``keys`` (id, h) with their range, and the function that gives any rows with id and h theirs."""
    low, high, n = keys.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    parts, span = max(1, -(-n // range_rows)), float((high or 0) - (low or 0) + 1)
    whole = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.floor((F.col("id").cast("double") - F.lit(float(low or 0))) / F.lit(span) * F.lit(float(parts)))).cast("long")
    divided: list[DataFrame] = []

    def split(rows: DataFrame, large: DataFrame) -> DataFrame:
        where = F.when(F.col("_same"), F.col("h")).otherwise(F.col("id")).cast("decimal(20,0)") - F.col("_low").cast("decimal(20,0)")
        part = F.least(F.floor(where.cast("double") / F.col("_span") * F.col("_parts")), F.col("_parts") - 1)
        both = rows.join(large, F.col("range") == F.col("_range"), "left")
        return both.withColumn("range", F.when(F.col("_range").isNull(), F.col("range")).otherwise(F.xxhash64("range", part))).drop("_range", "_same", "_low", "_span", "_parts")

    def ranged(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("range", whole)
        for large in divided:
            rows = split(rows, large)
        return rows

    for _ in range(most_rounds):
        sizes = ranged(keys).groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("i"), F.max("id").alias("j"), F.min("h").alias("p"), F.max("h").alias("q"))
        same = F.col("i").eqNullSafe(F.col("j"))
        large = sizes.where((F.col("n") > 2 * range_rows) & (~same | (F.col("p") < F.col("q"))))
        width = F.when(same, F.col("q").cast("decimal(20,0)") - F.col("p")).otherwise(F.col("j").cast("decimal(20,0)") - F.col("i")).cast("double") + 1.0
        large = materialize(large.select(F.col("range").alias("_range"), same.alias("_same"), F.when(same, F.col("p")).otherwise(F.col("i")).alias("_low"), width.alias("_span"), F.ceil(F.col("n") / range_rows).alias("_parts")), "large-ranges")
        if large.isEmpty():
            break
        divided.append(large)
    return ranged(keys), ranged


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 1024) -> DataFrame:
    """(range, halo, id, h, text): within a range, in the order (halo, id descending, h, text), the row after each row is the next
    document; halo rows only stand in for the first row of the next range."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys, ranged = _divide(materialize(rows.select("id", "h"), "keys"), range_rows)
    # a row for each range, in order; the head of each goes to the range before it, the first one's to the last
    first = F.min(F.struct(F.col("id").isNull().alias("none"), (-F.col("id").cast("decimal(20,0)")).alias("back"), "h", "id")).alias("head")
    heads = keys.groupBy("range").agg(first)
    order = W.partitionBy().orderBy("head")
    last = F.last("range").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    goes = materialize(heads.select(F.col("head.id").alias("_id"), F.col("head.h").alias("_h"), F.coalesce(F.lag("range").over(order), last).alias("_to")), "heads")
    halo = rows.join(goes, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).dropDuplicates(["_to"])
    return ranged(rows).select("range", F.lit(False).alias("halo"), "id", "h", "text").unionByName(halo.select(F.col("_to").alias("range"), F.lit(True).alias("halo"), "id", "h", "text"))


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 1024) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""
    rows = neighbours(docs, id_col, text_col, range_rows)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def follow(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows with the row after each; a range's halo row ends it."""
        before = None
        for now in rows:
            if before is not None and before[0] == now[0] and not before[1]:
                yield before, now
            before = now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True)

        out, known = [], None
        for (_, _, key, text), (_, _, _, after) in follow(stream()):
            if known is None or known[0] is not text:
                d = digests(text)
                known = (text, d, Sketch.of(d))
            _, d, s = known
            nd = digests(after)
            ns = Sketch.of(nd)
            edited = edit(text, after)
            ed = digests(edited)
            es = Sketch.of(ed)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((key, len(text), sha, s.hex(), es.hex(), likeness(d, ed, s, es), likeness(d, nd, s, ns)))
            known = (after, nd, ns)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    ordered = rows.repartition("range").sortWithinPartitions("range", "halo", F.desc_nulls_last("id"), "h", "text")
    return ordered.select("range", "halo", "id", "text").mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
