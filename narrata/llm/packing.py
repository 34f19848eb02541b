"""Mixture-controlled packing of token sequences by deficit round-robin over source queues.

In each round a source is given its share of one window as quantum. It serves what its saved-up quanta cover,
cutting documents where they end, and the rest of a token stays as its deficit for the rounds to come; a source whose quantum is
under ``least_piece`` tokens saves up until it can serve that many. As a deficit never resets while documents wait, the
round in which a packet is served is known at once: ``ceil(tokens of the source up to the packet's end / quantum)``. So
the whole schedule is prefix sums: deficits carry over windows and partitions without any sequential task. Packets in
the order (round, source, place) fill the windows one after the other, so only the last sequence is short.

Quanta follow ``targets``: source to weight (a source without one is an error unless ``other`` gives its weight), or a sequence of weights that repeats along the sources in code-point order, null
last. Without targets a quantum is the source's share of all tokens, so that every window holds the corpus's own proportions to the end. With targets, a source that runs dry leaves
its share to the rest.

How it is spread out: places within a source are prefix sums over ranges of a hash of id and content (without an id, of the row too), in levels, and places
in the stream are prefix sums over blocks of rounds; no task orders a source or the stream as a whole.
Token ids are written once (two bytes each where the vocabulary allows) and met again by row.

Defined results: a null text is empty and has one token, the end mark; null is a source of its own; rows
repeated under one id are packed one by one; documents of equal hash follow by id, content and row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrata.llm._work import hash_unit, materialize, running

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WINDOW = 4096
LEAST_PIECE = 128

# Latin-1 letters, numbers and white space, the only characters of the quick route.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼½¾"
_PIECE = re.compile(f"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^ \\t-\\r\\x85\\xa0{_L}{_N}]+")
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordTokenizer(dict):
    """Token ids of texts, as little-endian bytes; remembers the ids of pieces it has met.

    A text of Latin-1 characters is lower-cased and cut into pieces as the vocabulary's own normalizer and
    pre-tokenizer do, and each distinct piece goes through the vocabulary's model once. Any other text goes
    through the tokenizer as a whole. ``most`` bounds the pieces kept.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model, self.most = self.whole.model, most
        self.kind = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        mapped = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(_BYTE)
        self[piece] = ids = np.array([t.id for t in self.model.tokenize(mapped)], self.kind).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join([self[p] for p in _PIECE.findall(text.lower())])


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str | None) -> WordTokenizer:
    """One a worker and path; kept between tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(row, id, source, n, crc, wide, ids): every document's ids with the end mark, in a shared table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        end, wide = np.array([end_id], t.kind).tobytes(), t.kind == "<u4"
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = [t.encode(x.as_py() or "") + end for x in part.column(3)]
                n = pa.array([len(x) // (4 if wide else 2) for x in ids], pa.int64())
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], n, crc, pa.array([wide] * len(ids)), pa.array(ids, pa.binary())], ["row", "id", "source", "n", "crc", "wide", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, "row long, id long, source string, n long, crc long, wide boolean, ids binary"), "tokens")


def turn_of(source) -> F.Column:
    """The order in which sources are served within a round."""
    return F.xxhash64(F.lit("queue"), source)


def _weighed(by_source: DataFrame, targets: Mapping[str, float] | Sequence[float] | None, other: float | None) -> DataFrame:
    """``by_source`` with each source's weight ``w``."""
    if not targets:
        return by_source.withColumn("w", F.col("tokens").cast("double"))
    if isinstance(targets, Mapping):
        weigh = F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, float(v))])
        weight = F.coalesce(weigh[F.coalesce("source", F.lit(""))], F.lit(other).cast("double"))
        weighed = by_source.withColumn("w", weight)
        if (missing := weighed.where("w is null").first()) is not None:
            raise ValueError(f"no target for source {missing['source']!r}")
        return weighed
    cycle = F.array(*[F.lit(float(w)) for w in targets])
    return by_source.withColumn("w", F.element_at(cycle, (F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1) % len(targets) + 1))


def schedule(tokens: DataFrame, window: int = WINDOW, least_piece: int = LEAST_PIECE, targets: Mapping[str, float] | Sequence[float] | None = None, other: float | None = None, part_rows: int = 4096, part_rounds: int = 64) -> DataFrame:
    """(row, start, length, sequence_id, offset) for every piece of (row, id, source, n, crc)."""
    rows = tokens.select("row", "id", "source", "n", "crc")
    by_source = materialize(rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")), "queues")
    weighed = _weighed(by_source, targets, other)
    total = weighed.agg(F.sum("w")).first()[0] or 1.0
    queues = weighed.select(
        F.col("source").alias("qs"), F.ceil(F.col("rows") / part_rows).alias("parts"), (F.col("w") / F.lit(float(total)) * window).alias("quantum"), turn_of(F.col("source")).alias("turn"),
    )
    here = F.col("source").eqNullSafe(F.col("qs"))
    place = F.when(F.col("id").isNull(), hash_unit(F.lit("place"), F.col("crc"), F.col("row"))).otherwise(hash_unit(F.lit("place"), F.col("id"), F.col("crc")))
    placed = rows.join(queues, here).withColumn("h", place).withColumn("part", F.floor(F.col("h") * F.col("parts"))).withColumn("over", F.floor(F.col("part") / 1024))
    sums = running(placed, ["source"], ["over", "part"], "n", "base").select(F.col("source").alias("bs"), F.col("part").alias("bp"), "base")
    run = W.partitionBy("source", "part").orderBy("h", "id", "crc", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum("n").over(run), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("bs")) & (F.col("part") == F.col("bp")))
    placed = placed.select("row", "n", "turn", "quantum", (F.col("base") + F.col("within")).alias("first"), F.greatest("quantum", F.lit(float(least_piece))).alias("packet"))
    # the k-th packet of a queue ends at floor(k * packet); rounding can't part or overlap neighbours
    end = F.col("first") + F.col("n")
    span = F.sequence(F.ceil((F.col("first") + 1) / F.col("packet")) - 1, F.ceil(end / F.col("packet")) + 1)
    packets = placed.select("row", "turn", "quantum", "packet", "first", end.alias("last"), F.explode(span).alias("k"))
    packets = packets.withColumn("from", F.greatest("first", F.floor((F.col("k") - 1) * F.col("packet")))).withColumn("to", F.least("last", F.floor(F.col("k") * F.col("packet")))).where("`to` > `from`")
    packets = packets.select("row", "turn", "to", (F.col("from") - F.col("first")).alias("start"), (F.col("to") - F.col("from")).alias("length"), F.ceil(F.col("k") * F.col("packet") / F.col("quantum") - 1e-6).alias("round"))
    packets = materialize(packets.withColumn("block", F.floor(F.col("round") / part_rounds)), "packets")
    bases = running(packets.withColumn("over", F.floor(F.col("block") / 4096)), [], ["over", "block"], "length", "base").select(F.col("block").alias("bb"), "base")
    run = W.partitionBy("block").orderBy("round", "turn", "to", "row").rowsBetween(W.unboundedPreceding, -1)
    stream = packets.withColumn("within", F.coalesce(F.sum("length").over(run), F.lit(0))).join(bases, F.col("block") == F.col("bb"))
    stream = stream.withColumn("g", F.col("base") + F.col("within"))
    # a packet is no longer than a window, so at most one window ends within it
    room = F.lit(window) - F.col("g") % window
    piece = lambda start, length, g: F.struct(start.alias("start"), length.alias("length"), F.floor(g / window).cast("long").alias("sequence_id"), (g % window).alias("offset"))
    one = F.array(piece(F.col("start"), F.col("length"), F.col("g")))
    two = F.array(piece(F.col("start"), room, F.col("g")), piece(F.col("start") + room, F.col("length") - room, F.col("g") + room))
    return stream.select("row", F.explode(F.when(F.col("length") <= room, one).otherwise(two)).alias("p")).select("row", "p.*")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str | None = None, end_id: int = END_ID, window: int = WINDOW, least_piece: int = LEAST_PIECE, targets: Mapping[str, float] | Sequence[float] | None = None, other: float | None = None) -> DataFrame:
    """(id, source, start, length, ids, doc_tokens, sequence_id, offset): every piece with its ids (binary, 2 or 4
    bytes each, little-endian, by ``wide``)."""
    if least_piece > window:
        raise ValueError("a piece is no longer than a window")
    tokens = tokenize(docs, id_col, text_col, source_col, path, end_id)
    pieces = schedule(tokens, window, least_piece, targets, other).groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    held = tokens.select("row", "id", "source", F.col("n").alias("doc_tokens"), "wide", "ids").join(pieces, "row")
    each = F.col("p.length") * F.when(F.col("wide"), 4).otherwise(2)
    from_ = F.col("p.start") * F.when(F.col("wide"), 4).otherwise(2) + 1
    return held.select("id", "source", "doc_tokens", "wide", "ids", F.explode("pieces").alias("p")).select(
        "id", "source", "p.start", "p.length", F.substring(F.col("ids"), from_.cast("int"), each.cast("int")).alias("ids"), "wide", "doc_tokens", "p.sequence_id", "p.offset",
    )


def widened_crc32(ids="ids", wide="wide") -> F.Column:
    """CRC-32 of the ids as unsigned 32-bit little-endian numbers."""
    low = F.expr(f"unhex(regexp_replace(hex({ids}), '(....)', '$10000'))")
    return F.crc32(F.when(F.col(wide), F.col(ids)).otherwise(low))
