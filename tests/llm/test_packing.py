"""Packing against a sequential deficit round-robin over queues."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.llm import packing, queries


def _round_robin(queues, weights, order, window, least):
    """Serve the queues (source to [(doc, tokens)]) round by round; pieces as (doc, start, length, sequence, offset)."""
    total = sum(weights.values())
    packet = {s: max(weights[s] / total * window, least) for s in queues}
    credit, served, packets = dict.fromkeys(queues, 0.0), dict.fromkeys(queues, 0), dict.fromkeys(queues, 0)
    waiting = {s: [list(x) for x in q] for s, q in queues.items()}
    start = {}
    out, at, turn = [], 0, 0
    while any(waiting.values()):
        turn += 1
        for s in order:
            credit[s] = turn * weights[s] / total * window
            while waiting[s] and credit[s] >= (packets[s] + 1) * packet[s] - 1e-6 * packet[s]:
                packets[s] += 1
                left = math.floor(packets[s] * packet[s]) - served[s]
                while left and waiting[s]:
                    doc, n = waiting[s][0]
                    take = min(left, n, window - at % window)
                    out.append((doc, start.get(doc, 0), take, at // window, at % window))
                    start[doc] = start.get(doc, 0) + take
                    at, left, served[s] = at + take, left - take, served[s] + take
                    waiting[s][0][1] -= take
                    if not waiting[s][0][1]:
                        waiting[s].pop(0)
    return out


def _held_against(spark, docs, got, weights, window, least):
    """``got``: doc, start, length, doc_tokens, sequence_id, offset. The queues' order is that of the pieces; all the rest is simulated."""
    sources = {r.doc_id: r.source for r in docs.collect()}
    queues = {}
    for r in got.sort_values(["sequence_id", "offset"]).itertuples():
        q = queues.setdefault(sources[r.doc_id], [])
        if not any(d == r.doc_id for d, _ in q):
            q.append((r.doc_id, r.doc_tokens))
    names = spark.createDataFrame([(s,) for s in queues], "s string").select("s", packing.turn_of(F.col("s")).alias("t")).orderBy("t").collect()
    want = _round_robin(queues, weights(queues), [r.s for r in names], window, least)
    have = [tuple(x) for x in got.sort_values(["sequence_id", "offset"])[["doc_id", "start", "length", "sequence_id", "offset"]].itertuples(index=False)]
    merge = lambda pieces: _merged(pieces)
    assert merge(have) == merge(want)


def _merged(pieces):
    out = []
    for doc, start, length, seq, at in pieces:
        if out and out[-1][0] == doc and out[-1][3] == seq and out[-1][1] + out[-1][2] == start:
            out[-1][2] += length
        else:
            out.append([doc, start, length, seq, at])
    return out


def test_query_against_a_sequential_round_robin(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op5_packing(spark, sf).toPandas()
    cycle = queries.PACK_TARGETS
    _held_against(spark, docs, got, lambda q: {s: cycle[i % len(cycle)] for i, s in enumerate(sorted(q))}, packing.WINDOW, packing.LEAST_PIECE)
    t = packing.tokenizer(None)
    for r in docs.collect():
        ids = np.array([*t.whole.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        mine = got[got.doc_id == r.doc_id].sort_values("start")
        assert mine.length.sum() == len(ids) and all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in mine.itertuples())


@pytest.mark.parametrize(("targets", "least"), [(None, 1), (None, 200), ({f"src{i}": 1.0 + i for i in range(20)}, 16), ((3, 1), 64)])
def test_schedules_against_a_sequential_round_robin(spark, sf, targets, least):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs, window=1024, least_piece=least, targets=targets).withColumnRenamed("id", "doc_id").toPandas()
    tokens = got.groupby("source").length.sum().to_dict()

    def weights(queues):
        if targets is None:
            return tokens
        return {s: targets[s] if isinstance(targets, dict) else targets[i % len(targets)] for i, s in enumerate(sorted(queues))}

    _held_against(spark, docs, got, weights, 1024, least)


def test_targets_that_leave_sources_out(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e f", "y"), (3, None, None)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="no target"):
        packing.pack(docs, targets={"x": 1.0}).collect()
    assert {r.id for r in packing.pack(docs, targets={"x": 1.0}, other=0.5).collect()} == {1, 2, 3}


def test_rows_of_one_id_are_spread(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"w{i}" if i % 3 else "same", "s") for i in range(400)], "doc_id long, text string, source string")
    got = packing.pack(docs, window=64, least_piece=8).toPandas()
    assert got.length.sum() == got.drop_duplicates(["sequence_id", "offset"]).length.sum() and (got.groupby("sequence_id").length.sum().iloc[:-1] == 64).all()
    assert got[got.start == 0].shape[0] == 400
