"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

A document of a source is expected ``target / source_size`` times in the mix. Within a source the
expected copies are prefix-summed in the order (size, digest of the id), one random offset is added, and
a document is emitted once for each integer boundary that its step crosses. As neighbours in that
order have nearly equal sizes, the words taken stay near the target, and no document is taken more than
``ceil(target / source_size)`` times.

Targets: sources stand in code-point order, null last; weights repeat along them; together they get
``share`` times all words. No target exceeds ``most`` times its source's size; what is over goes to the
others by weight (a water level, solved from prefix sums over the sources instead of by rounds).

How it is spread out: rows of the same id, source and size are counted as one first, as any of them may take any of their places. Positions come from counts by (source, size) and, where one such
cell is large, by ranges of the id's digest, in prefix sums of several levels, so that no source is ever ordered in one task. The targets' pass has a row for each source.

Defined results: a null text has size 0; a source whose size is 0 has target 0 and nothing of it is
taken; null is a source of its own; rows repeated under one id count one by one and share their order; null ids stand
together in their source and size; an empty table gives an empty result; other columns are kept by ``mixed`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrata.llm._work import fresh, materialize, running, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
_STRETCH = 4096  #: rows of one key that are numbered or made at a time


def _part(text) -> F.Column:
    """A number in [0, 1) from the first 8 hexadecimal digits of the MD5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def source_targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row a source; a single ordered pass."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    all_rows = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = by_source.withColumn("pos", F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(cycle, (F.col("pos") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.partitionBy().orderBy("ratio", "pos")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - before) / rest)
    level = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(all_rows)
    return ranked.withColumn("at", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix", cell_rows: int = 512) -> DataFrame:
    """(id, size, source, source_size, target, copies), one row for each row of ``docs``."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = materialize(sizes.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    sizes = sizes.withColumn("digest", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    cells = materialize(sizes.groupBy("source", "size").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("ids")), "cells")
    by_source = cells.groupBy("source").agg(F.sum(F.col("rows") * F.col("size")).alias("source_size"))
    targets = source_targets(by_source, weights, share, most)
    hot = cells.where(F.col("ids") > cell_rows).select(F.col("source").alias("hs"), F.col("size").alias("hz"), F.ceil(F.col("ids") / cell_rows).alias("parts"))
    key = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    sizes = sizes.join(hot, F.col("source").eqNullSafe(F.col("hs")) & (F.col("size") == F.col("hz")), "left")
    part = F.floor(F.expr("coalesce(parts, 1)") * key / F.lit(4294967296)).cast("long")
    # dealt by all three, or what the join was dealt by would do for the counts and keep a large cell in one task
    sizes = sizes.withColumn("part", part).drop("hs", "hz", "parts").repartition("source", "size", "part")
    counted = sizes.groupBy("source", "size", "part").agg(F.sum("rows").alias("n")).withColumn("z", F.floor(F.col("size") / 1024)).withColumn("p", F.floor(F.col("part") / 1024))
    based = running(counted, ["source"], ["z", "size", "p", "part"], "n", "base")
    # the target is a value of the source: it rides along with the cell
    based = based.join(targets.withColumnRenamed("source", "ts"), F.col("source").eqNullSafe(F.col("ts"))).select(
        F.col("source").alias("bs"), F.col("size").alias("bz"), F.col("part").alias("bp"), "base", "source_size", "target"
    )
    before = F.sum("rows").over(W.partitionBy("source", "size", "part").orderBy("digest", "id").rowsBetween(W.unboundedPreceding, -1))
    rows = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    rows = rows.join(based, F.col("source").eqNullSafe(F.col("bs")) & (F.col("size") == F.col("bz")) & (F.col("part") == F.col("bp")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _part(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00"))))
    rows = rows.select("id", "size", "source", "source_size", "target", "rows", rate.alias("rate"), offset.alias("offset"), (F.col("base") + F.col("before")).alias("first"))
    # a row for each of the rows counted as one: in stretches, and those dealt anew where there are many
    stretch = lambda df: df.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(_STRETCH)))).withColumn("upto", F.least(F.col("k") + _STRETCH, F.col("rows")) - 1)
    many = F.col("rows") > _STRETCH
    if not cells.where(many).isEmpty():
        rows = stretch(rows.where(~many)).unionByName(stretch(rows.where(many)).repartition("id", "k"))
    else:
        rows = stretch(rows)
    rows = rows.withColumn("at", F.explode(F.sequence("k", "upto"))).withColumn("rank", F.col("first") + 1 + F.col("at"))
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    return rows.select("id", "size", "source", "source_size", "target", F.least(crossed, F.ceil("rate")).cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as it is taken."""
    taken = materialize(mix(docs, id_col, text_col, source_col, **options), "taken")
    i, s, z, c, n, r, x = fresh(docs, "_id", "_source", "_size", "_copies", "_copy", "_row", "_place")
    here = F.col(id_col).eqNullSafe(F.col(i))
    columns = [F.col(f"`{k}`") for k in docs.columns]
    repeated = materialize(taken.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias(i)), "repeated")
    copies = lambda rows: rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(c).cast("int")))).select(*columns)
    once = taken.where(F.col("copies") > 0).select(F.col("id").alias(i), F.col("copies").alias(c))
    if repeated.isEmpty():
        # the copies grow with the documents, so the planner may not take a small table's size for theirs: a merge join at every size
        return copies(docs.join(once.hint("merge"), here))
    # rows that share an id are told apart by source, size and place; places are counted within each part of a written table
    alone = docs.join(repeated, here, "left_anti").join(once.join(repeated.withColumnRenamed(i, "_r"), F.col(i).eqNullSafe(F.col("_r")), "left_anti").hint("merge"), here)
    mine = docs.join(repeated, here, "left_semi").withColumn(s, F.col(source_col).cast("string")).withColumn(z, word_count(F.col(text_col)))
    mine = materialize(mine.withColumn(r, F.monotonically_increasing_id()), "rows-of-one-id")
    theirs = taken.join(repeated, F.col("id").eqNullSafe(F.col(i)), "left_semi").select(F.col("id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("copies").alias(c))
    theirs = materialize(theirs.withColumn("_r", F.monotonically_increasing_id()), "takes-of-one-id")
    mine = _numbered(mine, [id_col, s, z], r, x)
    theirs = _numbered(theirs, ["_i", "_s", "_z"], "_r", "_x").drop("_r").where(F.col(c) > 0)
    same = F.col(id_col).eqNullSafe(F.col("_i")) & F.col(s).eqNullSafe(F.col("_s")) & (F.col(z) == F.col("_z")) & (F.col(x) == F.col("_x"))
    return copies(alone).unionByName(copies(mine.join(theirs, same)))


def _numbered(rows: DataFrame, key: list[str], row: str, into: str) -> DataFrame:
    """Rows with their number among those of their key, counted in parts of ``_STRETCH`` consecutive rows (``row``) that are then set one behind the other."""
    rows = rows.withColumn("_q", F.shiftright(row, 33)).withColumn("_p", F.floor(F.col(row) / _STRETCH))
    base = running(rows.withColumn("_one", F.lit(1)), key, ["_q", "_p"], "_one", "_base")
    names = [f"_b{j}" for j in range(len(key))]
    base = base.select(*[F.col(k).alias(a) for k, a in zip(key, names, strict=True)], F.col("_p").alias("_bp"), "_base")
    same = F.col("_p") == F.col("_bp")
    for k, a in zip(key, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(a))
    at = F.row_number().over(W.partitionBy(*key, "_p").orderBy(row))
    return rows.withColumn("_at", at).join(base, same).withColumn(into, F.col("_base") + F.col("_at")).drop("_q", "_p", "_at", "_bp", "_base", *names)


ORACLE = """
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos FROM by_source),
weighed AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM ranked),
leveled AS (SELECT *, cap / w AS ratio, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed),
targets AS (SELECT source, source_size, least(cap, coalesce(w * max(CASE WHEN lvl < ratio THEN lvl END) OVER (), cap)) AS target FROM leveled),
placed AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('mix:' || coalesce(d.source, chr(0))), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE AS u,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.digest, d.doc_id) AS r
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(least(floor(r * rate + u) - floor((r - 1) * rate + u), ceil(rate)) AS BIGINT) AS taken FROM placed
"""
