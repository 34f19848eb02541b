"""Near-duplicate groups by SimHash and a binary trie self-join.

Every text becomes a fingerprint of shingle hashes; equal ones are one node. Fingerprints form a binary trie that is joined with
itself: pairs of trie nodes are walked together, the bits in which they differ are summed, and a pair of subtrees is dropped as soon
as that sum exceeds the error budget. Linked nodes are joined to components by alternating large-star and small-star steps.

Two uses. ``near_duplicate_groups`` links 64-bit fingerprints within a budget of a few bits. ``similar_groups`` links texts whose
sets of shingles have a Jaccard similarity of ``least`` or more: bits of two such texts differ with a probability of up to
``acos(2 * least / (1 + least)) / pi`` (15 % at 0.8), too many for one trie of 64 bits, so the fingerprint is wider. It is cut into blocks, the trie is
entered at the nodes of every block (difference 0) and walked on through the 64 bits after it, and every pair that it gives is verified on the whole
sets. ``plan`` derives the blocks from the wanted recall: a pair exactly at ``least`` is a candidate with a probability of ``recall``,
a more similar one with more. The budget goes on over the whole fingerprint before anything is verified, so that families of texts that are alike, but less than ``least``, don't end in all their pairs. A block is as wide as keeps its units small however many texts there are, but at least 16 bits.

How it is spread out. Two 64-bit fingerprints that differ in at most ``k`` bits agree on at least one of ``k + 1`` blocks, so that trie
is entered at the nodes of each of ``k + 1`` blocks too. Each entered node is a unit of work. A unit of more than ``leaf_rows`` rows is opened level by level
with DataFrame joins of child nodes, under the same budget, until every unit is small; a node at full depth is one fingerprint, so this ends. A
task walks a few units at a time, merges what it has linked as it goes, and drops pairs of subtrees that are in one component already, so that
groups of copies give a forest, not all pairs.

Links of ``similar_groups`` are verified ones, which a forest of candidates could miss. So a first pass verifies a forest over a few blocks (large units only
in parts, each part's rows with the row most like all of them), which joins groups of copies, and a second pass walks all pairs of all blocks across the components of the first.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked
like any other by ``near_duplicate_groups``, and only with other texts without words by ``similar_groups``; equal texts share a component; rows repeated under one id give as many equal rows; a
null id stays null and never becomes a component id unless the component has no other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm._work import SPACE, fresh, materialize

BITS = 64
SEED = 42
SHINGLE = 3
_COUNTED = 240  #: shingles whose bits are counted at a time, in bytes
_GROUP = 1 << 14  #: rows of units that are walked at a time
_COMPARED = 1 << 14  #: pairs of whole fingerprints that are compared at a time
_U = np.uint64


def words(data: bytes | None) -> list[bytes]:
    return (data or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits


def shingle_hashes(found: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; the whole of fewer words; nothing without words."""
    from xxhash import xxh64_intdigest as xxh

    if not found:
        return np.zeros(0, _U)
    if len(found) < shingle:
        return np.array([xxh(b" ".join(found), SEED)], _U)
    return np.array([xxh(b" ".join(w), SEED) for w in zip(*(found[i:] for i in range(shingle)), strict=False)], _U)


def majority(hashes: np.ndarray, wide: int = 1) -> np.ndarray:
    """Bytes of ``wide`` 64-bit words: bits set in over half of the hashes, the first word of the hashes themselves and each further one of another mix of them."""
    ones = np.zeros(wide * BITS, np.int64)
    for at in range(0, len(hashes), _COUNTED):
        part = hashes[at : at + _COUNTED, None]
        if wide > 1:
            part = part ^ (np.arange(wide, dtype=_U) * _U(0x9E3779B97F4A7C15))
            mixed = (part ^ (part >> _U(30))) * _U(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> _U(27)
            mixed *= _U(0x94D049BB133111EB)
            mixed[:, 0] = part[:, 0]
            part = mixed
        bits = np.unpackbits(np.ascontiguousarray(part, "<u8").view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little")


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text."""
    return int(majority(shingle_hashes(words(data), shingle)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


# The walk --------------------------------------------------------------------------------------------------


def _products(pairs: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of all members of pairs of ranges, at most ``most`` at a time, of one pair of ranges too; a range with itself gives each pair once."""
    width = pairs[3] - pairs[2]
    size = (pairs[1] - pairs[0]) * width
    end = np.cumsum(size)
    for first in range(0, int(end[-1]), most):
        k = np.arange(first, min(first + most, int(end[-1])))
        each = np.searchsorted(end, k, "right")
        k -= (end - size)[each]
        a, b = pairs[0][each] + k // width[each], pairs[2][each] + k % width[each]
        keep = (pairs[0] != pairs[2])[each] | (a < b)
        yield a[keep], b[keep]


def trie_pairs(unit: np.ndarray, side: np.ndarray, value: np.ndarray, budget: int, comp: np.ndarray | None = None, most: int = 1 << 17, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the budget in the same unit. ``side`` is 0 where a unit joins with itself, else 1 and 2; pairs of
    subtrees that are in one component (``comp``) are dropped, and pairs of which ``skip`` holds all (the caller may fill it on the way).

    The trie over (unit, side, value) is a sorted array, a node is a range of it; a pair of leaves is compared at once. ``most`` bounds
    the node pairs that are held; more are walked in parts.
    """
    n = len(value)
    if not n:
        return
    order = np.lexsort((value, side, unit))
    unit, side, value = unit[order], side[order], value[order]
    cut = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])])
    end = np.r_[cut[1:], n]
    own = (side[cut] == 0) & (end - cut > 1)
    left = np.flatnonzero((side[cut[:-1]] == 1) & (side[cut[1:]] == 2) & (unit[cut[:-1]] == unit[cut[1:]]))
    pairs = np.concatenate([np.stack([cut[own], end[own], cut[own], end[own]]), np.stack([cut[left], end[left], cut[left + 1], end[left + 1]])], axis=1)
    if comp is not None:
        comp = comp[order]
        breaks = np.flatnonzero(comp[1:] != comp[:-1]) + 1
        same_to = np.r_[breaks, n][np.searchsorted(breaks, np.arange(n), "right")]  # where the run of one component ends
    ones: dict[int, np.ndarray] = {}
    stack = [(BITS - 1, pairs, np.zeros(pairs.shape[1], np.int8))]
    while stack:
        bit, pairs, diff = stack.pop()
        if comp is not None and pairs.shape[1]:
            alo, ahi, blo, bhi = pairs
            open_ = ~((comp[alo] == comp[blo]) & (same_to[alo] >= ahi) & (same_to[blo] >= bhi))
            pairs, diff = pairs[:, open_], diff[open_]
        if skip is not None and pairs.shape[1]:
            count = np.r_[0, np.cumsum(~skip[order])]
            open_ = (count[pairs[1]] > count[pairs[0]]) | (count[pairs[3]] > count[pairs[2]])
            pairs, diff = pairs[:, open_], diff[open_]
        if not pairs.shape[1]:
            continue
        if pairs.shape[1] > most:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, :half], diff[:half]), (bit, pairs[:, half:], diff[half:])]
            continue
        leaf = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        if bit < 0:
            for a, b in _products(pairs, most):
                if comp is not None:
                    across = comp[a] != comp[b]
                    a, b = a[across], b[across]
                yield order[a], order[b]
            continue
        if leaf.any():
            a, b = pairs[0, leaf], pairs[2, leaf]
            rest = (value[a] ^ value[b]) & _U((1 << (bit + 1)) - 1)
            near = diff[leaf] + np.bitwise_count(rest) <= budget
            if near.any():
                yield order[a[near]], order[b[near]]
            pairs, diff = pairs[:, ~leaf], diff[~leaf]
            if not pairs.shape[1]:
                continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((value >> _U(bit)) & _U(1), dtype=np.int64)]
        count, (alo, ahi, blo, bhi) = ones[bit], pairs
        amid, bmid = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
        same = alo == blo  # a node with itself
        zero, one = np.stack([alo, amid, blo, bmid]), np.stack([amid, ahi, bmid, bhi])
        over, under = np.stack([alo, amid, bmid, bhi]), np.stack([amid, ahi, blo, bmid])
        full = lambda p: (p[1] > p[0]) & (p[3] > p[2])
        twin = lambda p: ~same | (p[1] - p[0] > 1)  # noqa: E731  one fingerprint has no pair of its own
        may = diff < budget
        keep = [full(zero) & twin(zero), full(one) & twin(one), full(over) & may, full(under) & may & ~same]
        nxt = np.concatenate([p[:, k] for p, k in zip((zero, one, over, under), keep, strict=True)], axis=1)
        stack.append((bit - 1, nxt, np.concatenate([diff[keep[0]], diff[keep[1]], diff[keep[2]] + np.int8(1), diff[keep[3]] + np.int8(1)])))


class _Forest:
    """Joins positions; tells which links join something new."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def roots(self) -> np.ndarray:
        while (up := self.root[self.root]).tolist() != self.root.tolist():
            self.root = up
        return self.root

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the links (a, b) joined two trees."""
        root = self.roots()
        new = np.flatnonzero(root[a] != root[b])
        parent, kept = root, []
        for at in new.tolist():
            x, y = int(a[at]), int(b[at])
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(at)
        return np.array(kept, np.int64)


def _near_rows(unit: np.ndarray, side: np.ndarray, value: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the budget of each row (sorted by unit, side and value) with the next of its unit and with the one most like all of its unit."""
    n = len(value)
    fits = lambda a, b: np.bitwise_count(value[a] ^ value[b]) <= budget
    new = np.r_[True, (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])]
    cut = np.flatnonzero(new)
    size = np.diff(np.r_[cut, n])
    a, b = np.flatnonzero(~new) - 1, np.flatnonzero(~new)
    many = size > 2
    if many.any():
        row = np.repeat(many, size)
        which, first = np.repeat(np.arange(len(cut)), size), cut
        half = np.zeros((len(cut), BITS), np.int32)
        bits = np.unpackbits(value[row].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, which[row][1:] != which[row][:-1]])
        half[many] = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        middle = np.packbits(2 * half > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        off = np.bitwise_count(value ^ middle[which]).astype(np.int64)
        best = np.minimum.reduceat(off * n + np.arange(n), first) % n
        star_a, star_b = best[which[row]], np.flatnonzero(row)
        other = star_a != star_b
        a, b = np.r_[a, star_a[other]], np.r_[b, star_b[other]]
    keep = fits(a, b) if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by unit, in tables of whole units of about ``_GROUP`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= _GROUP:
            t = pa.Table.from_batches(held).combine_chunks()
            u = t.column("u").to_numpy()
            last = int(np.searchsorted(u, u[-1], "left")) if (u[:-1] <= u[1:]).all() else 0
            if last:
                yield t.slice(0, last)
                held, size = t.slice(last).to_batches(), t.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


@dataclass(frozen=True)
class Whole:
    """What the whole fingerprints of two rows in a unit say: whether they are within the budget of all bits, and whether their pair is this block's to give. Of the blocks in which
    two rows meet (equal block, the 64 bits after it within the budget) the first gives the pair, so that it comes once."""

    width: int
    blocks: int
    budget: int
    bits: int  #: that may differ in all

    def keeps(self, differ: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Which rows of ``differ`` (bytes of two fingerprints, one XOR the other), found in ``block``, are kept."""
        keep = np.bitwise_count(differ).sum(1, dtype=np.int32) <= self.bits
        at = np.flatnonzero(keep)
        for first in range(0, len(at), 1024):
            part = at[first : first + 1024]
            bits = np.unpackbits(differ[part], axis=1)
            bits = np.concatenate([bits, bits[:, : self.width + BITS]], axis=1)
            sums = np.concatenate([np.zeros((len(part), 1), np.int32), np.cumsum(bits, axis=1, dtype=np.int32)], axis=1)
            start = np.arange(self.blocks) * self.width
            off, after = sums[:, start + self.width] - sums[:, start], sums[:, start + self.width + BITS] - sums[:, start + self.width]
            keep[part] = ((off == 0) & (after <= self.budget)).argmax(1) == block[part]
        return keep


def _linked(ready: DataFrame, budget: int, least: float = 0.0, emit: str = "forest", whole: Whole | None = None) -> DataFrame:
    """Links within the budget of rows (u, side, value[, node, comp, n, block, fp]) between different components, where there are, and of sizes that
    allow a similarity of ``least``. ``emit``: "forest" gives (a, b) of a forest of each task's units, "pairs" all that ``whole`` keeps, and "rows" the
    rows (u, side, value, block, node) that have a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_units(batches):
            column = lambda name: t.column(name).to_numpy() if name in t.column_names else None  # noqa: B023, E731
            unit, side, value = column("u"), column("side"), column("value")
            new = np.r_[True, unit[1:] != unit[:-1]]
            alone = new & np.r_[new[1:], True]
            keep = np.flatnonzero(~alone)
            if not len(keep):
                continue
            unit, side, value = unit[keep], side[keep], value[keep].view(_U)
            order = np.lexsort((value, side, unit))
            keep, unit, side, value = keep[order], unit[order], side[order], value[order]
            node, comp, n, block = (None if (x := column(name)) is None else x[keep] for name in ("node", "comp", "n", "block"))
            node = value.view(np.int64) if node is None else node
            prints = np.frombuffer(b"".join(t.column("fp").take(pa.array(keep)).to_pylist()), np.uint8).reshape(len(keep), -1) if whole else None

            def fitting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                ok = node[a] != node[b]  # noqa: B023
                if comp is not None:  # noqa: B023
                    ok &= comp[a] != comp[b]  # noqa: B023
                if n is not None:  # noqa: B023
                    ok &= np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9  # noqa: B023
                a, b = a[ok], b[ok]
                if whole and len(a):
                    near = np.concatenate([whole.keeps(prints[a[i : i + _COMPARED]] ^ prints[b[i : i + _COMPARED]], block[a[i : i + _COMPARED]]) for i in range(0, len(a), _COMPARED)])  # noqa: B023
                    a, b = a[near], b[near]
                return a, b

            def pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
                if len(a):
                    x, y = node[a], node[b]  # noqa: B023
                    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

            if emit == "forest":
                tree = _Forest(len(value))
                a, b = _near_rows(unit, side, value, budget)
                yield from pairs(*fitting(a, b))
                tree.add(a, b)
                for a, b in trie_pairs(unit, side, value, budget, tree.roots().copy()):
                    new_ = tree.add(a, b)
                    yield from pairs(*fitting(a[new_], b[new_]))
                continue
            seen = np.zeros(len(value), bool)
            for a, b in trie_pairs(unit, side, value, budget, comp, skip=seen if emit == "rows" else None):
                a, b = fitting(a, b)
                if emit == "pairs":
                    yield from pairs(a, b)
                else:
                    seen[a] = seen[b] = True
            if seen.any():
                yield pa.RecordBatch.from_arrays([pa.array(unit[seen]), pa.array(side[seen]), pa.array(value[seen].view(np.int64)), pa.array(block[seen]), pa.array(node[seen])], ["u", "side", "value", "block", "node"])

    return ready.repartition("u").sortWithinPartitions("u").mapInArrow(run, "u long, side int, value long, block int, node long" if emit == "rows" else "a long, b long")


def _open_units(rows: DataFrame, budget: int, leaf_rows: int, step: int, label: str) -> DataFrame:
    """Rows (u, side, diff, pos, rot, ...) with every unit of more than ``leaf_rows`` rows opened into small ones."""
    keep = [c for c in rows.columns if c not in ("diff", "pos", "rot")]
    parts = [F.min("comp").alias("lo"), F.max("comp").alias("hi")] if "comp" in rows.columns else [F.lit(0).alias("lo"), F.lit(1).alias("hi")]
    counts = rows.groupBy("u").agg(F.count(F.lit(1)).alias("m"), *parts).where(F.col("m") > leaf_rows)
    counts = materialize(counts.select("u", (F.col("lo") < F.col("hi")).alias("open")), f"{label}-hot-units")
    busy = counts.where("open").select("u")  # a unit of one component has no link to give
    ready = rows.select(*keep)
    if not counts.isEmpty():
        ready = rows.join(counts, "u", "left_anti").select(*keep)
    if not busy.isEmpty():
        hot = materialize(rows.join(busy, "u", "left_semi"), f"{label}-hot")
        for level in range(BITS):
            opened = materialize(_descend(hot, budget, step), f"{label}-hot-{level}")
            done = (F.col("size") <= leaf_rows) | (F.col("pos") >= BITS)
            ready = ready.unionByName(opened.where(done).select(*keep))
            hot = opened.where(~done).drop("size")
            if hot.isEmpty():
                break
    return ready


def _descend(hot: DataFrame, budget: int, most_step: int) -> DataFrame:
    """Open each unit of ``hot`` by up to ``most_step`` more bits: pairs of child nodes within the budget and not in one component."""
    others = [c for c in hot.columns if c not in ("u", "side", "diff", "pos", "rot")]
    labelled = "comp" in others
    hot = hot.withColumn("step", F.expr(f"least({most_step}, {BITS} - pos)")).withColumn("x", F.expr(f"shiftrightunsigned(shiftleft(rot, pos), {BITS} - step)"))
    parts = [F.min("comp").alias("lo"), F.max("comp").alias("hi")] if labelled else [F.lit(0).alias("lo"), F.lit(1).alias("hi")]
    nodes = hot.groupBy("u", "side", "pos", "step", "diff", "x").agg(F.count(F.lit(1)).alias("n"), *parts)
    a, b = nodes.where("side < 2").alias("a"), nodes.where("side <> 1").alias("b")
    differ = F.expr("a.diff + bit_count(a.x ^ b.x)")
    own = F.expr("a.side = 0 and a.x = b.x")
    pairs = a.join(b, F.expr("a.u = b.u and (a.side = 1 or a.x <= b.x)")).where(differ <= budget).where("not (a.lo = a.hi and b.lo = b.hi and a.lo = b.lo)").select(
        F.col("a.u").alias("u"), F.col("a.x").alias("x"), F.col("b.x").alias("y"), F.col("a.side").alias("sa"), F.col("b.side").alias("sb"),
        differ.alias("d"), own.alias("own"), F.when(own, F.col("a.n")).otherwise(F.expr("a.n + b.n")).alias("size"),
        F.expr("xxhash64(a.u, a.x, b.x, a.pos)").alias("nu"),
    ).where("not own or size > 1")
    member = F.when(F.col("own"), F.expr("array(struct(sa as side, x as x, 0 as ns))")).otherwise(F.expr("array(struct(sa as side, x as x, 1 as ns), struct(sb as side, y as x, 2 as ns))"))
    members = pairs.select("u", "nu", "d", "size", F.explode(member).alias("m")).select("u", F.col("m.side").alias("side"), F.col("m.x").alias("x"), "nu", "d", "size", "m.ns")
    return hot.join(members, ["u", "side", "x"]).select(
        F.col("nu").alias("u"), F.col("ns").alias("side"), F.col("d").cast("int").alias("diff"), F.expr("pos + step").alias("pos"), "rot", *others, "size",
    )


# Fingerprints within a budget ------------------------------------------------------------------------------


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of each of budget + 1 blocks."""
    cuts = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _rotl(fp, by) -> F.Column:
    return F.expr(f"shiftleft({fp}, {by}) | shiftrightunsigned({fp}, {BITS} - {by})") if by else F.col(fp)


def links(nodes: DataFrame, budget: int = 2, leaf_rows: int = 8192) -> DataFrame:
    """(a, b) links among the distinct fingerprints of ``nodes`` (column fp) that join all pairs
    within ``budget`` differing bits into the same components as all pairs would."""
    if budget == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    turned = F.array(*[F.struct(F.lit(width).alias("pos"), _rotl("fp", lo).alias("rot")) for lo, width in _blocks(budget)])
    rows = nodes.select(F.col("fp").alias("value"), F.posexplode(turned).alias("r", "t")).select(
        F.expr("xxhash64(r, shiftrightunsigned(t.rot, 64 - t.pos))").alias("u"), F.lit(0).alias("side"), F.lit(0).alias("diff"), "t.pos", "t.rot", "value",
    )
    return _linked(_open_units(rows, budget, leaf_rows, 8, "trie"), budget)


def _solved(edges: DataFrame) -> DataFrame:
    """(node, root) of edges that one task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            names, code = np.unique(np.concatenate([t.column(0).to_numpy(), t.column(1).to_numpy()]), return_inverse=True)
            tree = _Forest(len(names))
            tree.add(code[: t.num_rows], code[t.num_rows :])
            root = tree.roots()
            below = root != np.arange(len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names[below]), pa.array(names[root[below]])], ["node", "root"])

    return edges.repartition(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, most_rounds: int = 64, small: int = 1 << 18) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) that can reach a smaller one, with the smallest. Up to ``small`` edges are joined in one task (4 MB at 16 bytes each); more by
    rounds of large-star and small-star steps, each of which at least halves the longest way. The result is the same."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if now.count() <= small:
        return materialize(_solved(now), "components")
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        now = materialize(joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38, 0))"))).first()
        if tuple(seen) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2, shingle: int = SHINGLE, leaf_rows: int = 8192) -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id among all rows that links reach."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), budget, leaf_rows))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def fingerprint_hex(fp="fp") -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# Texts of a similarity -------------------------------------------------------------------------------------


def plan(texts: int, least: float = 0.8, recall: float = 0.999, narrowest: int = 16) -> tuple[int, int, int]:
    """(block width, blocks, budget over the 64 bits after a block) that make a pair at ``least`` a candidate with probability ``recall``."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    width = min(max(narrowest, math.ceil(math.log2(max(texts, 2))) - 4), 48)
    budget, within = 0, (1 - p) ** BITS
    while within < 0.985:
        budget += 1
        within += math.comb(BITS, budget) * p**budget * (1 - p) ** (BITS - budget)
    one = (1 - p) ** width * within
    return width, math.ceil(math.log1p(-recall) / math.log1p(-one)), budget


def whole_budget(bits: int, least: float = 0.8, recall: float = 0.995) -> int:
    """The differing bits of whole fingerprints within which a pair at ``least`` stays with probability ``recall`` (normal approximation)."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    return math.ceil(bits * p + NormalDist().inv_cdf(recall) * math.sqrt(bits * p * (1 - p)))


def node_of(text) -> F.Column:
    """XXH64 of a text's words as ``words`` finds them, as a signed long; texts of the same words are one node."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.trim(F.regexp_replace(low, SPACE, " ")))


def _prints(rows: DataFrame, shingle: int, wide: int) -> DataFrame:
    """(id, node, n, fp) of (id, text): the words' hash, distinct shingles and their wide fingerprint; texts without words have none."""
    from xxhash import xxh64_intdigest as xxh

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                nodes, sizes, prints = np.zeros(b.num_rows, _U), [], []
                for i, x in enumerate(b.column(1)):
                    found = words(x.as_py())
                    nodes[i] = xxh(b" ".join(found), SEED)
                    h = np.unique(shingle_hashes(found, shingle))
                    sizes.append(len(h))
                    prints.append(majority(h, wide).tobytes() if len(h) else b"")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())], ["id", "node", "n", "fp"])

    return rows.mapInArrow(run, "id long, node long, n long, fp binary")


def _entries(nodes: DataFrame, width: int, blocks: int, wide: int) -> DataFrame:
    """(u, value, node, n[, comp, block]) for each block of (node, n, fp[, comp]): the node entered and the 64 bits after it."""
    labelled = "comp" in nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                raw = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, wide * 8)
                bits = np.unpackbits(raw, axis=1)
                bits = np.concatenate([bits, bits[:, : width + BITS]], axis=1)
                for i in range(blocks):
                    key = np.zeros((b.num_rows, BITS), np.uint8)
                    key[:, BITS - width :] = bits[:, i * width : (i + 1) * width]
                    key = np.packbits(key, axis=1).view(">u8")[:, 0].astype(np.int64) + (i << width)
                    value = np.packbits(bits[:, (i + 1) * width : (i + 1) * width + BITS], axis=1).view(">u8")[:, 0].astype(_U).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value), b.column(0), b.column(1), *([b.column(3), pa.array(np.full(b.num_rows, i, np.int32))] if labelled else [])], ["u", "value", "node", "n", *(["comp", "block"] if labelled else [])])

    return nodes.select("node", "n", "fp", *(["comp"] if labelled else [])).mapInArrow(run, "u long, value long, node long, n long" + (", comp long, block int" if labelled else ""))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(z.as_py(), _U) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("p")), "a")
    full = with_a.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("q")), "b")
    return full.select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, grams): the sorted distinct shingle hashes of the wanted nodes of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(words(x.as_py()), shingle)).tobytes() for x in b.column(1)], pa.binary())], ["node", "grams"])

    return texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(run, "node long, grams binary")


def similar_links(texts: DataFrame, nodes: DataFrame, least: float, shingle: int, blocks: tuple[int, int, int], wide: int, leaf_rows: int = 8192, first_blocks: int = 4) -> DataFrame:
    """(node, root) of all nodes (node, n, fp) that have a verified link; ``texts`` are (node, text)."""
    width, count, budget = blocks
    # a forest over the first blocks joins groups of copies; it need not be whole, so a large unit is dealt in parts
    rows = _entries(nodes, width, min(count, first_blocks), wide)
    large = materialize(rows.groupBy("u").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > leaf_rows).select("u", F.ceil(F.col("m") / leaf_rows).alias("parts")), "large-units")
    if not large.isEmpty():
        split = rows.join(large, "u", "left").withColumn("u", F.expr("if(parts is null, u, xxhash64(u, pmod(xxhash64(node, u), parts)))"))
        rows = split.select("u", "value", "node", "n")
    first = materialize(_linked(rows.withColumn("side", F.lit(0)), budget, least).distinct(), "candidates")
    known = materialize(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "known")
    sets = materialize(_sets(texts, known, shingle), "shingles")
    edges = materialize(_verified(first, sets, least), "links")
    roots = components(edges)
    # then all pairs of all blocks across the components
    labelled = nodes.join(roots, "node", "left").select("node", "n", "fp", F.coalesce("root", "node").alias("comp"))
    labelled = materialize(labelled, "labelled")
    rows = _entries(labelled, width, count, wide).select("u", F.lit(0).alias("side"), F.lit(0).alias("diff"), F.lit(0).alias("pos"), F.col("value").alias("rot"), "value", "node", "n", "comp", "block")
    # only rows that have a link in their unit take the whole fingerprint along, and only pairs that are near in all of it go on
    linked = materialize(_linked(_open_units(rows, budget, leaf_rows, 4, "across"), budget, least, "rows"), "linked-rows")
    wanted = linked.join(labelled, "node").select("u", "side", "value", "block", "node", "n", "comp", "fp")
    across = materialize(_linked(wanted, budget, least, "pairs", Whole(width, count, budget, whole_budget(wide * BITS, least))).distinct(), "across")
    rest = across.join(first, ["a", "b"], "left_anti")
    new = across.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti")
    more = materialize(_verified(rest, sets.unionByName(materialize(_sets(texts, new, shingle), "shingles")), least), "links")
    return roots if more.isEmpty() else components(edges.unionByName(more))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = 5, recall: float = 0.999, leaf_rows: int = 8192) -> DataFrame:
    """(id, node, root) for every row: rows of one root are near duplicates."""
    width, count, budget = plan(docs.count(), least, recall)
    wide = math.ceil(width * count / BITS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    prints = materialize(_prints(rows, shingle, wide), "prints")
    nodes = prints.where("n > 0").dropDuplicates(["node"]).select("node", "n", "fp")
    texts = docs.select(node_of(F.col(text_col)).alias("node"), F.col(text_col).cast("binary").alias("text"))
    roots = similar_links(texts, materialize(nodes, "nodes"), least, shingle, (width, count, budget), wide, leaf_rows)
    return prints.select("id", "node").join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, component_id): ``similar_groups`` by the smallest id of each."""
    groups = materialize(similar_groups(docs, id_col, text_col, **options), "groups")
    least = groups.groupBy("root").agg(F.min("id").alias("component_id"))
    return groups.join(least, "root").select("id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group of ``similar_groups``, all columns kept: the one with the smallest id (null ids last), of rows that
    share it the one with the smallest words' hash, then text; of rows that are still equal, one."""
    groups = materialize(similar_groups(docs, id_col, text_col, **options), "groups")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    keep = materialize(groups.groupBy("root").agg(first).select(F.col("first.id").alias("kid"), F.col("first.node").alias("knode")), "kept")
    mine = F.col("id").eqNullSafe(F.col("kid")) & (F.col("node") == F.col("knode"))
    twice = materialize(groups.join(keep, mine, "left_semi").groupBy("id", "node").count().where("count > 1").select(F.col("id").alias("kid"), F.col("node").alias("knode")), "repeated")
    i, k, r = fresh(docs, "kid_", "knode_", "row_")
    rows = docs.withColumn(k, node_of(F.col(text_col)))
    here = lambda names: (F.col(k) == names["knode"]) & F.col(id_col).cast("long").eqNullSafe(names["kid"])
    named = lambda df: df.select(F.col("kid").alias(i), F.col("knode").alias(f"{k}_"))
    at = {"kid": F.col(i), "knode": F.col(f"{k}_")}
    kept = rows.join(named(keep), here(at), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if twice.isEmpty():
        return kept.select(*columns)
    some = kept.join(named(twice), here(at), "left_semi")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = some.groupBy(F.col(f"`{id_col}`").cast("long"), k).agg(F.min_by(F.struct(*columns), F.struct(text_col, F.xxhash64(*plain))).alias(r))
    return kept.join(named(twice), here(at), "left_anti").select(*columns).unionByName(one.select(f"{r}.*"))
