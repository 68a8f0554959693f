"""Embedding near-duplicates by a forest of random-projection trees (operator 5).

Equal vectors are one class, compared once. Each tree splits a node at the median of a random projection, one direction
for each tree and level; vectors nearer to the cut than `spill` go to both sides. (Two vectors of 64 components at a
cosine of just 0.95 lie 0.04 apart on a projection as a rule, and a cut parts them for good at 3 levels in 100, so at 20
levels one tree of two still shows them together and one pair in 300 is missed by all eight.) Vectors within a leaf are
compared by cosine in double precision, and what all trees find together is linked; a pair that meets in several leaves
counts in the first leaf (by number) that its two vectors share.

The cuts of all trees are fitted on a sample of at most about SAMPLE classes, drawn by hash, to the depth at which a
leaf would hold `leaf` classes, or eight of the sample. They are broadcast (a number for eight of the sample, tree by tree), and every
class walks down all trees in one pass over the table, which writes each class once, with the numbers of its leaves. Leaves that are still
larger than eight times `leaf`, as in tables of many millions, are fitted on samples of their own and walked through
again in the same way, leaf by leaf in parallel, a bounded part of a leaf at a time. What no split can part (most of it
would go to both sides) stays whole: its vectors are nearly the same in every direction, and it is compared in blocks,
every pair of blocks being a task of bounded size. A leaf's rows therefore never have to fit in one task, and none is
dropped.

A vector is in some dozens of leaves, so vectors aren't moved to all of them at once: leaves are dealt by hash into so many
rounds that one round moves about one and a half times the bytes of all vectors (or ROUND bytes, if they have fewer). The files of a round's shuffle go
when it ends, and what later steps don't read is dropped, so that the disk holds a few times the vectors however deep the trees are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import Scratch, brief_shuffles, sampled, table
from .components import components

COSINE, TREES, LEAF, SPILL, STUCK = 0.95, 8, 512, 0.015, 0.9
#: Classes on which cuts are fitted, fewest of them in a leaf, levels in a walk, rows of a large leaf that walk at a time.
SAMPLE, FEWEST, LEVELS, PART = 65_536, 8, 24, 65_536
#: Vectors of a leaf that no split can part are compared in blocks of BLOCK, STRIPE rows at a time.
BLOCK, STRIPE = 8192, 256
#: Bytes that a round moves at least; rows of sorted leaves that are compared at a time; rows of a table that is broadcast at most.
ROUND, GATHER, BROADCAST = 1 << 27, 16_384, 1 << 20
#: Links of a stripe from which the leaves of a leaf's vectors are compared as bits.
CROWDED = 2048
#: A leaf's number is its tree, and below that as many bits of its node.
BITS = 48
#: Leaves are written as places in a dictionary, of up to a million of them.
NUMBERS = {"parquet.dictionary.page.size": str(8 << 20)}


def _directions(walk: int, tree: int, d: int) -> np.ndarray:
    """A unit vector for each level as columns."""
    r = np.random.default_rng(((walk * 1009) + tree + 1) * 1009).normal(size=(d, LEVELS))
    return r / np.linalg.norm(r, axis=0)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _sides(p: np.ndarray, cut: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    return p <= cut + spill, p > cut - spill


def _fit(x: np.ndarray, directions: np.ndarray, least: float, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, cuts) of a tree on vectors x, nodes sorted; node 1 is the root, 2 n and 2 n + 1 are the sides of n."""
    shot = x @ directions
    row, node, cuts = np.arange(len(x)), np.ones(len(x), dtype=np.int64), {}
    for level in range(LEVELS):
        order = np.argsort(node, kind="stable")
        row, node = row[order], node[order]
        begin = np.nonzero(np.append(True, node[1:] != node[:-1]))[0] if len(node) else []
        rows, nodes = [], []
        for i, j in zip(begin, [*begin[1:], len(node)]):
            p = shot[row[i:j], level]
            if j - i <= max(least, FEWEST):
                continue
            cut = float(np.median(p))
            left, right = _sides(p, np.float64(cut), spill)
            if max(left.sum(), right.sum()) < STUCK * (j - i):
                cuts[int(node[i])] = cut
                for side, own in enumerate((left, right)):
                    rows.append(row[i:j][own])
                    nodes.append(np.full(own.sum(), 2 * node[i] + side))
        if not rows:
            break
        row, node = np.concatenate(rows), np.concatenate(nodes)
    return np.array(sorted(cuts), dtype=np.int64), np.array([cuts[k] for k in sorted(cuts)])


def _walk(x: np.ndarray, directions: np.ndarray, nodes: np.ndarray, cuts: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): the leaves that each vector of x comes to."""
    row, node, shot, done = np.arange(len(x)), np.ones(len(x), dtype=np.int64), x @ directions, []
    for level in range(LEVELS + 1):
        at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
        inner = nodes[at] == node if len(nodes) else np.zeros(len(node), dtype=bool)
        done.append((row[~inner], node[~inner]))
        row, node, cut = row[inner], node[inner], cuts[at[inner]] if len(nodes) else cuts
        if not len(row):
            break
        left, right = _sides(shot[row, level], cut, spill)
        row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
    return tuple(np.concatenate(x) for x in zip(*done))


def _vectors(packed, kind: str) -> np.ndarray:
    """Packed vectors of equal length as rows; float numbers widen exactly."""
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1)


def _column(packed: pa.Array, kind: str) -> np.ndarray:
    """The same of a column without nulls, from its buffer."""
    ends = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(packed.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(packed), -1)


def _pack(kind: str):
    """(vec_id, v) with each vector as the bytes of its components over a power of two near the largest, which changes
    no direction and keeps the squares of very large and small ones finite; null where it has no direction, or no id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            x, first = v.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(size) - size  # nulls are NaN
            top = np.zeros(len(v))
            if len(x):
                top[size > 0] = np.maximum.reduceat(np.abs(x), first[size > 0])
            good = np.isfinite(top) & (top > 0) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            scale = np.exp2(np.floor(np.log2(np.where(good, top, 1.0))))
            packed = (x / np.repeat(scale, size) + 0.0).astype(kind)  # no negative zero
            rows = [packed[a : a + n].tobytes() if ok else None for a, n, ok in zip(first.tolist(), size.tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.binary())], names=["vec_id", "v"])

    return run


def _walk_all(forest, spill: float, kind: str):
    """The classes with `leaves`, the sorted numbers of the leaves of all trees that each comes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_column(batch.column("v"), kind))
            walks = [_walk(x, _directions(0, tree, x.shape[1]), nodes, cuts, spill) for tree, (nodes, cuts) in enumerate(forest.value)]
            row = np.concatenate([row for row, _ in walks])
            code = np.concatenate([(tree << BITS) + node for tree, (_, node) in enumerate(walks)])
            order = np.lexsort((code, row))
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(x))))
            leaves = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order]))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves], names=[*batch.schema.names, "leaves"])

    return run


def _planted(classes: DataFrame, d: int, trees: int, leaf: int, spill: float, kind: str) -> tuple[DataFrame, int, int]:
    """(classes with `leaves`, how many, of how many cuts are fitted at a time); classes: rep, v and what else goes along."""
    spark, n = classes.sparkSession, classes.count()
    size = min(SAMPLE, (1 << 24) // d)  # 128 MB of numbers at most
    share = size / max(1, n)
    own = classes.filter(sampled("rep", share)) if share < 1 else classes
    x = own.select("v").toArrow().column("v").to_pylist()
    given = spark.sparkContext.broadcast(_vectors(x, kind) if x else np.zeros((0, d)))
    fit = lambda t: _fit(_unit(given.value), _directions(0, t, d), leaf * len(given.value) / max(1, n), spill)
    forest = spark.sparkContext.broadcast(spark.sparkContext.parallelize(range(trees), trees).map(fit).collect())
    given.unpersist()
    return classes.mapInArrow(_walk_all(forest, spill, kind), StructType([*classes.schema, *StructType().add("leaves", ArrayType(LongType()))])), n, size


def plant(classes: DataFrame, d: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, kind: str = "<f8") -> DataFrame:
    """(tree, leaf, rep) for every leaf that a class is in; classes: (rep, v), packed vectors of length d that have a direction."""
    at, n, size = _planted(classes, d, trees, leaf, spill, kind)
    at = _again(Scratch("rp-planted", at, options=NUMBERS), n, size, leaf, spill, kind).frame
    return at.select("rep", F.explode("leaves").alias("leaf")).select(F.shiftright("leaf", BITS).cast("int").alias("tree"), "leaf", "rep")


def _rounds(moved: float, whole: float) -> int:
    """In how many rounds so many bytes are moved, of vectors of so many bytes."""
    return max(1, math.ceil(moved / max(ROUND, 1.5 * whole)))


def _mine(k: int, rounds: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(rounds)) == k if rounds > 1 else F.lit(True)


def _counted(at: DataFrame) -> DataFrame:
    """(d, leaf, n): the classes in each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            leaves = batch.column("leaves")
            size = pc.list_value_length(leaves).to_numpy(zero_copy_only=False)
            held.append(pa.table({"d": np.repeat(batch.column("d").to_numpy(), size), "leaf": leaves.flatten()}))
            n += len(held[-1])
            if n > 1 << 21:
                yield from sums(held)
                held, n = [], 0
        if n:
            yield from sums(held)

    def sums(held: list[pa.Table]) -> list[pa.RecordBatch]:
        return pa.concat_tables(held).group_by(["d", "leaf"]).aggregate([([], "count_all")]).rename_columns(["d", "leaf", "n"]).combine_chunks().to_batches()

    return at.select(F.octet_length("v").alias("d"), "leaves").mapInArrow(run, "d int, leaf long, n long").groupBy("d", "leaf").agg(F.sum("n").alias("n"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


def _weight(at: DataFrame) -> tuple[float, int, int]:
    """(bytes of all vectors, rows in leaves, bytes of the vectors in leaves) of classes with `leaves`, with what goes along."""
    row = at.agg(F.sum(F.octet_length("v") + 40), F.sum(F.size("leaves")), F.sum(F.size("leaves") * (F.octet_length("v") + 40 + 4 * F.size("leaves")))).first()
    return float(row[0] or 0), row[1] or 0, float(row[2] or 0)


def _again(at: Scratch, n: int, size: int, leaf: int, spill: float, kind: str) -> Scratch:
    """`at`, or after it, with leaves that were left large for want of a larger sample walked through further."""
    walk = 1
    while n * FEWEST / size > leaf:  # else there are none
        large = Scratch("rp-large", _counted(at.frame).filter(F.col("n") > 8 * leaf).select("leaf", "n"))
        many, rows = large.frame.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        moved = _move(at, large, many, rows, walk, leaf, spill, size, kind) if many else None
        large.drop()
        if moved is None:
            break
        at = _moved(at, moved)
        walk, n = walk + 1, n * FEWEST / size
    return at


def _move(at: Scratch, large: Scratch, many: int, rows: int, walk: int, leaf: int, spill: float, size: int, kind: str) -> Scratch | None:
    """(rep, of, leaf) of the classes in large leaves that could be fitted: the leaf that each was in and one that it goes to; None if no leaf could."""
    whole, all_rows, weight = _weight(at.frame)
    rounds = _rounds(weight * (rows / all_rows if many <= BROADCAST else 1), whole)  # a join that isn't broadcast moves all rows
    fitted, moved = Scratch("rp-cuts"), Scratch("rp-moved")
    for k in range(rounds):
        inside = at.frame.select("rep", "v", F.explode("leaves").alias("leaf")).filter(_mine(k, rounds, "leaf"))
        fitted.add(_fit_leaves(inside.join(_small(large.frame, many), "leaf"), walk, leaf, spill, size, kind))
        found = fitted.frame.filter(F.expr("size(nodes) > 0") & _mine(k, rounds, "leaf"))
        if not found.isEmpty():
            moved.add(_walk_leaves(inside, found, many, walk, spill, kind))
    fitted.drop()
    return moved if moved.path else None


def _moved(at: Scratch, moved: Scratch) -> Scratch:
    """The classes with the leaves that they went to instead of those that they were in."""
    out, rounds = Scratch("rp-planted", options=NUMBERS), min(16, _rounds(_weight(at.frame)[0], 0))
    for k in range(rounds):
        mine = _mine(k, rounds, "rep")
        new = moved.frame.filter(mine).groupBy("rep").agg(F.collect_set("of").alias("gone"), F.collect_set("leaf").alias("new"))
        leaves = F.when(F.col("gone").isNull(), F.col("leaves")).otherwise(F.array_sort(F.array_union(F.array_except("leaves", "gone"), "new")))
        out.add(at.frame.filter(mine).join(new, "rep", "left").withColumn("leaves", leaves).select(*at.frame.columns))
    at.drop()
    moved.drop()
    return out


def _fit_leaves(inside: DataFrame, walk: int, leaf: int, spill: float, size: int, kind: str) -> DataFrame:
    """(leaf, n, nodes, cuts) for each large leaf, each from a bounded sample of its own."""
    own = inside.filter(F.shiftrightunsigned(F.xxhash64(F.lit(walk), "rep"), 1) < F.lit(float(1 << 63)) * F.lit(float(size)) / F.col("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = _unit(_vectors(pdf["v"].tolist(), kind)), int(pdf["n"].iloc[0])
        nodes, cuts = _fit(x, _directions(walk, int(pdf["leaf"].iloc[0]) >> BITS, x.shape[1]), leaf * len(x) / n, spill)
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1], "n": [n], "nodes": [nodes], "cuts": [cuts]})

    return own.groupBy("leaf").applyInPandas(fit, "leaf long, n long, nodes array<long>, cuts array<double>")


def _walk_leaves(inside: DataFrame, fitted: DataFrame, many: int, walk: int, spill: float, kind: str) -> DataFrame:
    """(rep, of, leaf) of the classes in the leaves that were fitted, a part of a leaf of about PART rows at a time."""
    parts = fitted.withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    rows = inside.join(_small(parts.select("leaf", "parts"), many), "leaf").select("leaf", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), "rep", "v")
    cuts = parts.select("leaf", "nodes", "cuts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def go(key: tuple, own: pd.DataFrame, split: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["rep", "of", "node"])
        x = _unit(_vectors(own["v"].tolist(), kind))
        row, node = _walk(x, _directions(walk, int(key[0]) >> BITS, x.shape[1]), np.asarray(split["nodes"].iloc[0]), np.asarray(split["cuts"].iloc[0]), spill)
        return pd.DataFrame({"rep": own["rep"].to_numpy()[row], "of": key[0], "node": node})

    found = rows.groupBy("leaf", "part").cogroup(cuts.groupBy("leaf", "part")).applyInPandas(go, "rep long, of long, node long")
    tree = F.shiftleft(F.shiftright("of", BITS), BITS)
    return found.select("rep", "of", (tree + F.pmod(F.xxhash64("of", "node"), F.lit(1 << BITS))).alias("leaf"))


class _Classes:
    """Disjoint sets of places, each named by its smallest."""

    def __init__(self, n: int):
        self.name = np.arange(n)

    def find(self, at: np.ndarray) -> np.ndarray:
        while (self.name[at] != at).any():
            at = self.name[at]
        return at

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite each a with its b; the pairs may be millions, the sets that they join are few."""
        while True:
            a, b = self.find(a), self.find(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.name, np.maximum(a, b), np.minimum(a, b))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by `g` in batches that end where a value of it does, of about GATHER rows if no value has more."""
    held, n, most = [], 0, GATHER
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n < most:
            continue
        own = pa.concat_batches(held)
        begin = int(_begins(own, ["g"])[-1])
        if begin:
            yield own.slice(0, begin)
        held, n = [own.slice(begin)], own.num_rows - begin
        most = max(GATHER, 2 * n)
    if n:
        yield pa.concat_batches(held)


def _begins(rows: pa.RecordBatch, key: list[str]) -> np.ndarray:
    new = np.arange(rows.num_rows) == 0
    for name in key:
        v = rows.column(name).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.nonzero(new)[0]


def _bits(codes: np.ndarray) -> np.ndarray:
    """A row of bits for each row of codes (-1: none), one for each code that more than one row has."""
    row, at = np.nonzero(codes >= 0)
    _, code, n = np.unique(codes[row, at], return_inverse=True, return_counts=True)
    row, code = row[n[code] > 1], (np.cumsum(n > 1) - 1)[code[n[code] > 1]]
    bits = np.zeros((len(codes), int((n > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
    return bits


def _compare(cosine: float, kind: str):
    """Links of leaves, or of two blocks of one, that come together: how many each vector has that no earlier leaf shows, and an
    edge from each vector to the smallest one that those reach here. Pairs are held for one stripe of rows at a time."""
    key = ["d", "leaf", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            # the smallest place of a leaf is its smallest vector; two leaves may have one g
            rows = rows.take(pa.array(np.lexsort([rows.column(c).to_numpy() for c in ("rep", *reversed(key))])))
            at = [*_begins(rows, ["d"]).tolist(), rows.num_rows]
            for a, b in zip(at, at[1:]):
                yield links(rows.slice(a, b - a))

    def links(rows: pa.RecordBatch) -> pa.RecordBatch:
        rep, weight, part = (rows.column(c).to_numpy() for c in ("rep", "weight", "part"))
        one = rows.column("i").to_numpy() == rows.column("j").to_numpy()
        x = _unit(_column(rows.column("v"), kind))
        narrow, off = x.astype(np.float32), (x.shape[1] + 8) / 2**22  # no product of floats is off by as much
        early = rows.column("early")
        size = pc.list_value_length(early).to_numpy(zero_copy_only=False)
        shared = np.full((len(x), max(1, size.max())), -1, dtype=np.int64)
        shared[np.arange(shared.shape[1]) < size[:, None]] = early.flatten().to_numpy(zero_copy_only=False)
        count, classes, held, n = np.zeros(len(x), np.int64), _Classes(len(x)), [], 0

        def count_new() -> None:
            i, j = (np.concatenate(c) for c in zip(*held))
            for start in range(0, len(i), 200_000):
                a, b = i[start : start + 200_000], j[start : start + 200_000]
                new = np.ones(len(a), dtype=bool)
                for k in range(shared.shape[1]):
                    c = shared[a, k]
                    seen = np.nonzero((c >= 0) & new)[0]
                    if len(seen):
                        new[seen] = ~(shared[b[seen]] == c[seen, None]).any(axis=1)
                link(a[new], b[new])

        def link(a: np.ndarray, b: np.ndarray) -> None:
            classes.join(a, b)
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])

        begins = _begins(rows, key).tolist()
        for begin, end in zip(begins, [*begins[1:], len(x)]):
            bits = None
            for at in range(begin, end, STRIPE):
                near = narrow[at : min(at + STRIPE, end)] @ narrow[at:end].T
                i, j = np.divmod(np.flatnonzero(near >= cosine - off), end - at)
                keep, doubt = i < j, near[i, j] < cosine + off
                i, j = i + at, j + at
                keep &= (rep[i] != rep[j]) & (one[begin] | (part[i] != part[j]))
                asked = np.nonzero(keep & doubt)[0]
                keep[asked] = np.einsum("ij,ij->i", x[i[asked]], x[j[asked]]) >= cosine
                i, j = i[keep], j[keep]
                if len(i) > CROWDED:
                    bits = _bits(shared[begin:end]) if bits is None else bits
                    for start in range(0, len(i), GATHER):
                        a, b = i[start : start + GATHER], j[start : start + GATHER]
                        new = ~(bits[a - begin] & bits[b - begin]).any(axis=1)
                        link(a[new], b[new])
                elif len(i):
                    held, n = [*held, (i, j)], n + len(i)
                if n >= 200_000:
                    count_new()
                    held, n = [], 0
        if n:
            count_new()
        low = rep[classes.find(np.arange(len(x)))]
        touched = count > 0
        return pa.RecordBatch.from_arrays([pa.array(c[touched]) for c in (rep, count, low)], names=["rep", "links", "low"])

    return run


def _compared(planted: DataFrame, cosine: float, block: int, kind: str) -> Scratch:
    """(rep, low, links) of every leaf, a share of the leaves after the other."""
    leaves = planted.select("rep", "v", "weight", "leaves", F.octet_length("v").alias("d"), F.posexplode("leaves").alias("at", "leaf"))
    crowds = Scratch("rp-crowds", _counted(planted).filter(F.col("n") > block).select("d", "leaf", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    many, more = crowds.frame.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr("n * (blocks - 1)")), F.lit(0))).first()
    whole, rows, weight = _weight(planted)
    rounds, found = _rounds(weight * (1 + more / max(1, rows)), whole), Scratch("rp-found")
    columns, none = ["rep", "v", "weight", F.slice("leaves", F.lit(1), F.col("at")).alias("early"), "d", "leaf"], F.lit(0)
    for k in range(rounds):
        if not many:
            own = leaves.filter(_mine(k, rounds, "leaf")).select(*columns, none.alias("part"), none.alias("i"), none.alias("j"))
        else:
            # a leaf in blocks is dealt by its pairs of blocks, unless there are too many such leaves to tell before the rows are moved
            own = (leaves if many <= BROADCAST else leaves.filter(_mine(k, rounds, "leaf"))).join(_small(crowds.frame.drop("n"), many), ["d", "leaf"], "left")
            own = own.filter(F.col("blocks").isNotNull() | _mine(k, rounds, "leaf")).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            own = own.select(*columns, "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            own = own.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
            own = own.filter((F.col("blocks") == 1) | _mine(k, rounds, "leaf", "i", "j")) if many <= BROADCAST else own
        own = own.select(F.xxhash64("d", "leaf", "i", "j").alias("g"), "d", "leaf", "i", "j", "part", "rep", "weight", "early", "v")
        own = own.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(cosine, kind), "rep long, links long, low long")
        found.add(own.groupBy("rep", "low").agg(F.sum("links").alias("links")))  # else each of a round's tasks leaves a file of few rows
    crowds.drop()
    return found


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Null, empty and zero vectors and those with null or non-finite components link with nothing. Rows with
    equal vectors link with each other and have the same other links. Rows that repeat a vec_id count as
    vectors of their own, and link each by its own vector. Other columns aren't read. Vectors of different lengths link only among
    their own length. An empty table gives no rows.
    """
    with brief_shuffles(vectors.sparkSession):
        return _near_duplicates(vectors, vec_id, embedding, cosine, trees, leaf, spill, block)


def _near_duplicates(vectors: DataFrame, vec_id: str, embedding: str, cosine: float, trees: int, leaf: int, spill: float, block: int) -> DataFrame:
    # numbers stay as wide as they come: a vector moves once for each leaf that it is in
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    read = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v"))
    own = Scratch("rp-vectors", read.mapInArrow(_pack(kind), "vec_id long, v binary"))
    length, key = (F.octet_length("v") / int(kind[-1])).cast("int"), F.unhex(F.sha2("v", 256)).alias("key")
    # a class is numbered when it is written; its number is unique even where vec_ids repeat
    classes = Scratch("rp-classes", own.frame.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight")).withColumn("rep", F.monotonically_increasing_id()))
    # rows find their class again by a digest of the vector, so that vectors aren't moved for it
    ids = Scratch("rp-ids", own.frame.select("vec_id", key))
    own.drop()
    lengths = classes.frame.groupBy(length.alias("d")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > leaf)
    # a length of few vectors is a leaf; those of many get a forest each
    many = [r["d"] for r in lengths.select("d").collect()]
    few = classes.frame.filter(~length.isin(many)) if many else classes.frame
    planted = [(Scratch("rp-planted", few.withColumn("leaves", F.array(F.lit(0).cast("long"))), options=NUMBERS), 0, 1)]
    for d in many:
        at, n, size = _planted(classes.frame.filter(length == d), d, trees, leaf, spill, kind)
        planted.append((Scratch("rp-planted", at, options=NUMBERS), n, size))
    classes.drop()
    planted = [_again(at, n, size, leaf, spill, kind) for at, n, size in planted]
    whole = reduce(DataFrame.unionByName, (at.frame for at in planted))
    found = _compared(whole, cosine, max(2 * leaf, block), kind)
    links = found.frame.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.frame.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    whole = whole.select("rep", "first", "weight", key).join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    named = Scratch("rp-named", whole.join(least, "component").select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component_id"))
    for at in (found, *planted):
        at.drop()
    linked = ids.frame.filter("key IS NOT NULL").join(named.frame, "key").select("vec_id", F.col("n").alias("n_links"), "component_id")
    alone = ids.frame.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
