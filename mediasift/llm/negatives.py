"""Hard negatives by a threshold join of anchors with all vectors (operator 12).

Components are whole numbers, so scores (inner products) are exact. Rows with the same vector and label are one class,
of which the smallest ids stand for all. The classes lie sorted by label; a batch of them is a block with an inverted
index of its own: dimensions in the order of their weight, and under each the rows that are listed there. A row isn't
listed under its last dimensions if what they can add, at most the product of the norms of the two vectors' rests,
reaches no anchor's threshold. Anchors, a bounded number at a time and broadcast, accumulate partial scores list by
list; pairs go when the norms of their rests can bring them neither up to the threshold nor down below the upper end
of the window. What is left is completed and compared exactly.

A window (an anchor, its positives' score, the least and the highest score) is full with `most` rows. A first pass over
a sixteenth of the rows, chosen by hash, gives thresholds: high ones first, the second best of the sample. Windows that
don't fill are searched again down to the sample's last best, which must fill them, or else to their least score. Within
a task a threshold rises to the last of the best so far. So every result is exact, and a task passes on no more than
`most` rows for each window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Numbers in the vectors of the anchors that are broadcast at a time (8 MB), anchors that a block meets at once, dimensions between two prunings.
AT_ONCE, SLICE, STEP = 1 << 20, 512, 16
SAMPLE = 16
_LAST = (1 << 63) - 1
FOUND = "anchor long, p long, score long, other long"


def quantised(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as whole doubles."""
    return F.transform(embedding.cast("array<double>"), lambda x: F.when(F.abs(x) < float(1 << 44), F.floor(x * factor).cast("double")).otherwise(x * factor))


def classes_of(rows: DataFrame, most: int) -> DataFrame:
    """(c, label, v, ids): the rows (vec_id, label, v) of one label and vector as one class with its `most` smallest ids."""
    placed = rows.withColumn("k", F.row_number().over(W.partitionBy("label", "v").orderBy("vec_id"))).filter(F.col("k") <= most)
    own = placed.groupBy("label", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("h", F.xxhash64("label", "v"))
    spread = own.repartitionByRange(shuffle_partitions(rows.sparkSession), "label", "h").sortWithinPartitions("label", "h")
    return materialize(spread.select(F.monotonically_increasing_id().alias("c"), "label", "v", "ids", (F.pmod("h", F.lit(SAMPLE)) == 0).alias("picked")), "negatives-classes")


def _matrix(v: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros at their ends."""
    size, values = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return values.reshape(len(v), width)
    out = np.zeros((len(v), width))
    out[np.arange(width) < size[:, None]] = values
    return out


def _rests(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norms of the vectors from each edge on."""
    square = np.square(x.astype(float))
    return np.sqrt(np.stack([square[:, e:].sum(axis=1) for e in edges], axis=1)) * (1 + 1e-9)


def candidates(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs with low[i] <= x[i] @ y[j] <= high[i], through an inverted index of y."""
    width = x.shape[1]
    weight = np.argsort(-np.square(y.astype(float)).sum(axis=0), kind="stable")
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(width, 1) >= 1 << 53:
        x, y = (np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape) for m in (x, y))
    x, y = x[:, weight], y[:, weight]
    edges = [*range(0, width, STEP), width]
    x_rest, y_rest = _rests(x, edges), _rests(y, edges)
    listed = (y_rest[:, :-1] * x_rest[:, :-1].max(axis=0, initial=0) >= low.min(initial=np.inf)).sum(axis=1)
    by = np.argsort(-listed, kind="stable")
    by = by[listed[by] > 0] if low.min(initial=np.inf) > 0 else by  # an empty index reaches no positive threshold
    y, y_rest, listed = y[by], y_rest[by], listed[by]
    score, step = np.zeros((len(x), len(y)), dtype=x.dtype), 0
    for step, (begin, end) in enumerate(zip(edges, edges[1:]), 1):
        m = int((listed >= step).sum())
        score[:, :m] += x[:, begin:end] @ y[:m, begin:end].T
        rest = x_rest[:, step, None] * y_rest[None, :m, step]
        if ((score[:, :m] + rest >= low[:, None]) & (score[:, :m] - rest <= high[:, None])).mean() < 1 / 16 if m else True:
            break
    stop = np.minimum(listed, step)
    rest = x_rest[:, stop] * y_rest[np.arange(len(y)), stop]
    i, j = np.nonzero((score + rest >= low[:, None]) & (score - rest <= high[:, None]))
    total = score[i, j]
    for at in np.unique(stop[j]):
        for own in np.array_split(np.nonzero(stop[j] == at)[0], 1 + (stop[j] == at).sum() // 100_000):
            total[own] += (x[i[own], edges[at] :] * y[j[own], edges[at] :]).sum(axis=1)
    keep = (total >= low[i]) & (total <= high[i])
    total = np.clip(total[keep], -_LAST, _LAST) if total.dtype == object else total[keep]
    return i[keep], by[j[keep]], total.astype(np.int64)


def _best(window: np.ndarray, score: np.ndarray, other: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `most` of each window by score, then id, ordered by window."""
    order = np.lexsort((other, -score, window))
    window, score, other = window[order], score[order], other[order]
    keep = np.arange(len(window)) - np.searchsorted(window, window) < most
    return window[keep], score[keep], other[keep]


class _Anchors:
    """Some anchors: their classes, labels and vectors; and windows on them, sorted by anchor: owner (a place among
    the anchors), p, low and high, the ends included."""

    def __init__(self, c: np.ndarray, label: np.ndarray, x: np.ndarray):
        self.c, self.label, self.x = c, label, x

    def windows(self, owner: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> "_Anchors":
        out, order = _Anchors(self.c, self.label, self.x), np.argsort(owner, kind="stable")
        out.owner, out.p, out.low, out.high = owner[order], p[order], low[order], high[order]
        return out

    def offer(self, batch: pa.RecordBatch, same: bool, most: int, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, score, id) of rows of a block that are in a window above `low`, those of a window's best classes."""
        y, labels = _matrix(batch.column("v"), self.x.shape[1]), batch.column("label").to_numpy()
        ids = batch.column("ids")
        size = np.diff(ids.offsets.to_numpy())
        first, ids = np.cumsum(size) - size, ids.flatten().to_numpy()
        alone = (labels == labels[0]).all()
        met = np.isin(self.label, labels) if same else self.label != labels[0] if alone else np.ones(len(self.label), dtype=bool)
        owners = np.unique(self.owner[met[self.owner]])
        for at in range(0, len(owners), SLICE):
            part = owners[at : at + SLICE]
            own = np.nonzero(np.isin(self.owner, part))[0]
            place = np.searchsorted(part, self.owner[own])
            least, top = np.full(len(part), np.inf), np.full(len(part), -np.inf)
            np.minimum.at(least, place, low[own])
            np.maximum.at(top, place, self.high[own])
            i, j, score = candidates(self.x[part], y, least, top)
            fits = (self.label[part][i] == labels[j]) == same
            i, j, score = i[fits], j[fits], score[fits]
            # each pair with each of its anchor's windows
            begin, count = np.searchsorted(place, np.arange(len(part))), np.bincount(place, minlength=len(part))
            again = np.repeat(np.arange(len(i)), count[i])
            window = own[begin[i[again]] + np.arange(len(again)) - np.repeat(np.cumsum(count[i]) - count[i], count[i])]
            fits = (score[again] >= low[window]) & (score[again] <= self.high[window])
            window, again = window[fits], again[fits]
            # the first rows of a window are in its first classes
            order = np.lexsort((ids[first[j[again]]], -score[again], window))
            window, again = window[order], again[order]
            keep = np.arange(len(window)) - np.searchsorted(window, window) < most
            window, again = window[keep], again[keep]
            n = size[j[again]]
            rows = np.repeat(np.arange(len(again)), n)
            yield window[rows], score[again][rows], ids[first[j[again]][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)]


def _search(anchors, same: bool, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = anchors.value
        low = own.low.copy()
        have = tuple(np.empty(0, dtype=np.int64) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            for found in own.offer(batch, same, most, low):
                have = _best(*(np.concatenate(x) for x in zip(have, found)), most)
            if len(have[0]):  # full windows: their last row is a threshold
                last = np.nonzero(np.append(have[0][1:] != have[0][:-1], True))[0]
                full = last[last - np.searchsorted(have[0], have[0][last]) == most - 1]
                low[have[0][full]] = np.maximum(low[have[0][full]], have[1][full])
        columns = (own.c[own.owner[have[0]]], own.p[have[0]], have[1], have[2])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["anchor", "p", "score", "other"])

    return run


def _pass(classes: DataFrame, anchors: _Anchors, same: bool, most: int) -> DataFrame:
    """(anchor, p, score, other, rank): the first `most` rows of each window."""
    shared = classes.sparkSession.sparkContext.broadcast(anchors)
    each = classes.select("label", "v", "ids").mapInArrow(_search(shared, same, most), FOUND)
    rank = F.row_number().over(W.partitionBy("anchor", "p").orderBy(F.desc("score"), "other"))
    return materialize(each.withColumn("rank", rank).filter(F.col("rank") <= most), "negatives-found")


def _filled(classes: DataFrame, anchors: _Anchors, same: bool, most: int) -> list[DataFrame]:
    """What is found in each window of the anchors, in one or two tables."""
    ends = _pass(classes.filter("picked"), anchors, same, most).groupBy("anchor", "p").agg(F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("high"), F.max(F.when(F.col("rank") == most, F.col("score"))).alias("sure")).toPandas()
    windows = pd.DataFrame({"anchor": anchors.c[anchors.owner], "p": anchors.p, "place": np.arange(len(anchors.owner))})
    merged = windows.merge(ends, on=["anchor", "p"], how="left").sort_values("place")
    first, sure = (np.fmax(anchors.low, merged[c].to_numpy(dtype=float)) for c in ("high", "sure"))
    found = _pass(classes, anchors.windows(anchors.owner, anchors.p, first, anchors.high), same, most)
    counts = found.groupBy("anchor", "p").agg(F.max("rank").alias("n")).toPandas()
    n = windows.merge(counts, on=["anchor", "p"], how="left").sort_values("place")["n"].fillna(0).to_numpy()
    open_ = np.nonzero((n < most) & (first > anchors.low))[0]
    if not len(open_):
        return [found]
    again = anchors.windows(anchors.owner[open_], anchors.p[open_], sure[open_], anchors.high[open_])
    lacking = found.sparkSession.createDataFrame(pd.DataFrame({"anchor": anchors.c[anchors.owner[open_]], "p": anchors.p[open_]}))
    return [found.join(F.broadcast(lacking), ["anchor", "p"], "left_anti"), _pass(classes, again, same, most)]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def hard_negatives(rows: DataFrame, anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(vec_id, label, v), v whole numbers
    as doubles: for each row that `anchor` (by vec_id; all rows if none) chooses and each of its `positives` best other rows
    of its label, the `negatives` best rows of other labels with low * positive <= 100 * score <= high * positive.

    Higher scores come first, of equal ones the smaller vec_id. Rows with a null in vec_id, label or v or a component
    that isn't finite take no part. Rows that repeat a vec_id are rows of their own, and an anchor leaves itself out
    once. Shorter vectors count as if zeros followed. Scores beyond 64 bits count as the largest such number. Other
    columns aren't read. An empty table gives no rows.
    """
    spark = rows.sparkSession
    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v")
    usable = usable.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND abs(x) < double('infinity'))")
    classes = classes_of(usable, max(positives + 1, negatives))
    chosen = usable if anchor is None else usable.filter(anchor)
    named = materialize(chosen.join(classes.select("c", "label", "v"), ["label", "v"]).select("vec_id", "c"), "negatives-anchors")
    asked = materialize(classes.join(named.select("c").distinct(), "c", "left_semi").select("c", "label", "v"), "negatives-asked")
    width = classes.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0
    blocks = max(1, -(-asked.count() * max(1, width) // AT_ONCE))
    near, far = [], []
    for k in range(blocks):  # a bounded number of anchors, against all classes
        own = asked.filter(F.pmod(F.xxhash64("c"), F.lit(blocks)) == k).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        v = own.column("v").combine_chunks()
        anchors = _Anchors(own.column("c").to_numpy(), own.column("label").to_numpy(), _matrix(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v, width))
        one = np.arange(len(anchors.c))
        found = _filled(classes, anchors.windows(one, np.zeros(len(one), np.int64), np.full(len(one), -np.inf), np.full(len(one), np.inf)), True, positives + 1)
        near += found
        levels = _union(found).select("anchor", "score").distinct().toPandas()  # positives + 1 at most for each anchor
        order = np.argsort(anchors.c)
        owner = order[np.searchsorted(anchors.c[order], levels["anchor"].to_numpy())]
        scores = levels["score"].tolist()
        least, top = (np.array(x, dtype=float) for x in ([-(-low * p // 100) for p in scores], [high * p // 100 for p in scores]))
        real = least <= top
        if real.any():
            far += _filled(classes, anchors.windows(owner[real], levels["score"].to_numpy()[real], least[real], top[real]), False, negatives)
    if not far:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    lists = materialize(_union(near).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("back"), "other"))).alias("best")), "negatives-positives")
    own = named.join(lists, F.col("c") == F.col("anchor"))
    at = F.array_position("best.other", F.col("vec_id")).cast("int")
    others = F.slice(F.when(at > 0, F.concat(F.slice("best", F.lit(1), at - 1), F.slice("best", at + 1, F.lit(positives + 1)))).otherwise(F.col("best")), 1, positives)
    pairs = own.select(F.col("vec_id").alias("anchor_id"), "c", F.explode(others).alias("x")).select("anchor_id", "c", F.col("x.other").alias("positive_id"), (-F.col("x.back")).alias("positive_score"))
    met = pairs.join(_union(far).withColumnRenamed("other", "negative_id"), (F.col("c") == F.col("anchor")) & (F.col("positive_score") == F.col("p")))
    return met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as an anchor; every seventh with the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("v"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = (
    "WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "s AS (SELECT a.vec_id AS anchor_id, a.label AS own, v.vec_id, v.label, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0), "
    f"p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE label = own QUALIFY k <= {POSITIVES}), "
    f"n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score QUALIFY rank <= {NEGATIVES}) "
    "SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n"
)
