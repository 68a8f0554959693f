"""The nearest other print of each medium among all of them, exactly.

At thresholds beyond 11 bits no key that two near prints must share selects anything: 16 of 64 bits
need 17 bands of 3 or 4 bits, and a fifth of the bits wrong leaves 4-bit bands, which random prints share
more often than not. So distinct prints are compared in blocks with numpy: the rows that move are the
prints once per block of the other side, the compute is the square of the number of distinct prints.
Copies of a print cost nothing more: a print is compared once, and of its media the first two stand for it.

Up to 11 bits, as the reference's own 10, there is a key: of four parts of 16 bits one differs by two bits at most, so a
print looks for the 137 values near each of its parts among the parts of the others (`near_hashes`). Of prints without
structure that is a comparison in 120, and all of it is an equi-join with a partial minimum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediasift.sources.blobs import written

BLOCK = 4096
#: (prints, prints of the others) -> matrix of costs, the lower the nearer.
Compare = Callable[[np.ndarray, np.ndarray], np.ndarray]


def hamming_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of 64-bit numbers, as bytes: of wider ones the search for the least takes several times as long."""
    return np.bitwise_count(np.asarray(a, dtype=np.int64).view(np.uint64)[:, None] ^ np.asarray(b, dtype=np.int64).view(np.uint64)[None, :])


def acoustic_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The negative of dedup.acoustic_similarity of arrays of 16-bit frames."""
    size = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
    frames = np.zeros((len(b), max(1, size.max(initial=0))), dtype=np.uint16)
    for row, own in zip(frames, b):
        row[: len(own)] = np.asarray(own, dtype=np.int64) & 65535
    even, longest = bool((size == size[0]).all()) if len(size) else True, frames.shape[1]
    by_place = np.ascontiguousarray(frames.T)  # the same frame of all others side by side
    out = np.zeros((len(a), len(b)))
    for best, own in zip(out, a):
        own, most = (np.asarray(own, dtype=np.int64) & 65535).astype(np.uint16), np.minimum(5, np.minimum(len(own), size) // 2)
        for s in range(-int(most.max(initial=0)), int(most.max(initial=0)) + 1) if len(own) else ():
            first, second = max(0, s), max(0, -s)
            width = min(len(own) - first, longest - second)
            if width < 1:
                continue
            wrong = np.zeros(len(b), dtype=np.uint16 if width < 4096 else np.int64)
            for k in range(width):
                bits = np.bitwise_count(by_place[second + k] ^ own[first + k])
                wrong += bits if even else bits * (size > second + k)
            if even:  # one width for all, and each shift is allowed
                np.minimum(best, wrong / (16.0 * width) - 1, out=best)
                continue
            n = np.minimum(len(own) - first, size - second)
            valid = (n > 0) & (abs(s) <= most)
            np.minimum(best, np.where(valid, wrong / (16.0 * np.maximum(n, 1)) - 1, 0.0), out=best)
    return out


def _block_pairs(compare: Compare, limit: float, rows: int):
    """(place in the probing block, cost, id): of each print the two best of the other block within the limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for probes, ids, others, i in zip(pdf["probes"], pdf["ids"], pdf["others"], pdf["i"]):
                ids = np.asarray(ids, dtype=np.int64)  # in order, so the first of equal costs is the earliest
                for at in range(0, len(probes), rows):
                    costs = compare(probes[at : at + rows], others)
                    best = costs.argmin(axis=1)
                    least = costs[np.arange(len(best)), best]
                    near = np.nonzero(least <= limit)[0]
                    if not len(near):
                        continue
                    yield pd.DataFrame({"i": i, "place": near + at, "cost": least[near].astype(np.float64), "other": ids[best[near]]})
                    # only what is near is searched again, without the rows of what was found
                    costs = np.where(ids[None, :] == ids[best[near]][:, None], np.inf, costs[near])
                    best = costs.argmin(axis=1)
                    least = costs[np.arange(len(best)), best]
                    more = np.nonzero(least <= limit)[0]
                    if len(more):
                        yield pd.DataFrame({"i": i, "place": near[more] + at, "cost": least[more], "other": ids[best[more]]})

    return run


def _by_print(prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with an id and a print; of each print the first id, and the second where there is one."""
    rows = prints.filter("media_id IS NOT NULL AND print IS NOT NULL").select("media_id", "print")
    first = rows.groupBy("print").agg(F.min("media_id").alias("first"))
    return rows, first, rows.join(first, "print").filter("media_id != first").groupBy("print").agg(F.min("media_id").alias("second"))


PARTS, WIDTH = 4, 16


def _parts(of: str) -> Column:
    """The four parts of a print, each with its number before it."""
    return F.array(*(F.expr(f"({k}L << {WIDTH}) | (shiftrightunsigned({of}, {WIDTH * k}) & {(1 << WIDTH) - 1}L)") for k in range(PARTS)))


def close_hashes(probes: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """(print, other, first, second, distance) of probes(print) and stored(print, first, second): other prints within
    `limit` bits; a pair as often as parts of it are near."""
    radius = limit // PARTS
    if not 0 <= radius <= 2:
        raise ValueError("parts of 16 bits serve limits of 0 to 11")
    masks = F.array(*(F.lit(m).cast("long") for m in range(1 << WIDTH) if m.bit_count() <= radius))
    asked = probes.select("print", F.explode(_parts("print")).alias("part")).select("print", F.explode(F.transform(masks, lambda m: F.col("part").bitwiseXOR(m))).alias("key"))
    kept = stored.select(F.col("print").alias("other"), "first", "second", F.explode(_parts("print")).alias("key"))
    # neighbours are 137 times the rows that Spark takes them for: never to be broadcast
    met = asked.hint("merge").join(kept.hint("merge"), "key").withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("other"))))
    return met.filter((F.col("distance") <= limit) & (F.col("print") != F.col("other"))).drop("key")


def near_hashes(prints: DataFrame, limit: int = 10) -> DataFrame:
    """What nearest_others gives for hashes of 64 bits, for limits up to 11: (media_id, duplicate_of, cost)."""
    rows, first, second = _by_print(written(prints.select("media_id", "print"), "prints"))
    copies = written(first.join(second, "print", "left"), "copies")
    first = copies.select("print", "first")
    met = close_hashes(first.select("print"), copies, limit)
    best = written(met.groupBy("print").agg(F.min(F.struct("distance", "first")).alias("m")), "nearest")
    # a medium of several prints may be its own nearest: those rows look again, for others
    whole = rows.join(copies, "print").join(best, "print", "left")
    own = whole.filter("first = media_id AND second IS NULL AND m.first = media_id").select("media_id", "print").distinct()
    again = close_hashes(own.select("print").distinct(), copies, limit).join(own, "print").select("media_id", "print", "distance", F.explode(F.array("first", "second")).alias("id")).filter("id IS NOT NULL AND id != media_id")
    others = again.groupBy("media_id", "print").agg(F.min(F.struct("distance", "id")).alias("a"))
    whole = whole.join(others, ["media_id", "print"], "left")
    zero = lambda id_: F.struct(F.lit(0).alias("distance"), F.col(id_).alias("id"))
    found = F.when(F.col("first") != F.col("media_id"), zero("first")).when(F.col("second").isNotNull(), zero("second")).when(F.col("m.first") != F.col("media_id"), F.struct(F.col("m.distance").alias("distance"), F.col("m.first").alias("id"))).otherwise(F.col("a"))
    return whole.withColumn("f", found).filter("f IS NOT NULL").select("media_id", F.col("f.id").alias("duplicate_of"), F.col("f.distance").cast("double").alias("cost"))


def nearest_others(prints: DataFrame, compare: Compare, limit: float, block: int = BLOCK) -> DataFrame:
    """(media_id, duplicate_of, cost) for each row (media_id, print) that has another medium within the
    limit: the one of least cost, the earliest of equals.

    A row is never a duplicate of a row with its own media_id. Rows without an id or a print are left out.
    """
    rows, first, second = _by_print(prints)
    number = max(1, -(-first.count() // block))
    place = F.pmod(F.xxhash64("print"), F.lit(number)).cast("int")
    probes = first.groupBy(place.alias("i")).agg(F.array_sort(F.collect_list("print")).alias("probes"))
    each = first.select("print", F.col("first").alias("id")).unionByName(second.select("print", F.col("second").alias("id")))
    others = each.groupBy(place.alias("j")).agg(F.array_sort(F.collect_list(F.struct("id", "print"))).alias("o")).select("j", F.col("o.id").alias("ids"), F.col("o.print").alias("others"))
    pairs = probes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).join(others, "j").repartition(min(number * number, 1024), "i", "j")
    found = pairs.select("i", "probes", "ids", "others").mapInPandas(_block_pairs(compare, limit, 256), "i int, place int, cost double, other long")
    # two others at most, whatever the number of blocks
    each = found.groupBy("i", "place", "other").agg(F.min("cost").alias("cost"))
    rank = F.row_number().over(W.partitionBy("i", "place").orderBy("cost", "other"))
    best = each.withColumn("rank", rank).filter("rank <= 2").groupBy("i", "place").agg(F.collect_list(F.struct("cost", "other")).alias("c"))
    named = probes.select("i", F.posexplode("probes").alias("place", "print")).join(best, ["i", "place"]).select("print", "c")
    nearest = F.expr("array_min(filter(c, x -> x.other != media_id))").alias("m")
    return rows.join(named, "print").select("media_id", nearest).filter("m IS NOT NULL").select("media_id", F.col("m.other").alias("duplicate_of"), F.col("m.cost").alias("cost"))
