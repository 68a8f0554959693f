"""Packing token sequences by exact-complement hashing and best fit (operator 10).

Texts are tokenised once and cut into pieces; what packs them only needs to know how many pieces there
are of each length. The driver plans on that histogram (at most 1,023 counts, whatever the input): for a
piece of length L the gap capacity - L is looked up among single lengths, sums of two and sums of three;
a combination that fills it exactly is used as often as the counts allow. What is left is packed best
fit, longest first, again as often as the counts allow. The plan is a list of patterns (lengths and how
often); each step uses up a length or a kind of gap, so the list stays a few thousand patterns long.

The pieces of a length are then ranked on the executors: each task has numbered its own, and a window
over the counts of the tasks, one row for each task and length, gives the base. Rank and plan give a piece its sequence
and place.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc, materialize, small_batches, table
from .tokens import default_path, encoder

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _cut(path: str, capacity: int, end_id: int):
    """(doc_id, text) -> pieces, numbered by task and length in the order in which the task meets them."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, encode = TaskContext.get().partitionId(), defaultdict(int), encoder(path).encode
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for doc_id, data in zip(ids, encode(texts)):
                data += end
                n, start, piece = len(data) // 4, 0, 0
                while start < n:
                    length = (n % capacity or capacity) if not start else capacity  # only the first may be shorter
                    rows.append((doc_id, piece, start, length, crc(data[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            if rows:
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


@dataclass
class Plan:
    """For each length its slots in the order of ranks: first rank, first sequence and offset of each."""

    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    sequences: int


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The shortest of the plans that fill gaps exactly by up to three, two or one pieces: small pieces that
    triples use up early are at times worth more to the best fit."""
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: p.sequences)


def _plan(counts: dict[int, int], capacity: int, most: int) -> Plan:
    """Patterns for pieces of 1 to `capacity` tokens, of which there are counts[length]."""
    left = {k: v for k, v in counts.items() if v > 0}
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        need = defaultdict(int)
        for x in pattern:
            need[x] += 1
        times = min(left[x] // k for x, k in need.items())
        patterns.append((pattern, times))
        for x, k in need.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]

    def enough(*pattern: int) -> bool:
        return all(left.get(x, 0) >= pattern.count(x) for x in pattern)

    for first in sorted(left, reverse=True):
        while left.get(first, 0):
            gap, found = capacity - first, None
            if gap == 0:
                found = (first,)
            elif enough(first, gap):
                found = (first, gap)
            elif most > 1:
                have = sorted((x for x in left if x < gap), reverse=True)
                pair = next((b for b in have if 2 * b >= gap and enough(first, b, gap - b)), None)
                if pair:
                    found = (first, pair, gap - pair)
                elif most > 2:
                    for b in have:
                        if 3 * b < gap:
                            break
                        rest = gap - b
                        c = next((c for c in have if c <= b and 2 * c >= rest and c < rest and enough(first, b, c, rest - c)), None)
                        if c:
                            found = (first, b, c, rest - c)
                            break
            if not found:
                break
            use(found)

    # best fit of the rest, longest first: open patterns by room; some of a kind take a piece each, the others stay
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    order: list[int] = []
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                full, rest = divmod(n, each)
                made, n = ([((length,) * each, full)] if full else []) + ([((length,) * rest, 1)] if rest else []), 0
            else:
                room = order[at]
                pattern, times = rooms[room].pop()
                if not rooms[room]:
                    order.pop(at)
                    del rooms[room]
                took = min(n, times)
                n -= took
                made = [(pattern + (length,), took)] + ([(pattern, times - took)] if times > took else [])
            for pattern, times in made:
                room = capacity - sum(pattern)
                if room not in rooms:
                    bisect.insort(order, room)
                rooms[room].append((pattern, times))
    patterns += [x for room in sorted(rooms) for x in rooms[room]]

    slots, ranks, base = defaultdict(list), defaultdict(int), 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            slots[x].append((ranks[x], base, offset))
            ranks[x] += times
            offset += x
        base += times
    return Plan({x: tuple(np.array(c, dtype=np.int64) for c in zip(*s)) for x, s in slots.items()}, base)


def _place(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for x in np.unique(length):
                own = length == x
                first, base, place = plan.slots[int(x)]
                slot = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = base[slot] + rank[own] - first[slot], place[slot]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; rows that repeat a doc_id, or have none, are packed like
    any other. Other columns aren't read. An empty table gives no rows.
    """
    own = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = materialize(own.mapInArrow(_cut(tokenizer or default_path(), capacity, end_id), PIECES), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    bases = by_task.select("task", "length", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(_place(plan_packing(counts, capacity)), PLACED)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
