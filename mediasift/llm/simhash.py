"""SimHash near-duplicates by deletion-variant signatures (operator 7).

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most two bits,
one of the segments differs in at most one, so the two share a variant of it in which that one bit is a
wildcard. Each distinct fingerprint is indexed under its 64 variants (32 wildcards in either segment);
fingerprints that meet under a variant are verified. A variant under which more than `most_verified`
fingerprints meet isn't compared pair by pair: its members go to an exact second index by whole
fingerprints with one bit flipped. Two of them are within two bits exactly if they share such a
neighbour (or one is the other's), so one edge from each member to the smallest under that neighbour
keeps every link with work linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches, table
from .components import components

SHINGLE, SEED, BITS = 3, 42, 2
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ONES = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes.split: space and \t to \r
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1, out=starts[1:])
    k = min(shingle, n)
    begin, end = starts[: n - k + 1].tolist(), (starts[k:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(begin, end)), dtype=np.uint64, count=n - k + 1)
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        set_bits += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    value = int(ONES[set_bits * 2 > len(h)].sum(dtype=np.uint64))
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _verify(most: int, bits: int):
    """Rows sorted by key: links of the small groups (a, b) and members of the large ones (a, null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held, large = None, [], False  # the group that the last batch ended in

        def pairs(fps: np.ndarray) -> pd.DataFrame | None:
            x = fps[:, None] ^ fps[None, :]
            i, j = np.nonzero(np.triu(np.bitwise_count(x.view(np.uint64)) <= bits, 1))
            return pd.DataFrame({"a": fps[i], "b": pd.array(fps[j], dtype="Int64")}) if len(i) else None

        def members(fps) -> pd.DataFrame:
            return pd.DataFrame({"a": np.asarray(fps, dtype=np.int64), "b": pd.array([None] * len(fps), dtype="Int64")})

        for pdf in batches:
            if not len(pdf):
                continue
            key, fp = pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64)
            bounds = np.concatenate(([0], np.nonzero(np.diff(key))[0] + 1, [len(key)]))
            sizes = np.diff(bounds)
            last = len(sizes) - 1
            for g in range(len(sizes)) if held_key is not None and held_key == key[0] else []:
                if g:  # only the first group may go on from the last batch
                    break
                part = fp[: bounds[1]]
                if large:
                    yield members(part)
                else:
                    held.append(part)
                    if sum(map(len, held)) > most:
                        yield members(np.concatenate(held))
                        held, large = [], True
            first = 1 if held_key is not None and held_key == key[0] else 0
            if not (first and last == 0):  # the held group is over
                if held and not large and sum(map(len, held)) > 1 and (found := pairs(np.concatenate(held))) is not None:
                    yield found
                for g in (np.nonzero(sizes[first:last] > 1)[0] + first).tolist():
                    part = fp[bounds[g] : bounds[g + 1]]
                    if len(part) > most:
                        yield members(part)
                    elif (found := pairs(part)) is not None:
                        yield found
                part = fp[bounds[last] :]
                held_key, large = key[-1], len(part) > most
                held = [] if large else [part]
                if large:
                    yield members(part)
        if held and not large and sum(map(len, held)) > 1 and (found := pairs(np.concatenate(held))) is not None:
            yield found

    return run


def fingerprint_links(fps: DataFrame, bits: int = BITS, most_verified: int = 256) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct `fp` within `bits` = 2 bits."""
    if bits != 2:
        raise ValueError("two segments with one wildcard find differences of up to two bits")
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(
        F.expr("(cast(i as bigint) << 32) | (shiftrightunsigned(fp, 32 * (i div 32)) & 4294967295L & ~shiftleft(1L, i % 32))").alias("key"), "fp"
    )
    dealt = variants.repartition("key").sortWithinPartitions("key")
    met = materialize(dealt.mapInPandas(_verify(most_verified, bits), "a long, b long"), "simhash-met")
    close = met.filter("b is not null")
    crowded = met.filter("b is null").select(F.col("a").alias("fp")).distinct()
    near = crowded.select("fp", F.explode(F.expr("array_append(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), fp)")).alias("near"))
    least = near.groupBy("near").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("near", "m")
    starred = near.join(least, "near").filter("fp != m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return close.select("a", "b").unionByName(starred)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, text_hash) for each row of docs; component_id is the smallest doc_id reachable over
    fingerprints within two bits, itself included; text_hash tells apart rows that repeat a doc_id.

    Null and empty texts have fingerprint zero and link with whatever is near zero. Rows that repeat a
    doc_id stay apart as rows. A null doc_id is never the smallest; a group without any id has a null
    component_id. Other columns aren't read, whatever their names; an empty table gives no rows.
    """
    ids = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), _fingerprints(F.col(text)).alias("fp"))
    marked = materialize(ids, "simhash-docs")
    reps = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(fingerprint_links(reps.select("fp")))
    root = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = root.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "text_hash")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that reach a smaller doc_id; a null doc_id is larger than every other. Of a group without
    any id all rows stay, as nothing says which is first; rows that repeat the smallest id of their group stay too.
    """
    found = near_duplicates(docs, doc_id, text).filter("component_id < doc_id OR doc_id IS NULL AND component_id IS NOT NULL")
    gone = found.select(F.col("doc_id").alias("__gone"), "text_hash").distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["__gone"]) & (F.xxhash64(docs[text]) == gone["text_hash"]), "left_anti")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
