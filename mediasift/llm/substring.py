"""Removal of long repeated word passages by difference-cover anchors (operator 4).

A window is `window` = 13 consecutive words. Seven-word grams are hashed only where the word position
modulo 7 is in the difference cover {0, 1, 3}: for any two positions i and j some shift t < 7 brings both
onto the cover, so two occurrences of one 13-word window share the anchor that starts t words into it.

Documents are dealt into blocks by a hash of their id, anchors and windows into buckets by their hash.
Three passes read the blocks of documents (the exchange is reused):

1. each block sends the distinct anchor hashes to the buckets, which answer with one bit for each:
   whether the anchor is in two documents;
2. around shared anchors each block extends to the windows that hold them and sends the windows' hashes
   with the smallest doc_id that has each; the buckets answer with one bit: whether another block has a
   smaller doc_id;
3. each block removes the words of windows whose sequence starts in a smaller document.

A block sends one entry for each distinct anchor or window, however often it occurs, so a passage in a
third of all documents costs a bucket one entry a block. Messages are packed arrays; the answers rely on
the order of the distinct hashes in the block, which is a function of its documents, so a lost task can be run again. Anchor hashes
are cut to 32 bits inside a bucket (a false hit only offers a window to pass 2); windows count as equal
if 64 bits and the bucket, taken from a second hash, are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, small_batches, table

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
GRAM = WINDOW - PERIOD + 1
BLOCK_CHARS, BUCKET_CHARS = 3_000_000, 16_000_000
_RANDOM = np.random.default_rng(20240229)
_ANCHOR, _WIN_A, _WIN_B = (_RANDOM.integers(1, 1 << 63, size=WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
_NO_ID = (1 << 63) - 1


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()  # bytes.split: space and \t to \r


def _word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and how many each text has."""
    cut = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], type=pa.large_string()))
    coded = cut.values.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    code, ends = coded.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), dtype=np.uint64, count=len(distinct))
    real = np.fromiter((w != "" for w in distinct), dtype=bool, count=len(distinct))[code]  # white space at either end leaves an empty word
    before = np.concatenate(([0], np.cumsum(real)))
    return known[code[real]], np.diff(before[ends])


def _gram_hashes(words: np.ndarray, at: np.ndarray, size: int, factors: np.ndarray) -> np.ndarray:
    """Hashes of the `size` words from each place on."""
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        h += words[at + j] * factors[j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


class _Block:
    """The documents of one block in the order of their ids, with their distinct anchors and windows.

    Words are numbered through the block; `begin` and `end` are those of the document that a word is in.
    """

    def __init__(self, pdf: pd.DataFrame, buckets: int):
        ids = pdf["__id"].to_numpy(np.int64)
        # rows that repeat an id are one document for "smaller id": what counts is the id
        self.order = np.argsort(ids, kind="stable")
        self.buckets = np.uint64(buckets)
        self.words, self.count = _word_hashes(pdf["__text"].iloc[self.order].tolist())
        self.first = np.cumsum(self.count) - self.count
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.doc_ids = ids[self.order]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct (bucket, 32 bits), whether two ids have it; and where each anchor is found in them."""
        place = np.arange(len(self.words)) - self.first[self.row]
        self.spots = np.nonzero(np.isin(place % PERIOD, COVER) & (place + GRAM <= self.count[self.row]))[0]
        h = _gram_hashes(self.words, self.spots, GRAM, _ANCHOR)
        return _distinct(((h % self.buckets) << np.uint64(32)) | (h >> np.uint64(32)), self.doc_ids[self.row[self.spots]])

    def windows(self, shared: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows around shared anchors: bucket, hash, smallest id; and of each window start its window and its id."""
        hit = self.spots[shared[inverse]]
        row = self.row[hit]
        low, high = np.maximum(hit - PERIOD + 1, self.first[row]), np.minimum(hit, self.first[row] + self.count[row] - WINDOW)
        low, high = low[low <= high], high[low <= high]
        self.starts = np.nonzero(_covered(len(self.words), low, high + 1))[0]
        key, bucket = _gram_hashes(self.words, self.starts, WINDOW, _WIN_A), _gram_hashes(self.words, self.starts, WINDOW, _WIN_B) % self.buckets
        doc = self.doc_ids[self.row[self.starts]]
        order = np.lexsort((doc, key, bucket))
        k, b, d = key[order], bucket[order], doc[order]
        first = np.ones(len(k), dtype=bool)
        first[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        inverse = np.empty(len(k), dtype=np.int64)
        inverse[order] = np.cumsum(first) - 1
        return b[first], k[first], d[first], inverse, doc


def _covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each of n places whether it is in one of the ranges."""
    edge = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")  # ids ascend within a key
    k, d = key[order], doc[order]
    first = np.ones(len(k), dtype=bool)
    first[1:] = k[1:] != k[:-1]
    begin = np.nonzero(first)[0]
    end = np.append(begin[1:], len(k)) - 1
    inverse = np.empty(len(k), dtype=np.int64)
    inverse[order] = np.cumsum(first) - 1
    return k[first], d[begin] != d[end] if len(k) else np.empty(0, dtype=bool), inverse


def _messages(block: int, kind: str, bucket: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """One row for each bucket that the sorted entries go to; the columns are packed one after the other."""
    begin = np.nonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[0] if len(bucket) else []
    end = [*begin[1:], len(bucket)] if len(bucket) else []
    rows = [(int(bucket[i]), block, kind, j - i, b"".join(c[i:j].tobytes() for c in columns)) for i, j in zip(begin, end)]
    return pd.DataFrame(rows, columns=["bucket", "block", "kind", "n", "data"])


MESSAGE = "bucket long, block long, kind string, n long, data binary"


def _bits(answers: pd.DataFrame, kind: str, n: int) -> np.ndarray:
    own = answers[answers["kind"] == kind].sort_values("bucket")
    out = [np.unpackbits(np.frombuffer(d, dtype=np.uint8), count=k) for k, d in zip(own["n"], own["data"])]
    bits = np.concatenate([*out, np.empty(0, dtype=np.uint8)]).astype(bool)
    if len(bits) != n:
        raise RuntimeError(f"{len(bits)} answers for {n} entries: the block has changed between passes")
    return bits


def _ask_anchors(buckets: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, several, _ = _Block(pdf, buckets).anchors()
        return _messages(int(key[0]), "anchor", keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), several)

    return run


def _answer_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whether each anchor is in two documents: in two blocks, or twice in one."""
    parts = [(np.frombuffer(d, np.uint32, n), np.frombuffer(d, bool, n, 4 * n)) for n, d in zip(pdf["n"], pdf["data"])]
    value = np.concatenate([p[0] for p in parts])
    _, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[inverse[np.concatenate([p[1] for p in parts])]] = True
    return _answers(pdf, shared[inverse])


def _answers(pdf: pd.DataFrame, bits: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum(pdf["n"].to_numpy())
    return pdf.assign(data=[np.packbits(bits[e - n : e]).tobytes() for n, e in zip(pdf["n"], ends)])


def _ask_windows(buckets: int):
    def run(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=["bucket", "block", "kind", "n", "data"])
        block = _Block(docs, buckets)
        keys, _, inverse = block.anchors()
        bucket, win, first, _, _ = block.windows(_bits(answers, "anchor", len(keys)), inverse)
        return _messages(int(key[0]), "window", bucket, win, first)

    return run


def _answer_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whether each window is in a smaller document of another block."""
    parts = [(np.frombuffer(d, np.uint64, n), np.frombuffer(d, np.int64, n, 8 * n)) for n, d in zip(pdf["n"], pdf["data"])]
    win, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((doc, win))
    w, d = win[order], doc[order]
    begin = np.concatenate(([True], w[1:] != w[:-1]))
    least = d[np.nonzero(begin)[0]][np.cumsum(begin) - 1]
    smaller = np.empty(len(win), dtype=bool)
    smaller[order] = least < d
    return _answers(pdf, smaller)


def _remove(buckets: int, names: list[str]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(docs.select(["__id", "__text"]).to_pandas(), buckets)
        keys, _, inverse = block.anchors()
        bits = answers.to_pandas()
        bucket, _, first, seen_at, doc = block.windows(_bits(bits, "anchor", len(keys)), inverse)
        gone = block.starts[_bits(bits, "window", len(bucket))[seen_at] | (first[seen_at] < doc)]
        covered = _covered(len(block.words), gone, gone + WINDOW)
        removed = np.bincount(block.row[covered], minlength=docs.num_rows)
        kept, texts = [""] * docs.num_rows, docs["__text"]
        digest = kept.copy()
        for i, at, n, hit in zip(block.order.tolist(), block.first.tolist(), block.count.tolist(), removed.tolist()):
            words = _words(texts[i].as_py())
            if hit:
                words = [w for w, c in zip(words, covered[at : at + n].tolist()) if not c]
            joined = b" ".join(words)
            kept[i], digest[i] = joined.decode("utf-8"), hashlib.sha256(joined).hexdigest()
        counts = [pa.array(_unsorted(x, block.order)) for x in (block.count, removed)]
        own = docs.drop_columns(["__block", "__id", "__text"])
        return pa.Table.from_arrays([*own.columns, *counts, pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _unsorted(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(values), dtype=np.int64)
    out[order] = values
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), block_chars: int = BLOCK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(doc_id, *keep, n_words, n_removed, kept_sha256, kept_text) for each row of docs.

    A word goes if a 13-word window covers it whose sequence also starts in a document with a smaller
    doc_id. Null and empty texts have no words and keep ''. Rows that repeat a doc_id are parts of one
    document: none is smaller than the other. A null doc_id is larger than every other. Columns other than
    `keep` aren't read; those of `keep` may have any names but those of the results. An empty table gives no rows.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    blocks, buckets = (max(shuffle_partitions(spark), -(-chars // size)) for size in (block_chars, bucket_chars))
    names = ["doc_id", *keep]
    own = small_batches(docs).select(
        F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1))), F.lit(blocks)).alias("__block"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("__id"), F.col(text).alias("__text"),
        F.col(doc_id).alias("__keep"), *(F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)),
    )
    dealt = own.repartition(blocks, "__block")
    asked = dealt.groupBy("__block").applyInPandas(_ask_anchors(buckets), MESSAGE)
    anchors = asked.groupBy("bucket").applyInPandas(_answer_anchors, MESSAGE)
    windows = dealt.groupBy("__block").cogroup(anchors.groupBy("block")).applyInPandas(_ask_windows(buckets), MESSAGE).groupBy("bucket").applyInPandas(_answer_windows, MESSAGE)
    answers = anchors.unionByName(windows)
    kinds = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, own.schema[3:])])
    result = kinds.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")
    return dealt.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(_remove(buckets, names), result)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
hit AS (SELECT DISTINCT g.doc_id, p.i AS i FROM g JOIN f USING (win), unnest(range(g.i, g.i + 13)) AS p(i) WHERE f.first < g.doc_id),
words AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
agg AS (SELECT words.doc_id, count(*) FILTER (WHERE hit.i IS NOT NULL) AS n_removed,
  string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE hit.i IS NULL) AS kept
  FROM words LEFT JOIN hit ON hit.doc_id = words.doc_id AND hit.i = words.i GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN agg USING (doc_id)
"""
