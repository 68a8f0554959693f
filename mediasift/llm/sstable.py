r"""Token ids in sorted-string-table shards (operator 8).

A shard holds a range of documents in the order of their ids:

    data blocks   entries, about `block_bytes` together: the length of the prefix that the key shares with
                  the one before, the length of the rest, the rest, the number of token ids and the ids as
                  16- or 32-bit little-endian integers; the first entry of a block shares nothing
    index         for each block: last key, place, size, documents and ids before it in the shard
    Bloom filter  10 bits a key, 7 probes by double hashing
    footer        places and sizes of index and filter, documents, ids, width of an id, magic

Keys are document ids as 8 big-endian bytes with the sign bit flipped, so bytes sort as numbers do. A
lookup asks the filter, bisects the index, and reads and bisects one block.

The writer sorts by range and writes one file per task under a name of its own, then renames it, so that
a task that runs again replaces its file with an equal one. The manifest, a row per shard, gives the ids
before each shard.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc, materialize, scratch_path, shuffle_partitions, small_batches, table
from .tokens import default_path, encoder

END_ID, BLOCK_BYTES, SHARD_CHARS = 0, 64 << 10, 16_000_000
FOOTER = struct.Struct("<QQQQQQB7x8s")
INDEX = struct.Struct("<8sQIQQ")
MAGIC = b"TOKSST01"
MANIFEST = "shard int, path string, first_id long, n_docs long, n_tokens long, bytes long"


def _key(doc_id: int) -> bytes:
    return ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def _doc_id(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(7)]


class Writer:
    """Entries in ascending order of their keys (equal keys are allowed) into one binary sink."""

    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.at = self.docs = self.tokens = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._start()

    def _start(self) -> None:
        self.block, self.last, self.before = bytearray(), b"", (self.docs, self.tokens)

    def add(self, doc_id: int, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        key, n, shared = _key(doc_id), len(ids) // 4, 0
        if self.last:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        packed = memoryview(ids).cast("H")[::2].tobytes() if self.width == 2 else ids
        self.block += _varint(shared) + _varint(8 - shared) + key[shared:] + _varint(n) + packed
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs += 1
        self.tokens += n
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block)
            self.sink.write(data)
            self.index.append(INDEX.pack(self.last, self.at, len(data), *self.before))
            self.at += len(data)
            self._start()

    def close(self) -> int:
        self._flush()
        bits = max(64, 10 * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.sink.write(index)
        self.sink.write(bytes(bloom))
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.tokens, self.width, MAGIC))
        return self.at + len(index) + len(bloom) + FOOTER.size


class Reader:
    """One shard, given its bytes or a function (place, size) -> bytes and its size; only footer, index and filter are
    read at first, and of the blocks those that are asked for."""

    def __init__(self, data: bytes | Callable[[int, int], bytes], size: int | None = None):
        self.read = data if callable(data) else lambda at, n: data[at : at + n]
        size = len(data) if size is None else size
        index_at, index_size, bloom_at, bloom_size, self.docs, self.tokens, self.width, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        tail = self.read(index_at, bloom_at + bloom_size - index_at)
        self.bloom = tail[bloom_at - index_at :]
        self.index = [INDEX.unpack_from(tail, i) for i in range(0, index_size, INDEX.size)]
        self.last_keys = [x[0] for x in self.index]

    @classmethod
    def open(cls, uri: str) -> Reader:
        """A shard in a folder that pyarrow.fs knows, by ranged reads."""
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(uri)
        file = fs.open_input_file(path)
        return cls(lambda at, n: file.read_at(n, at), file.size())

    def block(self, i: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids before it in the shard, ids as 32-bit integers) of each entry of a block."""
        _, at, size, _, start = self.index[i]
        data, key, p = self.read(at, size), b"", 0
        while p < len(data):
            shared, p = _read_varint(data, p)
            rest, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + rest]
            n, p = _read_varint(data, p + rest)
            ids = data[p : p + self.width * n]
            p += self.width * n
            yield key, start, _widen(ids) if self.width == 2 else ids
            start += n

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        for i in range(len(self.index)):
            for key, start, ids in self.block(i):
                yield _doc_id(key), start, ids

    def get(self, doc_id: int) -> bytes | None:
        """The ids of one document by binary search; None if the shard doesn't hold it."""
        key = _key(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8)):
            return None
        i = bisect.bisect_left(self.last_keys, key)
        if i == len(self.index):
            return None
        return next((ids for k, _, ids in self.block(i) if k == key), None)  # an id that repeats: its first entry


def _widen(ids: bytes) -> bytes:
    out = bytearray(2 * len(ids))
    out[0::4], out[1::4] = ids[0::2], ids[1::2]
    return bytes(out)


def _write(folder: str, tokenizer: str, end_id: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        shard, own, end = TaskContext.get().partitionId(), encoder(tokenizer), int(end_id).to_bytes(4, "little")
        width = 2 if max(own.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        path, part = f"{base}/shard-{shard:07d}.sst", f"{base}/.{uuid.uuid4().hex}.tmp"
        sink = writer = first = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, data in zip(ids, own.encode(texts)):
                if writer is None:
                    sink = fs.open_output_stream(part)
                    writer, first = Writer(sink, width, block_bytes), doc_id
                writer.add(doc_id, data + end)
        if writer is not None:
            size = writer.close()
            sink.close()
            fs.move(part, path)
            row = (shard, f"{folder}/shard-{shard:07d}.sst", first, writer.docs, writer.tokens, size)
            kinds = (pa.int32(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, kinds)], names=["shard", "path", "first_id", "n_docs", "n_tokens", "bytes"])

    return run


def write_shards(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_chars: int = SHARD_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write every document with an id to shards in `folder`, a URI that all executors share, in ascending
    order of ids; return the manifest with `start`, the number of ids in the shards before.

    Null and empty texts are the end id alone. Rows that repeat an id are entries of their own, in any order among each other.
    Rows with a null id can't be looked up and aren't written. Other columns aren't read. An empty table
    gives no shards.
    """
    from pyarrow.fs import FileSystem

    spark = docs.sparkSession
    fs, base = FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    own = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    chars = own.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shards = max(shuffle_partitions(spark), -(-chars // shard_chars))
    # a second key, so that the rows of one id need not be one shard
    ordered = own.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    manifest = materialize(ordered.mapInArrow(_write(folder, tokenizer or default_path(), end_id, block_bytes), MANIFEST), "manifest")
    return _started(manifest)


def _started(manifest: DataFrame) -> DataFrame:
    """manifest with `start`: sums over groups of 1,024 shards first, so that no task orders more than a 1,024th of it or a group."""
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grouped = manifest.withColumn("__group", F.floor(F.col("shard") / 1024))
    bases = grouped.groupBy("__group").agg(F.sum("n_tokens").alias("n_tokens")).select("__group", before(W.orderBy("__group")).alias("__base"))
    return grouped.join(bases, "__group").withColumn("start", F.col("__base") + before(W.partitionBy("__group").orderBy("shard"))).drop("__group", "__base")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = [(path, doc_id, start, len(ids) // 4, crc(ids)) for doc_id, start, ids in Reader(content.as_py())]
            kinds = (pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=["name", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry in the files of a folder."""
    files = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "shard-*.sst").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    entries = files.select(name.alias("name"), "content").mapInArrow(_read, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    starts = manifest.select(name.alias("name"), "start")
    return entries.join(starts, "name").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-shards")
    manifest = write_shards(table(spark, sf_dir, "documents"), folder)
    return read_shards(manifest, folder)
