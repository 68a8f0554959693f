"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a temporary folder
    serves a local master (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if given:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with its session set to at most `rows` rows in a batch for Python: batches hold whole texts on both sides, and
    ten thousand long ones, the usual bound, are hundreds of megabytes in each worker and as much in its executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A frame as Parquet in the shared folder, written in parts and read back, until it is dropped."""

    def __init__(self, name: str, *parts: DataFrame, options: dict[str, str] | None = None):
        self.name, self.path, self.options = name, None, options or {}
        for df in parts:
            self.add(df)

    def add(self, df: DataFrame) -> None:
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = self.path or scratch_path(self.spark, self.name)
        df.write.mode("append").options(**self.options).parquet(self.path)

    @property
    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it the files of a query's shuffles go when the query ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; for small frames in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(col: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus if isinstance(col, str) else F.crc32(col.cast("string").cast("binary")) % modulus


def sampled(key: str, share: Column | float) -> Column:
    """Whether a row belongs to a share of all rows, by a 63-bit hash of `key`; a share as small as 1e-15 still holds."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key)), 1) < F.lit(float(1 << 63)) * share


def bounded_sample(df: DataFrame, key: str, by: str, most: int, most_classes: int = 1000) -> DataFrame:
    """At most about `most` rows, chosen by a hash of `key`, an equal part of them from each value of `by`: a class with
    fewer rows gives them all. `weight` is how many rows of its class a row stands for. Of more than `most_classes`
    values the most frequent are learned."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(most_classes).collect()
    if not counts:
        return df.limit(0).withColumn("weight", F.lit(1.0))
    shares = shares_of({r[by]: r["n"] for r in counts}, most)
    wanted = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col(by)), F.lit(0.0))
    return df.filter((wanted >= 1.0) | sampled(key, wanted)).withColumn("weight", 1 / wanted)


def shares_of(counts: dict, most: int) -> dict:
    """Of each class the share of its rows that a sample of `most` rows takes; what small classes leave goes to the larger."""
    left, shares = most, {}
    for k, (name, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        took = min(n, left / (len(counts) - k))
        shares[name] = 1.0 if took == n else took / n
        left -= took
    return shares


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
