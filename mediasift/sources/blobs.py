"""Files under one folder by storage key: written, read, removed and looked for by executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.sources.views import small_batches


def clean_key(key: Column) -> Column:
    """A key without leading slashes and with `.` and `..` resolved; null for null, blank and empty ones and for those that leave the folder."""
    parts = F.filter(F.split(F.regexp_replace(key, r"^[\\\\/]+", ""), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("kept"), F.lit(True).alias("inside"))

    def step(s: Column, p: Column) -> Column:
        up = F.struct(F.slice(s["kept"], 1, F.greatest(F.size(s["kept"]) - 1, F.lit(0))).alias("kept"), (s["inside"] & (F.size(s["kept"]) > 0)).alias("inside"))
        return F.when(p == "..", up).otherwise(F.struct(F.array_append(s["kept"], p).alias("kept"), s["inside"].alias("inside")))

    done = F.aggregate(parts, start, step)
    return F.when((F.trim(key) != "") & done["inside"] & (F.size(done["kept"]) > 0), F.array_join(done["kept"], "/"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, that driver and executors share: under spark.checkpoint.dir, or for a local master, where that
    may be unset, under the machine's temporary folder."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(given or 'file://' + tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: what is used several times is computed once, and lineage ends there."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _each(folder: str, act):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        for pdf in batches:
            yield pd.DataFrame([(k, act(fs, f"{base}/{k}", row)) for k, row in zip(pdf["key"], pdf.to_dict("records"))], columns=["key", "done"])

    return run


def _write(fs, path: str, row: dict) -> bool:
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        out = fs.open_output_stream(part)
    except OSError:  # the first file of its folder
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        out = fs.open_output_stream(part)
    with out:
        out.write(row["content"])
    fs.move(part, path)
    return True


def _remove(fs, path: str, row: dict) -> bool:
    there = fs.get_file_info(path).is_file
    if there:
        fs.delete_file(path)
    return there


def store(blobs: DataFrame, folder: str) -> DataFrame:
    """Write blobs (key, content); (key, done) of each with a valid key. A file appears whole, by a rename, so a task may run again."""
    rows = small_batches(blobs).select(clean_key(F.col("key")).alias("key"), "content").filter("key IS NOT NULL AND content IS NOT NULL")
    return rows.mapInPandas(_each(folder, _write), "key string, done boolean")


def remove(keys: DataFrame, folder: str) -> DataFrame:
    """Delete the files of keys; `done` says whether there was one."""
    return keys.select(clean_key(F.col("key")).alias("key")).filter("key IS NOT NULL").distinct().mapInPandas(_each(folder, _remove), "key string, done boolean")


def exists(keys: DataFrame, folder: str) -> DataFrame:
    """(key, done) of distinct valid keys: whether there is a file."""
    return keys.select(clean_key(F.col("key")).alias("key")).filter("key IS NOT NULL").distinct().mapInPandas(_each(folder, lambda fs, path, row: fs.get_file_info(path).is_file), "key string, done boolean")


def load(spark: SparkSession, keys: DataFrame, folder: str, most_bytes: int = 8 << 20) -> DataFrame:
    """(key, content) of the files of keys, opened by executors by their names: a list of all files would be the driver's, and
    Spark's reader of files counts each as megabytes. Keys without a file give no row; a batch holds few files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem, FileType

        fs, base = FileSystem.from_uri(folder)
        for pdf in batches:
            names, held, size = [], [], 0
            for key, info in zip(pdf["key"], fs.get_file_info([f"{base}/{k}" for k in pdf["key"]])):
                if info.type != FileType.File:
                    continue
                with fs.open_input_stream(info.path) as file:
                    names.append(key)
                    held.append(file.read())
                size += len(held[-1])
                if size >= most_bytes:
                    yield pd.DataFrame({"key": names, "content": held})
                    names, held, size = [], [], 0
            yield pd.DataFrame({"key": names, "content": held}, dtype=object)

    return small_batches(keys).select(clean_key(F.col("key")).alias("key")).filter("key IS NOT NULL").distinct().mapInPandas(run, "key string, content binary")
