"""Scans that depend on order, of keys with very many rows, in parallel.

Rows are cut into ranges of neighbours. Each range is scanned as if nothing came before, and tells the state in which it
ends; a range that goes on with the key of the one before is scanned again from the state there, until no range
begins in another state than it was scanned from. By induction the first ranges are final, so the result is that of one
scan from the start. Scans forget: what they chose long ago hardly ever matters, so a round or two settle most ranges at
once. What is gathered on the driver is a state for each range.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediasift.sources.blobs import scratch_folder

#: Rows of a key that one task holds, and of a range.
MANY, RANGE = 100_000, 250_000
#: (state or None, rows of one key in order) -> (state, what comes out of them); a state is made of numbers and texts.
Step = Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]]


def by_size(df: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with `most` rows or fewer, and those of the others, None if there are none. Null keys are keys."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*(F.col(k).alias(f"__{k}") for k in keys))
    if large.isEmpty():
        return df, None
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def carried(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, size: int = RANGE) -> DataFrame:
    """(*keys, ..) with the columns of `schema`: what `step` makes of each key's rows in order, in ranges of about `size`
    rows of any number of keys. Null keys are keys; `step` doesn't see them."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // size))
    folder = scratch_folder(spark, "scan")
    own_keys = T.StructType([df.schema[k] for k in keys])
    keyed = df.withColumn("__key", F.to_json(F.struct(*keys))).drop(*keys)
    keyed.repartitionByRange(parts, "__key", *order).withColumn("__part", F.spark_partition_id()).write.parquet(f"{folder}/rows")
    rows = spark.read.schema(T.StructType([*keyed.schema.fields, T.StructField("__part", T.IntegerType())])).parquet(f"{folder}/rows")
    out = T.StructType([T.StructField("__key", T.StringType()), *T._parse_datatype_string(schema).fields, T.StructField("__part", T.IntegerType()), T.StructField("__end", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__key", *order], kind="stable", na_position="first")
        part, carry, found = int(pdf["__part"].iloc[0]), pdf["__carry"].iloc[0], []
        state, named, first = json.loads(carry) if isinstance(carry, str) else None, None, None
        for named, own in pdf.groupby("__key", sort=False):
            state, made = step(state if first is None else None, own)
            first = named if first is None else first
            found.append(made.assign(__key=named))
        # as objects: whole numbers beside the nulls of the last row stay whole
        made = pd.concat(found, ignore_index=True).astype(object).assign(__part=part)
        end = pd.DataFrame({"__part": [part], "__end": [json.dumps([first, named, state])]}, dtype=object)
        made = pd.concat([made, end], ignore_index=True).reindex(columns=[f.name for f in out]).astype(object)
        return made.where(made.notna(), None)

    carries, begun, ends, latest, made = None, {}, {}, {}, []
    while carries is None or carries:
        if carries is None:
            own = rows.withColumn("__carry", F.lit(None).cast("string"))
        else:
            begun |= carries
            table = spark.createDataFrame([(k, json.dumps(v)) for k, v in carries.items()], "__part int, __carry string")
            own = rows.join(F.broadcast(table), "__part")
        path = f"{folder}/{len(made)}"
        own.groupBy("__part").applyInPandas(run, out).write.parquet(path)
        made.append(spark.read.schema(out).parquet(path))
        for r in made[-1].filter("__end IS NOT NULL").select("__part", "__end").collect():
            ends[r["__part"]], latest[r["__part"]] = json.loads(r["__end"]), len(made) - 1
        carries, before = {}, None
        for part in sorted(ends):
            now = ends[before][2] if before is not None and ends[before][1] == ends[part][0] else None
            if now != begun.get(part):
                carries[part] = now
            before = part
    names = [f.name for f in T._parse_datatype_string(schema)]
    if not latest:
        return spark.createDataFrame([], T.StructType([*own_keys.fields, *T._parse_datatype_string(schema).fields]))
    last = F.broadcast(spark.createDataFrame(list(latest.items()), "__part int, __last int"))
    kept = None
    for k, frame in enumerate(made):
        own = frame.filter("__end IS NULL").join(last.filter(F.col("__last") == k), "__part").select(F.from_json("__key", own_keys).alias("__k"), *names).select("__k.*", *names)
        kept = own if kept is None else kept.unionByName(own)
    return kept
