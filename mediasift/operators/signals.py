"""Signals of a medium: alignment of sound and picture, peaks, windows of embeddings, spectra, boxes.

A shifted signal is a `lag` over the medium's frames, so all lags of a search come from one sort and no join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediasift.functions import signals as S
from mediasift.functions.spectra import acceleration_of, cosine_weights, decibels, forensics_of, log_mel_of, mel_weights, pitch_of, print_of, weighted, yin_of
from mediasift.operators.registry import half_up_sql, query
from mediasift.operators.timeline import apart_spans, islands, merge_intervals
from mediasift.sources.views import FRAMES_SQL, frames, table

FPS = 5.0


def numbered(df: DataFrame) -> DataFrame:
    w = W.partitionBy("media_id")
    return df.withColumn("i", (F.row_number().over(w.orderBy("t", "event_id")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))


#: Picture (v), sound (a) and whether a face is seen, in turns of 15 frames: dubbed, muted, hidden, unlike, alike.
_TURN = "CAST(floor(i / 15) AS INT) % 5"
SIGNALS = {
    "v": f"CASE {_TURN} WHEN 0 THEN 0.05 + score / 20 WHEN 1 THEN 0.5 + score / 4 WHEN 2 THEN 0.1 WHEN 3 THEN 0.2 + CAST(event_id % 97 AS DOUBLE) / 150 ELSE 0.2 + score / 2 END",
    "a": f"CASE {_TURN} WHEN 0 THEN 0.4 + score / 4 WHEN 1 THEN 0.03 WHEN 2 THEN 0.5 WHEN 3 THEN 0.2 + CAST(event_id * 31 % 89 AS DOUBLE) / 140 ELSE 0.25 + score / 3 END",
    "face": f"{_TURN} <> 2 OR event_id % 7 = 0",
}
SIGNALS_SQL = (
    f"{FRAMES_SQL}, nu AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM frames), "
    f"sg AS (SELECT media_id, event_id, i, n, i / {FPS} AS t, CAST({SIGNALS['v']} AS DOUBLE) AS v, CAST({SIGNALS['a']} AS DOUBLE) AS a, {SIGNALS['face']} AS face FROM nu)"
)


def signals(spark: SparkSession, d: str) -> DataFrame:
    return numbered(frames(spark, d)).selectExpr("media_id", "event_id", "i", "n", f"i / {FPS}D AS t", *(f"{e if k == 'face' else f'CAST({e} AS DOUBLE)'} AS {k}" for k, e in SIGNALS.items()))


def best_lag(df: DataFrame, keys: list[str], most: int, allowed: Column, steady: float | None = None) -> DataFrame:
    """df(keys, i, v, a) -> keys, r, k: the lag of the sound with the highest correlation, the first of equals.

    Lags beyond `allowed`, of two pairs or fewer and (with `steady`) of slices that hardly vary don't count; r is -1 and k 0 if none does.
    """
    w = W.partitionBy(*keys).orderBy("i")
    moved = df.select(*keys, "v", allowed.alias("__most"), *(F.lag("a", k).over(w).alias(f"a{k + most}") if k >= 0 else F.lead("a", -k).over(w).alias(f"a{k + most}") for k in range(-most, most + 1)))
    found = []
    for k in range(-most, most + 1):
        own = F.col(f"a{k + most}")
        vary = F.lit(True) if steady is None else (F.stddev_pop(own) > steady) & (F.stddev_pop(F.when(own.isNotNull(), F.col("v"))) > steady)
        seen = F.when(own.isNotNull(), F.col("v"))
        r = F.round(F.try_divide(F.covar_pop("v", own), F.stddev_pop(seen) * F.stddev_pop(own)), 9)
        found.append(F.when((abs(k) <= F.max("__most")) & (F.count(own) > 2) & vary & (r > -1), F.struct(r.alias("r"), F.lit(-k).alias("back"))))
    best = moved.groupBy(*keys).agg(F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("best"))
    return best.select(*keys, F.coalesce("best.r", F.lit(-1.0)).alias("r"), F.coalesce(-F.col("best.back"), F.lit(0)).alias("k"))


def cross_correlation(df: DataFrame, fps: float, most_ms: float, app: bool = False) -> DataFrame:
    """(media_id, offset_ms, peak, confidence) of df(media_id, i, n, v, a): standardised signals multiplied at every lag.

    Zeros for fewer than five frames or a signal that hardly varies. With `app` products are averaged over all frames,
    lags go up to the next whole frame, and the confidence is the peak's height in deviations. Otherwise a bound below
    half a frame leaves nothing to search: the signals' correlation with a confidence of a half. Frames of which either
    signal is null don't count for a lag; a medium has one row, whatever its frames.
    """
    if not app and round(most_ms * fps / 1000) < 1:
        flat = (F.max("n") < 5) | (F.stddev_pop("a") < 1e-4) | (F.stddev_pop("v") < 1e-4)
        zeros = lambda x: F.when(F.coalesce(flat, F.lit(True)), 0.0).otherwise(x)
        return df.groupBy("media_id").agg(F.lit(0.0).alias("offset_ms"), zeros(F.try_divide(F.covar_pop("a", "v"), F.stddev_pop("a") * F.stddev_pop("v"))).alias("peak"), zeros(F.lit(0.5)).alias("confidence"))
    everything, frame_ms = W.partitionBy("media_id"), 1000 / fps
    most = -int(-most_ms / 1000 * fps // 1) if app else round(most_ms / frame_ms)
    zed = lambda c: F.try_divide(F.col(c) - F.avg(c).over(everything), F.stddev_pop(c).over(everything))
    flat = (F.col("n") < 5) | (F.stddev_pop("a").over(everything) < (1e-6 if app else 1e-4)) | (F.stddev_pop("v").over(everything) < (1e-6 if app else 1e-4))
    ready = df.select("media_id", "i", "n", flat.alias("flat"), F.greatest(F.max("a").over(everything), F.max("v").over(everything)).alias("top"), zed("v").alias("v"), zed("a").alias("a"))
    w = W.partitionBy("media_id").orderBy("i")
    moved = ready.select("media_id", "n", "flat", "top", *((F.col("v") * (F.lag("a", k).over(w) if k >= 0 else F.lead("a", -k).over(w))).alias(f"p{k + most}") for k in range(-most, most + 1)))
    limit = F.max("n") - 2 if app else F.floor(F.max("n") / 2)
    value = lambda c: F.sum(c) / F.max("n") if app else F.when(F.count(c) > 2, F.avg(c)).otherwise(0.0)
    points = [F.when(abs(k) <= limit, F.struct(F.round(value(f"p{k + most}"), 9).alias("r"), F.lit(-k).alias("back"))) for k in range(-most, most + 1)]
    curve = moved.groupBy("media_id").agg(F.max("flat").alias("flat"), F.max("top").alias("top"), F.filter(F.array(*points), lambda x: x.isNotNull()).alias("c"))
    best = curve.withColumn("peak", F.array_max("c")).withColumn("rs", F.expr("transform(c, x -> x.r)"))
    mean = S.total(F.col("rs")) / F.size("rs")
    best = best.withColumn("mean", mean)
    spread = F.sqrt(S.total(F.transform("rs", lambda x: x * x)) / F.size("rs") - F.col("mean") * F.col("mean"))
    r = F.col("peak.r")
    if app:
        sure = F.when(spread > 1e-6, S.clip((r - F.col("mean")) / (3 * spread))).otherwise(S.clip(r))
    else:
        sure = S.clip((F.greatest(F.lit(0.0), r - F.col("mean")) * 0.7 + F.greatest(F.lit(0.0), r) * 0.3) * S.clip(F.col("top"), 0.1))
    digits = (6, 6, 6) if app else (2, 4, 4)
    out = [F.when(F.col("flat"), 0.0).otherwise(F.round(x, k)).alias(n) for n, x, k in (("offset_ms", F.col("peak.back") * frame_ms, digits[0]), ("peak", r, digits[1]), ("confidence", sure, digits[2]))]
    return best.select("media_id", *out)


def drift(df: DataFrame, fps: float, most: int = 8) -> DataFrame:
    """(media_id, drift): how the best lag differs between the four quarters of df(media_id, i, n, v, a), 0 to 1.

    Quarters whose signals hardly vary don't count; with fewer than two, or four seconds, it is 0.
    """
    quartered = df.filter(F.col("n") >= int(fps * 4)).withColumn("quarter", F.floor(F.col("i") / F.floor(F.col("n") / 4))).filter("quarter < 4")
    lively = quartered.groupBy("media_id", "quarter").agg((F.stddev_pop("v") > 1e-4).alias("x"), (F.stddev_pop("a") > 1e-4).alias("y")).filter("x AND y").select("media_id", "quarter")
    lags = best_lag(quartered.join(lively, ["media_id", "quarter"]), ["media_id", "quarter"], most, F.lit(most))
    found = lags.groupBy("media_id").agg(F.count(F.lit(1)).alias("m"), F.stddev_pop(F.col("k") * (1000 / fps)).alias("s"))
    each = df.select("media_id").distinct().join(found, "media_id", "left")
    return each.select("media_id", F.when(F.col("m") >= 2, F.round(S.clip(F.col("s") / 200), 4)).otherwise(0.0).alias("drift"))


def placed_windows(df: DataFrame, size: Column, hop: Column) -> DataFrame:
    """df(media_id, i, n, ..) with a row for each whole window of `size` frames every `hop` frames that a frame is in."""
    sized = df.withColumn("size", size.cast("long")).withColumn("hop", hop.cast("long"))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("i") - F.col("size") + 1) / F.col("hop"))), F.least(F.floor(F.col("i") / F.col("hop")), F.floor((F.col("n") - F.col("size")) / F.col("hop")))
    return sized.withColumn("__a", first.cast("long")).withColumn("__b", last.cast("long")).filter("__a <= __b").withColumn("window", F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")


def mismatches(df: DataFrame, fps: float, window: float = 1.0, step: float = 0.5, most_lag: int = 10) -> DataFrame:
    """Windows of df(media_id, i, n, t, v, a, face) that show a mismatch: media_id, window, start, end, kind, severity, offset_ms.

    In this order: a hidden face while there is speech, speech with a closed mouth, a moving mouth without speech, and
    a lag of the sound. A medium shorter than a window has shorter ones; fewer than five frames give none.
    """
    everything = W.partitionBy("media_id")
    lasts = F.max("t").over(everything) - F.min("t").over(everything)
    short = lasts < window
    seconds, pace = F.when(short, F.greatest(F.lit(0.5), lasts)).otherwise(window), F.when(short, F.greatest(F.lit(0.5), lasts) / 2).otherwise(step)
    sized = df.filter("n >= 5").withColumn("__s", F.bround(seconds * fps)).withColumn("__h", F.greatest(F.lit(1), F.bround(pace * fps)))
    rows = placed_windows(sized, F.col("__s"), F.col("__h"))
    keys = ["media_id", "window"]
    means = rows.groupBy(*keys).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.avg(F.col("face").cast("int")).alias("face"), F.avg("v").alias("v"), F.avg("a").alias("a"), F.max("size").alias("size"))
    lags = best_lag(rows, keys, most_lag, F.least(F.floor(F.col("size") / 3), F.lit(most_lag)), 1e-4)
    each = means.join(lags, keys).withColumn("offset", F.round(F.col("k") * (1000 / fps), 1))
    seen, far = F.col("face") >= 0.7, F.abs("offset")
    kind = (
        F.when((F.col("face") < 0.3) & (F.col("a") > 0.25), "FACE_OCCLUSION").when((F.col("a") > 0.30) & (F.col("v") < 0.12) & seen, "DUBBING").when((F.col("v") > 0.30) & (F.col("a") < 0.08) & seen, "MUTED_SPEECH")
        .when((F.col("v") > 0.15) & (F.col("a") > 0.15) & seen & ((far >= 160) | (far >= 120) & (F.col("r") < 0.3)), "DESYNC")
    )
    out = each.withColumn("kind", kind).filter("kind IS NOT NULL")
    severity = F.when((F.col("kind") == "DUBBING") | (F.col("kind") == "DESYNC") & (far >= 250), "HIGH").otherwise("MEDIUM")
    return out.select("media_id", "window", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "kind", severity.alias("severity"), F.when(F.col("kind") == "DESYNC", F.col("offset")).otherwise(0.0).alias("offset_ms"))


def mismatches_app(df: DataFrame, fps: float, offset_ms: Column, window: float = 1.0, step: float = 0.5) -> DataFrame:
    """The other profile's segments: windows of one reason that follow each other within one and a half steps are one."""
    size, hop = max(5, round(window * fps)), max(2, round(step * fps))
    rows = placed_windows(df.filter("n >= 5"), F.lit(size), F.lit(hop))
    means = rows.groupBy("media_id", "window").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.avg(F.col("face").cast("int")).alias("face"), F.avg("v").alias("v"), F.avg("a").alias("a"), F.max(offset_ms).alias("offset_ms"))
    reason = F.when(F.col("face") < 0.25, "FACE_LOST").when((F.col("a") > 0.35) & (F.col("v") < 0.10), "DUBBING").when((F.col("v") > 0.40) & (F.col("a") < 0.08), "MUTED").when((F.abs("offset_ms") > 150) & (F.col("a") > 0.2) & (F.col("v") > 0.2), "OFFSET")
    flagged = means.withColumn("reason", reason).filter("reason IS NOT NULL").withColumn("end", F.round("end", 3))
    w = W.partitionBy("media_id").orderBy("window")
    new = F.coalesce((F.lag("reason").over(w) != F.col("reason")) | (F.abs(F.lag("end").over(w) - F.col("start")) > step * 1.5), F.lit(True))
    sure = F.expr("CASE reason WHEN 'FACE_LOST' THEN 0.65D WHEN 'DUBBING' THEN 0.85D WHEN 'MUTED' THEN 0.8D ELSE 0.75D END")
    grouped = islands(flagged.withColumn("new", new), ["media_id"], ["window"], F.col("new")).groupBy("media_id", "island", "reason")
    return grouped.agg(F.round(F.min("start"), 3).alias("start"), F.max("end").alias("end"), F.round(F.min_by("offset_ms", "window"), 2).alias("offset_ms")).withColumn("confidence", sure)


def _tallest(distance: int):
    """Of a run's peaks (i in order, score) the places of those that stay: none nearer than `distance` to a taller one, of
    equals the later."""

    @F.arrow_udf("array<int>")
    def kept(places: pa.Array, scores: pa.Array) -> pa.Array:
        out = []
        for i, score in zip(places.to_pylist(), scores.to_pylist()):
            gone, own = [False] * len(i), []
            for at in sorted(range(len(i)), key=lambda k: (-score[k], -i[k])):
                if gone[at]:
                    continue
                own.append(at)
                for step in (-1, 1):
                    k = at + step
                    while 0 <= k < len(i) and abs(i[k] - i[at]) < distance:
                        gone[k] = True
                        k += step
            out.append(own)
        return pa.array(out, pa.list_(pa.int32()))

    return kept


def peaks(df: DataFrame, height: float, distance: int) -> DataFrame:
    """(media_id, i, score): local maxima of df(media_id, i, score) of at least `height`, without those nearer than
    `distance` to a taller one. A flat top counts at its middle; ends don't count.

    Runs of peaks with gaps below `distance` are settled each on its own, so a task holds one run and not a medium.
    """
    w = W.partitionBy("media_id").orderBy("i")
    flat = islands(df.withColumn("new", F.coalesce(F.lag("score").over(w) != F.col("score"), F.lit(True))), ["media_id"], ["i"], F.col("new"))
    tops = flat.groupBy("media_id", "island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.max("score").alias("score"))
    x = W.partitionBy("media_id").orderBy("first")
    high = tops.withColumn("up", F.lag("score").over(x) < F.col("score")).withColumn("down", F.lead("score").over(x) < F.col("score")).filter((F.col("score") >= height) & F.col("up") & F.col("down"))
    found = high.select("media_id", F.floor((F.col("first") + F.col("last")) / 2).alias("i"), "score")
    runs = islands(found.withColumn("new", F.coalesce(F.col("i") - F.lag("i").over(w) >= distance, F.lit(True))), ["media_id"], ["i"], F.col("new"))
    each = runs.groupBy("media_id", "island").agg(F.array_sort(F.collect_list(F.struct("i", "score"))).alias("p")).select("media_id", "p")
    # many runs in a batch: a call of Python for each costs more than its peaks
    kept = each.select("media_id", "p", F.explode(_tallest(distance)(F.col("p.i"), F.col("p.score"))).alias("at"))
    return kept.select("media_id", F.expr("p[at]").alias("x")).select("media_id", "x.i", "x.score")


def onset_peaks(df: DataFrame, wait: int = 10, quantile: float = 0.96) -> DataFrame:
    """(media_id, i, score, reason): the other profile's splices of df(media_id, i, score): the highest of five places either side,
    well above the mean of seven, at least `wait` after the one before; scores are shares of the highest."""
    everything, near = W.partitionBy("media_id"), lambda b, a: W.partitionBy("media_id").orderBy("i").rowsBetween(b, a)
    levels = df.groupBy("media_id").agg(F.greatest(F.lit(1.5), F.percentile("score", F.lit(quantile)) + 0.5 * F.stddev_pop("score")).alias("least"), F.max("score").alias("top"))
    marked = df.withColumn("around", F.max("score").over(near(-5, 4))).withColumn("level", F.avg("score").over(near(-7, 6))).join(levels, "media_id")
    high = marked.filter((F.col("score") == F.col("around")) & (F.col("score") >= F.col("level") + 0.4 * F.col("least")))
    w = W.partitionBy("media_id").orderBy("i")
    runs = islands(high.withColumn("new", F.coalesce(F.col("i") - F.lag("i").over(w) > wait, F.lit(True))), ["media_id"], ["i"], F.col("new"))
    grouped = runs.groupBy("media_id", "island").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("score") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("score")))).alias("p"))
    kept = F.aggregate("p", F.expr("CAST(array() AS array<struct<i: bigint, score: double>>)"), lambda k, x: F.when((F.size(k) == 0) | (x["i"] - F.element_at(k, -1)["i"] > wait), F.array_append(k, x)).otherwise(k))
    out = grouped.select("media_id", F.explode(kept).alias("x")).select("media_id", "x.i", F.round(S.clip(F.col("x.score")), 4).alias("score")).filter("score >= 0.6")
    return out.withColumn("reason", F.when(F.col("score") >= 0.75, "SPECTRAL_FLUX_JUMP").otherwise("ACOUSTIC_ENERGY_TRANSITION"))


@query(
    "m5_cross_correlation",
    f"WITH {SIGNALS_SQL}, z AS (SELECT media_id, i, n, n < 5 OR stddev_pop(a) OVER w < 1e-4 OR stddev_pop(v) OVER w < 1e-4 AS flat, greatest(max(a) OVER w, max(v) OVER w) AS top, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v, (a - avg(a) OVER w) / stddev_pop(a) OVER w AS a FROM sg WINDOW w AS (PARTITION BY media_id)), "
    "l AS (SELECT x.media_id, k, round(CASE WHEN count(y.a) > 2 THEN avg(x.v * y.a) ELSE 0.0 END, 9) AS r FROM z x JOIN range(-3, 4) u(k) ON abs(k) <= x.n // 2 LEFT JOIN z y ON y.media_id = x.media_id AND y.i = x.i - k GROUP BY x.media_id, k), "
    "m AS (SELECT media_id, arg_max(k, (r, -k)) AS k, max(r) AS r, avg(r) AS mean FROM l GROUP BY media_id), q AS (SELECT media_id, bool_or(flat) AS flat, max(top) AS top FROM z GROUP BY media_id) "
    f"SELECT media_id, CASE WHEN flat THEN 0.0 ELSE round(-k * {1000 / FPS}, 2) END AS offset_ms, CASE WHEN flat THEN 0.0 ELSE round(r, 4) END AS peak, CASE WHEN flat THEN 0.0 ELSE round(greatest(0.0, least(1.0, (greatest(0.0, r - mean) * 0.7 + greatest(0.0, r) * 0.3) * greatest(0.1, least(1.0, top)))), 4) END AS confidence FROM q LEFT JOIN m USING (media_id)",
)
def m5(spark: SparkSession, d: str) -> DataFrame:
    return cross_correlation(signals(spark, d), FPS, 600)


@query(
    "m27_cross_correlation_app",
    f"WITH {SIGNALS_SQL}, z AS (SELECT media_id, i, n, n < 5 OR stddev_pop(a) OVER w < 1e-6 OR stddev_pop(v) OVER w < 1e-6 AS flat, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v, (a - avg(a) OVER w) / stddev_pop(a) OVER w AS a FROM sg WINDOW w AS (PARTITION BY media_id)), "
    "l AS (SELECT x.media_id, k, round(sum(x.v * y.a) / max(x.n), 9) AS r FROM z x JOIN range(-3, 4) u(k) ON abs(k) <= x.n - 2 LEFT JOIN z y ON y.media_id = x.media_id AND y.i = x.i - k GROUP BY x.media_id, k), "
    "m AS (SELECT media_id, arg_max(k, (r, -k)) AS k, max(r) AS r, avg(r) AS mean, stddev_pop(r) AS s FROM l GROUP BY media_id), q AS (SELECT media_id, bool_or(flat) AS flat FROM z GROUP BY media_id) "
    f"SELECT media_id, CASE WHEN flat THEN 0.0 ELSE round(-k * {1000 / FPS}, 6) END AS offset_ms, CASE WHEN flat THEN 0.0 ELSE round(r, 6) END AS peak, CASE WHEN flat THEN 0.0 ELSE round(greatest(0.0, least(1.0, CASE WHEN s > 1e-6 THEN (r - mean) / (3 * s) ELSE r END)), 6) END AS confidence FROM q LEFT JOIN m USING (media_id)",
)
def m27(spark: SparkSession, d: str) -> DataFrame:
    return cross_correlation(signals(spark, d), FPS, 500, app=True)


def _lag_sql(name: str, source: str, keys: str, most: str, bound: int, steady: bool) -> str:
    vary = " AND stddev_pop(y.a) > 1e-4 AND stddev_pop(CASE WHEN y.a IS NOT NULL THEN x.v END) > 1e-4" if steady else ""
    on = " AND ".join(f"y.{k} = x.{k}" for k in keys.split(", "))
    own = ", ".join(f"x.{k}" for k in keys.split(", "))
    return (
        f"{name}0 AS (SELECT {own}, k, CASE WHEN abs(k) <= max({most}) AND count(y.a) > 2{vary} THEN round(corr(x.v, y.a), 9) END AS r FROM {source} x CROSS JOIN range({-bound}, {bound + 1}) u(k) LEFT JOIN {source} y ON {on} AND y.i = x.i - k GROUP BY {own}, k), "
        f"{name}1 AS (SELECT {keys}, arg_max(k, (r, -k)) AS k, max(r) AS r FROM {name}0 WHERE r IS NOT NULL AND NOT isnan(r) AND r > -1 GROUP BY {keys}), {name} AS (SELECT {keys}, coalesce(k, 0) AS k, coalesce(r, -1.0) AS r FROM (SELECT DISTINCT {keys} FROM {source}) LEFT JOIN {name}1 USING ({keys}))"
    )


@query(
    "m6_local_lag",
    f"WITH {SIGNALS_SQL}, p AS (SELECT *, i // 20 AS part FROM sg), {_lag_sql('bl', 'p', 'media_id, part', '4', 4, True)} SELECT media_id, part, k, r FROM bl",
)
def m6(spark: SparkSession, d: str) -> DataFrame:
    """The best lag of every part of twenty frames."""
    parts = signals(spark, d).withColumn("part", F.floor(F.col("i") / 20))
    return best_lag(parts, ["media_id", "part"], 4, F.lit(4), 1e-4)


@query(
    "w11_drift",
    f"WITH {SIGNALS_SQL}, p AS (SELECT *, i // (n // 4) AS quarter FROM sg WHERE n >= 20 AND i // (n // 4) < 4), v AS (SELECT media_id, quarter FROM p GROUP BY media_id, quarter HAVING stddev_pop(v) > 1e-4 AND stddev_pop(a) > 1e-4), w AS (SELECT p.* FROM p JOIN v USING (media_id, quarter)), {_lag_sql('bl', 'w', 'media_id, quarter', '8', 8, False)} "
    f"SELECT s.media_id, CASE WHEN count(k) >= 2 THEN round(least(1.0, stddev_pop(k * {1000 / FPS}) / 200), 4) ELSE 0.0 END AS drift FROM (SELECT DISTINCT media_id FROM sg) s LEFT JOIN bl ON bl.media_id = s.media_id GROUP BY s.media_id",
)
def w11(spark: SparkSession, d: str) -> DataFrame:
    return drift(signals(spark, d), FPS)


_PLACED = "SELECT sg.*, k AS \"window\", {size} AS size FROM sg, unnest(range(0, CASE WHEN n >= {size} THEN CAST(floor((n - {size}) / {hop}) AS BIGINT) + 1 ELSE 0 END)) u(k) WHERE n >= 5 AND i >= k * {hop} AND i < k * {hop} + {size}"
MISMATCHES_SQL = (
    f"{SIGNALS_SQL}, pw AS ({_PLACED.format(size=5, hop=2)}), {_lag_sql('bl', 'pw', 'media_id, window', 'x.size // 3', 2, True).replace('media_id, window', 'media_id, \"window\"').replace('x.window', 'x.\"window\"').replace('y.window', 'y.\"window\"')}, "
    f"mw AS (SELECT media_id, \"window\", min(t) AS start, max(t) AS \"end\", avg(face::INT) AS f, avg(v) AS v, avg(a) AS a FROM pw GROUP BY media_id, \"window\"), ml AS (SELECT *, round(k * {1000 / FPS}, 1) AS o FROM mw JOIN bl USING (media_id, \"window\")), "
    "mk AS (SELECT *, CASE WHEN f < 0.3 AND a > 0.25 THEN 'FACE_OCCLUSION' WHEN a > 0.3 AND v < 0.12 AND f >= 0.7 THEN 'DUBBING' WHEN v > 0.3 AND a < 0.08 AND f >= 0.7 THEN 'MUTED_SPEECH' WHEN v > 0.15 AND a > 0.15 AND f >= 0.7 AND (abs(o) >= 160 OR abs(o) >= 120 AND r < 0.3) THEN 'DESYNC' END AS kind FROM ml), "
    "mm AS (SELECT media_id, \"window\", round(start, 3) AS start, round(\"end\", 3) AS \"end\", kind, CASE WHEN kind = 'DUBBING' OR kind = 'DESYNC' AND abs(o) >= 250 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN kind = 'DESYNC' THEN o ELSE 0.0 END AS offset_ms FROM mk WHERE kind IS NOT NULL)"
)


@query(
    "w4_mismatches",
    f"WITH {MISMATCHES_SQL}, g AS (SELECT *, coalesce(start > max(\"end\") OVER (PARTITION BY media_id, kind ORDER BY start, \"window\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.25, true) AS fresh FROM mm), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY media_id, kind ORDER BY start, \"window\" ROWS UNBOUNDED PRECEDING) AS island FROM g) "
    f"SELECT media_id, kind, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n, CASE WHEN bool_or(severity = 'HIGH') THEN 'HIGH' ELSE arg_min(severity, (start, \"window\")) END AS severity, list_reduce(list(CAST(offset_ms AS DOUBLE) ORDER BY start, \"window\"), lambda a, b: {half_up_sql('(a + b) / 2', 1)}) AS offset_ms FROM s GROUP BY media_id, kind, island",
)
def w4(spark: SparkSession, d: str) -> DataFrame:
    """Mismatching windows of a second, those of one kind within a quarter of a second merged."""
    return merge_intervals(mismatches(signals(spark, d), FPS, most_lag=2).withColumnRenamed("window", "seq"), 0.25)


@query(
    "w4v_mismatches_app",
    f"WITH {SIGNALS_SQL}, pw AS ({_PLACED.format(size=5, hop=2)}), mw AS (SELECT media_id, \"window\", min(t) AS start, round(max(t), 3) AS \"end\", avg(face::INT) AS f, avg(v) AS v, avg(a) AS a, max(CAST(media_id % 5 * 100 - 200 AS DOUBLE)) AS o FROM pw GROUP BY media_id, \"window\"), "
    "mk AS (SELECT *, CASE WHEN f < 0.25 THEN 'FACE_LOST' WHEN a > 0.35 AND v < 0.1 THEN 'DUBBING' WHEN v > 0.4 AND a < 0.08 THEN 'MUTED' WHEN abs(o) > 150 AND a > 0.2 AND v > 0.2 THEN 'OFFSET' END AS reason FROM mw), "
    "g AS (SELECT *, coalesce(lag(reason) OVER w <> reason OR abs(lag(\"end\") OVER w - start) > 0.75, true) AS fresh FROM mk WHERE reason IS NOT NULL WINDOW w AS (PARTITION BY media_id ORDER BY \"window\")), s AS (SELECT *, CAST(sum(fresh::INT) OVER (PARTITION BY media_id ORDER BY \"window\" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g) "
    "SELECT media_id, island, reason, round(min(start), 3) AS start, max(\"end\") AS \"end\", max(o) AS offset_ms, CASE reason WHEN 'FACE_LOST' THEN 0.65 WHEN 'DUBBING' THEN 0.85 WHEN 'MUTED' THEN 0.8 ELSE 0.75 END AS confidence FROM s GROUP BY media_id, island, reason",
)
def w4v(spark: SparkSession, d: str) -> DataFrame:
    return mismatches_app(signals(spark, d), FPS, (F.col("media_id") % 5 * 100 - 200).cast("double"))


@query("w7_peaks")
def w7(spark: SparkSession, d: str) -> DataFrame:
    """Suppression goes by height, which SQL can't fold; a test holds it against a loop."""
    return peaks(numbered(frames(spark, d)).select("media_id", "i", "score"), 0.3, 4)


@query("w7v_onset_peaks")
def w7v(spark: SparkSession, d: str) -> DataFrame:
    return onset_peaks(numbered(frames(spark, d)).select("media_id", "i", (F.col("score") * 10).alias("score")))


@query(
    "w15_clip_frames",
    f"WITH {FRAMES_SQL}, nu AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM frames), "
    "c AS (SELECT media_id, k, CASE WHEN n <= 16 THEN least(k, n - 1) ELSE CAST(floor(k * ((n - 1) / 15.0)) AS BIGINT) END AS i FROM (SELECT DISTINCT media_id, n FROM nu), range(16) u(k)) SELECT c.media_id, c.k AS place, nu.event_id FROM c JOIN nu ON nu.media_id = c.media_id AND nu.i = c.i",
)
def w15(spark: SparkSession, d: str) -> DataFrame:
    return clip_frames(numbered(frames(spark, d)), 16).select("media_id", "place", "event_id")


def clip_frames(df: DataFrame, length: int) -> DataFrame:
    """`length` frames of each medium of df(media_id, i, n, ..): the last repeated if there are fewer, evenly spread ones if
    more. Each frame names its own places, so nothing is joined."""
    few, step = F.col("n") <= length, (F.col("n") - 1) / float(length - 1)
    low = F.greatest(F.lit(0), F.floor(F.col("i") / step) - 1)
    near = F.filter(F.sequence(low.cast("long"), F.least(F.lit(length - 1), F.ceil((F.col("i") + 1) / step) + 1).cast("long")), lambda k: F.floor(k * step) == F.col("i"))
    last = F.when(F.col("i") == F.col("n") - 1, F.sequence(F.col("i"), F.lit(length - 1).cast("long"))).otherwise(F.array("i"))
    return df.withColumn("place", F.explode(F.when(few, last).otherwise(near)))


#: Sixty-four vectors are a medium: the picture of a frame, and the sound of two columns.
VECTORS_SQL = "ve AS (SELECT vec_id // 64 AS media_id, vec_id % 64 AS f, count(*) OVER (PARTITION BY vec_id // 64) AS n, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    media = F.floor(F.col("vec_id") / 64)
    return table(spark, d, "embeddings").select(media.alias("media_id"), (F.col("vec_id") % 64).alias("f"), F.count(F.lit(1)).over(W.partitionBy(media)).alias("n"), F.col("embedding").cast("array<double>").alias("e"))


def shift_distances(seen: DataFrame, heard: DataFrame, most: int) -> DataFrame:
    """(media_id, shift, distance): mean distance of pictures (media_id, f, n, e) at every other frame and the sound
    (media_id, start, columns, e) around them, moved by up to `most` frames; 1.414 with fewer than two."""
    at = seen.filter("f % 2 = 0 AND f <= n - 5").withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    at = at.withColumn("start", (F.bround((F.col("f") + 2 + F.col("shift")) * 2.0) - 10).cast("long"))
    met = at.join(heard.select("media_id", "start", F.col("e").alias("other")), ["media_id", "start"]).filter("start >= 0 AND start + 20 <= 2 * n")
    found = met.groupBy("media_id", "shift").agg(F.count(F.lit(1)).alias("m"), F.avg(S.distance(F.col("e"), F.col("other"))).alias("mean"))
    every = seen.select("media_id").distinct().withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    return every.join(found, ["media_id", "shift"], "left").select("media_id", "shift", F.when(F.col("m") >= 2, F.col("mean")).otherwise(1.414).alias("distance"))


SHIFTS_SQL = (
    f"{VECTORS_SQL}, mt AS (SELECT x.media_id, s AS shift, list_distance(x.e, y.e) AS dist FROM ve x, range(-4, 5) u(s), ve y WHERE x.f % 2 = 0 AND x.f <= x.n - 5 AND y.media_id = x.media_id AND 2 * y.f = 2 * (x.f + 2 + s) - 10 AND 2 * y.f + 20 <= 2 * x.n), "
    "sd AS (SELECT m.media_id, s AS shift, CASE WHEN count(dist) >= 2 THEN avg(dist) ELSE 1.414 END AS distance FROM (SELECT DISTINCT media_id FROM ve) m CROSS JOIN range(-4, 5) u(s) LEFT JOIN mt ON mt.media_id = m.media_id AND mt.shift = s GROUP BY m.media_id, s)"
)


def _shifts(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return shift_distances(v, v.select("media_id", (2 * F.col("f")).alias("start"), "e"), 4)


@query("w16_shift_distances", f"WITH {SHIFTS_SQL} SELECT media_id, shift, round(distance, 9) AS distance FROM sd")
def w16(spark: SparkSession, d: str) -> DataFrame:
    return _shifts(spark, d).withColumn("distance", F.round("distance", 9))


@query("m7_embedding_offset", f"WITH {SHIFTS_SQL} SELECT media_id, arg_min(shift, (round(distance, 9), shift)) AS shift, round(min(distance), 4) AS least, round(greatest(0.0, least(1.0, 2.5 * (avg(distance) - min(distance)))), 4) AS confidence FROM sd GROUP BY media_id")
def m7(spark: SparkSession, d: str) -> DataFrame:
    found = _shifts(spark, d).groupBy("media_id").agg(F.min_by("shift", F.struct(F.round("distance", 9), "shift")).alias("shift"), F.min("distance").alias("m"), F.avg("distance").alias("mean"))
    return found.select("media_id", "shift", F.round("m", 4).alias("least"), F.round(S.clip(2.5 * (F.col("mean") - F.col("m"))), 4).alias("confidence"))


@query("m8_unit_vectors", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 1e-12))), 9) AS total FROM embeddings")
def m8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(S.total(S.unit(F.col("embedding").cast("array<double>"))), 9).alias("total"))


_SAMPLES = "(e[{i}] + 1) * 127 * CASE WHEN vec_id % 6 = 0 THEN 0.001 ELSE 1 END"


@query(
    "m3_gradient_hash",
    "WITH s AS (SELECT vec_id, list_transform(range(0, 72), lambda i: CAST(floor((CAST(embedding[i % 64 + 1] AS DOUBLE) + 1) * 127 * CASE WHEN vec_id % 6 = 0 THEN 0.001 ELSE 1 END) AS BIGINT)) AS s FROM embeddings) "
    "SELECT vec_id, CASE WHEN list_max(s) - list_min(s) <= 2 THEN repeat(lpad(bin(CAST(floor(list_sum(s) / 72) AS BIGINT) & 255), 8, '0'), 8) ELSE array_to_string(list_transform(range(63, -1, -1), lambda b: CASE WHEN s[(b // 8) * 9 + b % 8 + 1] > s[(b // 8) * 9 + b % 8 + 2] THEN '1' ELSE '0' END), '') END AS bits FROM s",
)
def m3(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of 72 samples from the vectors, every sixth of them nearly flat."""
    e = F.col("embedding").cast("array<double>")
    scale = F.when(F.col("vec_id") % 6 == 0, 0.001).otherwise(1.0)
    samples = F.transform(F.zip_with(F.concat(e, F.slice(e, 1, 8)), F.array_repeat(scale, 72), lambda x, k: (x + 1) * 127 * k), lambda x: F.floor(x))
    return table(spark, d, "embeddings").select("vec_id", samples.alias("s")).select("vec_id", F.lpad(F.bin(S.gradient_hash(F.col("s"))), 64, "0").alias("bits"))


@query(
    "m10_spectral_features",
    "WITH s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS m, CAST(embedding AS DOUBLE[]) AS w FROM embeddings), u AS (SELECT vec_id, m, w, list_sum(m) AS total, list_sum(list_transform(range(0, 64), lambda i: i * (8000.0 / 63) * m[i + 1])) AS first, list_sum(list_transform(range(0, 64), lambda i: i * (8000.0 / 63) * i * (8000.0 / 63) * m[i + 1])) AS second FROM s), "
    "v AS (SELECT *, first / (total + 1e-10) AS c FROM u) SELECT vec_id, round(c, 4) AS centroid, round(sqrt(greatest(0, (second - 2 * c * first + c * c * total) / (total + 1e-10))), 4) AS bandwidth, "
    "round(CASE WHEN total <= 1e-9 THEN 0.0 ELSE least(63, len(list_filter(range(1, 65), lambda i: list_sum(m[1:i]) < 0.85 * total))) * (8000.0 / 63) END, 4) AS rolloff, round(len(list_filter(range(1, 64), lambda i: (w[i] < 0) <> (w[i + 1] < 0))) / 63.0, 9) AS crossings, round(sqrt(list_sum(list_transform(w, lambda x: x * x)) / 64 + 1e-10), 9) AS loudness FROM v",
)
def m10(spark: SparkSession, d: str) -> DataFrame:
    """A vector's sizes as a spectrum of 64 bins up to 8 kHz, and its values as a wave."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w")).withColumn("m", F.transform("w", lambda x: F.abs(x))).withColumn("c", S.centroid(F.col("m"), 64, 8000.0))
    return e.select("vec_id", F.round("c", 4).alias("centroid"), F.round(S.bandwidth(F.col("m"), F.col("c"), 64, 8000.0), 4).alias("bandwidth"), F.round(S.rolloff(F.col("m"), 64, 8000.0), 4).alias("rolloff"), F.round(S.crossings(F.col("w")), 9).alias("crossings"), F.round(S.loudness(F.col("w")), 9).alias("loudness"))


@query("m10_spectral_flux", f"WITH {VECTORS_SQL}, u AS (SELECT media_id, f, list_transform(e, lambda x: abs(x) / (sqrt(list_sum(list_transform(e, lambda y: y * y))) + 1e-10)) AS s FROM ve), p AS (SELECT *, lag(s) OVER (PARTITION BY media_id ORDER BY f) AS b FROM u) SELECT media_id, f, round(CASE WHEN b IS NULL THEN 0.0 ELSE list_distance(s, b) END, 9) AS flux FROM p")
def m10_flux(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("k", S.norm(F.col("e")) + 1e-10)
    v = v.select("media_id", "f", F.zip_with("e", F.array_repeat("k", F.size("e")), lambda x, k: F.abs(x) / k).alias("s"))
    before = F.lag("s").over(W.partitionBy("media_id").orderBy("f"))
    return v.withColumn("b", before).select("media_id", "f", F.round(F.coalesce(S.distance(F.col("s"), F.col("b")), F.lit(0.0)), 9).alias("flux"))


@query("m12_spectral_anomaly", f"WITH {FRAMES_SQL} SELECT event_id, round(greatest(0.0, least(1.0, 0.6 * score + 0.4 * CASE WHEN event_id % 211 / 200.0 < 0.005 THEN 0.4 WHEN event_id % 211 / 200.0 > 0.8 THEN 0.5 ELSE 0.1 END)), 9) AS anomaly FROM frames")
def m12(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("event_id", F.round(S.spectral_anomaly(F.col("score"), F.col("event_id") % 211 / 200), 9).alias("anomaly"))


@query("m13_silence", "WITH s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x) * CASE WHEN vec_id % 3 = 0 THEN 1e-4 ELSE 1 END) AS m FROM embeddings) SELECT vec_id, sqrt(list_sum(list_transform(m, lambda x: x * x)) / len(m)) < 1e-4 OR list_max(m) < 1e-4 AS silent FROM s")
def m13(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    scale = F.when(F.col("vec_id") % 3 == 0, 1e-4).otherwise(1.0)
    return table(spark, d, "embeddings").select("vec_id", S.silent(F.zip_with(e, F.array_repeat(scale, F.size(e)), lambda x, k: x * k)).alias("silent"))


@query("m24_activity_envelope", f"WITH {FRAMES_SQL}, x AS (SELECT *, CAST(event_id % 61 AS DOUBLE) AS flux FROM frames), e AS (SELECT *, 0.7 * least(1.0, score / (CASE WHEN max(score) OVER w > 1e-6 THEN max(score) OVER w ELSE 1.0 END)) + 0.3 * least(1.0, flux / (CASE WHEN max(flux) OVER w > 1e-6 THEN max(flux) OVER w ELSE 1.0 END)) AS raw, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY media_id)) SELECT event_id, round(least(1.0, CASE WHEN n >= 5 THEN sum(raw) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE raw END), 9) AS envelope FROM e")
def m24(spark: SparkSession, d: str) -> DataFrame:
    everything = W.partitionBy("media_id")
    share = lambda c: S.clip(F.col(c) / F.when(F.max(c).over(everything) > 1e-6, F.max(c).over(everything)).otherwise(1.0))
    raw = frames(spark, d).withColumn("flux", (F.col("event_id") % 61).cast("double")).withColumn("raw", 0.7 * share("score") + 0.3 * share("flux")).withColumn("n", F.count(F.lit(1)).over(everything))
    smooth = F.sum("raw").over(everything.orderBy("t", "event_id").rowsBetween(-2, 2)) / 5
    return raw.select("event_id", F.round(S.clip(F.when(F.col("n") >= 5, smooth).otherwise(F.col("raw"))), 9).alias("envelope"))


@query("m28_crop_differences", f"WITH {VECTORS_SQL}, p AS (SELECT *, lag(e) OVER (PARTITION BY media_id ORDER BY f) AS b FROM ve) SELECT media_id, f, round(CASE WHEN b IS NULL THEN 0.0 ELSE list_sum(list_transform(range(1, 65), lambda i: abs(e[i] - b[i]))) / 64 END, 9) AS change FROM p")
def m28(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("b", F.lag("e").over(W.partitionBy("media_id").orderBy("f")))
    change = S.total(F.zip_with("e", "b", lambda x, y: F.abs(x - y))) / F.size("e")
    return v.select("media_id", "f", F.round(F.when(F.col("b").isNull(), 0.0).otherwise(change), 9).alias("change"))


#: Two boxes of an event.
_BOX = "named_struct('x', CAST(event_id % {a} AS DOUBLE), 'y', CAST(event_id % {b} AS DOUBLE), 'width', CAST(10 + event_id % 30 AS DOUBLE), 'height', CAST(8 + event_id % {c} AS DOUBLE))"
_BOX_SQL = "SELECT event_id, CAST(event_id % 53 AS DOUBLE) AS x1, CAST(event_id % 41 AS DOUBLE) AS y1, CAST(10 + event_id % 30 AS DOUBLE) AS w1, CAST(8 + event_id % 23 AS DOUBLE) AS h1, CAST(event_id % 47 AS DOUBLE) AS x2, CAST(event_id % 43 AS DOUBLE) AS y2, CAST(10 + event_id % 30 AS DOUBLE) AS w2, CAST(8 + event_id % 19 AS DOUBLE) AS h2 FROM events"


@query("m17_box_overlap", f"WITH b AS ({_BOX_SQL}), i AS (SELECT *, greatest(0, least(x1 + w1, x2 + w2) - greatest(x1, x2)) * greatest(0, least(y1 + h1, y2 + h2) - greatest(y1, y2)) AS common FROM b) SELECT event_id, round(common / (w1 * h1 + w2 * h2 - common + 1e-6), 9) AS overlap, round(sqrt(pow(x1 + w1 / 2 - x2 - w2 / 2, 2) + pow(y1 + h1 / 2 - y2 - h2 / 2, 2)), 9) AS distance FROM i")
def m17(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "events").selectExpr("event_id", f"{_BOX.format(a=53, b=41, c=23)} AS a", f"{_BOX.format(a=47, b=43, c=19)} AS b")
    return both.select("event_id", F.round(S.overlap(F.col("a"), F.col("b")), 9).alias("overlap"), F.round(S.centre_distance(F.col("a"), F.col("b")), 9).alias("distance"))


@query(
    "m18_box_rescale",
    f"WITH b AS ({_BOX_SQL}), r AS (SELECT event_id, greatest(0, CAST(round_even(x1 * 1.37, 0) AS INT)) AS x, greatest(0, CAST(round_even(y1 * 0.81, 0) AS INT)) AS y, w1, h1 FROM b), q AS (SELECT event_id, x, y, greatest(1, least(90 - x, CAST(round_even(w1 * 1.37, 0) AS INT))) AS width, greatest(1, least(50 - y, CAST(round_even(h1 * 0.81, 0) AS INT))) AS height FROM r) SELECT *, round(x / 90, 4) AS left_share, round(height / 50, 4) AS height_share FROM q",
)
def m18(spark: SparkSession, d: str) -> DataFrame:
    box = table(spark, d, "events").selectExpr("event_id", f"{_BOX.format(a=53, b=41, c=23)} AS a").select("event_id", S.rescaled(F.col("a"), F.lit(1.37), F.lit(0.81), F.lit(90), F.lit(50)).alias("r"))
    return box.select("event_id", "r.x", "r.y", "r.width", "r.height", F.col("r.share")[0].alias("left_share"), F.col("r.share")[3].alias("height_share"))


@query(
    "m19_small_measures",
    f"WITH {FRAMES_SQL} SELECT event_id, round(greatest(0.0, least(1.0, abs(score - 0.5) * 2)), 9) AS certainty, CASE WHEN event_id % 181 - 90 < -45 THEN -(90 + event_id % 181 - 90) WHEN event_id % 181 - 90 > 45 THEN 90 - (event_id % 181 - 90) ELSE event_id % 181 - 90 END AS angle, round(greatest(0.05, least(1.0, (event_id % 40) / 30.0 * 0.5 + score * 0.5)), 9) AS mouth, "
    "CASE WHEN greatest(event_id % 5000 + 1, 3 * (event_id % 999) + 1) > 2048 THEN greatest(1, CAST(round_even((event_id % 5000 + 1) * (2048.0 / greatest(event_id % 5000 + 1, 3 * (event_id % 999) + 1))::DOUBLE, 0) AS INT)) ELSE event_id % 5000 + 1 END AS width FROM frames",
)
def m19(spark: SparkSession, d: str) -> DataFrame:
    """Certainty (M19), folded angle (M20), mouth ratio (M21) and downscaled width (M25)."""
    c, f = F.col("event_id"), frames(spark, d)
    return f.select("event_id", F.round(S.certainty(F.col("score")), 9).alias("certainty"), S.folded_angle(c % 181 - 90).alias("angle"), F.round(S.mouth_ratio((c % 40).cast("double"), F.lit(30.0), F.col("score")), 9).alias("mouth"), S.downscaled(c % 5000 + 1, 3 * (c % 999) + 1)["width"].alias("width"))


@query("m20_median_skew", f"WITH {FRAMES_SQL}, a AS (SELECT media_id, CASE WHEN x < -45 THEN -(90 + x) WHEN x > 45 THEN 90 - x ELSE x END AS x FROM (SELECT media_id, (event_id * 7 % 1801) / 10.0 - 90 AS x FROM frames)) SELECT media_id, round(CASE WHEN abs(median(x)) < 0.5 THEN 0.0 ELSE median(x) END, 9) AS skew FROM a WHERE abs(x) < 45 GROUP BY media_id")
def m20(spark: SparkSession, d: str) -> DataFrame:
    angles = frames(spark, d).select("media_id", S.folded_angle((F.col("event_id") * 7 % 1801) / 10 - 90).alias("x")).filter("abs(x) < 45")
    return angles.groupBy("media_id").agg(F.round(F.when(F.abs(F.median("x")) < 0.5, 0.0).otherwise(F.median("x")), 9).alias("skew"))


@query("a6_pitch_statistics", f"WITH {FRAMES_SQL}, v AS (SELECT media_id, count(*) AS n, count_if(event_type = 'click') AS k, avg(CASE WHEN event_type = 'click' THEN score END) AS m, var_pop(CASE WHEN event_type = 'click' THEN score END) AS s FROM frames GROUP BY media_id) SELECT media_id, round(k / n, 9) AS voiced, round(coalesce(m, 0.0), 9) AS pitch_mean, round(CASE WHEN k >= 2 THEN s ELSE 0.0 END, 9) AS pitch_variance FROM v")
def a6(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance of the voiced frames (clicks stand for them); no variance of fewer than two."""
    voiced = F.when(F.col("event_type") == "click", F.col("score"))
    return frames(spark, d).groupBy("media_id").agg(F.round(F.count(voiced) / F.count(F.lit(1)), 9).alias("voiced"), F.round(F.coalesce(F.avg(voiced), F.lit(0.0)), 9).alias("pitch_mean"), F.round(F.when(F.count(voiced) >= 2, F.var_pop(voiced)).otherwise(0.0), 9).alias("pitch_variance"))


@query("a7_noise_variation", f"WITH {FRAMES_SQL}, v AS (SELECT media_id, avg(score * 10) AS m, stddev_pop(score * 10) AS s FROM frames GROUP BY media_id), c AS (SELECT *, CASE WHEN m > 1e-4 THEN s / m ELSE 0.0 END AS cv FROM v) SELECT media_id, cv > 0.85 AND m > 1 AS spliced, round(greatest(0.0, least(1.0, cv / 1.5)), 9) AS score, round(1 - 1 / (1 + s / (m + 1e-6) * 0.5), 9) AS inconsistency FROM c")
def a7(spark: SparkSession, d: str) -> DataFrame:
    """Variation of regional noise (A7), and the other profile's inconsistency (A7v)."""
    v = frames(spark, d).groupBy("media_id").agg(F.avg(F.col("score") * 10).alias("m"), F.stddev_pop(F.col("score") * 10).alias("s")).withColumn("cv", F.when(F.col("m") > 1e-4, F.col("s") / F.col("m")).otherwise(0.0))
    return v.select("media_id", ((F.col("cv") > 0.85) & (F.col("m") > 1)).alias("spliced"), F.round(S.clip(F.col("cv") / 1.5), 9).alias("score"), F.round(1 - 1 / (1 + F.col("s") / (F.col("m") + 1e-6) * 0.5), 9).alias("inconsistency"))


@query("s6_interval_sampling", f"WITH {FRAMES_SQL}, nu AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY t, event_id) - 1 AS i FROM frames) SELECT media_id, event_id FROM nu WHERE i % 3 = 0 AND i // 3 < 10")
def s6(spark: SparkSession, d: str) -> DataFrame:
    """A frame every max(1, round(fps * interval)) = 3, ten at most."""
    return sampled_frames(numbered(frames(spark, d)), 2.5, 1.0, 10).select("media_id", "event_id")


def sampled_frames(df: DataFrame, fps: float, interval: float, most: int) -> DataFrame:
    step = max(1, int(fps * interval + 0.5))
    return df.filter((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < most))


@query("t6_largest_face", f"WITH b AS ({_BOX_SQL}) SELECT user_id AS media_id, arg_max(b.event_id, (w1 * h1, -b.event_id)) AS event_id, max(w1 * h1) AS area FROM b JOIN events USING (event_id) GROUP BY user_id")
def t6(spark: SparkSession, d: str) -> DataFrame:
    area = (10 + F.col("event_id") % 30) * (8 + F.col("event_id") % 23)
    return table(spark, d, "events").groupBy(F.col("user_id").alias("media_id")).agg(F.max_by("event_id", F.struct(area, -F.col("event_id"))).alias("event_id"), F.max(area).cast("double").alias("area"))


@query(
    "t7_longest_spans",
    "WITH RECURSIVE s AS (SELECT user_id AS media_id, event_id, event_id % 997 AS start_char, event_id % 997 + 5 + event_id % 37 AS end_char FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_char, start_char - end_char, event_id) AS k FROM s), "
    "f AS (SELECT media_id, k, event_id, true AS kept, end_char AS until FROM o WHERE k = 1 UNION ALL SELECT o.media_id, o.k, o.event_id, o.start_char >= f.until, CASE WHEN o.start_char >= f.until THEN o.end_char ELSE f.until END FROM f JOIN o ON o.media_id = f.media_id AND o.k = f.k + 1) SELECT media_id, event_id FROM f WHERE kept",
)
def t7(spark: SparkSession, d: str) -> DataFrame:
    """Of overlapping spans the earliest, then the longest."""
    spans_ = table(spark, d, "events").select(F.col("user_id").alias("media_id"), (F.col("event_id") % 997).cast("int").alias("start_char"), (F.col("event_id") % 997 + 5 + F.col("event_id") % 37).cast("int").alias("end_char"), F.col("event_id").alias("id"))
    return apart_spans(spans_, ["media_id"]).select("media_id", F.col("id").alias("event_id"))


@query("t8_suppressed_boxes")
def t8(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a user and kind of event, the overlapping ones of lower score left out; a test holds it against a loop."""
    box = F.expr("named_struct('score', value + event_id / 1e9, 'x', CAST(event_id % 53 AS DOUBLE), 'y', CAST(event_id % 41 AS DOUBLE), 'width', CAST(10 + event_id % 30 AS DOUBLE), 'height', CAST(8 + event_id % 23 AS DOUBLE))")
    each = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_list(box).alias("b"))
    return each.select("user_id", "event_type", F.explode(S.suppressed(F.col("b"))).alias("x")).select("user_id", "event_type", "x.*")


def track(frames_: DataFrame, near: float = 80.0) -> DataFrame:
    """(media_id, frame, box_id, track): boxes (media_id, frame, box_id, x, y, width, height) followed through the frames.

    Each track of the frame before, oldest first, takes the nearest free box closer than `near` or overlapping by more
    than 0.3; boxes left over begin tracks. A frame without boxes is passed over. What is held is one medium's last frame.
    A box without a medium, frame or id, or of unknown place or size is in no track and gives no row; of rows that repeat
    an id in a frame the one least by place and size counts. An empty table gives no rows.
    """
    keys, sides = ["media_id", "frame", "box_id"], ["x", "y", "width", "height"]
    boxes = frames_.select(*keys, *sides).dropna().groupBy(*keys).agg(F.min(F.struct(*sides)).alias("b"))
    each = boxes.groupBy("media_id", "frame").agg(F.array_sort(F.collect_list(F.struct("box_id", "b.*"))).alias("b")).repartition("media_id").sortWithinPartitions("media_id", "frame")
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    # columns of lists: a frame's boxes are never rows of their own in Python, nor groups of pandas
    rows = each.select("media_id", "frame", *(F.col(f"b.{n}").alias(n) for n in ("box_id", *sides)))
    found = rows.mapInArrow(_followed(near), f"media_id {kinds['media_id']}, frame {kinds['frame']}, box_id array<{kinds['box_id']}>, track array<bigint>")
    return found.select("media_id", "frame", F.explode(F.arrays_zip("box_id", "track")).alias("t")).select("media_id", "frame", "t.box_id", "t.track")


def _followed(near: float):
    """Frames (media_id, frame, box_id, x, y, width, height), the last five as lists, by medium and frame in order: box_id
    and track as lists. What is held between batches is one medium's last frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        medium, tracks, fresh = None, {}, 0
        for batch in batches:
            ids, names = [], []
            for media, _, boxes, *sides in zip(*(c.to_pylist() for c in batch.columns)):
                if media != medium:
                    medium, tracks, fresh = media, {}, 0
                free, now, own = dict(zip(boxes, zip(*sides))), {}, {}
                for name, last in tracks.items():
                    best = min(((d, b) for b, box in free.items() for d, o in [_closeness(last, box)] if d < near or o > 0.3), default=None, key=lambda x: x[0])
                    if best:
                        now[name], own[best[1]] = free.pop(best[1]), name
                for b, box in free.items():
                    now[fresh], own[b] = box, fresh
                    fresh += 1
                tracks = now
                ids.append(boxes)
                names.append([own[b] for b in boxes])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, batch.column(2).type), pa.array(names, pa.list_(pa.int64()))], names=["media_id", "frame", "box_id", "track"])

    return run


def _closeness(a: tuple, b: tuple) -> tuple[float, float]:
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    both = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
    return ((ax + aw / 2 - bx - bw / 2) ** 2 + (ay + ah / 2 - by - bh / 2) ** 2) ** 0.5, both / (aw * ah + bw * bh - both + 1e-6)


@query("j14_face_tracks")
def j14(spark: SparkSession, d: str) -> DataFrame:
    """Three events of a user are a frame; a test holds the tracks against a loop."""
    boxes = numbered(frames(spark, d)).select("media_id", F.floor(F.col("i") / 3).alias("frame"), F.col("event_id").alias("box_id"), *((F.col("event_id") % m * k).cast("double").alias(n) for n, m, k in (("x", 53, 4), ("y", 41, 4))), (20 + F.col("event_id") % 30).cast("double").alias("width"), (20 + F.col("event_id") % 23).cast("double").alias("height"))
    return track(boxes)


def waves(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, wave): the 64 vectors of a medium end to end, 4,096 samples."""
    media = F.floor(F.col("vec_id") / 64).alias("media_id")
    parts = table(spark, d, "embeddings").groupBy(media).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e")))).alias("p"))
    return parts.select("media_id", F.flatten("p.e").alias("wave"))


@query("m4_spectral_print")
def m4(spark: SparkSession, d: str) -> DataFrame:
    """Fourier transforms aren't SQL; tests hold these three against plain sums."""
    return waves(spark, d).select("media_id", print_of("wave").alias("print"))


@query("m11_pitch_contour")
def m11(spark: SparkSession, d: str) -> DataFrame:
    return waves(spark, d).select("media_id", F.posexplode(pitch_of(F.col("wave"), 16000)).alias("frame", "f0"))


@query("m29_phase_acceleration")
def m29(spark: SparkSession, d: str) -> DataFrame:
    return waves(spark, d).select("media_id", acceleration_of("wave").alias("score"))


#: Vectors as power spectra of 64 bins of a sound of 16,000 samples a second, twelve bands, six coefficients.
_BINS, _BANDS, _COEFFICIENTS = 64, 12, 6
_EDGES = f"list_transform(range(0, {_BANDS + 2}), lambda j: least({_BINS - 1}, floor({2 * _BINS - 1} * 700 * (pow(10, 2595 * log10(1 + 8000 / 700.0) * j / {_BANDS + 1} / 2595) - 1) / 16000)))"


@query(
    "m9_mel_cepstrum",
    f"WITH ed AS (SELECT {_EDGES} AS b), fb AS (SELECT m, k, CAST(CASE WHEN k >= b[m] AND k < b[m + 1] THEN (k - b[m]) / (b[m + 1] - b[m]) WHEN k >= b[m + 1] AND k < b[m + 2] THEN (b[m + 2] - k) / (b[m + 2] - b[m + 1]) ELSE 0 END AS FLOAT) AS w FROM ed, range(1, {_BANDS + 1}) u(m), range(0, {_BINS}) v(k)), "
    "sp AS (SELECT vec_id, k, pow(CAST(embedding[k + 1] AS DOUBLE), 2) AS x FROM embeddings, range(0, 64) u(k)), ml AS (SELECT vec_id, m - 1 AS band, 10 * log10(greatest(sum(x * CAST(w AS DOUBLE)), 1e-10)) AS db FROM sp JOIN fb USING (k) GROUP BY vec_id, m) "
    f"SELECT vec_id, c AS coefficient, round(sum(db * cos(pi() * c * (2 * band + 1) / {2 * _BANDS}) * CASE WHEN c = 0 THEN sqrt(1.0 / {_BANDS}) ELSE sqrt(2.0 / {_BANDS}) END), 6) AS value FROM ml, range(0, {_COEFFICIENTS}) u(c) GROUP BY vec_id, c",
)
def m9_cepstrum(spark: SparkSession, d: str) -> DataFrame:
    """Bands and cosines as weighted sums of an array; nothing leaves the JVM."""
    power = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x)
    bands = table(spark, d, "embeddings").select("vec_id", decibels(weighted(power, mel_weights(16000, 2 * (_BINS - 1), _BANDS))).alias("db"))
    return bands.select("vec_id", F.posexplode(weighted(F.col("db"), cosine_weights(_BANDS, _COEFFICIENTS))).alias("c", "v")).select("vec_id", F.col("c").cast("long").alias("coefficient"), F.round("v", 6).alias("value"))


@query("m9_log_mel")
def m9(spark: SparkSession, d: str) -> DataFrame:
    """Log-mel levels of whole waves in 80 bands, and 20 coefficients from them; a test holds both against plain sums."""
    frames_ = waves(spark, d).select("media_id", F.posexplode(log_mel_of(F.col("wave"))).alias("frame", "levels"))
    return frames_.select("media_id", "frame", "levels", weighted(F.col("levels"), cosine_weights(80, 20)).alias("coefficients"))


#: Spectra by plain sums: wave, padding, window and the tables of 1,024 angles as lists.
SPECTRA_SQL = (
    "wv AS (SELECT vec_id // 64 AS media_id, flatten(list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id)) AS x FROM embeddings GROUP BY vec_id // 64), "
    "wp AS (SELECT media_id, list_concat(list_concat(list_transform(range(0, 512), lambda i: 0.0), x), list_transform(range(0, 512 + greatest(0, 1024 - len(x))), lambda i: 0.0)) AS x FROM wv), wq AS (SELECT media_id, list_concat(x, list_transform(range(0, (256 - len(x) % 256) % 256), lambda i: 0.0)) AS x FROM wp), "
    "tb AS (SELECT list_transform(range(0, 1024), lambda i: cos(2 * pi() * i / 1024)) AS cs, list_transform(range(0, 1024), lambda i: sin(2 * pi() * i / 1024)) AS sn), "
    "wf AS (SELECT media_id, f, list_transform(range(0, 1024), lambda i: x[f * 256 + i + 1] * (0.5 - 0.5 * cs[i + 1]) / 512) AS y FROM wq, tb, unnest(range(0, (len(x) - 1024) // 256 + 1)) u(f)), "
    "sc AS (SELECT media_id, f, k, list_sum(list_transform(range(0, 1024), lambda i: y[i + 1] * cs[(k * i) % 1024 + 1])) AS re, -list_sum(list_transform(range(0, 1024), lambda i: y[i + 1] * sn[(k * i) % 1024 + 1])) AS im FROM wf, tb, range(0, 513) u(k)), "
    "ss AS (SELECT *, sqrt(re * re + im * im) AS size, atan2(im, re) - lag(atan2(im, re)) OVER (PARTITION BY media_id, k ORDER BY f) - 2 * pi() * k / 4 AS turn FROM sc)"
)


@query(
    "m12_phase_deviation",
    f"WITH {SPECTRA_SQL}, ps AS (SELECT media_id, least(1.0, coalesce(sum(abs(atan2(sin(turn), cos(turn))) * size) FILTER (WHERE f > 0), 0) / (pi() * (coalesce(sum(size) FILTER (WHERE f > 0), 0) + 1e-10))) AS phase, sum(CASE WHEN k * 15.625 >= 7000 THEN size ELSE 0 END) / greatest(sum(CASE WHEN k * 15.625 BETWEEN 1000 AND 4000 THEN size ELSE 0 END), 1e-9) AS high FROM ss GROUP BY media_id) "
    "SELECT media_id, round(phase, 6) AS phase, round(high, 6) AS high_share, round(least(1.0, 0.6 * phase + 0.4 * CASE WHEN high < 0.005 THEN 0.4 WHEN high > 0.8 THEN 0.5 ELSE 0.1 END), 6) AS anomaly FROM ps",
)
def m12_phase(spark: SparkSession, d: str) -> DataFrame:
    """Phases of whole waves, in frames of 1,024 samples every 256."""
    found = waves(spark, d).select("media_id", forensics_of("wave").alias("x"))
    return found.select("media_id", *(F.round(F.col("x")[c], 6).alias(c) for c in ("phase", "high_share", "anomaly")))


@query("m29_yin_pitch")
def m29_yin(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance of the pitch by normalised differences; a test holds it against plain sums."""
    return waves(spark, d).select("media_id", yin_of(F.col("wave"), 16000).alias("x")).select("media_id", F.col("x.mean").alias("pitch_mean"), F.col("x.variance").alias("pitch_variance"))
