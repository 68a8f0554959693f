"""Timelines: gap clusters, interval merging, sliding windows, smoothing, interpolation.

All take rows of many media at once and window within one of them, in order of time. The windows use frames
that Spark streams and spills; a medium's rows are sorted, never gathered. Where a fold depends on their order, a
bounded number is gathered, and what has more is scanned in ranges (see `scan`).
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediasift.operators.registry import half_up_sql, query
from mediasift.operators.scan import MANY, RANGE, by_size, carried
from mediasift.sources.views import FRAMES_SQL, LINES_SQL, frames, lines, table


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """Number the runs of rows within keys; `starts` says of a row whether it begins a new one."""
    return df.withColumn("island", F.sum(starts.cast("long")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def gap_clusters(df: DataFrame, gap: float) -> DataFrame:
    """Suspicious frames (media_id, event_id, t, score, inconsistency) chained while neighbours are at most `gap` apart.

    One row per cluster: its bounds, its first highest frame and the reason. Rows without a time don't cluster.
    """
    before = F.lag("t").over(W.partitionBy("media_id").orderBy("t", "event_id"))
    marked = islands(df.filter("t IS NOT NULL").withColumn("new", F.coalesce(F.col("t") - before > gap, F.lit(True))), ["media_id"], ["t", "event_id"], F.col("new"))
    peak = F.max_by(F.struct("event_id", "t", "score", "inconsistency"), F.struct("score", -F.col("t"), -F.col("event_id")))
    out = marked.groupBy("media_id", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n"), peak.alias("p"))
    jitter = F.col("p.inconsistency") >= 0.4
    said = lambda text, value: F.format_string(text, F.floor(F.col(value) * 100 + 0.5) / 100)  # noqa: E731  half up
    reason = (
        F.when(jitter & (F.col("p.score") >= 0.6), said("Facial synthesis anomaly & boundary discontinuity (score: %.2f)", "p.score")).when(jitter, said("Abrupt temporal facial jitter (inconsistency: %.2f)", "p.inconsistency"))
        .otherwise(said("High facial artifact anomaly (score: %.2f)", "p.score"))
    )
    return out.select("media_id", "island", "start", "end", "n", F.col("p.event_id").alias("event_id"), F.round("p.t", 2).alias("peak"), F.round("p.score", 4).alias("score"), reason.alias("reason"))


def frame_scores(df: DataFrame, scale: float) -> DataFrame:
    """Adds inconsistency (change against the frame before, 0 in the first), frame_score and suspicious."""
    change = F.abs(F.col("score") - F.lag("score").over(W.partitionBy("media_id").orderBy("t", "event_id")))
    out = df.withColumn("inconsistency", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(change, F.lit(0.0)) / scale)))
    out = out.withColumn("frame_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.col("score") + 0.3 * F.col("inconsistency"))))
    return out.withColumn("suspicious", (F.col("frame_score") >= 0.5) | (F.col("inconsistency") >= 0.45))


def sliding_windows(df: DataFrame, size: int, hop: int) -> DataFrame:
    """(media_id, window, n, mean, top) of windows of `size` rows every `hop` rows.

    A window starts at each multiple of `hop` before n - size / 2, until one reaches the end. Each row names its own
    windows, so nothing is joined by range.
    """
    idx = F.row_number().over(W.partitionBy("media_id").orderBy("t", "event_id")) - 1
    total = F.count(F.lit(1)).over(W.partitionBy("media_id"))
    rows = df.select("media_id", idx.cast("long").alias("i"), total.alias("n"), "score")
    # the window that first reaches the end, and the last multiple of hop before n - size / 2
    last = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.least(F.ceil((F.col("n") - size) / hop), F.ceil((F.col("n") - size / 2) / hop) - 1))
    first_k, last_k = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / hop)), F.least(F.floor(F.col("i") / hop), last)
    placed = rows.withColumn("a", first_k.cast("long")).withColumn("b", last_k.cast("long")).filter("a <= b").select("media_id", "score", F.explode(F.sequence("a", "b")).alias("window"))
    return placed.groupBy("media_id", "window").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.max("score").alias("top"))


def merge_intervals(df: DataFrame, gap: float, many: int = MANY, size: int = RANGE) -> DataFrame:
    """Intervals (media_id, kind, start, end, severity, offset_ms, seq) of a kind that overlap or are within `gap`, as one.

    HIGH severity stays; the description is that of the first. The offset is a running pairwise mean rounded to one digit,
    which depends on order: a kind of a medium with `many` rows or fewer folds it in an array, one with more is scanned
    in ranges of `size` rows.
    """
    keys, few, large = ["media_id", "kind"], *by_size(df, ["media_id", "kind"], many)
    w = W.partitionBy(*keys).orderBy("start", "seq").rowsBetween(W.unboundedPreceding, -1)
    marked = few.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(w) + gap, F.lit(True)))
    grouped = islands(marked, keys, ["start", "seq"], F.col("new")).groupBy(*keys, "island")
    merged = [F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.max((F.col("severity") == "HIGH").cast("int")).alias("high"), F.min_by("severity", F.struct("start", "seq")).alias("first_severity")]
    out = grouped.agg(*merged, F.array_sort(F.collect_list(F.struct("start", "seq", "offset_ms"))).alias("parts")).withColumn("offset_ms", running_mean(F.col("parts.offset_ms"), 1)).drop("parts")
    if large is not None:
        columns = ["start", "end", "severity", "offset_ms", "seq"]

        def step(state, own: pd.DataFrame):
            until, island, mean = state or (None, None, None)
            named = []
            for start, end, seq, offset in zip(own["start"].tolist(), own["end"].tolist(), own["seq"].tolist(), own["offset_ms"].tolist()):
                if until is None or start > until + gap:
                    until, island, mean = end, f"{start!r}:{seq!r}", offset
                else:
                    until, mean = max(until, end), half_up((mean + offset) / 2, 1)
                named.append((island, mean))
            return (until, island, mean), own[columns].assign(island=[x[0] for x in named], mean=[x[1] for x in named])

        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        placed = carried(large.select(*keys, *columns), keys, ["start", "seq"], step, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", island string, mean double", size)
        found = placed.groupBy(*keys, "island").agg(*merged, F.max_by("mean", F.struct("start", "seq")).cast("double").alias("offset_ms"))
        out = out.select(*keys, "start", "end", "n", "high", "first_severity", "offset_ms").unionByName(found.drop("island"))
    return out.select("media_id", "kind", "start", "end", "n", F.when(F.col("high") == 1, "HIGH").otherwise(F.col("first_severity")).alias("severity"), "offset_ms")


def half_up(x: float, digits: int) -> float:
    """Rounding as Spark's: a half of the number as it is written goes away from zero."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def running_mean(values: Column, digits: int) -> Column:
    """Fold of round((so far + next) / 2, digits) over an array."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(values, 1).cast("double"), lambda a, x: F.round((a + x) / 2, digits))


def consolidate_text(df: DataFrame, interval: float, many: int = MANY, size: int = RANGE) -> DataFrame:
    """Regions (media_id, start, end, y, text, confidence) that show the same trimmed lower-case text in consecutive samples, as one.

    A text that a medium shows more than `many` times is scanned in ranges of `size` rows."""
    own = df.withColumn("key", F.lower(F.trim("text"))).filter("key <> ''")
    keys, few, large = ["media_id", "key"], *by_size(own, ["media_id", "key"], many)
    before = F.lag("end").over(W.partitionBy(*keys).orderBy("start", "y"))
    marked = few.withColumn("new", F.coalesce(F.abs(F.col("start") - before) > 1.5 * interval, F.lit(True)))
    grouped = islands(marked, keys, ["start", "y"], F.col("new")).groupBy(*keys, "island")
    merged = [F.min("start").alias("start"), F.max_by("end", F.struct("start", "y")).alias("end"), F.min("y").alias("y"), F.count(F.lit(1)).alias("n")]
    out = grouped.agg(*merged, F.array_sort(F.collect_list(F.struct("start", "y", "confidence"))).alias("parts")).withColumn("confidence", running_mean(F.col("parts.confidence"), 4)).drop("parts")
    if large is not None:

        def step(state, rows: pd.DataFrame):
            until, island, mean = state or (None, None, None)
            named = []
            for start, end, y, sure in zip(rows["start"].tolist(), rows["end"].tolist(), rows["y"].tolist(), rows["confidence"].tolist()):
                if until is None or abs(start - until) > 1.5 * interval:
                    island, mean = f"{start!r}:{y!r}", sure
                else:
                    mean = half_up((mean + sure) / 2, 4)
                until = end
                named.append((island, mean))
            return (until, island, mean), rows[["start", "end", "y"]].assign(island=[x[0] for x in named], mean=[x[1] for x in named])

        kinds = {f.name: f.dataType.simpleString() for f in own.schema}
        columns = ["start", "end", "y"]
        placed = carried(large.select(*keys, *columns, "confidence"), keys, ["start", "y"], step, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", island string, mean double", size)
        found = placed.groupBy(*keys, "island").agg(*merged, F.max_by("mean", F.struct("start", "y")).alias("confidence"))
        out = out.select(*keys, "start", "end", "y", "n", "confidence").unionByName(found.drop("island"))
    return out.select("media_id", F.col("key").alias("text"), "start", "end", "y", "n", "confidence")


def apart_spans(df: DataFrame, keys: list[str], many: int = MANY, size: int = RANGE) -> DataFrame:
    """Of spans df(*keys, start_char, end_char, id) those that begin where no chosen one reaches: the earliest first, then
    the longest, then the least id. Keys with more than `many` spans are scanned in ranges of `size` rows."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def step(state, own: pd.DataFrame):
        until, kept = state if state is not None else float("-inf"), []
        for start, end in zip(own["start_char"].tolist(), own["end_char"].tolist()):
            kept.append(start >= until)
            until = end if kept[-1] else until
        return until, own[["start_char", "end_char", "id"]][kept]

    few, large = by_size(df, keys, many)
    span = F.struct("start_char", (F.col("start_char") - F.col("end_char")).alias("longest"), "id", "end_char")
    gathered = few.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("s"))
    out = gathered.select(*keys, F.explode(_chosen(F.col("s"), kinds["end_char"])).alias("x")).select(*keys, "x.start_char", "x.end_char", "x.id")
    if large is not None:
        ranged = large.select(*keys, "start_char", (-F.col("end_char")).alias("back"), "id", "end_char")
        out = out.unionByName(carried(ranged, keys, ["start_char", "back", "id"], step, ", ".join(f"`{c}` {kinds[c]}" for c in ("start_char", "end_char", "id")), size))
    return out


def _chosen(spans: Column, kind: str) -> Column:
    kept = F.aggregate(spans, F.struct(F.slice(spans, 1, 0).alias("kept"), F.lit(None).cast(kind).alias("until")), lambda s, x: F.when(s["until"].isNull() | (x["start_char"] >= s["until"]), F.struct(F.array_append(s["kept"], x).alias("kept"), x["end_char"].alias("until"))).otherwise(s))
    return kept["kept"]


def relative_steps(df: DataFrame, value: str, gate: float = 0.12) -> Column:
    """|change| / value against the row before, 0 below the gate; 0 in the first row."""
    change = F.abs(F.col(value) - F.lag(value).over(W.partitionBy("media_id").orderBy("t", "event_id"))) / (F.col(value) + 1e-4)
    return F.when(change >= gate, change).otherwise(0.0)


def interpolate(source: DataFrame, target: DataFrame) -> DataFrame:
    """(media_id, event_id, v): source (media_id, t, v) at the times of target (media_id, t, event_id), linearly; 0 outside.

    One sort each way over the union of both; of several values at one time the largest counts.
    """
    one = source.groupBy("media_id", "t").agg(F.max("v").alias("v"))
    both = one.select("media_id", "t", F.lit(0).alias("side"), F.struct("t", "v").alias("p"), F.lit(None).cast("long").alias("event_id"))
    both = both.unionByName(target.select("media_id", "t", F.lit(1).alias("side"), F.lit(None).cast(both.schema["p"].dataType).alias("p"), "event_id"))
    back = F.last("p", ignorenulls=True).over(W.partitionBy("media_id").orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0))
    ahead = F.last("p", ignorenulls=True).over(W.partitionBy("media_id").orderBy(F.desc("t"), "side").rowsBetween(W.unboundedPreceding, 0))
    near = both.withColumn("a", back).withColumn("b", ahead).filter("side = 1")
    share = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    v = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(F.col("a.t") == F.col("b.t"), F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * share)
    return near.select("media_id", "event_id", v.alias("v"))


#: The frame before, and the scored frames, for the SQL side.
STEPS_SQL = f"{FRAMES_SQL}, steps AS (SELECT *, lag(score) OVER w AS p, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM frames WINDOW w AS (PARTITION BY media_id ORDER BY t, event_id))"
SUSPICIOUS_SQL = f"{STEPS_SQL}, inc AS (SELECT *, least(1.0, coalesce(abs(score - p), 0.0) / 0.4) AS inconsistency FROM steps), fs AS (SELECT *, least(1.0, 0.7 * score + 0.3 * inconsistency) AS frame_score FROM inc)"


@query("w2_frame_scores", f"WITH {SUSPICIOUS_SQL} SELECT event_id, round(inconsistency, 6) AS inconsistency, round(frame_score, 6) AS frame_score, frame_score >= 0.5 OR inconsistency >= 0.45 AS suspicious FROM fs")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return frame_scores(frames(spark, d), 0.4).select("event_id", F.round("inconsistency", 6).alias("inconsistency"), F.round("frame_score", 6).alias("frame_score"), "suspicious")


@query(
    "w1_gap_clusters",
    f"WITH {SUSPICIOUS_SQL}, s AS (SELECT * FROM fs WHERE frame_score >= 0.5 OR inconsistency >= 0.45), g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY media_id ORDER BY t, event_id) > 86400, true) AS fresh FROM s), "
    "k AS (SELECT *, CAST(sum(CAST(fresh AS INT)) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g), "
    "c AS (SELECT media_id, island, min(t) AS start, max(t) AS \"end\", count(*) AS n, arg_max(event_id, (frame_score, -t, -event_id)) AS event_id, max(frame_score) AS top, arg_max(inconsistency, (frame_score, -t, -event_id)) AS inc, arg_max(t, (frame_score, -t, -event_id)) AS pt FROM k GROUP BY media_id, island) "
    "SELECT media_id, island, start, \"end\", n, event_id, round(pt, 2) AS peak, round(top, 4) AS score, CASE WHEN inc >= 0.4 AND top >= 0.6 THEN printf('Facial synthesis anomaly & boundary discontinuity (score: %.2f)', floor(top * 100 + 0.5) / 100) WHEN inc >= 0.4 THEN printf('Abrupt temporal facial jitter (inconsistency: %.2f)', floor(inc * 100 + 0.5) / 100) ELSE printf('High facial artifact anomaly (score: %.2f)', floor(top * 100 + 0.5) / 100) END AS reason FROM c",
)
def w1(spark: SparkSession, d: str) -> DataFrame:
    """A gap of a day, as events are days apart."""
    scored = frame_scores(frames(spark, d), 0.4).filter("suspicious").select("media_id", "event_id", "t", F.col("frame_score").alias("score"), "inconsistency")
    return gap_clusters(scored, 86400)


@query(
    "w3_sliding_windows",
    f"WITH {STEPS_SQL}, w AS (SELECT media_id, n, unnest(range(0, CASE WHEN n <= 8 THEN 1 ELSE least(CAST(ceil((n - 8) / 3) AS BIGINT) + 1, CAST(ceil((n - 4) / 3) AS BIGINT)) END)) AS k FROM (SELECT DISTINCT media_id, n FROM steps)) "
    "SELECT w.media_id, k AS \"window\", count(*) AS n, round(avg(score), 10) AS mean, max(score) AS top FROM w JOIN steps s ON s.media_id = w.media_id AND s.i >= 3 * k AND s.i < 3 * k + 8 GROUP BY w.media_id, k",
)
def w3(spark: SparkSession, d: str) -> DataFrame:
    return sliding_windows(frames(spark, d), 8, 3).withColumn("mean", F.round("mean", 10))


@query(
    "w5_interval_merge",
    f"WITH {FRAMES_SQL}, s AS (SELECT media_id, event_type AS kind, t AS start, t + 100000 * score AS \"end\", CASE WHEN score > 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CAST(event_id % 201 AS DOUBLE) - 100 AS offset_ms, event_id AS seq FROM frames), "
    "g AS (SELECT *, coalesce(start > max(\"end\") OVER (PARTITION BY media_id, kind ORDER BY start, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600, true) AS fresh FROM s), "
    "k AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY media_id, kind ORDER BY start, seq ROWS UNBOUNDED PRECEDING) AS island FROM g) "
    f"SELECT media_id, kind, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n, CASE WHEN bool_or(severity = 'HIGH') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, list_reduce(list(offset_ms ORDER BY start, seq), lambda a, b: {half_up_sql('(a + b) / 2', 1)}) AS offset_ms FROM k GROUP BY media_id, kind, island",
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("media_id", F.col("event_type").alias("kind"), F.col("t").alias("start"), (F.col("t") + 100000 * F.col("score")).alias("end"), F.when(F.col("score") > 0.6, "HIGH").otherwise("MEDIUM").alias("severity"), ((F.col("event_id") % 201).cast("double") - 100).alias("offset_ms"), F.col("event_id").alias("seq"))
    return merge_intervals(f, 3600)


@query(
    "w6_text_consolidation",
    f"WITH {LINES_SQL}, r AS (SELECT *, lower(trim(text, ' ')) AS key, 0.5 + (y % 50) / 100 AS confidence FROM lines), g AS (SELECT *, coalesce(abs(start - lag(\"end\") OVER (PARTITION BY media_id, key ORDER BY start, y)) > 1.5, true) AS fresh FROM r WHERE key <> ''), "
    "k AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY media_id, key ORDER BY start, y ROWS UNBOUNDED PRECEDING) AS island FROM g) "
    f"SELECT media_id, key AS text, min(start) AS start, arg_max(\"end\", (start, y)) AS \"end\", min(y) AS y, count(*) AS n, list_reduce(list(CAST(confidence AS DOUBLE) ORDER BY start, y), lambda a, b: {half_up_sql('(a + b) / 2', 4)}) AS confidence FROM k GROUP BY media_id, key, island",
)
def w6(spark: SparkSession, d: str) -> DataFrame:
    return consolidate_text(lines(spark, d).withColumn("confidence", 0.5 + (F.col("y") % 50) / 100), 1.0)


@query(
    "w8_relative_steps",
    f"WITH {STEPS_SQL}, c AS (SELECT *, abs(score - p) / (score + 1e-4) AS x FROM steps), g AS (SELECT *, CASE WHEN x >= 0.12 THEN x ELSE 0.0 END AS y FROM c) SELECT event_id, round(least(1.0, y / (max(y) OVER (PARTITION BY media_id) + 1e-6)), 6) AS step FROM g",
)
def w8(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    f = f.withColumn("step", relative_steps(f, "score"))
    return f.select("event_id", F.round(F.least(F.lit(1.0), F.col("step") / (F.max("step").over(W.partitionBy("media_id")) + 1e-6)), 6).alias("step"))


@query("w9_median_spacing", f"WITH {STEPS_SQL.replace('lag(score)', 'lag(t)')} SELECT media_id, round(quantile_cont(t - p, 0.5), 6) AS spacing FROM steps WHERE p IS NOT NULL GROUP BY media_id")
def w9(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("gap", F.col("t") - F.lag("t").over(W.partitionBy("media_id").orderBy("t", "event_id")))
    return f.filter("gap IS NOT NULL").groupBy("media_id").agg(F.round(F.median("gap"), 6).alias("spacing"))


@query("w10_moving_average", f"WITH {FRAMES_SQL} SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY media_id) >= 5 THEN sum(score) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE score END, 6) AS smooth FROM frames")
def w10(spark: SparkSession, d: str) -> DataFrame:
    """Edges count as zeros outside; a series of fewer than five stays as it is."""
    near = F.sum("score").over(W.partitionBy("media_id").orderBy("t", "event_id").rowsBetween(-2, 2)) / 5
    return frames(spark, d).select("event_id", F.round(F.when(F.count(F.lit(1)).over(W.partitionBy("media_id")) >= 5, near).otherwise(F.col("score")), 6).alias("smooth"))


@query("w12_carry_forward", f"WITH {FRAMES_SQL} SELECT event_id, coalesce(last_value(CASE WHEN event_type <> 'view' THEN score END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0.25) AS ratio FROM frames")
def w12(spark: SparkSession, d: str) -> DataFrame:
    """The last valid value (views stand for lost faces), 0.25 before the first."""
    kept = F.last(F.when(F.col("event_type") != "view", F.col("score")), ignorenulls=True).over(W.partitionBy("media_id").orderBy("t", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return frames(spark, d).select("event_id", F.coalesce(kept, F.lit(0.25)).alias("ratio"))


@query(
    "w13_lip_activity",
    f"WITH {STEPS_SQL}, m AS (SELECT *, abs(event_id % 97 - lag(event_id % 97) OVER w) / 97 AS x, lead(event_id % 97) OVER w AS z FROM steps WINDOW w AS (PARTITION BY media_id ORDER BY t, event_id)), "
    "a AS (SELECT *, 0.6 * coalesce(abs(score - p), 0) + 0.4 * CASE WHEN p IS NULL THEN coalesce(abs(z - event_id % 97) / 97, 0) ELSE x END AS activity FROM m), b AS (SELECT *, max(activity) OVER (PARTITION BY media_id) AS top FROM a) "
    "SELECT event_id, round(CASE WHEN top > 1e-5 THEN activity / top ELSE 0.0 END, 6) AS activity FROM b",
)
def w13(spark: SparkSession, d: str) -> DataFrame:
    """0.6 of the ratio's change and 0.4 of motion; the first frame has the motion of the second."""
    w, crop = W.partitionBy("media_id").orderBy("t", "event_id"), F.col("event_id") % 97
    first = F.lag("event_id").over(w).isNull()
    motion = F.when(first, F.coalesce(F.abs(F.lead(crop).over(w) - crop) / 97, F.lit(0.0))).otherwise(F.abs(crop - F.lag(crop).over(w)) / 97)
    f = frames(spark, d).withColumn("activity", 0.6 * F.coalesce(F.abs(F.col("score") - F.lag("score").over(w)), F.lit(0.0)) + 0.4 * motion)
    top = F.max("activity").over(W.partitionBy("media_id"))
    return f.select("event_id", F.round(F.when(top > 1e-5, F.col("activity") / top).otherwise(0.0), 6).alias("activity"))


@query(
    "w14_fixed_segments",
    "WITH s AS (SELECT doc_id, CAST(n_chars AS DOUBLE) / 10 AS dur, unnest(range(0, CAST(ceil(n_chars / 30.0) AS BIGINT))) AS seg FROM documents) SELECT doc_id AS media_id, seg, CAST(3 * seg AS DOUBLE) AS start, least(dur, 3.0 * (seg + 1)) AS \"end\" FROM s WHERE 3 * seg < dur",
)
def w14(spark: SparkSession, d: str) -> DataFrame:
    """Segments of three seconds; a document lasts a second for every ten characters."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), (F.col("n_chars") / 10).alias("dur")).filter("dur > 0")
    seg = docs.select("media_id", "dur", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("dur") / 3) - 1)).alias("seg"))
    return seg.filter(3 * F.col("seg") < F.col("dur")).select("media_id", "seg", (3 * F.col("seg")).cast("double").alias("start"), F.least("dur", 3.0 * (F.col("seg") + 1)).alias("end"))


def word_offsets(segments_: DataFrame, digits: int = 3) -> DataFrame:
    """(media_id, seg, word, start, end, probability): two to five words evenly placed in each segment (media_id, seg, start,
    end, confidence), one for each half second; a word lasts 0.85 of its share and each is a little less sure."""
    length = F.col("end") - F.col("start")
    words = F.greatest(F.lit(2), F.least(F.lit(5), F.floor(length / 0.5))).cast("int")
    each = segments_.select("media_id", "seg", "start", "confidence", length.alias("length"), words.alias("words"), F.explode(F.sequence(F.lit(0), words - 1)).alias("word"))
    at = lambda shift: F.round(F.col("start") + (F.col("word") + shift) * F.col("length") / F.col("words"), digits)
    return each.select("media_id", "seg", "word", at(0.0).alias("start"), at(0.85).alias("end"), F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.5), F.col("confidence") - F.col("word") * 0.02)), 4).alias("probability"))


@query(
    "w14_word_offsets",
    "WITH s AS (SELECT doc_id, CAST(n_chars AS DOUBLE) / 10 AS dur, unnest(range(0, CAST(ceil(n_chars / 30.0) AS BIGINT))) AS seg FROM documents), g AS (SELECT doc_id AS media_id, seg, CAST(3 * seg AS DOUBLE) AS start, least(dur, 3.0 * (seg + 1)) - 3 * seg AS len FROM s WHERE 3 * seg < dur), "
    "w AS (SELECT *, greatest(2, least(5, CAST(floor(len / 0.5) AS INT))) AS k FROM g) SELECT media_id, seg, CAST(i AS INT) AS word, round(start + CAST(i AS DOUBLE) * len / k, 6) AS start, round(start + (i + CAST(0.85 AS DOUBLE)) * len / k, 6) AS \"end\", round(least(0.99, greatest(0.5, CAST(media_id % 50 AS DOUBLE) / 100 + 0.5 - i * 0.02)), 4) AS probability FROM w, unnest(range(0, k)) u(i)",
)
def w14_words(spark: SparkSession, d: str) -> DataFrame:
    found = w14(spark, d).withColumn("confidence", (F.col("media_id") % 50).cast("double") / 100 + 0.5)
    return word_offsets(found, 6)


@query(
    "j13_timeline_alignment",
    f"WITH {FRAMES_SQL}, s AS (SELECT media_id, t, max(score) AS v FROM frames WHERE event_type = 'click' GROUP BY media_id, t), g AS (SELECT media_id, event_id, t FROM frames WHERE event_type = 'view'), "
    "a AS (SELECT g.*, s.t AS ta, s.v AS va FROM g ASOF LEFT JOIN s ON g.media_id = s.media_id AND g.t >= s.t), b AS (SELECT a.*, s.t AS tb, s.v AS vb FROM a ASOF LEFT JOIN s ON a.media_id = s.media_id AND a.t <= s.t) "
    "SELECT media_id, event_id, round(CASE WHEN ta IS NULL OR tb IS NULL THEN 0.0 WHEN ta = tb THEN va ELSE va + (vb - va) * ((t - ta) / (tb - ta)) END, 6) AS v FROM b",
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return interpolate(f.filter("event_type = 'click'").select("media_id", "t", F.col("score").alias("v")), f.filter("event_type = 'view'")).withColumn("v", F.round("v", 6))
