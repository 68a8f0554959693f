"""Rules that turn findings and measures of a medium into scores and assessments, and metrics of scores over all media.

The rules are column expressions: they stay in generated code and shuffle nothing. The metrics aggregate before they
shuffle; ranks over all rows come from counts by level, never from one window over everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediasift.operators.registry import half_up_sql, query
from mediasift.sources.views import FRAMES_SQL, LINES_SQL, MEDIA_SQL, SCORED_SQL, SEGMENTS_SQL, frames, lines, media, scored_labels, segments, table

#: Software that edits pictures, software that encodes anew, makers of cameras, software that a camera doesn't run.
EDITORS = ("photoshop", "gimp", "canva", "capcut", "lightroom", "premiere", "after effects", "final cut", "snapseed", "picsart", "indesign", "affinity photo", "pixelmator")
ENCODERS = ("ffmpeg", "libx264", "libx265", "handbrake", "lavf", "mencoder", "formatfactory")
MAKERS = ("canon", "nikon", "sony", "fujifilm", "olympus", "panasonic", "leica", "hasselblad")
FOREIGN = ("photoshop", "gimp", "capcut", "canva", "apple", "android")


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words, in any case; false if it is null."""
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def anomalies(as_of: Column) -> Column:
    """Findings about metadata: array of (code, category, severity, confidence, weight), in the order of the rules.

    Reads media_type, software, make, model, captured_at, modified_at, latitude, longitude, container, codec, duration
    and exif_present. A time later than an hour after `as_of` is in the future.
    """
    c, late = F.col, as_of + F.expr("INTERVAL 1 HOUR")
    lat, lon = c("latitude"), c("longitude")
    edited = mentions(c("software"), EDITORS)
    outside = (lat < -90) | (lat > 90) | (lon < -180) | (lon > 180)
    rules = [
        (edited, "ANOM_EDITING_SOFTWARE", "SOFTWARE_MODIFICATION", "HIGH", 0.95, 0.35),
        (~edited & mentions(c("software"), ENCODERS), "ANOM_RE_ENCODING_SOFTWARE", "SOFTWARE_MODIFICATION", "MEDIUM", 0.85, 0.20),
        (c("captured_at") > late, "ANOM_FUTURE_CAPTURE_TIMESTAMP", "TIMESTAMP_INCONSISTENCY", "HIGH", 0.90, 0.35),
        (c("modified_at") > late, "ANOM_FUTURE_MODIFY_TIMESTAMP", "TIMESTAMP_INCONSISTENCY", "HIGH", 0.90, 0.35),
        (c("modified_at") < c("captured_at") - F.expr("INTERVAL 1 MINUTE"), "ANOM_TIMESTAMP_INCONSISTENCY", "TIMESTAMP_INCONSISTENCY", "MEDIUM", 0.80, 0.20),
        ((c("media_type") == "IMAGE") & ~c("exif_present") & c("make").isNull() & c("model").isNull(), "ANOM_METADATA_STRIPPED", "METADATA_STRIPPED", "LOW", 0.70, 0.05),
        (mentions(c("make"), MAKERS) & mentions(c("software"), FOREIGN), "ANOM_CAMERA_SOFTWARE_MISMATCH", "DEVICE_INCONSISTENCY", "HIGH", 0.85, 0.35),
        (lat.isNotNull() & lon.isNotNull() & outside, "ANOM_GPS_OUT_OF_BOUNDS", "GPS_ANOMALY", "HIGH", 0.95, 0.35),
        (~outside & (F.abs(lat) < 0.0001) & (F.abs(lon) < 0.0001), "ANOM_GPS_NULL_ISLAND", "GPS_ANOMALY", "MEDIUM", 0.75, 0.20),
        ((c("media_type") == "VIDEO") & c("container").isNotNull() & c("codec").isNull() & c("duration").isNull(), "ANOM_VIDEO_STREAM_INCONSISTENCY", "CONTAINER_INCONSISTENCY", "MEDIUM", 0.75, 0.20),
    ]
    names = ("code", "category", "severity", "confidence", "weight")
    found = [F.when(rule, F.struct(*(F.lit(v).alias(n) for n, v in zip(names, values)))) for rule, *values in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def anomaly_score(found: Column) -> Column:
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x["weight"])
    return F.least(F.lit(1.0), F.floor(total * 10000 + 0.5) / 10000)


def risk_level(score: Column) -> Column:
    return F.when(score <= 0, "CLEAN").when(score < 0.5, "SUSPICIOUS").otherwise("HIGH_RISK")


def unfinished(status: Column) -> Column:
    return F.when(status == "FAILED", "ANALYSIS_FAILED").when(status.isin("PENDING", "PROCESSING"), "IN_PROGRESS")


def image_assessment(ai: Column, manipulated: Column, status: Column) -> Column:
    return (
        unfinished(status).when((ai >= 0.75) & (manipulated >= 0.75), "HIGH_SYNTHETIC_AND_MANIPULATION_RISK").when(ai >= 0.75, "HIGH_SYNTHETIC_RISK").when(manipulated >= 0.75, "HIGH_MANIPULATION_RISK")
        .when((ai >= 0.5) | (manipulated >= 0.5), "SUSPICIOUS_ANOMALIES_DETECTED").when((ai <= 0.25) & (manipulated <= 0.25), "LOW_ANOMALY_LEVEL").otherwise("MODERATE_ANOMALY_LEVEL")
    )


def video_assessment(p: Column, status: Column) -> Column:
    return unfinished(status).when(p >= 0.75, "HIGH_DEEPFAKE_RISK").when(p >= 0.5, "SUSPICIOUS_DEEPFAKE_INDICATORS").when(p <= 0.25, "LOW_DEEPFAKE_RISK").otherwise("MODERATE_DEEPFAKE_RISK")


def audio_assessment(p: Column, status: Column) -> Column:
    return unfinished(status).when(p >= 0.75, "HIGH_SYNTHETIC_VOICE_RISK").when(p >= 0.5, "SUSPICIOUS_VOICE_CLONING_INDICATORS").when(p <= 0.25, "LIKELY_AUTHENTIC_AUDIO").otherwise("MODERATE_SYNTHETIC_VOICE_RISK")


def sync_assessment(score: Column, offset_ms: Column, status: Column) -> Column:
    off = F.abs(offset_ms)
    return F.when(status == "FAILED", "ANALYSIS_FAILED").when((score >= 0.75) & (off <= 60), "SYNCHRONIZED").when((score < 0.4) | (off > 180), "SUSPECTED_DUBBING_OR_DESYNC").otherwise("ANOMALOUS_SYNCHRONIZATION")


def composite_sync(offset_ms: Column, corr: Column, distance: Column, confidence: Column, face: Column, audio: Column, mouth: Column, speech: Column) -> Column:
    """struct(score, confidence, status) of how well lips and sound agree; unrounded."""
    off = F.abs(offset_ms)
    by_corr, by_distance = clip(corr + 0.2), clip((1.4 - distance) / 0.8)
    score = clip((1.0 - 0.5 * clip((off - 60) / 340)) * (0.3 + 0.45 * by_corr + 0.25 * by_distance))
    sure = F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.5 * by_corr + 0.3 * confidence + 0.2))
    status = F.when((off <= 80) & (score >= 0.7), "ALIGNED").when((off <= 160) & (score >= 0.45), "SLIGHT_DESYNC").otherwise("SEVERE_DESYNC")

    def out(a: Column, b: Column, s: Column) -> Column:
        return F.struct(a.alias("score"), b.alias("confidence"), s.alias("status"))

    return (
        F.when(~audio, out(F.lit(0.0), F.lit(1.0), F.lit("NO_AUDIO_TRACK"))).when(~face, out(F.lit(0.0), F.lit(0.9), F.lit("NO_FACE_DETECTED")))
        .when(~mouth & ~speech, out(F.lit(0.5), F.lit(0.5), F.lit("SILENT_OR_INACTIVE"))).otherwise(out(score, sure, status))
    )


def composite_sync_app(env_ms: Column, corr: Column, env_sure: Column, net_ms: Column, distance: Column, net_sure: Column, stability: Column) -> Column:
    """The other profile: struct(score, offset_ms, confidence) with a piecewise offset factor and a penalty for poor tracking."""
    a, b = F.greatest(F.lit(0.1), env_sure), F.greatest(F.lit(0.1), net_sure)
    offset = (env_ms * a + net_ms * b) / (a + b)
    off = F.abs(offset)
    factor = F.when(off <= 60, 1.0).when(off <= 200, 1.0 - ((off - 60) / 140) * 0.45).when(off <= 400, 0.55 - ((off - 200) / 200) * 0.35).otherwise(0.2)
    raw = factor * 0.4 + clip((corr + 0.5) / 1.5) * 0.35 + clip(1.0 - distance / 2) * 0.25
    raw = F.when(stability < 0.3, raw * (0.5 + stability * 1.5)).otherwise(raw)
    return F.struct(clip(raw).alias("score"), offset.alias("offset_ms"), clip(env_sure * 0.4 + net_sure * 0.3 + stability * 0.3).alias("confidence"))


def fused_offset(corr_ms: Column, corr_sure: Column, net_ms: Column, net_sure: Column, least: float = 0.35) -> Column:
    both = (corr_ms * corr_sure + net_ms * net_sure) / (corr_sure + net_sure)
    return F.when((corr_sure >= least) & (net_sure >= least), F.round(both, 1)).when(corr_sure >= least, corr_ms).when(net_sure >= least, net_ms).otherwise(corr_ms)


def manipulation_app(pairs: Column, noise: Column, ela: Column, cluster: int = 8) -> Column:
    """The other profile's additive score: copied regions, spliced regions, noise."""
    copied = F.when(pairs >= cluster, 0.45 + F.least(F.lit(0.35), (pairs - cluster) * 0.02)).otherwise(0.0)
    spliced = F.when(((noise > 0.65) & (ela > 80)) | (noise > 0.8), 0.4).otherwise(0.0)
    return clip(0.05 + copied + spliced + noise * 0.2)


def voice_ensemble_app(model: Column, phase: Column, f0_mean: Column, f0_variance: Column, splices: Column) -> Column:
    pitch = F.when(f0_mean > 0, F.when(f0_variance < 35, 0.75).when(f0_variance > 3500, 0.7).when(f0_variance < 80, 0.5).otherwise(0.2)).otherwise(0.2)
    return clip(0.6 * model + 0.25 * phase + 0.15 * pitch + F.least(F.lit(0.1), 0.03 * splices))


def frequency_app(peaks: Column, high_ratio: Column) -> Column:
    return clip(0.6 * F.least(F.lit(1.0), peaks / 100) + 0.4 * F.least(F.lit(1.0), F.abs(high_ratio - 0.15) * 4))


def temporal_app(difference: Column, flow: Column, laplacian: Column) -> Column:
    one = F.lit(1.0)
    return clip(0.4 * F.least(one, difference / 50) + 0.35 * F.least(one, flow / 20) + 0.25 * F.least(one, laplacian / 40))


def splice_composite(rms: Column, flux: Column, phase: Column, t: Column, duration: Column, margin: float = 0.15) -> Column:
    return F.when((t >= margin) & (t <= duration - margin), 0.5 * rms + 0.35 * flux + 0.15 * phase).otherwise(0.0)


def ordinal_ranks(df: DataFrame, levels: list[str], order: list[str]) -> DataFrame:
    """Adds `place` (1..n) over all rows in `order`, where `levels` sort coarse to fine the way `order` does.

    Rows are numbered within the finest level; what lies before comes from counts, level by level. The first level has to
    have few values, and the finest few rows each, however the values are spread.
    """
    fine = df.groupBy(*levels).agg(F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(W.partitionBy(*levels).orderBy(*order)).cast("long")
    out = df.withColumn("place", place)
    for k in range(len(levels)):
        sums = fine.groupBy(*levels[: k + 1]).agg(F.sum("rows").alias("rows"))
        before = F.coalesce(F.sum("rows").over(W.partitionBy(*levels[:k]).orderBy(levels[k]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        out = out.join(sums.withColumn("before", before).drop("rows"), levels[: k + 1]).withColumn("place", F.col("place") + F.col("before")).drop("before")
    return out


def classification_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of counts, accuracy, precision, recall, f1 and auc of (id, y_true, y_prob); 0 where undefined. Rows with nulls don't count.

    The area is that of ordinal ranks: equal scores are ordered by id, not averaged.
    """
    rows = scored.dropna(subset=["id", "y_true", "y_prob"]).withColumn("bucket", F.floor(F.col("y_prob") * 4096)).withColumn("block", F.floor(F.col("id") / 65536))
    ranked = ordinal_ranks(rows, ["bucket", "y_prob", "block"], ["y_prob", "id"])
    hit, true = F.col("y_prob") >= threshold, F.col("y_true") == 1
    c = ranked.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"), F.coalesce(F.sum(F.when(true, F.col("place"))), F.lit(0)).alias("ranks"))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.expr(b) > 0, F.expr(f"({a}) / ({b})")).otherwise(0.0)

    return c.select("tp", "fp", "fn", "tn", ratio("tp + tn", "tp + fp + fn + tn").alias("accuracy"), ratio("tp", "tp + fp").alias("precision"), ratio("tp", "tp + fn").alias("recall"), ratio("2 * tp", "2 * tp + fp + fn").alias("f1"), ratio("ranks - (tp + fn) * (tp + fn + 1) / 2", "(tp + fn) * (fp + tn)").alias("auc"))


def equal_error_rate(scored: DataFrame, steps: int = 1000) -> DataFrame:
    """(eer, threshold) on an even grid from 0 to 1: the first point where the share of genuine rows (y_true 0) above and that of
    others at or below differ least. (0, 0.5) if a class is empty. Every row counts at the first grid point not below it."""
    last = steps - 1
    near = F.greatest(F.lit(0), F.least(F.lit(steps), F.ceil(F.col("y_prob") * last)))
    point = F.when((near > 0) & ((near - 1) / last >= F.col("y_prob")), near - 1).when(near / last < F.col("y_prob"), near + 1).otherwise(near)
    counts = scored.dropna(subset=["y_true", "y_prob"]).groupBy(point.cast("long").alias("i")).agg(F.count_if(F.col("y_true") == 0).alias("genuine"), F.count_if(F.col("y_true") != 0).alias("other"))
    # at most steps + 1 rows from here on
    w, whole = W.orderBy("i"), W.orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    grid = scored.sparkSession.range(steps + 1).withColumnRenamed("id", "i").join(counts, "i", "left").na.fill(0)
    shares = grid.select("i", (1 - F.sum("genuine").over(w) / F.nullif(F.sum("genuine").over(whole), F.lit(0))).alias("frr"), (F.sum("other").over(w) / F.nullif(F.sum("other").over(whole), F.lit(0))).alias("far"))
    best = shares.filter(F.col("i") < steps).agg(F.min_by(F.struct("i", "frr", "far"), F.struct(F.round(F.abs(F.col("frr") - F.col("far")), 12), "i")).alias("b"))
    return best.select(F.coalesce(F.round((F.col("b.frr") + F.col("b.far")) / 2, 4), F.lit(0.0)).alias("eer"), F.when((F.col("b.frr") + F.col("b.far")).isNull(), 0.5).otherwise(F.round(F.col("b.i") / last, 4)).alias("threshold"))


def holdout_split(df: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """Adds `validation`: the max(1, floor(n * share)) rows first by a hash of the key; the same rows in every run."""
    hashed = df.withColumn("h", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 10), 16, 10).cast("long")).withColumn("bucket", F.expr("shiftright(h, 28)"))
    total = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("most"))
    return ordinal_ranks(hashed, ["bucket"], ["h", key]).crossJoin(F.broadcast(total)).withColumn("validation", F.col("place") <= F.col("most")).drop("h", "bucket", "place", "most")


#: Measures of a medium, one row for each event, by expressions that both engines read alike.
PROBE = {
    "event_id": "event_id", "media_id": "user_id", "p": "least(1.0D, value / 500)", "q": "cast(event_id % 97 AS double) / 96", "r": "cast(event_id % 89 AS double) / 88", "offset_ms": "cast(event_id * 7 % 1001 AS double) - 500",
    "net_ms": "cast(event_id * 13 % 801 AS double) - 400", "distance": "cast(event_id % 41 AS double) / 20", "status": "CASE event_id % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'PROCESSING' ELSE 'COMPLETED' END",
}
PROBE_SQL = "probe AS (SELECT " + ", ".join(f"{v.replace('1.0D', '1.0')} AS {k}" for k, v in PROBE.items()) + " FROM events)"
METADATA = {
    "media_id": "o_orderkey", "media_type": "CASE o_orderkey % 3 WHEN 0 THEN 'IMAGE' WHEN 1 THEN 'VIDEO' ELSE 'AUDIO' END",
    "software": "CASE o_orderkey % 7 WHEN 0 THEN 'Adobe Photoshop 24' WHEN 1 THEN 'Lavf58.29' WHEN 2 THEN 'Android 13' WHEN 3 THEN 'GIMP via FFmpeg' WHEN 4 THEN '' WHEN 5 THEN 'HandBrake' END",
    "make": "CASE o_orderkey % 5 WHEN 0 THEN 'Canon' WHEN 1 THEN 'NIKON CORP' WHEN 2 THEN 'Apple' END", "model": "CASE WHEN o_orderkey % 9 > 3 THEN 'M' END",
    "captured_at": "cast(o_orderdate AS timestamp)", "modified_at": "cast(l_shipdate AS timestamp) - INTERVAL 60 DAY", "latitude": "CASE o_orderkey % 11 WHEN 0 THEN 0.0 WHEN 1 THEN 95.0 WHEN 2 THEN NULL ELSE l_quantity END",
    "longitude": "CASE o_orderkey % 11 WHEN 0 THEN 0.00001 WHEN 3 THEN -181.0 ELSE l_quantity END", "container": "CASE WHEN o_orderkey % 2 = 0 THEN 'mp4' END", "codec": "CASE WHEN o_orderkey % 8 > 4 THEN 'h264' END",
    "duration": "CASE WHEN o_orderkey % 6 = 0 THEN l_quantity END", "exif_present": "o_orderkey % 4 = 0",
}
METADATA_SQL = "meta AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in METADATA.items()) + " FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS l_shipdate, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"


def probes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*(f"{v} AS {k}" for k, v in PROBE.items()))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("l_shipdate"), F.max("l_quantity").alias("l_quantity"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(first, "o_orderkey").selectExpr(*(f"{v} AS {k}" for k, v in METADATA.items()))


def _any(column: str, words: tuple[str, ...]) -> str:
    return f"coalesce(regexp_matches(lower({column}), '{'|'.join(words)}'), false)"


_ANOMALIES_SQL = (
    f"{METADATA_SQL}, f AS (SELECT *, {_any('software', EDITORS)} AS edited, TIMESTAMP '1998-01-01 01:00:00' AS late, latitude < -90 OR latitude > 90 OR longitude < -180 OR longitude > 180 AS outside FROM meta), "
    f"c AS (SELECT media_id, edited AS r1, NOT edited AND {_any('software', ENCODERS)} AS r2, captured_at > late AS r3, modified_at > late AS r4, modified_at < captured_at - INTERVAL 1 MINUTE AS r5, media_type = 'IMAGE' AND NOT exif_present AND make IS NULL AND model IS NULL AS r6, "
    f"{_any('make', MAKERS)} AND {_any('software', FOREIGN)} AS r7, latitude IS NOT NULL AND longitude IS NOT NULL AND outside AS r8, coalesce(NOT outside AND abs(latitude) < 0.0001 AND abs(longitude) < 0.0001, false) AS r9, media_type = 'VIDEO' AND container IS NOT NULL AND codec IS NULL AND duration IS NULL AS r10 FROM f), "
    "s AS (SELECT *, least(1.0, (35 * (r1::INT + r3::INT + r4::INT + r7::INT + r8::INT) + 20 * (r2::INT + r5::INT + r9::INT + r10::INT) + 5 * r6::INT) / 100) AS score FROM c), "
    "an AS (SELECT media_id, concat_ws(',', CASE WHEN r1 THEN 'ANOM_EDITING_SOFTWARE' END, CASE WHEN r2 THEN 'ANOM_RE_ENCODING_SOFTWARE' END, CASE WHEN r3 THEN 'ANOM_FUTURE_CAPTURE_TIMESTAMP' END, CASE WHEN r4 THEN 'ANOM_FUTURE_MODIFY_TIMESTAMP' END, CASE WHEN r5 THEN 'ANOM_TIMESTAMP_INCONSISTENCY' END, "
    "CASE WHEN r6 THEN 'ANOM_METADATA_STRIPPED' END, CASE WHEN r7 THEN 'ANOM_CAMERA_SOFTWARE_MISMATCH' END, CASE WHEN r8 THEN 'ANOM_GPS_OUT_OF_BOUNDS' END, CASE WHEN r9 THEN 'ANOM_GPS_NULL_ISLAND' END, CASE WHEN r10 THEN 'ANOM_VIDEO_STREAM_INCONSISTENCY' END) AS codes, score, "
    "CASE WHEN score <= 0 THEN 'CLEAN' WHEN score < 0.5 THEN 'SUSPICIOUS' ELSE 'HIGH_RISK' END AS risk FROM s)"
)


@query("r1_metadata_anomalies", f"WITH {_ANOMALIES_SQL} SELECT * FROM an")
def r1(spark: SparkSession, d: str) -> DataFrame:
    """Findings as of the start of 1998, with the risk level of their sum."""
    out = metadata(spark, d).withColumn("found", anomalies(F.lit("1998-01-01 00:00:00").cast("timestamp"))).withColumn("score", anomaly_score(F.col("found")))
    return out.select("media_id", F.array_join("found.code", ",").alias("codes"), "score", risk_level(F.col("score")).alias("risk"))


def anomalous(found: DataFrame, media_: DataFrame) -> DataFrame:
    """media's rows of which found(media_id, found) has findings, with their codes and score, the highest score first, then
    by media_id. Findings of a medium that isn't there, null or empty ones don't show."""
    own = found.filter(F.size("found") > 0).select("media_id", F.array_join("found.code", ",").alias("codes"), anomaly_score(F.col("found")).alias("score"))
    return media_.join(own, "media_id").orderBy(F.desc("score"), "media_id")


@query("f4_anomalous_metadata", f"WITH {MEDIA_SQL}, {_ANOMALIES_SQL} SELECT media_id, uploader, media_type, codes, score FROM media JOIN an USING (media_id) WHERE codes <> '' ORDER BY score DESC, media_id")
def f4(spark: SparkSession, d: str) -> DataFrame:
    """Every medium with findings about its metadata."""
    found = metadata(spark, d).select("media_id", anomalies(F.lit("1998-01-01 00:00:00").cast("timestamp")).alias("found"))
    return anomalous(found, media(spark, d).select("media_id", "uploader", "media_type"))


STATUS_SQL = "CASE WHEN status = 'FAILED' THEN 'ANALYSIS_FAILED' WHEN status IN ('PENDING', 'PROCESSING') THEN 'IN_PROGRESS'"


@query(
    "r3_assessments",
    f"WITH {PROBE_SQL} SELECT event_id, {STATUS_SQL} WHEN p >= 0.75 AND q >= 0.75 THEN 'HIGH_SYNTHETIC_AND_MANIPULATION_RISK' WHEN p >= 0.75 THEN 'HIGH_SYNTHETIC_RISK' WHEN q >= 0.75 THEN 'HIGH_MANIPULATION_RISK' WHEN p >= 0.5 OR q >= 0.5 THEN 'SUSPICIOUS_ANOMALIES_DETECTED' WHEN p <= 0.25 AND q <= 0.25 THEN 'LOW_ANOMALY_LEVEL' ELSE 'MODERATE_ANOMALY_LEVEL' END AS image, "
    f"{STATUS_SQL} WHEN q >= 0.75 THEN 'HIGH_DEEPFAKE_RISK' WHEN q >= 0.5 THEN 'SUSPICIOUS_DEEPFAKE_INDICATORS' WHEN q <= 0.25 THEN 'LOW_DEEPFAKE_RISK' ELSE 'MODERATE_DEEPFAKE_RISK' END AS video, "
    f"{STATUS_SQL} WHEN r >= 0.75 THEN 'HIGH_SYNTHETIC_VOICE_RISK' WHEN r >= 0.5 THEN 'SUSPICIOUS_VOICE_CLONING_INDICATORS' WHEN r <= 0.25 THEN 'LIKELY_AUTHENTIC_AUDIO' ELSE 'MODERATE_SYNTHETIC_VOICE_RISK' END AS audio, "
    "CASE WHEN status = 'FAILED' THEN 'ANALYSIS_FAILED' WHEN r >= 0.75 AND abs(offset_ms) <= 60 THEN 'SYNCHRONIZED' WHEN r < 0.4 OR abs(offset_ms) > 180 THEN 'SUSPECTED_DUBBING_OR_DESYNC' ELSE 'ANOMALOUS_SYNCHRONIZATION' END AS sync FROM probe",
)
def r3(spark: SparkSession, d: str) -> DataFrame:
    """Assessments of images, videos, sound and synchrony (R3 to R6)."""
    p, q, r, s = map(F.col, ("p", "q", "r", "status"))
    return probes(spark, d).select("event_id", image_assessment(p, q, s).alias("image"), video_assessment(q, s).alias("video"), audio_assessment(r, s).alias("audio"), sync_assessment(r, F.col("offset_ms"), s).alias("sync"))


def clip_sql(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


@query(
    "r7_composite_sync",
    f"WITH {PROBE_SQL}, a AS (SELECT *, abs(offset_ms) AS o, {clip_sql('(2 * p - 1) + 0.2')} AS cf, {clip_sql('(1.4 - distance) / 0.8')} AS df FROM probe), b AS (SELECT *, {clip_sql('(1.0 - 0.5 * ' + clip_sql('(o - 60) / 340') + ') * (0.3 + 0.45 * cf + 0.25 * df)')} AS s FROM a) "
    "SELECT event_id, round(CASE WHEN event_id % 11 = 0 THEN 0.0 WHEN event_id % 7 = 0 THEN 0.0 WHEN q <= 0.05 AND r <= 0.08 THEN 0.5 ELSE s END, 11) AS score, round(CASE WHEN event_id % 11 = 0 THEN 1.0 WHEN event_id % 7 = 0 THEN 0.9 WHEN q <= 0.05 AND r <= 0.08 THEN 0.5 ELSE greatest(0.1, least(1.0, 0.5 * cf + 0.3 * q + 0.2)) END, 11) AS confidence, "
    "CASE WHEN event_id % 11 = 0 THEN 'NO_AUDIO_TRACK' WHEN event_id % 7 = 0 THEN 'NO_FACE_DETECTED' WHEN q <= 0.05 AND r <= 0.08 THEN 'SILENT_OR_INACTIVE' WHEN o <= 80 AND s >= 0.7 THEN 'ALIGNED' WHEN o <= 160 AND s >= 0.45 THEN 'SLIGHT_DESYNC' ELSE 'SEVERE_DESYNC' END AS status FROM b",
)
def r7(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x = composite_sync(c("offset_ms"), 2 * c("p") - 1, c("distance"), c("q"), c("event_id") % 7 != 0, c("event_id") % 11 != 0, c("q") > 0.05, c("r") > 0.08)
    return probes(spark, d).select("event_id", x.alias("x")).select("event_id", F.round("x.score", 11).alias("score"), F.round("x.confidence", 11).alias("confidence"), "x.status")


@query(
    "r7v_composite_sync_app",
    f"WITH {PROBE_SQL}, a AS (SELECT *, (offset_ms * greatest(0.1, q) + net_ms * greatest(0.1, r)) / (greatest(0.1, q) + greatest(0.1, r)) AS o FROM probe), "
    f"b AS (SELECT *, CASE WHEN abs(o) <= 60 THEN 1.0 WHEN abs(o) <= 200 THEN 1.0 - ((abs(o) - 60) / 140) * 0.45 WHEN abs(o) <= 400 THEN 0.55 - ((abs(o) - 200) / 200) * 0.35 ELSE 0.2 END * 0.4 + {clip_sql('((2 * p - 1) + 0.5) / 1.5')} * 0.35 + {clip_sql('1.0 - distance / 2')} * 0.25 AS raw FROM a) "
    f"SELECT event_id, round({clip_sql('CASE WHEN p < 0.3 THEN raw * (0.5 + p * 1.5) ELSE raw END')}, 11) AS score, round(o, 7) AS offset_ms, round({clip_sql('q * 0.4 + r * 0.3 + p * 0.3')}, 11) AS confidence FROM b",
)
def r7v(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x = composite_sync_app(c("offset_ms"), 2 * c("p") - 1, c("q"), c("net_ms"), c("distance"), c("r"), c("p"))
    return probes(spark, d).select("event_id", x.alias("x")).select("event_id", *(F.round(f"x.{n}", k).alias(n) for n, k in {"score": 11, "offset_ms": 7, "confidence": 11}.items()))


@query(
    "r8_fused_offset",
    f"WITH {PROBE_SQL} SELECT event_id, CASE WHEN q >= 0.35 AND r >= 0.35 THEN {half_up_sql('(offset_ms * q + net_ms * r) / (q + r)', 1)} WHEN q >= 0.35 THEN offset_ms WHEN r >= 0.35 THEN net_ms ELSE offset_ms END AS offset_ms FROM probe",
)
def r8(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return probes(spark, d).select("event_id", fused_offset(c("offset_ms"), c("q"), c("net_ms"), c("r")).alias("offset_ms"))


@query(
    "r9_manipulation",
    f"WITH {PROBE_SQL} SELECT event_id, greatest(p, q, r) AS strongest, round({clip_sql('0.05 + CASE WHEN event_id % 40 >= 8 THEN 0.45 + least(0.35, (event_id % 40 - 8) * 0.02) ELSE 0.0 END + CASE WHEN (p > 0.65 AND q * 120 > 80) OR p > 0.8 THEN 0.4 ELSE 0.0 END + p * 0.2')}, 11) AS additive FROM probe",
)
def r9(spark: SparkSession, d: str) -> DataFrame:
    """The strongest of three findings (R9), and the other profile's sum (R9v)."""
    return probes(spark, d).select("event_id", F.greatest("p", "q", "r").alias("strongest"), F.round(manipulation_app(F.col("event_id") % 40, F.col("p"), F.col("q") * 120), 11).alias("additive"))


@query(
    "r10_signal_composites",
    f"WITH {PROBE_SQL} SELECT event_id, round(CASE WHEN distance >= 0.15 AND distance <= 2 - 0.15 THEN 0.5 * p + 0.35 * q + 0.15 * r ELSE 0.0 END, 11) AS splice, "
    f"round({clip_sql('0.6 * p + 0.25 * q + 0.15 * CASE WHEN offset_ms > 0 THEN CASE WHEN net_ms * 20 < 35 THEN 0.75 WHEN net_ms * 20 > 3500 THEN 0.7 WHEN net_ms * 20 < 80 THEN 0.5 ELSE 0.2 END ELSE 0.2 END + least(0.1, 0.03 * (event_id % 6))')}, 11) AS voice, "
    f"round({clip_sql('0.6 * least(1.0, (event_id % 150) / 100) + 0.4 * least(1.0, abs(q - 0.15) * 4)')}, 11) AS frequency, round({clip_sql('0.4 * least(1.0, p * 100 / 50) + 0.35 * least(1.0, q * 40 / 20) + 0.25 * least(1.0, r * 80 / 40)')}, 11) AS temporal FROM probe",
)
def r10(spark: SparkSession, d: str) -> DataFrame:
    """Composites of given measures: splices (R10), voices (R11), spectra (R12), change over time (R14)."""
    c = F.col
    voice = voice_ensemble_app(c("p"), c("q"), c("offset_ms"), c("net_ms") * 20, c("event_id") % 6)
    return probes(spark, d).select("event_id", *(F.round(x, 11).alias(n) for n, x in {"splice": splice_composite(c("p"), c("q"), c("r"), c("distance"), F.lit(2.0)), "voice": voice, "frequency": frequency_app(c("event_id") % 150, c("q")), "temporal": temporal_app(c("p") * 100, c("q") * 40, c("r") * 80)}.items()))


@query(
    "r13_primary_score",
    f"WITH {PROBE_SQL} SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN floor(greatest(p, q) * 100 + 0.5) WHEN event_id % 5 = 0 THEN floor(p * 100 + 0.5) WHEN event_id % 7 = 0 THEN floor(r * 100 + 0.5) END AS BIGINT) AS score, "
    "CASE WHEN event_id % 3 = 0 THEN CASE WHEN p > q THEN 'AI Probability' ELSE 'Manipulation Probability' END WHEN event_id % 5 = 0 THEN 'Deepfake Probability' WHEN event_id % 7 = 0 THEN 'Synthetic Voice Probability' ELSE 'AI / Manipulation Likelihood' END AS label FROM probe",
)
def r13(spark: SparkSession, d: str) -> DataFrame:
    """The first analysis that a medium has, of image, video and sound."""
    c, pct = F.col, lambda x: F.floor(x * 100 + 0.5)
    has = lambda n, score, label: F.when(c("event_id") % n == 0, F.struct(score.alias("score"), label.alias("label")))
    first = F.coalesce(has(3, pct(F.greatest("p", "q")), F.when(c("p") > c("q"), "AI Probability").otherwise("Manipulation Probability")), has(5, pct(c("p")), F.lit("Deepfake Probability")), has(7, pct(c("r")), F.lit("Synthetic Voice Probability")))
    return probes(spark, d).select("event_id", first.alias("x")).select("event_id", "x.score", F.coalesce("x.label", F.lit("AI / Manipulation Likelihood")).alias("label"))


@query("x15_confidence_percent", f"WITH {FRAMES_SQL} SELECT event_id, CAST(floor(score * 100 + 0.5) AS BIGINT) AS percent FROM frames")
def x15(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("event_id", F.floor(F.col("score") * 100 + 0.5).alias("percent"))


@query("a3_top_fraction_mean", f"WITH {FRAMES_SQL}, o AS (SELECT media_id, score, row_number() OVER (PARTITION BY media_id ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY media_id) AS n FROM frames) SELECT media_id, round(greatest(0.0, least(1.0, avg(score))), 4) AS top_mean FROM o WHERE k <= greatest(1, ceil(0.35 * n)) GROUP BY media_id")
def a3(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("media_id")
    ranked = frames(spark, d).select("media_id", "score", F.row_number().over(w.orderBy(F.desc("score"))).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.filter(F.col("k") <= F.greatest(F.lit(1), F.ceil(0.35 * F.col("n")))).groupBy("media_id").agg(F.round(clip(F.avg("score")), 4).alias("top_mean"))


@query(
    "a4_percentile_blend",
    f"WITH {FRAMES_SQL} SELECT media_id, round(CASE WHEN count(*) = 1 THEN max(score) ELSE 0.7 * quantile_cont(score, 0.85) + 0.3 * avg(score) END, 8) AS blend, round({clip_sql('0.5 * quantile_cont(score, 0.9) + 0.25 * avg(score) + 0.25 * quantile_cont(abs(2 * score - 1), 0.9)')}, 8) AS blend_app FROM frames GROUP BY media_id",
)
def a4(spark: SparkSession, d: str) -> DataFrame:
    """The 85th percentile and the mean (A4), and the other profile's blend with the 90th of a second measure (A4v)."""
    s = F.col("score")
    high, app = F.percentile("score", F.lit(0.85)), clip(0.5 * F.percentile("score", F.lit(0.9)) + 0.25 * F.avg("score") + 0.25 * F.percentile(F.abs(2 * s - 1), F.lit(0.9)))
    return frames(spark, d).groupBy("media_id").agg(F.round(F.when(F.count(F.lit(1)) == 1, F.max("score")).otherwise(0.7 * high + 0.3 * F.avg("score")), 8).alias("blend"), F.round(app, 8).alias("blend_app"))


@query("a8_region_rollup", f"WITH {LINES_SQL} SELECT media_id, round(coalesce(avg(0.5 + (y % 50) / 100), 1.0), 8) AS confidence, md5(coalesce(string_agg(CASE WHEN trim(text) <> '' THEN trim(text) END, chr(10) ORDER BY y), '')) AS text_md5, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM lines GROUP BY media_id")
def a8(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence, the trimmed texts that aren't empty by line (as their digest) and the languages."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("y", F.trim("text").alias("text"))))), lambda x: x["text"]), "\n")
    return lines(spark, d).groupBy("media_id").agg(F.round(F.coalesce(F.avg(0.5 + (F.col("y") % 50) / 100), F.lit(1.0)), 8).alias("confidence"), F.md5(text.cast("binary")).alias("text_md5"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


@query(
    "a9_transcript_rollup",
    f"WITH {SEGMENTS_SQL}, s AS (SELECT *, round(greatest(0.0, least(1.0, exp(-(length(text) % 100) / 100))), 4) AS c FROM segments) SELECT media_id, round(avg(c), 8) AS confidence, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words, md5(string_agg(trim(text, ' '), ' ' ORDER BY seg)) AS text_md5 FROM s GROUP BY media_id",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    """Confidence exp(mean log-probability) of each segment, averaged; words; the joined text (as its digest)."""
    sure = F.round(clip(F.exp(-(F.length("text") % 100) / 100)), 4)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.trim("text").alias("text")))), lambda x: x["text"]), " ")
    return segments(spark, d).groupBy("media_id").agg(F.round(F.avg(sure), 8).alias("confidence"), F.sum(F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")).cast("long")).alias("words"), F.md5(text.cast("binary")).alias("text_md5"))


def _ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END"


@query(
    "a10_classification_metrics",
    f"WITH {SCORED_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY y_prob, id) AS place FROM scored), c AS (SELECT count_if(y_prob >= 0.5 AND y_true = 1) AS tp, count_if(y_prob >= 0.5 AND y_true = 0) AS fp, count_if(y_prob < 0.5 AND y_true = 1) AS fn, count_if(y_prob < 0.5 AND y_true = 0) AS tn, sum(CASE WHEN y_true = 1 THEN place END) AS ranks FROM k) "
    f"SELECT tp, fp, fn, tn, {_ratio_sql('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_ratio_sql('tp', 'tp + fp')} AS precision, {_ratio_sql('tp', 'tp + fn')} AS recall, {_ratio_sql('2 * tp', '2 * tp + fp + fn')} AS f1, {_ratio_sql('ranks - (tp + fn) * (tp + fn + 1) / 2', '(tp + fn) * (fp + tn)')} AS auc FROM c",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    return classification_metrics(scored_labels(spark, d))


@query(
    "a11_equal_error_rate",
    f"WITH {SCORED_SQL}, g AS (SELECT i, CAST(i AS DOUBLE) / 999 AS th FROM range(1000) u(i)), x AS (SELECT i, th, avg(CASE WHEN y_true = 0 THEN CAST(y_prob > th AS INT) END) AS frr, avg(CASE WHEN y_true <> 0 THEN CAST(y_prob <= th AS INT) END) AS far FROM g, scored GROUP BY i, th), b AS (SELECT * FROM x ORDER BY round(abs(frr - far), 12), i LIMIT 1) "
    "SELECT coalesce(round((frr + far) / 2, 4), 0.0) AS eer, CASE WHEN frr + far IS NULL THEN 0.5 ELSE round(th, 4) END AS threshold FROM b",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    return equal_error_rate(scored_labels(spark, d))


@query("a12_face_counts", f"WITH {FRAMES_SQL} SELECT media_id, max(event_id % 5) AS faces, count(DISTINCT event_type) AS tracks FROM frames GROUP BY media_id")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).groupBy("media_id").agg(F.max(F.col("event_id") % 5).alias("faces"), F.count_distinct("event_type").alias("tracks"))


@query(
    "a13_primary_speaker",
    f"WITH {FRAMES_SQL}, t AS (SELECT media_id, event_type AS track, count(*) AS n, min(event_id) AS first, avg(score * 50000) AS area, CASE WHEN count(*) > 1 THEN var_pop(score) ELSE 0.0 END AS mar FROM frames GROUP BY media_id, event_type), s AS (SELECT *, round(0.4 * n / (SELECT max(k) FROM (SELECT count(DISTINCT t) AS k FROM frames f WHERE f.media_id = t.media_id)) + 0.3 * least(1.0, area / 40000) + 0.3 * least(1.0, 50 * mar), 11) AS score FROM t) "
    "SELECT media_id, arg_max(track, (score, -first)) AS track, max(score) AS score FROM s GROUP BY media_id",
)
def a13(spark: SparkSession, d: str) -> DataFrame:
    """The track with the highest blend of persistence (share of the medium's frames), area and movement, the first of equals; event types stand for tracks."""
    t = frames(spark, d).groupBy("media_id", F.col("event_type").alias("track")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.avg(F.col("score") * 50000).alias("area"), F.var_pop("score").alias("mar"))
    t = t.join(frames(spark, d).groupBy("media_id").agg(F.count_distinct("t").alias("frames")), "media_id")
    score = 0.4 * F.col("n") / F.col("frames") + 0.3 * F.least(F.lit(1.0), F.col("area") / 40000) + 0.3 * F.least(F.lit(1.0), 50 * F.col("mar"))
    return t.withColumn("score", F.round(score, 11)).groupBy("media_id").agg(F.max_by("track", F.struct("score", -F.col("first"))).alias("track"), F.max("score").alias("score"))


@query("a14_holdout_split", "WITH r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))[1:10], doc_id) AS place, count(*) OVER () AS n FROM labels) SELECT doc_id, quality, place <= greatest(1, floor(n * 0.2)) AS validation FROM r")
def a14(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the labelled documents for validation, by a hash of the id."""
    return holdout_split(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
