import random

from pyspark.sql import functions as F

from mediasift.operators.scoring import anomalies, anomaly_score, classification_metrics, composite_sync, equal_error_rate, holdout_split, image_assessment, ordinal_ranks, risk_level
from mediasift.operators.timeline import consolidate_text, gap_clusters, interpolate, merge_intervals, sliding_windows


def test_gap_clusters_take_the_first_peak(spark):
    rows = [(1, 0, 1.0, 0.6, 0.1), (1, 1, 1.5, 0.9, 0.5), (1, 2, 2.0, 0.9, 0.1), (1, 3, 3.0, 0.55, 0.1), (1, 4, 10.0, 0.75, 0.0), (2, 5, None, 0.9, 0.0)]
    df = spark.createDataFrame(rows, "media_id int, event_id long, t double, score double, inconsistency double")
    got = [(r.start, r.end, r.event_id, r.score, r.reason) for r in gap_clusters(df, 1.5).orderBy("start").collect()]
    assert got == [(1.0, 3.0, 1, 0.9, "Facial synthesis anomaly & boundary discontinuity (score: 0.90)"), (10.0, 10.0, 4, 0.75, "High facial artifact anomaly (score: 0.75)")]


def test_intervals_merge_within_a_kind(spark):
    rows = [("a", 0.0, 1.0, "MEDIUM", 10.0, 1), ("a", 1.25, 1.5, "HIGH", 20.0, 2), ("a", 1.3, 1.4, "MEDIUM", 40.0, 3), ("a", 1.76, 2.0, "LOW", 5.0, 4), ("b", 0.0, 9.0, "LOW", 1.0, 5)]
    df = spark.createDataFrame([(1, *r) for r in rows], "media_id int, kind string, start double, end double, severity string, offset_ms double, seq int")
    got = {tuple(r) for r in merge_intervals(df, 0.25).collect()}
    assert got == {(1, "a", 0.0, 1.5, 3, "HIGH", 27.5), (1, "a", 1.76, 2.0, 1, "LOW", 5.0), (1, "b", 0.0, 9.0, 1, "LOW", 1.0)}


def test_text_is_consolidated_over_neighbouring_samples(spark):
    rows = [(1, 0.0, 1.0, 0, "News ", 0.9), (1, 1.0, 2.0, 0, "NEWS", 0.7), (1, 9.0, 10.0, 0, "news", 0.5), (1, 0.0, 1.0, 1, "  ", 0.5)]
    df = spark.createDataFrame(rows, "media_id int, start double, end double, y int, text string, confidence double")
    assert {tuple(r) for r in consolidate_text(df, 1.0).collect()} == {(1, "news", 0.0, 2.0, 0, 2, 0.8), (1, "news", 9.0, 10.0, 0, 1, 0.5)}


def test_sliding_windows_equal_the_loop(spark):
    for n, size, hop in [(1, 4, 2), (4, 4, 2), (5, 4, 2), (9, 4, 3), (17, 8, 3), (20, 5, 5)]:
        want, start = [], 0
        while n <= size and start == 0 or n > size and start < n - size / 2:
            want.append((start // hop, min(start + size, n) - start))
            if start + size >= n:
                break
            start += hop
        df = spark.range(n).selectExpr("1 AS media_id", "id AS event_id", "double(id) AS t", "0.5D AS score")
        assert sorted((r.window, r.n) for r in sliding_windows(df, size, hop).collect()) == want


def test_interpolation_is_zero_outside(spark):
    source = spark.createDataFrame([(1, 1.0, 0.0), (1, 2.0, 1.0), (1, 3.0, 0.0)], "media_id int, t double, v double")
    target = spark.createDataFrame([(1, t, i) for i, t in enumerate((0.5, 1.5, 2.0, 2.5, 3.5))] + [(2, 1.0, 9)], "media_id int, t double, event_id long")
    assert [r.v for r in interpolate(source, target).orderBy("event_id").collect()] == [0.0, 0.5, 1.0, 0.5, 0.0, 0.0]


def metadata(spark, **given):
    kinds = {"media_type": "string", "software": "string", "make": "string", "model": "string", "captured_at": "timestamp", "modified_at": "timestamp", "latitude": "double", "longitude": "double", "container": "string", "codec": "string", "duration": "double", "exif_present": "boolean"}
    given = {"media_type": "IMAGE", "exif_present": True} | given
    df = spark.range(1).select(*(F.lit(given.get(k)).cast(t).alias(k) for k, t in kinds.items()))
    row = df.withColumn("f", anomalies(F.lit("2024-01-01 00:00:00").cast("timestamp"))).withColumn("s", anomaly_score(F.col("f"))).select("f.code", "s", risk_level(F.col("s")).alias("r")).first()
    return row.code, row.s, row.r


def test_metadata_rules(spark):
    assert metadata(spark) == ([], 0.0, "CLEAN")
    assert metadata(spark, software="GIMP with ffmpeg") == (["ANOM_EDITING_SOFTWARE"], 0.35, "SUSPICIOUS")
    assert metadata(spark, software="Canva", make="Canon EOS") == (["ANOM_EDITING_SOFTWARE", "ANOM_CAMERA_SOFTWARE_MISMATCH"], 0.7, "HIGH_RISK")
    assert metadata(spark, exif_present=False, latitude=0.0, longitude=0.0) == (["ANOM_METADATA_STRIPPED", "ANOM_GPS_NULL_ISLAND"], 0.25, "SUSPICIOUS")
    assert metadata(spark, captured_at="2024-01-01 01:00:00")[0] == []
    assert metadata(spark, captured_at="2024-01-01 01:00:01", modified_at="2023-01-01 00:00:00", latitude=91.0, longitude=0.0)[0] == ["ANOM_FUTURE_CAPTURE_TIMESTAMP", "ANOM_TIMESTAMP_INCONSISTENCY", "ANOM_GPS_OUT_OF_BOUNDS"]
    assert metadata(spark, media_type="VIDEO", container="mp4") == (["ANOM_VIDEO_STREAM_INCONSISTENCY"], 0.2, "SUSPICIOUS")


def test_assessments(spark):
    df = spark.createDataFrame([(0.8, 0.8, "COMPLETED"), (0.8, 0.1, "COMPLETED"), (0.1, 0.5, "COMPLETED"), (0.3, 0.3, "COMPLETED"), (0.9, 0.9, "FAILED")], "a double, m double, s string")
    got = [r[0] for r in df.select(image_assessment(F.col("a"), F.col("m"), F.col("s"))).collect()]
    assert got == ["HIGH_SYNTHETIC_AND_MANIPULATION_RISK", "HIGH_SYNTHETIC_RISK", "SUSPICIOUS_ANOMALIES_DETECTED", "MODERATE_ANOMALY_LEVEL", "ANALYSIS_FAILED"]
    yes, no = F.lit(True), F.lit(False)
    rows = [composite_sync(F.lit(o), F.lit(0.8), F.lit(0.6), F.lit(1.0), yes, a, yes, yes) for o, a in ((0.0, yes), (-400.0, yes), (0.0, no))]
    first, second, third = spark.range(1).select(*(r.alias(f"x{i}") for i, r in enumerate(rows))).first()
    assert (round(first.score, 6), first.status) == (1.0, "ALIGNED") and (round(second.score, 6), second.status) == (0.5, "SEVERE_DESYNC") and third.status == "NO_AUDIO_TRACK"


def test_ranks_metrics_and_error_rate(spark):
    r = random.Random(3)
    rows = [(i * 40_000, r.randint(0, 1), r.choice([0.0, 0.25, 0.5, 1.0, r.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y_true int, y_prob double")
    place = {row[0]: k + 1 for k, row in enumerate(sorted(rows, key=lambda x: (x[2], x[0])))}
    leveled = df.withColumn("bucket", F.floor(F.col("y_prob") * 4096)).withColumn("block", F.floor(F.col("id") / 65536))
    assert {x.id: x.place for x in ordinal_ranks(leveled, ["bucket", "y_prob", "block"], ["y_prob", "id"]).collect()} == place
    m = classification_metrics(df).first()
    pos = [x for x in rows if x[1]]
    assert abs(m.auc - (sum(place[x[0]] for x in pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (300 - len(pos)))) < 1e-12
    assert m.tp == sum(x[2] >= 0.5 for x in pos) and m.tp + m.fn == len(pos)
    best = min(((abs(a - b), i, (a + b) / 2) for i in range(1000) for a, b in [(sum(x[2] > i / 999 for x in rows if not x[1]) / (300 - len(pos)), sum(x[2] <= i / 999 for x in pos) / len(pos))]), key=lambda x: (round(x[0], 12), x[1]))
    e = equal_error_rate(df).first()
    assert (e.eer, e.threshold) == (round(best[2], 4), round(best[1] / 999, 4))
    assert tuple(equal_error_rate(df.filter("y_true = 1")).first()) == (0.0, 0.5) and tuple(classification_metrics(df.limit(0)).first())[4:] == (0.0,) * 5
    assert holdout_split(df, "id").filter("validation").count() == 60 and holdout_split(df.limit(1), "id").filter("validation").count() == 1
