import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediasift.functions import signals as S
from mediasift.operators.catalog import bounded_json, delete_then_insert, is_picture, upsert
from mediasift.operators.signals import _closeness, _followed, best_lag, clip_frames, cross_correlation, numbered, onset_peaks, peaks, track


def series(n, seed, levels=None):
    r = random.Random(seed)
    return [r.choice(levels) if levels else r.random() for _ in range(n)]


def local_maxima(x):
    """Middles of runs that are higher than what is on either side."""
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def test_peaks_are_suppressed_by_taller_ones(spark):
    rows, want = [], set()
    for m in range(6):
        x = series(120, m, [0.1, 0.3, 0.5, 0.7, 0.9] if m % 2 else None)
        rows += [(m, i, v) for i, v in enumerate(x)]
        found, kept = [i for i in local_maxima(x) if x[i] >= 0.4], []
        for i in sorted(found, key=lambda i: (-x[i], -i)):
            if all(abs(i - k) >= 5 for k in kept):
                kept.append(i)
        want |= {(m, i, x[i]) for i in kept}
    df = spark.createDataFrame(rows, "media_id int, i long, score double")
    assert {tuple(r) for r in peaks(df, 0.4, 5).collect()} == want and peaks(df.limit(0), 0.4, 5).count() == 0


def test_onsets_wait(spark):
    x = np.array(series(300, 7)) ** 6 * 9
    least, want, last = max(1.5, np.quantile(x, 0.96) + 0.5 * x.std()), [], -99
    for i in range(len(x)):
        if x[i] == x[max(0, i - 5) : i + 5].max() and x[i] >= x[max(0, i - 7) : i + 7].mean() + 0.4 * least and i - last > 10:
            last = i
            if x[i] / x.max() >= 0.6:
                want.append((1, i, round(x[i] / x.max(), 4)))
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "media_id int, i long, score double")
    assert sorted(tuple(r)[:3] for r in onset_peaks(df).collect()) == want and want


def moved(n, shift, seed=2):
    base = np.convolve(series(n + 40, seed), np.ones(3) / 3, "same")
    return [(1, i, n, float(base[i + 20]), float(base[i + 20 - shift])) for i in range(n)]


def test_offsets_of_shifted_sound(spark):
    kinds = "media_id int, i long, n long, v double, a double"
    for shift in (-5, 0, 5):
        got = cross_correlation(spark.createDataFrame(moved(100, shift), kinds), 25.0, 500).first()
        assert abs(got.offset_ms - 40.0 * shift) < 1e-9 and got.peak > 0.8
        assert abs(cross_correlation(spark.createDataFrame(moved(100, shift), kinds), 25.0, 500, app=True).first().offset_ms - 40.0 * shift) < 1e-9
        assert best_lag(spark.createDataFrame(moved(100, shift), kinds), ["media_id"], 8, F.lit(8)).first().k == -shift
    silent = [(1, i, 10, 0.5, 0.0) for i in range(10)] + [(2, i, 3, float(i), float(i)) for i in range(3)]
    assert {tuple(r)[1:] for r in cross_correlation(spark.createDataFrame(silent, kinds), 25.0, 200).collect()} == {(0.0, 0.0, 0.0)}


def test_clip_frames(spark):
    for n, size in ((3, 8), (8, 8), (9, 8), (50, 8), (17, 16)):
        df = numbered(spark.range(n).selectExpr("1 AS media_id", "double(id) AS t", "id AS event_id"))
        got = [r.i for r in clip_frames(df, size).orderBy("place").collect()]
        assert got == ([min(k, n - 1) for k in range(size)] if n <= size else np.linspace(0, n - 1, size, dtype=int).tolist())


def iou(a, b):
    both = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])) * max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    return both / (a[3] * a[4] + b[3] * b[4] - both + 1e-6)


def test_suppressed_boxes(spark):
    r = random.Random(9)
    boxes = [(r.random(), float(r.randrange(50)), float(r.randrange(50)), float(r.randrange(5, 40)), float(r.randrange(5, 40))) for _ in range(60)]
    kept = []
    for b in sorted(boxes, reverse=True):
        if all(iou(k, b) <= 0.4 for k in kept):
            kept.append(b)
    df = spark.createDataFrame([(boxes,)], "b array<struct<score: double, x: double, y: double, width: double, height: double>>")
    assert [tuple(x) for x in df.select(S.suppressed(F.col("b"))).first()[0]] == kept


def test_tracks(spark):
    r = random.Random(4)
    rows, want = [], set()
    for m in range(3):
        tracks, fresh = {}, 0
        for f in range(0, 40, 1 + m):
            own = [(f * 10 + k, float(r.randrange(300)), float(r.randrange(300)), 60.0, 50.0) for k in range(r.randrange(4))]
            rows += [(m, f, *b) for b in own]
            if not own:
                continue
            free, now = {b[0]: b[1:] for b in own}, {}
            for name, last in tracks.items():
                near = [(d, k) for k, b in free.items() for d, o in [_closeness(last, b)] if d < 80 or o > 0.3]
                if near:
                    k = min(near, key=lambda x: x[0])[1]
                    now[name] = free.pop(k)
                    want.add((m, f, k, name))
            for k, b in free.items():
                now[fresh] = b
                want.add((m, f, k, fresh))
                fresh += 1
            tracks = now
    df = spark.createDataFrame(rows, "media_id int, frame int, box_id long, x double, y double, width double, height double")
    assert {tuple(x) for x in track(df).collect()} == want


def test_hash_of_flat_and_stepped_pictures(spark):
    flat, steps = [77] * 71 + [78], [(i * 37) % 256 for i in range(72)]
    bits = sum(1 << (y * 8 + x) for y in range(8) for x in range(8) if steps[y * 9 + x] > steps[y * 9 + x + 1])
    got = [r[0] % (1 << 64) for r in spark.createDataFrame([(1, flat), (2, steps)], "i int, s array<long>").orderBy("i").select(S.gradient_hash(F.col("s"))).collect()]
    assert got == [int.from_bytes(bytes([77] * 8), "big"), bits]


def test_bounded_json(spark):
    tree = {f"d{i}": {"t": "x" * 400} for i in range(40)}
    one = spark.createDataFrame([(tree,), ({},), (None,), ({"a": {"b": "c"}},)], "m map<string, map<string, string>>").select(bounded_json(F.col("m"), 5000)).collect()
    import json

    cut = json.loads(one[0][0])
    assert cut["_metadata_status"] == "TRUNCATED" and len(one[0][0]) < 5000 and set(cut["directories"]) < set(tree) and len(next(iter(cut["directories"].values()))["t"]) == 150 + len("... [truncated]")
    assert [r[0] for r in one[1:]] == ["{}", "{}", '{"a":{"b":"c"}}']


def test_stores(spark):
    old, new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"), spark.createDataFrame([(1, "z"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, delete_then_insert(old, new, "k").collect())) == [(1, "z"), (2, "c"), (3, "y")]
    assert sorted(map(tuple, upsert(old.filter("v <> 'b'"), new, ["k"], [F.col("v")]).collect())) == [(1, "z"), (2, "c"), (3, "y")]
    heads = [(bytearray(b"\x89PNG\r\n\x1a\n"), True), (bytearray(b"BM123456"), True), (bytearray(b"RIFF0000WEBP"), True), (bytearray(b"RIFF0000WAVE"), False), (bytearray(b"BM"), False), (None, False)]
    assert [r[0] for r in spark.createDataFrame([(i, h) for i, (h, _) in enumerate(heads)], "i int, c binary").orderBy("i").select(is_picture(F.col("c"))).collect()] == [x for _, x in heads]


def test_a_bound_below_a_frame_is_plain_correlation(spark):
    r = random.Random(6)
    rows = [(m, i, 12, r.random(), r.random()) for m in (1, 2) for i in range(12)] + [(3, i, 4, r.random(), r.random()) for i in range(4)] + [(4, i, 6, 0.5, r.random()) for i in range(6)]
    df = spark.createDataFrame(rows, "media_id long, i long, n long, v double, a double")
    got = {x.media_id: x for x in cross_correlation(df, 5.0, 60).collect()}
    for m in (1, 2):
        want = np.corrcoef([x[3] for x in rows if x[0] == m], [x[4] for x in rows if x[0] == m])[0, 1]
        assert got[m].peak == pytest.approx(want) and (got[m].offset_ms, got[m].confidence) == (0.0, 0.5)
    assert all(tuple(got[m])[1:] == (0.0, 0.0, 0.0) for m in (3, 4))


def test_tracks_leave_out_unknown_boxes(spark):
    rows = [(1, 0, 5, 0.0, 0.0, 10.0, 10.0), (1, 1, 6, 5.0, 0.0, 10.0, 10.0), (1, 1, 6, 2.0, 0.0, 10.0, 10.0), (None, 0, 7, 0.0, 0.0, 1.0, 1.0), (1, None, 8, 0.0, 0.0, 1.0, 1.0), (1, 2, None, 0.0, 0.0, 1.0, 1.0), (1, 3, 9, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "media_id long, frame long, box_id long, x double, y double, width double, height double")
    assert sorted(map(tuple, track(df).collect())) == [(1, 0, 5, 0), (1, 1, 6, 0)]
    assert track(df.limit(0)).count() == 0


def test_peaks_call_python_for_many_runs_at_once(spark):
    df = spark.createDataFrame([(1, i, float(i % 2)) for i in range(20)], "media_id long, i long, score double")
    plan = peaks(df, 0.4, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("size", [1, 2, 100])
def test_tracks_go_on_from_batch_to_batch(size):
    """Frames come as lists of boxes; where a batch ends makes no difference."""
    frames = [(m, f, [1, 2], [0.0 + f, 300.0 - f], [0.0, 0.0], [9.0, 9.0], [9.0, 9.0]) for m in (1, 2) for f in range(5)]
    names = ["media_id", "frame", "box_id", "x", "y", "width", "height"]
    batches = [pa.RecordBatch.from_pydict({n: [r[k] for r in frames[at : at + size]] for k, n in enumerate(names)}) for at in range(0, len(frames), size)]
    got = [r for b in _followed(80.0)(iter(batches)) for r in b.to_pylist()]
    assert [(r["media_id"], r["frame"], r["track"]) for r in got] == [(m, f, [0, 1]) for m in (1, 2) for f in range(5)]
