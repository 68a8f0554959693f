import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, v string, c string, ids string"


def rows_of(n=260, seed=3, labels=4):
    """Vectors around a few centres with copies, ties, zeros, repeated ids, other lengths, nulls and numbers that aren't finite."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        v = [x + r.gauss(0, r.choice([0.0, 0.02, 0.5])) for x in c]
        rows.append((i, r.randrange(labels), v if i % 9 else [r.choice([0.0, 0.5, -0.5]) for _ in range(12)]))
    rows += [(400 + i, i % labels, rows[10][2]) for i in range(60)] + [(500 + i, 1, [0.0] * 12) for i in range(20)]
    rows += [(600, 1, None), (601, None, rows[1][2]), (602, 1, [float("nan")] * 12), (603, 1, [1.0, None]), (604, 2, [float("inf")] * 12), (None, 1, rows[1][2]), (605, 1, []), (606, 1, rows[1][2][:5]), (700, 2, rows[3][2] + [0.25, 1.0])]
    rows += [(100, 1, rows[100][2]), (100, rows[100][1], rows[100][2]), (100, rows[100][1], rows[100][2])]
    r.shuffle(rows)
    return [(*x, "a", "b", "c") for x in rows]


def brute(rows, anchor, positives=5, negatives_=10, low=30, high=90):
    own = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for k, (i, label, v) in enumerate(own):
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m, at) for at, (j, m, w) in enumerate(own)), key=lambda x: x[:2])
        scored.remove(next(x for x in scored if x[1] == i and x[2] == label and own[x[3]][2] == v))
        for p, j, *_ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:negatives_]
            out += [(i, j, rank, x[1], -p, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out)


def prepared(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return spark.createDataFrame(rows, SCHEMA).select("vec_id", label.alias("label"), negatives.quantised(F.col("embedding")).alias("v"), "c", "ids")


@pytest.mark.parametrize("seed", [3, 4])
def test_every_tenth_row_as_an_anchor(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE", 3)
    monkeypatch.setattr(negatives, "AT_ONCE", 200)  # several blocks of anchors
    rows = rows_of(seed=seed)
    found = sorted(map(tuple, negatives.hard_negatives(prepared(spark, rows), F.col("vec_id") % 10 == 0).collect()))
    assert found == brute(rows, lambda i: i % 10 == 0)
    assert {x[2] for x in found} >= {1, 10}


def test_query(spark, tmp_path):
    rows = rows_of(n=320)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = negatives.op12_hard_negatives(spark, str(tmp_path))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 100 == 0)


def test_other_counts_and_window(spark):
    rows = rows_of(n=120)
    found = negatives.hard_negatives(prepared(spark, rows), F.col("vec_id") % 10 == 3, positives=2, negatives=3, low=0, high=100)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 10 == 3, 2, 3, 0, 100)


def test_empty_table_and_anchors_alone(spark):
    assert negatives.hard_negatives(prepared(spark, [])).count() == 0
    one = [(0, 1, [0.5], "a", "b", "c")]
    assert negatives.hard_negatives(prepared(spark, one)).count() == 0
    assert negatives.hard_negatives(prepared(spark, rows_of(n=40)), F.lit(False)).count() == 0


def test_very_large_components(spark):
    rows = [(i, i % 2, [1e17 * (i + 1), 3.0 * i, 1.0], "a", "b", "c") for i in range(8)]
    plain = [(i, m, [float(np.float32(x)) for x in v]) for i, m, v, *_ in rows]
    own = {i: ((m + 1) % 10 if i % 7 == 0 else m, [int(256 * x) for x in v]) for i, m, v in plain}
    x = np.array([own[i][1] for i in own], dtype=float)
    i, j, score = negatives.candidates(x, x, np.full(8, -np.inf), np.full(8, np.inf))
    most = (1 << 63) - 1
    assert {(a, b): c for a, b, c in zip(i.tolist(), j.tolist(), score.tolist())} == {(a, b): min(most, sum(p * q for p, q in zip(own[a][1], own[b][1]))) for a in own for b in own}


def test_candidates_equal_all_pairs_and_prune():
    r = np.random.default_rng(1)
    x, y = np.floor(r.normal(size=(40, 64)) * 100), np.floor(r.normal(size=(500, 64)) * np.geomspace(100, 1, 64))
    for least, top in ((20_000.0, 40_000.0), (-1e4, 100.0), (60_000.0, np.inf), (1e9, np.inf)):
        i, j, score = negatives.candidates(x, y, np.full(40, least), np.full(40, top))
        full = x @ y.T
        want = np.argwhere((full >= least) & (full <= top))
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist())) and (full[i, j] == score).all()
