import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.functions import pictures as P
from mediasift.operators import pictures

KEYS = "media_id long, key_id long, x double, y double, v array<double>"


def keys_of(seed=1, sizes=(40, 11, 9, 3, 1)):
    """Pictures of which parts are seen twice, with ties, repeated ids and nulls."""
    r = random.Random(seed)
    rows = []
    for media, n in enumerate(sizes):
        for k in range(n):
            rows.append((media, k, r.uniform(0, 400), r.uniform(0, 400), [r.gauss(0, 1) for _ in range(3)]))
        for k in range(0, n, 3):
            _, _, x, y, v = rows[-n + k]
            rows.append((media, 100 + k, x + 80, y + 40, v if k % 2 else [c + 1e-3 for c in v]))
    rows += [(0, 500, 1.0, 1.0, [9.0, 9.0, 9.0]), (0, 501, 1.5, 1.0, [9.0, 9.0, 9.0]), (0, 502, 1.0, 300.0, [9.0, 9.0, 9.0]), (0, None, 1.0, 1.0, [0.0] * 3), (0, 503, 1.0, 1.0, None), (0, 504, 1.0, 1.0, [0.0, None, 0.0]), (None, 1, 1.0, 1.0, [0.0] * 3), (1, 600, None, 3.0, [5.0, 5.0, 5.0]), (1, 601, 3.0, 3.0, [5.0, 5.001, 5.0])]
    r.shuffle(rows)
    return rows


def brute_nearest(rows, most, cost):
    own = [x for x in rows if None not in x[:2] and x[4] is not None and None not in x[4]]
    out = {}
    for m, k, _, _, v in own:
        out[m, k] = sorted((cost(v, w), j) for n, j, _, _, w in own if n == m)[:most]
    return out


def distance(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))


@pytest.mark.parametrize("block", [1024, 7])
def test_nearest_keys(spark, block):
    rows = keys_of()
    want = brute_nearest(rows, 4, distance)
    got = {}
    for r in pictures.nearest_keys(spark.createDataFrame(rows, KEYS), 4, block=block).collect():
        got.setdefault((r["media_id"], r["key_id"]), []).append((r["rank"], r["distance"], r["other"]))
    assert set(got) == set(want)
    for k, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(found) + 1)) and [x[2] for x in found] == [x[1] for x in want[k]]
        assert [x[1] for x in found] == pytest.approx([x[0] for x in want[k]])


def test_hamming(spark):
    r = random.Random(2)
    rows = [(1, k, 0.0, 0.0, [r.getrandbits(64) - (1 << 63) for _ in range(4)]) for k in range(30)]
    bits = lambda a, b: sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b))
    want = brute_nearest(rows, 3, bits)
    found = pictures.nearest_keys(spark.createDataFrame(rows, KEYS.replace("array<double>", "array<long>")), 3, pictures.hamming, block=8)
    assert {(r["media_id"], r["key_id"], r["rank"]): (r["distance"], r["other"]) for r in found.collect()} == {(*k, i): x for k, v in want.items() for i, x in enumerate(v, 1)}


def brute_matches(rows, ratio=0.75, apart=30.0):
    near, at, seen, out = brute_nearest(rows, 3, distance), {(m, k): (x, y) for m, k, x, y, _ in rows}, set(), []
    size = {m: sum(n == m for n, _ in near) for m, _ in near}
    for m, k in sorted(near):
        best = near[m, k]
        if size[m] < 10 or len(best) < 3 or not best[1][0] < ratio * best[2][0] or best[1][1] == k:
            continue
        pair = (m, *sorted((k, best[1][1])))
        if pair in seen:
            continue
        seen.add(pair)
        (x1, y1), (x2, y2) = at[m, k], at[m, best[1][1]]
        if None not in (x1, y1, x2, y2) and math.hypot(x1 - x2, y1 - y2) >= apart:
            out.append((m, k, best[1][1], x1, y1, x2, y2))
    return sorted(out)


def test_self_matches(spark):
    rows = keys_of()
    found = pictures.self_matches(spark.createDataFrame(rows, KEYS), block=13)
    assert sorted((r["media_id"], r["key_id"], r["other"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in found.collect()) == brute_matches(rows)
    assert {r[0] for r in brute_matches(rows)} == {0, 1, 2}  # the others have fewer than ten keys
    assert pictures.self_matches(spark.createDataFrame([], KEYS)).count() == 0


def brute_agreement(own, seed=0):
    own = sorted(own, key=lambda r: (r[1], r[2]))
    n, step = len(own), lambda u: (u * 1103515245 + 12345) % 2147483648
    best = (0, None)
    for t in range(min(2000, n * (n - 1)) if n >= 4 else 0):
        if n * (n - 1) <= 2000:
            i, k = t % n, t // n
        else:
            u = step(t + seed * 7919)
            i, k = u // 64 % n, step(u) // 64 % (n - 1)
        a, b = own[i], own[(i + 1 + k) % n]
        p1, p2, q1, q2 = complex(*a[3:5]), complex(*b[3:5]), complex(*a[5:7]), complex(*b[5:7])
        if p1 == p2:
            continue
        z = (q2 - q1) / (p2 - p1)
        votes = sum(abs(complex(*r[5:7]) - (z * complex(*r[3:5]) + q1 - z * p1)) <= 8.0 for r in own)
        if votes > best[0] or best[1] is None:
            best = (votes, t)
    return n, *best


def test_agreed_transformation(spark):
    r = random.Random(7)
    z, shift, rows = complex(0.9, 0.3), complex(50, -20), []
    for media, (copied, other) in enumerate([(20, 60), (8, 2), (3, 1), (2, 1), (0, 12)]):
        for k in range(copied + other):
            p = complex(r.uniform(0, 300), r.uniform(0, 300))
            q = z * p + shift + complex(r.uniform(-2, 2), r.uniform(-2, 2)) if k < copied else complex(r.uniform(0, 900), r.uniform(0, 900))
            rows.append((media, k, 1000 + k, p.real, p.imag, q.real, q.imag))
    rows += [(9, k, 50 + k, 5.0, 5.0, 90.0 + k, 7.0) for k in range(5)]  # one first place: no trial fits
    matches = spark.createDataFrame(rows, "media_id long, key_id long, other long, x1 double, y1 double, x2 double, y2 double")
    for seed in (0, 3):
        found = {x["media_id"]: x for x in pictures.agreed_transformation(matches, seed).collect()}
        for media in {x[0] for x in rows}:
            n, votes, trial = brute_agreement([x for x in rows if x[0] == media], seed)
            f = found[media]
            assert (f["n_matches"], f["inliers"], f["trial"]) == (n, votes, trial)
            assert f["score"] == pytest.approx(min(1.0, votes / 12)) and f["detected"] == (votes >= 6)
        assert found[0]["detected"] and found[0]["inliers"] >= 20 and found[1]["detected"] and not found[3]["detected"] and found[9]["inliers"] == 0
    assert pictures.agreed_transformation(matches.limit(0)).count() == 0


def brute_variance(p):
    h, w = p.shape
    edge = lambda i, n: i if 0 <= i < n else (0 if n == 1 else 1 if i < 0 else n - 2)
    return np.var([p[edge(i - 1, h), j] + p[edge(i + 1, h), j] + p[i, edge(j - 1, w)] + p[i, edge(j + 1, w)] - 4 * p[i, j] for i in range(h) for j in range(w)])


def brute_share(p):
    h, w = p.shape
    size = {(k, m): abs(sum(p[i, j] * complex(math.cos(a := -2 * math.pi * (i * k / h + j * m / w)), math.sin(a)) for i in range(h) for j in range(w))) for k in range(h) for m in range(w)}
    centred = lambda k, n: (k + n // 2) % n - n // 2
    total = sum(size.values())
    return sum(s for (k, m), s in size.items() if math.hypot(centred(k, h), centred(m, w)) > 0.75 * (min(h, w) // 2)) / total if total else 0.0


def test_noise(spark):
    r = np.random.default_rng(4)
    shapes = [(8, 8), (5, 9), (1, 1), (1, 6), (7, 1), (2, 2), (6, 5)]
    plain = [np.floor(r.uniform(0, 256, s)) for s in shapes] + [np.zeros((4, 4)), np.full((6, 6), 90.0)]
    rows = [(i, p.tolist()) for i, p in enumerate(plain)] + [(100, None), (101, [])]
    df = spark.createDataFrame(rows, "i int, p array<array<double>>")
    found = {x["i"]: (x["v"], x["s"]) for x in df.select("i", P.laplacian_variance(F.col("p")).alias("v"), P.high_share_of("p").alias("s")).collect()}
    for i, p in enumerate(plain):
        assert found[i][0] == pytest.approx(brute_variance(p), abs=1e-6) and found[i][1] == pytest.approx(brute_share(p), abs=1e-9)
    assert found[100] == (None, None) and found[101] == (None, None)
