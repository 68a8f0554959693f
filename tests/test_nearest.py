import random

from pyspark.sql import functions as F

from mediasift.operators.dedup import acoustic_duplicates, cascade, perceptual_duplicates_all
from mediasift.operators.nearest import _parts, acoustic_costs, close_hashes, hamming_costs, near_hashes, nearest_others


def brute(rows, cost, limit):
    out = []
    for a, x in rows:
        near = [(cost(x, y), b) for b, y in rows if a != b and x is not None and y is not None and cost(x, y) <= limit]
        out += [(a, min(near)[1], min(near)[0])] if near else []
    return sorted(out)


def test_perceptual_pair_beyond_the_first_hundred(spark):
    r = random.Random(1)
    rows = [(i, format(r.getrandbits(64), "064b")) for i in range(300)]
    rows += [(901, "01" * 32), (902, "01" * 31 + "10")]
    got = {tuple(x) for x in perceptual_duplicates_all(spark.createDataFrame(rows, "media_id long, bits string"), 10).collect()}
    assert {(901, 902, 2), (902, 901, 2)} <= got


def test_nearest_hashes_equal_brute_force(spark):
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(12)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, signed(r.choice(centres) ^ sum(1 << r.randrange(64) for _ in range(r.randrange(3))) & (1 << 64) - 1)) for i in range(200)]
    rows += [(500 + i, signed(centres[0])) for i in range(40)] + [(7, signed(centres[1])), (7, signed(centres[2])), (600, None), (-3, signed(centres[5]))]
    cost = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    df = spark.createDataFrame(rows, "media_id long, print long")
    for block in (30, 4096):
        assert sorted(tuple(x) for x in nearest_others(df, hamming_costs, 3, block).collect()) == brute(rows, cost, 3)
    assert nearest_others(df.limit(0), hamming_costs, 3).count() == 0


def test_near_hashes_equal_brute_force(spark):
    """Up to 11 bits apart, with copies, media of several prints, repeated rows and nulls."""
    r = random.Random(8)
    centres = [r.getrandbits(64) for _ in range(20)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    rows = [(i, signed(flip(r.choice(centres), r.randrange(9)))) for i in range(250)] + [(300 + i, signed(r.getrandbits(64))) for i in range(50)]
    rows += [(500 + i, signed(centres[0])) for i in range(30)] + [(600, None), (-3, signed(centres[5])), (-3, signed(centres[5]))]
    rows += [(700, signed(c)) for c in (flip(centres[7], 3), centres[7], flip(centres[7], 1))] + [(800, signed(x)) for x in (1 << 20, (1 << 20) + 1)]  # their own nearest
    cost = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    df = spark.createDataFrame(rows, "media_id long, print long")
    for limit in (0, 3, 7, 10, 11):
        assert sorted(tuple(x) for x in near_hashes(df, limit).collect()) == brute(rows, cost, limit)
    assert near_hashes(df.limit(0)).count() == 0


def test_parts_select_few_pairs(spark):
    r = random.Random(9)
    df = spark.createDataFrame([(i, r.getrandbits(64) - (1 << 63)) for i in range(3000)], "first long, print long").selectExpr("print", "first", "CAST(NULL AS long) AS second")
    keys = _parts("print")
    asked = df.select(F.explode(keys).alias("part")).select(F.explode(F.array(*(F.col("part").bitwiseXOR(F.lit(m)) for m in range(1 << 16) if m.bit_count() <= 2))).alias("key"))
    assert asked.join(df.select(F.explode(keys).alias("key")), "key").count() < 3000 * 3000 / 60
    assert close_hashes(df.select("print"), df, 10).count() == 0


def similar(x, y):
    best, most = 0.0, min(5, min(len(x), len(y)) // 2)
    for s in range(-most, most + 1) if x and y else ():
        i, j = max(0, s), max(0, -s)
        n = min(len(x) - i, len(y) - j)
        if n > 0:
            best = max(best, 1 - sum(((a ^ b) & 65535).bit_count() for a, b in zip(x[i : i + n], y[j : j + n])) / (16.0 * n))
    return best


def test_acoustic_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    tracks = [[r.getrandbits(16) for _ in range(r.choice([1, 2, 4, 9, 20]))] for _ in range(15)]
    rows = [(i, [x ^ (1 << r.randrange(16) if r.random() < 0.7 else 0) for x in r.choice(tracks)][r.randrange(3) :]) for i in range(150)]
    rows += [(300, tracks[4]), (301, tracks[4]), (302, None), (303, []), (9, tracks[2]), (9, tracks[3])]
    want = [(a, b, -c) for a, b, c in brute(rows, lambda x, y: -similar(x, y), -0.8)]
    df = spark.createDataFrame(rows, "media_id long, print array<long>")
    for heard in (acoustic_duplicates(df), nearest_blocks(df)):
        assert sorted(tuple(x) for x in heard.collect()) == want
    assert len(want) > 100


def nearest_blocks(df):
    return nearest_others(df, acoustic_costs, -0.8, 40).selectExpr("media_id", "duplicate_of", "-cost AS similarity")


def test_a_sound_is_an_acoustic_duplicate_only_after_the_others(spark):
    m = spark.createDataFrame([(1,), (2,), (3,), (4,)], "media_id long")
    exact, near = spark.createDataFrame([(1, 9)], "media_id long, e long"), spark.createDataFrame([(1, 8, 4), (2, 8, 16)], "media_id long, h long, distance long")
    heard = spark.createDataFrame([(1, 7, 0.9), (2, 7, 0.9), (3, 7, 0.875)], "media_id long, a long, s double")
    got = sorted(tuple(x) for x in cascade(m, exact, near, heard).collect())
    assert got == [(1, 9, "EXACT", 1.0), (2, 8, "PERCEPTUAL", 0.75), (3, 7, "ACOUSTIC", 0.875), (4, None, "NONE", 0.0)]


def test_costs_of_hashes_are_bytes_and_second_best_is_sought_near_only():
    """Blocks are searched as bytes; a print without another near it is searched once."""
    import numpy as np
    import pandas as pd

    from mediasift.operators.nearest import _block_pairs

    r = np.random.default_rng(5)
    probes = r.integers(-(2**63), 2**63 - 1, 300)
    assert hamming_costs(probes, probes).dtype == np.uint8
    block = pd.DataFrame({"i": [0], "probes": [probes], "ids": [np.array([7, 7, *range(10, 308)])], "others": [np.array([probes[0], probes[0], *probes[:298] ^ 1])]})
    got = pd.concat(_block_pairs(hamming_costs, 3, 256)(iter([block])))
    assert sorted(map(tuple, got.itertuples(index=False)))[:3] == [(0, 0, 0.0, 7), (0, 0, 1.0, 10), (0, 1, 1.0, 11)] and len(got) == 299
