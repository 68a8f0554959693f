import cmath
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.functions import spectra
from mediasift.functions.spectra import phase_acceleration, pitch_contour, spectral_print
from mediasift.sources.blobs import exists, load, remove, store


def wave(n, seed):
    r = random.Random(seed)
    return np.array([0.5 * math.sin(2 * math.pi * 180 * i / 16000) + 0.3 * r.gauss(0, 1) * (i // 700 % 2) for i in range(n)])


def power(x, k):
    w = [0.5 * (1 - math.cos(2 * math.pi * i / 1023)) for i in range(1024)]
    return abs(sum(a * b * cmath.exp(-2j * math.pi * k * i / 1024) for i, (a, b) in enumerate(zip(x, w)))) ** 2


def test_print_is_that_of_plain_sums():
    x = wave(1024 + 2 * 512, 3)
    bands = [[math.log1p(sum(power(x[t * 512 : t * 512 + 1024], k) for k in range(b * 32, b * 32 + 32))) for b in range(16)] for t in range(3)]
    want = ""
    for t in (1, 2):
        want += f"{sum(1 << m for m in range(15) if (bands[t][m] - bands[t][m + 1]) - (bands[t - 1][m] - bands[t - 1][m + 1]) > 0):04x}"
    assert spectral_print(x) == "chroma-v1-" + want and spectral_print(x[:1000]) is None
    assert spectral_print(x[:1024]) == "chroma-v1-" + f"{sum(1 << m for m in range(15) if bands[0][m] > bands[0][m + 1]):04x}"


def test_pitch_is_that_of_plain_autocorrelation():
    x = wave(6000, 5)
    got = pitch_contour(x, 16000)
    for i, f0 in enumerate(got):
        frame = x[i * 256 : i * 256 + 800]
        lags = np.correlate(frame, frame, mode="full")[799:]
        near = (lags / lags[0])[32:267]
        k = int(np.argmax(near))
        want = 0.0
        if near[k] >= 0.35:
            tau = 32.0 + k
            if 0 < k < len(near) - 1:
                tau += (near[k - 1] - near[k + 1]) / (2 * (2 * near[k] - near[k - 1] - near[k + 1]))
            want = 16000 / tau if 60 <= 16000 / tau <= 500 else 0.0
        assert abs(f0 - want) < 1e-6
    assert (got > 170).any() and pitch_contour(np.zeros(100), 16000).tolist() == [0.0]


def test_phases():
    assert phase_acceleration(np.zeros(10)) == 0.1 and phase_acceleration(wave(1024, 1)) <= 1.0
    steady = np.sin(2 * np.pi * 1000 * np.arange(8192) / 16000)
    assert phase_acceleration(np.random.default_rng(1).normal(size=8192)) > 0.3 >= phase_acceleration(steady) - 1.0


def plain_spectra(x, size, hop):
    x = list(x) + [0.0] * max(0, size - len(x))
    x = [0.0] * (size // 2) + x + [0.0] * (size // 2)
    while (len(x) - size) % hop:
        x.append(0.0)
    w = [0.5 - 0.5 * math.cos(2 * math.pi * i / size) for i in range(size)]
    return [[sum(x[f + i] * w[i] * cmath.exp(-2j * math.pi * k * i / size) for i in range(size)) / sum(w) for k in range(size // 2 + 1)] for f in range(0, len(x) - size + 1, hop)]


def plain_mel(rate, size, bands):
    top = 2595 * math.log10(1 + rate / 2 / 700)
    at = [min(size // 2, math.floor((size + 1) * 700 * (10 ** (top * j / (bands + 1) / 2595) - 1) / rate)) for j in range(bands + 2)]
    rows = [[0.0] * (size // 2 + 1) for _ in range(bands)]
    for m in range(bands):
        for k in range(at[m], at[m + 1]):
            rows[m][k] = (k - at[m]) / (at[m + 1] - at[m])
        for k in range(at[m + 1], at[m + 2]):
            rows[m][k] = (at[m + 2] - k) / (at[m + 2] - at[m + 1])
    return rows


@pytest.mark.parametrize(("n", "size", "hop"), [(300, 64, 16), (40, 64, 16), (64, 64, 16), (301, 64, 48)])
def test_spectra_mel_and_phases_are_plain_sums(n, size, hop):
    x = wave(n, n)
    plain = plain_spectra(x, size, hop)
    np.testing.assert_allclose(spectra.padded_spectra(x, size, hop), plain, atol=1e-12)
    np.testing.assert_allclose(spectra.mel_weights(16000, size, 10), plain_mel(16000, size, 10), atol=1e-6)
    mel = [[10 * math.log10(max(1e-10, sum(abs(s) ** 2 * w for s, w in zip(frame, row)))) for row in plain_mel(16000, size, 10)] for frame in plain]
    np.testing.assert_allclose(spectra.log_mel(x, 16000, size, hop, 10), mel, atol=1e-4)
    phase, high, anomaly, by_frame = spectra.phase_forensics(x, 16000, size, hop)
    off = lambda f, k: abs(cmath.phase(cmath.exp(1j * (cmath.phase(plain[f][k]) - cmath.phase(plain[f - 1][k]) - 2 * math.pi * k * hop / size))))
    sums = [(sum(off(f, k) * abs(s) for k, s in enumerate(plain[f])), sum(map(abs, plain[f]))) for f in range(1, len(plain))]
    assert phase == pytest.approx(sum(a for a, _ in sums) / (math.pi * sum(b for _, b in sums)), abs=1e-6)
    assert by_frame == pytest.approx([0.0] + [a / (math.pi * b + 1e-10) for a, b in sums], abs=1e-5)
    at = lambda low, top: sum(abs(s) for f in plain for k, s in enumerate(f) if low <= k * 16000 / size <= top)
    assert high == pytest.approx(at(7000, 1e9) / at(1000, 4000)) and anomaly == pytest.approx(0.6 * phase + 0.4 * (0.4 if high < 0.005 else 0.5 if high > 0.8 else 0.1))


def test_phases_of_louder_and_silent_waves():
    x = wave(4096, 9)
    assert spectra.phase_forensics(8 * x)[:3] == pytest.approx(spectra.phase_forensics(x)[:3])
    assert spectra.phase_forensics(np.zeros(4096))[:3] == (0.0, 0.0, pytest.approx(0.16))


def test_cosine_transform():
    rows = spectra.cosine_weights(80, 80)
    np.testing.assert_allclose(rows @ rows.T, np.eye(80), atol=1e-12)
    assert spectra.cosine_weights(80, 20)[3][5] == pytest.approx(math.sqrt(2 / 80) * math.cos(math.pi * 3 * 11 / 160))


def test_columns_of_waves(spark):
    plain = [wave(3000, 2), wave(50, 3), np.zeros(2500)]
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(plain)] + [(9, None)], "i int, wave array<double>")
    found = {r["i"]: r for r in df.select("i", spectra.log_mel_of(F.col("wave"), bands=12).alias("mel"), spectra.forensics_of("wave").alias("x"), spectra.yin_of(F.col("wave"), 16000).alias("y")).withColumn("c", F.transform("mel", lambda m: spectra.weighted(m, spectra.cosine_weights(12, 5)))).collect()}
    for i, w in enumerate(plain):
        mel = spectra.log_mel(w, bands=12)
        np.testing.assert_allclose(found[i]["mel"], mel)
        np.testing.assert_allclose(found[i]["c"], mel @ spectra.cosine_weights(12, 5).T, atol=1e-9)
        assert found[i]["x"]["anomaly"] == pytest.approx(spectra.phase_forensics(w)[2]) and tuple(found[i]["y"]) == spectra.yin_statistics(w, 16000)
    assert found[9]["mel"] is None and found[9]["x"]["phase"] is None and found[9]["y"]["mean"] is None


def plain_yin(x, rate, low=50.0, high=500.0, size=2048, hop=512, threshold=0.1):
    x, half, out = np.pad(x, size // 2), size // 2, []
    first, last = int(rate // high), min(math.ceil(rate / low), size - half - 1)
    for at in range(0, len(x) - size + 1, hop):
        y = x[at : at + size]
        d = np.array([sum((y[1 : half + 1] - y[1 + t : half + 1 + t]) ** 2) for t in range(last + 1)])
        norm = np.array([d[t] / (d[1 : t + 1].mean() + np.finfo(float).tiny) for t in range(first, last + 1)])
        n = len(norm)
        dips = [i for i in range(n) if norm[i] < threshold and (i == 0 or norm[i] < norm[i - 1]) and (norm[i] < norm[1] if i == 0 else i == n - 1 or norm[i] <= norm[i + 1])]
        k = dips[0] if dips else int(norm.argmin())
        shift = 0.0
        if 0 < k < n - 1:
            a, b = norm[k + 1] + norm[k - 1] - 2 * norm[k], (norm[k + 1] - norm[k - 1]) / 2
            shift = -b / a if abs(b) < abs(a) else 0.0
        out.append(rate / (first + k + shift))
    return out


def test_yin_is_that_of_plain_differences():
    x = wave(6000, 8)
    np.testing.assert_allclose(spectra.yin_contour(x, 16000), plain_yin(x, 16000), rtol=1e-4)
    noise = np.random.default_rng(2).normal(size=4000)
    np.testing.assert_allclose(spectra.yin_contour(noise, 8000), plain_yin(noise, 8000), rtol=1e-4)


@pytest.mark.parametrize("tone", [82.4, 110.0, 196.0, 233.1, 440.0])
def test_yin_recovers_tones(tone):
    x = 0.7 * np.sin(2 * np.pi * tone * np.arange(32000) / 16000) + 0.2 * np.sin(4 * np.pi * tone * np.arange(32000) / 16000)
    f0 = spectra.yin_contour(x, 16000)[4:-4]
    assert np.abs(f0 - tone).max() < 1.0
    assert abs(spectra.yin_statistics(x, 16000)[0] - tone) < 15
    assert spectra.yin_statistics(x[:2000], 16000) == spectra.yin_statistics(np.zeros(9000), 16000) == (0.0, 0.0)


def test_files_by_key(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    rows = [("a/1.bin", b"one"), ("/b/../a/2.bin", b"two"), ("../out.bin", b"no"), ("", b"no"), (None, b"no"), ("c", None)]
    blobs = spark.createDataFrame([(k, bytearray(v) if v else None) for k, v in rows], "key string, content binary")
    assert {tuple(x) for x in store(blobs, folder).collect()} == {("a/1.bin", True), ("a/2.bin", True)}
    assert not (tmp_path / "out.bin").exists()
    assert {(x.key, bytes(x.content)) for x in load(spark, blobs.select("key"), folder).collect()} == {("a/1.bin", b"one"), ("a/2.bin", b"two")}
    one = spark.createDataFrame([("a/1.bin",), ("a/9.bin",)], "key string")
    assert dict(remove(one, folder).collect()) == {"a/1.bin": True, "a/9.bin": False}
    assert dict(exists(blobs.select("key"), folder).collect()) == {"a/1.bin": False, "a/2.bin": True, "c": False}
