"""Column functions on arrays of numbers, boxes and measures.

Arrays are folded from their own elements; a lambda never indexes an array, which would compute it anew for each element.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of one length."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm(values: Column) -> Column:
    return F.sqrt(total(F.transform(values, lambda x: x * x)))


def unit(values: Column, least: float = 1e-12) -> Column:
    """An array scaled to length one; shorter ones than `least` by that."""
    n = F.greatest(norm(values), F.lit(least))
    return F.transform(F.arrays_zip(values.alias("x"), F.array_repeat(n, F.size(values)).alias("n")), lambda p: p["x"] / p["n"])


def gradient_hash(samples: Column) -> Column:
    """64-bit hash of a picture of 8 rows of 9 samples: bit 8 y + x says whether a sample is above the one after it.

    Of a nearly flat picture (range 2 at most) it is the mean's byte eight times.
    """
    pairs = F.zip_with(samples, F.slice(samples, 2, 71), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("h"))

    folded = F.aggregate(pairs, zero, lambda s, p: F.struct((s["i"] + 1).alias("i"), s["h"].bitwiseOR(F.when((s["i"] % 9 < 8) & (p["a"] > p["b"]), F.call_function("shiftleft", F.lit(1).cast("long"), (F.floor(s["i"] / 9) * 8 + s["i"] % 9).cast("int"))).otherwise(F.lit(0).cast("long"))).alias("h")), lambda s: s["h"])
    mean = F.floor(F.aggregate(samples, F.lit(0).cast("long"), lambda a, x: a + x) / 72).cast("long").bitwiseAND(F.lit(255).cast("long"))
    return F.when(F.array_max(samples) - F.array_min(samples) <= 2, reduce(Column.bitwiseOR, [F.shiftleft(mean, 8 * i) for i in range(8)])).otherwise(folded)


def bins(n: int, top: float) -> Column:
    """`n` frequencies from 0 to `top`."""
    return F.array(*(F.lit(i * top / (n - 1)) for i in range(n)))


def centroid(spectrum: Column, n: int, top: float) -> Column:
    return total(F.zip_with(bins(n, top), spectrum, lambda f, m: f * m)) / (total(spectrum) + 1e-10)


def bandwidth(spectrum: Column, centre: Column, n: int, top: float) -> Column:
    second = total(F.zip_with(bins(n, top), spectrum, lambda f, m: f * f * m)) - 2 * centre * total(F.zip_with(bins(n, top), spectrum, lambda f, m: f * m)) + centre * centre * total(spectrum)
    return F.sqrt(F.greatest(second / (total(spectrum) + 1e-10), F.lit(0.0)))


def rolloff(spectrum: Column, n: int, top: float, share: float = 0.85) -> Column:
    """The frequency up to which `share` of a spectrum lies; 0 of a silent one."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), (share * total(spectrum)).alias("goal"))
    step = lambda s, x: F.struct((s["i"] + F.when(s["sum"] + x < s["goal"], 1).otherwise(0)).alias("i"), (s["sum"] + x).alias("sum"), s["goal"].alias("goal"))
    place = F.least(F.aggregate(spectrum, zero, step, lambda s: s["i"]), F.lit(n - 1))
    return F.when(total(spectrum) <= 1e-9, 0.0).otherwise(place * (top / (n - 1)))


def crossings(wave: Column) -> Column:
    """Share of neighbouring samples that differ in sign."""
    changes = F.zip_with(F.slice(wave, 2, F.size(wave) - 1), F.slice(wave, 1, F.size(wave) - 1), lambda x, y: F.when((x < 0) != (y < 0), 1.0).otherwise(0.0))
    return total(changes) / (F.size(wave) - 1)


def loudness(wave: Column) -> Column:
    return F.sqrt(total(F.transform(wave, lambda x: x * x)) / F.size(wave) + 1e-10)


def silent(wave: Column) -> Column:
    quiet = F.sqrt(total(F.transform(wave, lambda x: x * x)) / F.size(wave))
    return (quiet < 1e-4) | (F.array_max(F.transform(wave, lambda x: F.abs(x))) < 1e-4)


def spectral_anomaly(phase: Column, high_ratio: Column) -> Column:
    """0.6 of the phase's score and 0.4 of what the share of high frequencies says."""
    cut = F.when(high_ratio < 0.005, 0.4).when(high_ratio > 0.8, 0.5).otherwise(0.1)
    return clip(0.6 * clip(phase) + 0.4 * cut)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, width, height)."""
    wide = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)
    return both / (a["width"] * a["height"] + b["width"] * b["height"] - both + 1e-6)


def centre_distance(a: Column, b: Column) -> Column:
    across, down = a["x"] + a["width"] / 2 - b["x"] - b["width"] / 2, a["y"] + a["height"] / 2 - b["y"] - b["height"] / 2
    return F.sqrt(across * across + down * down)


def rescaled(box: Column, scale_x: Column, scale_y: Column, wide: Column, high: Column) -> Column:
    """A box in the original picture: x, y, width, height as whole numbers inside it, and as shares of it."""
    x, y = F.greatest(F.lit(0), F.bround(box["x"] * scale_x).cast("int")), F.greatest(F.lit(0), F.bround(box["y"] * scale_y).cast("int"))
    w, h = F.greatest(F.lit(1), F.least(wide - x, F.bround(box["width"] * scale_x).cast("int"))), F.greatest(F.lit(1), F.least(high - y, F.bround(box["height"] * scale_y).cast("int")))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), F.array(F.round(x / wide, 4), F.round(y / high, 4), F.round(w / wide, 4), F.round(h / high, 4)).alias("share"))


def downscaled(wide: Column, high: Column, most: int = 2048) -> Column:
    """Width and height with the larger side at most `most`, in proportion."""
    scale = F.when(F.greatest(wide, high) > most, most / F.greatest(wide, high)).otherwise(F.lit(1.0))
    side = lambda d: F.when(F.greatest(wide, high) > most, F.greatest(F.lit(1), F.bround(d * scale).cast("int"))).otherwise(d.cast("int"))
    return F.struct(side(wide).alias("width"), side(high).alias("height"))


def certainty(p: Column) -> Column:
    return clip(F.abs(clip(p) - 0.5) * 2)


def folded_angle(angle: Column) -> Column:
    return F.when(angle < -45, -(90 + angle)).when(angle > 45, 90 - angle).otherwise(angle)


def mouth_ratio(high: Column, wide: Column, opening: Column) -> Column:
    return clip(high / wide * 0.5 + opening * 0.5, 0.05, 1.0)


def suppressed(boxes: Column, most: float = 0.4) -> Column:
    """Of boxes (score, x, y, width, height), highest score first, those that no kept one overlaps by more than `most`."""
    kind = "array<struct<score: double, x: double, y: double, width: double, height: double>>"
    return F.aggregate(F.reverse(F.array_sort(boxes)), F.expr(f"CAST(array() AS {kind})"), lambda kept, b: F.when(F.exists(kept, lambda k: overlap(k, b) > most), kept).otherwise(F.array_append(kept, b)))
