"""Measures of grey pictures, array<array<double>> by rows: a stencil as an expression, spectra with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _mirrored(values: Column) -> tuple[Column, Column]:
    """The elements before and after each of an array, with its ends reflected: the second stands before the first."""
    n = F.size(values)
    before = F.concat(F.slice(values, F.greatest(F.lit(1), F.least(F.lit(2), n)), 1), F.slice(values, F.lit(1), F.greatest(F.lit(0), n - 1)))
    after = F.concat(F.slice(values, F.lit(2), n), F.slice(values, F.greatest(F.lit(1), n - 1), 1))
    return before, after


def laplacian(picture: Column) -> Column:
    """At each place the four neighbours less four times the place; beyond an edge the picture is reflected."""
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    up, down = _mirrored(picture)
    columns = F.zip_with(up, down, add)
    rows = F.transform(picture, lambda r: F.zip_with(add(*_mirrored(r)), r, lambda x, y: x - 4 * y))
    return F.zip_with(columns, rows, add)


def laplacian_variance(picture: Column) -> Column:
    """The variance of the Laplacian over all places; null for a picture without any."""
    n = F.size(F.flatten(picture))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate(F.flatten(laplacian(picture)), start, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), lambda a: F.struct(F.try_divide(a["s"], n).alias("m"), F.try_divide(a["q"], n).alias("q")))
    return F.when(n > 0, F.greatest(F.lit(0.0), sums["q"] - sums["m"] * sums["m"]))


def high_share(picture: np.ndarray, beyond: float = 0.75) -> float:
    """The share of a spectrum's sizes that lie farther from its middle than `beyond` of the radius, half the shorter
    side; 0 for a black picture."""
    h, w = picture.shape
    size = np.abs(np.fft.fftshift(np.fft.fft2(picture)))
    far = np.hypot(*np.ogrid[-(h // 2) : h - h // 2, -(w // 2) : w - w // 2]) > beyond * (min(h, w) // 2)
    return float(np.clip(size[far].sum() / total, 0.0, 1.0)) if (total := size.sum()) else 0.0


@F.pandas_udf(T.DoubleType())
def high_share_of(pictures: pd.Series) -> pd.Series:
    return pictures.map(lambda p: high_share(np.stack([np.asarray(r, dtype=float) for r in p])) if len(p) and len(p[0]) else None, na_action="ignore").astype(float)
