"""Language identification by nearest centroid (operator 9).

A text is lower-cased, every run of non-letters becomes one space, and its character trigrams are hashed
into 8,192 counts. Counts are damped by a logarithm, weighted by inverse document frequency and scaled to
length one. Each language of the training sample is clustered into several centroids (spherical k-means);
a text gets the language of the nearest centroid by cosine. It is rejected by distance if it is less near than
`FAR` of the cosine that all but a hundredth of the centroid's own training texts reach.

The model is fitted on a bounded sample: at most about `most_rows` labelled documents, chosen by a hash of
the id, whose sparse vectors the driver clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, small_batches, table

BUCKETS, CLUSTERS, ROUNDS, MOST_TRAINING_ROWS, FAR = 8192, 3, 12, 3000, 0.6
_LETTER = None


def _letters() -> np.ndarray:
    """For each code point 1 if it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def trigrams(text: str | None) -> np.ndarray | None:
    """Bucket of each character trigram of a text; None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    codes = codes[letter | np.concatenate(([True], letter[:-1]))]  # one space for a run of others
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    h = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(51)).astype(np.int64)


def term_weights(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    found = trigrams(text)
    if found is None:
        return None
    count = np.bincount(found, minlength=BUCKETS)
    at = np.nonzero(count)[0]
    return at, np.log1p(count[at])


@dataclass(frozen=True)
class Centroids:
    languages: list[str]  # of each centroid
    weighted: np.ndarray  # buckets x centroids: centroid times inverse document frequency
    idf: np.ndarray
    bars: np.ndarray  # of each centroid: the cosine under which a text is rejected

    def nearest(self, text: str | None) -> tuple[str, float, bool] | None:
        """Language and cosine of the nearest centroid, and whether that is too far; None for a text without letters."""
        if (found := term_weights(text)) is None:
            return None
        at, tf = found
        cosines = tf @ self.weighted[at] / np.linalg.norm(tf * self.idf[at])
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best]))), bool(cosines[best] < self.bars[best])


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(lang, at.astype("<i4").tobytes(), tf.astype("<f4").tobytes()) for lang, text in zip(pdf["lang"], pdf["text"]) if (found := term_weights(text)) is not None for at, tf in [found]]
        yield pd.DataFrame(rows, columns=["lang", "at", "tf"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", most_rows: int = MOST_TRAINING_ROWS, clusters: int = CLUSTERS) -> Centroids | None:
    """Centroids of every language in a sample of at most about `most_rows` rows; None without any text that has letters."""
    rows = bounded_sample(small_batches(labelled).select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL"), "doc_id", "lang", most_rows)
    sample = rows.mapInPandas(_vectors, "lang string, at binary, tf binary").orderBy("lang", "at", "tf").collect()  # the bounded sample
    if not sample:
        return None
    x = np.zeros((len(sample), BUCKETS), dtype=np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["tf"], "<f4")
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1
    x *= idf.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    langs = np.array([r["lang"] for r in sample])
    names, centres, bars = [], [], []
    for name in sorted(set(langs)):
        own = x[langs == name]
        c = own[np.linspace(0, len(own) - 1, min(clusters, len(own))).astype(int)]
        for _ in range(ROUNDS):
            near = np.argmax(own @ c.T, axis=1)
            c = np.stack([own[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        names += [name] * len(c)
        centres.append(c)
        cosines = own @ c.T
        near = np.argmax(cosines, axis=1)
        bars += [FAR * float(np.quantile(cosines[near == k, k], 0.01)) if (near == k).any() else 0.0 for k in range(len(c))]
    return Centroids(names, np.ascontiguousarray((np.concatenate(centres) * idf).T), idf, np.array(bars))


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """docs with `lang_pred`, `score` (cosine with the nearest centroid, 0 to 1) and `rejected`.

    `und` with score 0, rejected, where the text is null or has no letter, and everywhere without a model. Texts too far
    from their centroid keep its language and are marked rejected; of equally near centroids the first counts. Columns of
    these names are replaced; all others stay. Equal texts have equal results. An empty table gives no rows.
    """

    @F.pandas_udf("lang string, score double, far boolean")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(model.nearest(t) if model else None) or ("und", 0.0, True) for t in texts], columns=["lang", "score", "far"])

    out = small_batches(docs).withColumn("__near", nearest("text"))
    return out.withColumns({"lang_pred": F.col("__near.lang"), "score": F.col("__near.score"), "rejected": F.col("__near.far")}).drop("__near")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter((fold("doc_id", 5) != 0) & F.col("lang").isNotNull()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
