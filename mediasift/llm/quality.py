"""Quality by a regularised quadratic discriminant (operator 2).

A document becomes a vector of transformed statistics (logarithms of sizes, square roots of shares of
characters, words and lines). Counts, sums and sums of products of each class are summed over all
labelled rows on the executors; the driver gets three small matrices. Class covariances are shrunk
towards the pooled covariance and that towards its diagonal; their Cholesky factors are computed once,
travel with the scoring function and give the Mahalanobis log-densities, whose difference plus the prior
log-odds is the score's logit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, materialize, small_batches, table

NAMES = ("chars", "words", "word_length", "long_words", "upper", "digits", "marks", "symbols", "other_bytes", "capital_words", "distinct", "repeated_lines", "pairs", "separators", "line_length", "marked_words")
THRESHOLD = 0.3
_KIND = np.zeros(256, dtype=np.uint8)  # of a byte: 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other mark, 6 white space, 7 beyond ASCII, 8 control
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[:33], _KIND[127] = 1, 2, 3, 7, 8, 8
for _c in b".,;:?!'\"()-":
    _KIND[_c] = 4
for _c in range(33, 127):
    _KIND[_c] = _KIND[_c] or 5
for _c in b" \t\n\r\x0b\x0c":
    _KIND[_c] = 6


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text; of a null or empty one those of no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=9).astype(float)
    words = raw.split()
    n, w = max(1.0, kinds.sum() - kinds[6]), max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda x, of: np.sqrt(x / of)
    marked = sum(1 for x in words if not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,;:?!'\")-")
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(lengths.mean() if len(words) else 0.0), share((lengths > 20).sum(), w),
        share(kinds[2], n), share(kinds[3], n), share(kinds[4], n), share(kinds[5], n), share(kinds[7] + kinds[8], n), share(sum(1 for x in words if x[:1].isupper()), w),
        share(len(set(words)), w), share(len(lines) - len(set(lines)), max(1, len(lines))), share(len(set(zip(words, words[1:]))), w), share(sum(1 for x in words if len(x) == 1 and not x.isalnum() and x[0] < 128), w),
        np.log1p(len(raw) / max(1, len(lines))), share(marked, w),
    ])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def measure(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], dtype=object)


@dataclass(frozen=True)
class Discriminant:
    """Means, lower Cholesky factors and log-determinants of both classes, and the prior log-odds of label 1."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (np.square(np.linalg.solve(self.factors[c], (x - self.means[c]).T)).sum(axis=0) + self.log_dets[c]) for c in (0, 1)]
        return self.prior + density[1] - density[0]


def fit(labelled: DataFrame, text: str = "text", label: str = "label", to_pooled: float = 0.1, to_diagonal: float = 0.05) -> Discriminant | None:
    """The discriminant of all rows with label 0 or 1; None if either class has no row. Null labels are left out."""
    return fit_measured(labelled.select(measure(F.col(text)).alias("x"), F.col(label).alias("label")), to_pooled, to_diagonal)


def fit_measured(measured: DataFrame, to_pooled: float = 0.1, to_diagonal: float = 0.05) -> Discriminant | None:
    """As fit, from the statistics x of the texts."""
    rows, d = measured.select("x", F.col("label").cast("int").alias("label")).filter("label IN (0, 1)"), len(NAMES)
    places = [(i, j) for i in range(d) for j in range(i, d)]
    of = [F.sum(F.col("x")[i]) for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in places]
    sums = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
    for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*of).alias("s")).collect():  # two rows
        products = np.zeros((d, d))
        for (i, j), v in zip(places, r["s"][d:]):
            products[i, j] = products[j, i] = v
        sums[r["label"]] = np.array([float(r["n"]), *r["s"][:d], *products.ravel()])
    n = np.array([sums[c][0] for c in (0, 1)])
    if not n.all():
        return None
    means = np.array([sums[c][1 : 1 + d] / n[c] for c in (0, 1)])
    spread = [sums[c][1 + d :].reshape(d, d) - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (spread[0] + spread[1]) / n.sum()
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    factors = [np.linalg.cholesky((1 - to_pooled) * ((1 - to_diagonal) * (s := spread[c] / n[c]) + to_diagonal * np.diag(np.diag(s))) + to_pooled * pooled + 1e-6 * np.eye(d)) for c in (0, 1)]
    return Discriminant(means, np.array(factors), np.array([2 * np.log(np.diag(f)).sum() for f in factors]), float(np.log(n[1] / n[0])))


def scorer(model: Discriminant | None, measured: bool = False):
    """Column function text (or its statistics) -> score; 0.5 for every text without a model."""

    @F.pandas_udf(T.DoubleType())
    def score(values: pd.Series) -> pd.Series:
        if model is None or not len(values):
            return pd.Series([0.5] * len(values), dtype=float)
        z = model.logit(np.array([v if measured else statistics(v) for v in values]))
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    return score


def learned_labels(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, label) of the rows that have both and pass `learn`; repeated equal labels count once."""
    return labels.select("doc_id", F.col(label).alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learn).distinct()


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, x, label) of the documents that have one label and pass `learn`.

    Texts are measured where they are read, so that the join moves 16 numbers of a document and never its text.
    """
    return small_batches(docs).filter(F.col("doc_id").isNotNull() & learn).select("doc_id", measure("text").alias("x")).join(learned_labels(labels, label, learn), "doc_id").select("doc_id", "x", "label")


def score_quality(docs: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 from the threshold on).

    Null and empty texts are scored as texts without words. Columns of these two names are replaced; all
    others stay. Equal texts have equal scores. An empty table gives no rows.
    """
    return small_batches(docs).withColumn("score", scorer(model)("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score_quality would predict as 1, with all their columns as they are."""
    return small_batches(docs).filter(scorer(model)("text") >= threshold)


def learn_quality(spark: SparkSession, sf_dir: str) -> Discriminant | None:
    """The model of the labels of the documents table, without the fold that is held out."""
    return fit_measured(labelled_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is measured once: model and scores both read the 16 numbers written for it."""
    measured = materialize(small_batches(table(spark, sf_dir, "documents")).select("doc_id", measure("text").alias("x")), "quality-measured")
    learn = fold("doc_id", 5) != 0
    model = fit_measured(measured.filter(F.col("doc_id").isNotNull() & learn).join(learned_labels(table(spark, sf_dir, "labels"), "quality", learn), "doc_id"))
    scored = measured.select("doc_id", (~learn).alias("held_out"), scorer(model, measured=True)("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
