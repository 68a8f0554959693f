"""Toxic passages by maximum-scoring segments (operator 1).

Terms are lower-cased words and their prefixes. In a bounded sample of labelled documents, from which
near copies are dropped by the minima of four hashes over their word triples, each term's documents are counted.
Its score is the log-odds of its rates in toxic and other documents under an informative Dirichlet prior
(the rate in both together, as strong as the smaller class), less one standard error. Terms that don't
tell the classes apart by four standard errors are dropped; every other word scores a small negative drift. A linear-time scan finds all maximal scoring
segments of a text (each is a passage that no neighbouring words would improve).

For random clean text the score of the best of n places follows an extreme-value law: with lambda the
positive root of E[exp(lambda * score)] = 1 under the clean documents' term rates, lambda * S - ln(K n)
is the normalised score of a segment, and its expected number by chance is exp(-normalised). Segments with a positive one are
significant. Their sum is turned into a probability by a logistic curve fitted on the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, fold, materialize, small_batches, table
from .quality import learned_labels

THRESHOLD, MOST_TRAINING_ROWS = 0.7, 20_000
PREFIXES = (4, 5, 6)
DRIFT, K, SURE = -0.3, 0.1, 4
_WORD = re.compile(r"[^\W_]+")
_MOST_REMEMBERED = 300_000


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _terms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        count = Counter(), Counter()
        for label, text in zip(pdf["label"], pdf["text"]):
            count[int(label)].update({term for word in set(words(text)) for term in _terms(word)})
        by_term: dict[str, list[int]] = {}
        for label in (0, 1):
            for term, n in count[label].items():
                by_term.setdefault(term, [0, 0])[label] += n
        totals = [sum(count[label].values()) for label in (0, 1)]
        yield pd.DataFrame([("", *totals), *((t, *n) for t, n in by_term.items())], columns=["term", "n0", "n1"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _minima(texts: pd.Series) -> pd.Series:
    """The least of four multiples of the hashes of three words at a time; null without words."""
    out = []
    for text in texts:
        own = words(text)
        h = np.array([xxhash.xxh64_intdigest(" ".join(own[i : i + 3])) for i in range(max(len(own) - 2, min(len(own), 1)))], dtype=np.uint64)
        out.append([int((h * np.uint64(2 * k + 0x9E3779B97F4A7C15)).view(np.int64).min()) for k in range(4)] if len(h) else None)
    return pd.Series(out, dtype=object)


def _apart(rows: DataFrame) -> DataFrame:
    """rows without those that share one of four minima with another, and without those that have no words."""
    keys = rows.select("doc_id", _minima("text").alias("k")).filter("k IS NOT NULL").select("doc_id", *(F.col("k")[i].alias(f"k{i}") for i in range(4)))
    kept = keys
    for i in range(4):
        kept = kept.groupBy(f"k{i}").agg(F.min(F.struct("doc_id", *(f"k{j}" for j in range(4) if j != i))).alias("s")).select("s.*", f"k{i}")
    return rows.join(kept.select("doc_id"), "doc_id", "left_semi")


class _WordScores(dict):
    """Scores of words, each looked up among the terms when it is first asked for."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> float:
        scores = self.scores
        terms = (word, *(word[:k] + "*" for k in reversed(PREFIXES) if len(word) >= k))
        self[word] = score = next((scores[t] for t in terms if t in scores), DRIFT)
        return score


@dataclass(frozen=True)
class Model:
    """Scores of terms, lambda of the extreme-value law, and the logistic curve of the sum of normalised scores."""

    scores: dict[str, float]
    rate: float
    slope: float = 1.0
    intercept: float = -3.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "memo", _WordScores(self.scores))

    def __reduce__(self):
        return Model, (self.scores, self.rate, self.slope, self.intercept)

    def word_scores(self, own: list[str]) -> np.ndarray:
        """Of each word: its own score, else that of its longest known prefix, else the drift."""
        if len(self.memo) > _MOST_REMEMBERED:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, own), dtype=float, count=len(own))

    def passages(self, own: list[str]) -> list[tuple[int, int, float]]:
        """Significant segments (first word, word after the last, normalised score)."""
        if not own:
            return []
        bar = math.log(max(K * len(own), 1.0))
        return [(i, j, z) for i, j, s in segments(self.word_scores(own)) if (z := self.rate * s - bar) > 0]

    def evidence(self, text: str | None) -> float:
        return sum(z for _, _, z in self.passages(words(text)))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.intercept + self.slope * math.log1p(evidence)))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, after the last, score), by one pass over the positive scores."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # [first, after, sum before, sum through]
    for i in np.nonzero(scores > 0)[0].tolist():
        new = [i, i + 1, float(sums[i]), float(sums[i + 1])]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]  # the last before it with a smaller sum before
            if j < 0 or found[j][3] >= new[3]:
                new = [*new[:4], j]
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r, _ in found]


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(shares * exp(rate * scores)) = 1."""
    if not (scores > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    f = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", most_rows: int = MOST_TRAINING_ROWS) -> Model | None:
    """A model from at most about `most_rows` labelled rows (chosen by a hash of doc_id, half of them from either class
    if it has as many); None if either class has no words. Null labels are left out."""
    rows = labelled.select("doc_id", F.col(text).alias("text"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    return fit_sample(bounded_sample(rows, "doc_id", "label", most_rows))


def fit_sample(rows: DataFrame) -> Model | None:
    """As fit, from all of a bounded sample of rows (doc_id, text, label, weight)."""
    rows = small_batches(materialize(rows, "toxicity-sample"))
    counts = _apart(rows).mapInPandas(_count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = counts.filter("term = ''").first()
    if total is None or not total["n0"] or not total["n1"]:
        return None
    n0, n1 = float(total["n0"]), float(total["n1"])
    prior = min(n0, n1)  # as strong as the smaller class
    a = F.expr(f"{prior} * (n0 + n1) / {n0 + n1}")
    odds = lambda y, n: F.log((y + a) / (n + prior - y - a))
    told = counts.filter("term != '' AND n0 + n1 >= 5").withColumn("d", odds(F.col("n1"), n1) - odds(F.col("n0"), n0)).withColumn("se", F.sqrt(1 / (F.col("n1") + a) + 1 / (F.col("n0") + a)))
    best = told.filter(f"abs(d) > {SURE} * se").orderBy(F.desc(F.abs(F.col("d")) / F.col("se")), "term").select("term", "d", "se", "n0").collect()  # terms of the bounded sample
    scores = {r["term"]: (r["d"] - r["se"] if r["d"] > 0 else min(r["d"] + r["se"], DRIFT)) for r in best}
    own = [r for r in best if not r["term"].endswith("*")]
    shares = np.array([(r["n0"] + 0.5) / n0 for r in own])
    rate = _rate(np.array([*(scores[r["term"]] for r in own), DRIFT]), np.append(shares, max(0.0, 1 - shares.sum())))
    model = Model(scores, rate)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"bin": [round(100 * math.log1p(model.evidence(t))) for t in pdf["text"]], "label": pdf["label"], "weight": pdf["weight"]})

    bins = rows.mapInPandas(binned, "bin int, label int, weight double").groupBy("bin").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("y"), F.count(F.lit(1)).alias("rows")).collect()  # 100 times the logarithm of the evidence: a few thousand at most
    each = sum(r["rows"] for r in bins) / sum(r["n"] for r in bins)  # weights that sum to the rows of the sample
    return Model(scores, rate, *_logistic(np.array([r["bin"] / 100 for r in bins]), np.array([r["n"] * each for r in bins]), np.array([r["y"] * each for r in bins])))


def _logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a weak ridge."""
    X, beta, ridge = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2), np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        step = np.linalg.solve((X * (n * p * (1 - p))[:, None]).T @ X + ridge, X.T @ (y - n * p) - ridge @ beta)
        beta = np.clip(beta + step, -30, 30)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def score_toxicity(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` (0 to 1, higher: toxic likelier), `predicted` and `passages` (first word, word after
    the last, normalised score of every significant passage).

    Null and empty texts have no passages and the score of no evidence; without a model every score is 0.
    Columns of these names are replaced; all others stay. An empty table gives no rows.
    """

    @F.pandas_udf("score double, passages array<struct<first: int, after: int, score: double>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        found = [model.passages(words(t)) if model else [] for t in texts]
        return pd.DataFrame({"score": [model.probability(sum(z for *_, z in p)) if model else 0.0 for p in found], "passages": [[{"first": i, "after": j, "score": z} for i, j, z in p] for p in found]})

    out = small_batches(docs).withColumn("__scored", scored("text"))
    return out.withColumns({"score": F.col("__scored.score"), "passages": F.col("__scored.passages")}).drop("__scored").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most_rows: int = MOST_TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of labels. The sample is drawn from the labels, so its size is known
    before any text is read and it is broadcast: no text moves."""
    picked = bounded_sample(learned_labels(labels, label, learn).withColumn("label", F.col("label").cast("int")).filter("label IN (0, 1)"), "doc_id", "label", most_rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label", "weight")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_sample(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 3) != 1))
    return score_toxicity(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
