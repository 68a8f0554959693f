"""Licence notices by Dice coefficient over word bigrams (operator 3).

Words are lower-cased runs of letters and digits. A passage is every run of as many words as a template
has (a shorter text is one passage); it matches a template if twice their common bigrams over the sum of
their bigrams, both as multisets, is at least the threshold. A licence has several templates, its wordings.

Size bounds prune first: a text with fewer bigrams than t / (2 - t) of the template's can't reach t. An
index of the templates' bigrams then gives each template its places in the text, and only windows in
which enough bigrams are the template's at all are compared.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .license_templates import WORDINGS

DICE = 0.8
#: Wordings a licence has: "MIT", "MIT#1", "MIT#2" and so on; the licence is what comes before the mark.
TEMPLATES = {f"{name}#{k}" if k else name: text for name, texts in WORDINGS.items() for k, text in enumerate(texts)}
MOST_TEMPLATES = 10_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def bigrams(own: list[str]) -> list[tuple[str, str]]:
    return list(zip(own, own[1:]))


def dice(a: Counter, b: Counter) -> float:
    both = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / both if both else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"{len(templates)} templates; each worker holds them, so {MOST_TEMPLATES} at most")
        self.threshold = threshold
        self.templates = []
        self.index: dict[tuple[str, str], list[int]] = {}
        for name, text in sorted(templates.items()):
            template = Counter(bigrams(words(text)))
            if template:
                for p in template:
                    self.index.setdefault(p, []).append(len(self.templates))
                self.templates.append((name.partition("#")[0], template.total(), template))

    def _passages(self, pairs: list[tuple[str, str]], hits: list[int], template: Counter, m: int) -> list[tuple[int, int, int, float]]:
        """(common bigrams, first word, word after the last, Dice) of the best of overlapping passages of one template."""
        t, width = self.threshold, min(m, len(pairs))
        need = t * (width + m) / 2
        if len(hits) < need - 1e-9:
            return []
        at = np.array(hits)
        first = max(0, int(at[0]) - width + 1)  # the windows that touch a hit are between these
        mask = np.zeros(int(at[-1]) - first + 2, dtype=np.int64)
        mask[at - first + 1] = 1
        sums = np.cumsum(mask)
        starts = np.arange(first, min(int(at[-1]), len(pairs) - width) + 1)
        inside = sums[np.minimum(starts - first + width, len(sums) - 1)] - sums[starts - first]
        out, best, before, have, common = [], None, None, Counter(), 0
        for s in starts[inside >= need - 1e-9].tolist():
            if before is not None and s == before + 1:  # one bigram goes, one comes
                gone, new = pairs[before], pairs[s + width - 1]
                if gone in template:
                    common -= have[gone] <= template[gone]
                    have[gone] -= 1
                if new in template:
                    have[new] += 1
                    common += have[new] <= template[new]
            else:
                have = Counter(p for p in pairs[s : s + width] if p in template)
                common = (have & template).total()
            before, score = s, 2 * common / (width + m)
            if score < t:
                continue
            if best and s < best[2]:  # overlapping passages of one template: the best, the first of equals
                best = (common, s, s + width + 1, score) if score > best[3] else best
            else:
                out += [best] if best else []
                best = (common, s, s + width + 1, score)
        return out + [best] if best else out

    def matches(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(licence, first word, word after the last, Dice) of the best passage at each place, in order.

        Wordings hold and resemble each other (GPL-2.0 and GPL-3.0, the clauses of BSD): of overlapping
        passages the one with the most bigrams in common stands, then the higher Dice, the earlier, the
        first by name. If a passage inside it has a higher Dice with a wording of the same licence, that
        one is given.
        """
        pairs = bigrams(words(text))
        hits: dict[int, list[int]] = {}
        for i, p in enumerate(pairs):
            if p in self.index:
                for k in self.index[p]:
                    hits.setdefault(k, []).append(i)
        found = []
        for k, places in hits.items():
            name, m, template = self.templates[k]
            if len(pairs) >= self.threshold / (2 - self.threshold) * m - 1e-9:
                found += [(-common, -score, i, name, j) for common, i, j, score in self._passages(pairs, places, template, m)]
        kept: list[tuple[int, int, str]] = []  # apart from each other, in order
        best: dict[int, tuple[str, int, int, float]] = {}
        for _, score, i, name, j in sorted(found):
            at = bisect_left(kept, (i,))
            if (at == 0 or kept[at - 1][1] <= i) and (at == len(kept) or j <= kept[at][0]):
                kept.insert(at, (i, j, name))
                best[i] = (name, i, j, -score)
                continue
            at -= at == len(kept) or kept[at][0] > i
            first, after, own = kept[at] if at >= 0 else (i, i, "")
            if own == name and first <= i and j <= after and -score > best[first][3]:
                best[first] = (name, i, j, -score)
        return [best[i] for i, _, _ in kept]


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = DICE) -> DataFrame:
    """(doc_id, license, score, n_matches, matches) for each row of docs: the licence of the best passage
    (the earliest, then the first by name of equals; null if none), its Dice coefficient (0 if none) and all
    passages that match and don't overlap a better one (see Scanner.matches). `templates` maps a licence to a
    wording; more wordings of one licence follow as "name#1" and so on.

    Null, empty and one-word texts match nothing. Repeated rows are scanned each on its own; other columns
    aren't read. An empty table gives no rows.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, threshold)

    @F.pandas_udf("array<struct<license: string, first: int, after: int, score: double>>")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"license": n, "first": i, "after": j, "score": s} for n, i, j, s in scanner.matches(t)] for t in texts], dtype=object)

    out = small_batches(docs).select(F.col(doc_id).alias("doc_id"), scan(F.col(text)).alias("matches"))
    best = F.expr("element_at(array_sort(matches, (a, b) -> CASE WHEN a.score != b.score THEN IF(a.score > b.score, -1, 1) WHEN a.first != b.first THEN a.first - b.first WHEN a.license < b.license THEN -1 WHEN a.license > b.license THEN 1 ELSE 0 END), 1)")
    out = out.withColumn("best", F.when(F.size("matches") > 0, best))
    return out.select("doc_id", F.col("best.license").alias("license"), F.coalesce("best.score", F.lit(0.0)).alias("score"), F.size("matches").alias("n_matches"), "matches")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license", "score", "n_matches")
