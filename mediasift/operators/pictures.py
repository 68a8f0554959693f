"""Pictures: copied regions by matches of keypoints and a transformation they agree on, and noise.

The keypoints of a picture are compared in blocks of numpy arrays: what moves is each block once for each block of its
own picture, what comes out is `most` rows for each keypoint and block. Trials of a transformation are rows; how many
matches agree with each is a sum with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediasift.functions.pictures import high_share_of, laplacian_variance
from mediasift.operators.registry import query
from mediasift.sources.views import table

BLOCK, ROWS = 1024, 32
#: Nearest rows of a keypoint, keypoints and matches that a picture must have, trials, and what a copied region needs.
NEAREST, LEAST_KEYS, LEAST_MATCHES, TRIALS, REPROJECTION, FLAGGED, SURE = 3, 10, 4, 2000, 8.0, 6, 12.0


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(a[:, None, :] - b[None, :, :]).sum(axis=2))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of descriptors that are whole numbers of 64 bits."""
    whole = lambda x: x.astype(np.int64).view(np.uint64)
    return np.bitwise_count(whole(a)[:, None, :] ^ whole(b)[None, :, :]).sum(axis=2).astype(float)


def _nearest_of_blocks(compare: Callable, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                a, b = (np.stack([np.asarray(v) for v in x]) for x in (r.v, r.other_v))
                ids, others = np.asarray(r.ids, dtype=np.int64), np.asarray(r.other_ids, dtype=np.int64)
                k = min(most, len(others))
                for at in range(0, len(a), ROWS):
                    cost = compare(a[at : at + ROWS], b)
                    best = np.lexsort((np.broadcast_to(others, cost.shape), cost), axis=1)[:, :k]
                    yield pd.DataFrame({"media_id": r.media_id, "key_id": np.repeat(ids[at : at + ROWS], k), "distance": np.take_along_axis(cost, best, axis=1).ravel(), "other": others[best].ravel()})

    return run


def nearest_keys(keys: DataFrame, most: int = NEAREST, compare: Callable = euclidean, block: int = BLOCK) -> DataFrame:
    """(media_id, key_id, rank, distance, other): the `most` keys of its own medium nearest to each of keys(media_id,
    key_id, v), itself among them, the nearest first and of equal ones the smaller key_id.

    Keys with a null medium, id, or vector, or with a null component take no part; vectors of a medium have one length.
    Rows that repeat an id are keys of their own. A medium with more than `block` keys is compared in blocks.
    """
    usable = keys.select("media_id", F.col("key_id").cast("long").alias("key_id"), "v").filter("media_id IS NOT NULL AND key_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    parts = usable.groupBy("media_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    dealt = usable.join(parts, "media_id").withColumn("part", F.pmod(F.xxhash64("key_id"), "parts").cast("int"))
    blocks = dealt.groupBy("media_id", "parts", "part").agg(F.collect_list(F.struct("key_id", "v")).alias("b"))
    own = blocks.select("media_id", "part", F.col("b.key_id").alias("ids"), F.col("b.v").alias("v"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other_part"))
    others = blocks.select("media_id", F.col("part").alias("other_part"), F.col("b.key_id").alias("other_ids"), F.col("b.v").alias("other_v"))
    kind = keys.schema["media_id"].dataType.simpleString()
    found = own.join(others, ["media_id", "other_part"]).select("media_id", "ids", "v", "other_ids", "other_v").mapInPandas(_nearest_of_blocks(compare, most), f"media_id {kind}, key_id long, distance double, other long")
    rank = F.row_number().over(W.partitionBy("media_id", "key_id").orderBy("distance", "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).select("media_id", "key_id", "rank", "distance", "other")


def self_matches(keys: DataFrame, ratio: float = 0.75, apart: float = 30.0, compare: Callable = euclidean, block: int = BLOCK) -> DataFrame:
    """(media_id, key_id, other, x1, y1, x2, y2): pairs of keypoints (media_id, key_id, x, y, v) that look alike and lie apart.

    The nearest row of a key is taken to be itself. The second is a match if it is nearer than `ratio` times the third
    (so a key that looks like several matches none) and isn't the key. A pair that is found from both sides is given
    as the smaller key_id found it; it counts if its places are `apart` or more. Pictures with fewer than ten keys
    have no matches. Nulls as in nearest_keys; a null place is apart from none.
    """
    near = nearest_keys(keys, NEAREST, compare, block).groupBy("media_id", "key_id").agg(*(F.max(F.when(F.col("rank") == k, F.struct("distance", "other"))).alias(f"m{k}") for k in (2, 3)))
    enough = near.groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_KEYS).select("media_id")
    alike = near.filter((F.col("m2.distance") < ratio * F.col("m3.distance")) & (F.col("m2.other") != F.col("key_id"))).select("media_id", "key_id", F.col("m2.other").alias("other"))
    pairs = alike.groupBy("media_id", F.least("key_id", "other").alias("low"), F.greatest("key_id", "other").alias("high")).agg(F.min("key_id").alias("key_id"))
    pairs = pairs.join(enough, "media_id", "left_semi").select("media_id", "key_id", (F.col("low") + F.col("high") - F.col("key_id")).alias("other"))
    place = keys.groupBy("media_id", "key_id").agg(F.min(F.struct("x", "y")).alias("p"))
    at = lambda id_, x, y: place.select("media_id", F.col("key_id").alias(id_), F.col("p.x").cast("double").alias(x), F.col("p.y").cast("double").alias(y))
    met = pairs.join(at("key_id", "x1", "y1"), ["media_id", "key_id"]).join(at("other", "x2", "y2"), ["media_id", "other"])
    far = F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2) >= apart * apart
    return met.filter(far).select("media_id", "key_id", "other", "x1", "y1", "x2", "y2")


_NEXT = "({0} * 1103515245 + 12345) % 2147483648"


def _two_of(t: str, n: str, seed: int) -> tuple[str, str]:
    """SQL of the two different matches that trial t of n matches draws: all ordered pairs in turn if they are no more
    than the trials, else two draws of a linear congruence."""
    one = _NEXT.format(f"({t} + {seed} * 7919)")
    two = _NEXT.format(f"({one})")
    few = f"{n} * ({n} - 1) <= {TRIALS}"
    first = f"CASE WHEN {few} THEN {t} % {n} ELSE ({one}) // 64 % {n} END"
    step = f"CASE WHEN {few} THEN {t} // {n} ELSE ({two}) // 64 % ({n} - 1) END"
    return first, f"({first} + 1 + {step}) % {n}"


def agreed_transformation(matches: DataFrame, seed: int = 0, within: float = REPROJECTION, least: int = LEAST_MATCHES, flagged: int = FLAGGED, sure: float = SURE) -> DataFrame:
    """(media_id, n_matches, inliers, score, detected, trial) of matches(media_id, key_id, other, x1, y1, x2, y2): the
    shift, turn and scale, out of 2,000 trials at most, that brings the most first places within `within` of the second.

    A trial draws two matches, which give the four parameters in closed form; two with one first place give none. Of
    equal trials the first counts. Fewer than `least` matches have no inliers. Costs the trials times the matches.
    """
    # numbered from 0 in the order of their keys within the picture
    w = W.partitionBy("media_id")
    rows = matches.withColumn("i", F.row_number().over(w.orderBy("key_id", "other")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    sizes = rows.groupBy("media_id").agg(F.max("n").cast("long").alias("n"))
    first, second = (x.replace("//", "div") for x in _two_of("t", "n", seed))
    trials = sizes.filter(F.col("n") >= least).select("media_id", F.explode(F.expr(f"sequence(0L, least({TRIALS}L, n * (n - 1)) - 1)")).alias("t"), "n").selectExpr("media_id", "t", f"{first} AS i", f"{second} AS j")
    end = lambda i, tag: rows.select("media_id", F.col("i").cast("long").alias(i), *(F.col(c).alias(f"{tag}{c}") for c in ("x1", "y1", "x2", "y2")))
    drawn = trials.join(end("i", "a"), ["media_id", "i"]).join(end("j", "b"), ["media_id", "j"])
    # second = z * first + shift, with complex z = (p, q)
    drawn = drawn.selectExpr("*", "bx1 - ax1 AS dx", "by1 - ay1 AS dy", "bx2 - ax2 AS ex", "by2 - ay2 AS ey").selectExpr("*", "dx * dx + dy * dy AS dd").filter("dd > 0")
    fits = drawn.selectExpr("media_id", "t", "ax1", "ay1", "ax2", "ay2", "(ex * dx + ey * dy) / dd AS p", "(ey * dx - ex * dy) / dd AS q").selectExpr("media_id", "t", "p", "q", "ax2 - (p * ax1 - q * ay1) AS sx", "ay2 - (q * ax1 + p * ay1) AS sy")
    off = "pow(p * x1 - q * y1 + sx - x2, 2) + pow(q * x1 + p * y1 + sy - y2, 2)"
    votes = fits.join(rows.select("media_id", "x1", "y1", "x2", "y2"), "media_id").groupBy("media_id", "t").agg(F.count_if(F.expr(off) <= within * within).alias("votes"))
    best = votes.groupBy("media_id").agg(F.max(F.struct("votes", (-F.col("t")).alias("back"))).alias("b"))
    inliers = F.coalesce("b.votes", F.lit(0)).cast("long")
    out = sizes.join(best, "media_id", "left").select("media_id", F.col("n").alias("n_matches"), inliers.alias("inliers"), (-F.col("b.back")).alias("trial"))
    return out.select("media_id", "n_matches", "inliers", F.least(F.lit(1.0), F.col("inliers") / sure).alias("score"), (F.col("inliers") >= flagged).alias("detected"), "trial")


#: A vector is a keypoint by its first four components; every third is seen again elsewhere, moved, and every ninth moved by another way.
_FIRST = "vec_id // 64 AS media_id, 2 * vec_id AS key_id, CAST(vec_id * 37 % 640 AS DOUBLE) AS x, CAST(vec_id * 53 % 480 AS DOUBLE) AS y"
_AGAIN = "vec_id // 64 AS media_id, 2 * vec_id + 1 AS key_id, CAST(vec_id * 37 % 640 + CASE WHEN vec_id % 9 = 0 THEN vec_id % 200 ELSE 120 END + vec_id % 5 AS DOUBLE) AS x, CAST(vec_id * 53 % 480 + 60 + vec_id % 3 AS DOUBLE) AS y"
_PART = "[CAST(embedding[1] AS DOUBLE){0}, CAST(embedding[2] AS DOUBLE){0}, CAST(embedding[3] AS DOUBLE){0}, CAST(embedding[4] AS DOUBLE){0}]"
KEYS_SQL = f"kp AS (SELECT {_FIRST}, {_PART.format('')} AS v FROM embeddings UNION ALL SELECT {_AGAIN}, {_PART.format(' + 0.001')} AS v FROM embeddings WHERE vec_id % 3 = 0)"
MATCHES_SQL = (
    f"{KEYS_SQL}, kn AS (SELECT a.media_id, a.key_id, b.key_id AS other, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.media_id, a.key_id ORDER BY list_distance(a.v, b.v), b.key_id) AS rank FROM kp a JOIN kp b ON b.media_id = a.media_id), "
    "k3 AS (SELECT media_id, key_id, max(CASE WHEN rank = 2 THEN other END) AS other, max(CASE WHEN rank = 2 THEN distance END) AS d2, max(CASE WHEN rank = 3 THEN distance END) AS d3, count(*) OVER (PARTITION BY media_id) AS n FROM kn WHERE rank <= 3 GROUP BY media_id, key_id), "
    "kl AS (SELECT media_id, min(key_id) AS key_id, max(greatest(key_id, other)) + min(least(key_id, other)) - min(key_id) AS other FROM k3 WHERE d2 < 0.75 * d3 AND other <> key_id AND n >= 10 GROUP BY media_id, least(key_id, other), greatest(key_id, other)), "
    "km AS (SELECT l.media_id, l.key_id, l.other, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM kl l JOIN kp a ON a.key_id = l.key_id JOIN kp b ON b.key_id = l.other WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) >= 900)"
)


def keypoints(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    spark_sql = lambda x: x.replace("//", "div")
    part = lambda more: F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") + more)
    first = e.select(*(F.expr(x) for x in spark_sql(_FIRST).split(", ")), part(0.0).alias("v"))
    again = e.filter("vec_id % 3 = 0").select(*(F.expr(x) for x in spark_sql(_AGAIN).split(", ")), part(0.001).alias("v"))
    return first.unionByName(again)


@query("j15_keypoint_matches", f"WITH {MATCHES_SQL} SELECT * FROM km")
def j15(spark: SparkSession, d: str) -> DataFrame:
    return self_matches(keypoints(spark, d))


_DRAW = _two_of("t", "n", 0)


@query(
    "m16_copied_regions",
    f"WITH {MATCHES_SQL}, kr AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY key_id, other) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM km), kt AS (SELECT media_id, n, t, {_DRAW[0]} AS i, {_DRAW[1]} AS j FROM (SELECT DISTINCT media_id, n FROM kr WHERE n >= {LEAST_MATCHES}), unnest(range(0, least({TRIALS}, n * (n - 1)))) u(t)), "
    "kd AS (SELECT k.media_id, k.t, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 - a.x1 AS dx, b.y1 - a.y1 AS dy, b.x2 - a.x2 AS ex, b.y2 - a.y2 AS ey FROM kt k JOIN kr a ON a.media_id = k.media_id AND a.i = k.i JOIN kr b ON b.media_id = k.media_id AND b.i = k.j), "
    "kf AS (SELECT *, (ex * dx + ey * dy) / (dx * dx + dy * dy) AS p, (ey * dx - ex * dy) / (dx * dx + dy * dy) AS q FROM kd WHERE dx * dx + dy * dy > 0), kg AS (SELECT media_id, t, p, q, ax2 - (p * ax1 - q * ay1) AS sx, ay2 - (q * ax1 + p * ay1) AS sy FROM kf), "
    f"kv AS (SELECT g.media_id, t, count_if(pow(p * x1 - q * y1 + sx - x2, 2) + pow(q * x1 + p * y1 + sy - y2, 2) <= {REPROJECTION * REPROJECTION}) AS votes FROM kg g JOIN kr r ON r.media_id = g.media_id GROUP BY g.media_id, t), kb AS (SELECT media_id, max(votes) AS votes, arg_max(t, (votes, -t)) AS trial FROM kv GROUP BY media_id) "
    f"SELECT s.media_id, s.n AS n_matches, CAST(coalesce(votes, 0) AS BIGINT) AS inliers, least(1.0, coalesce(votes, 0) / {SURE}) AS score, coalesce(votes, 0) >= {FLAGGED} AS detected, trial FROM (SELECT DISTINCT media_id, n FROM kr) s LEFT JOIN kb ON kb.media_id = s.media_id",
)
def m16(spark: SparkSession, d: str) -> DataFrame:
    return agreed_transformation(self_matches(keypoints(spark, d)))


#: A vector as a picture of 8 by 8, in levels of 0 to 255.
_LEVEL = "floor((x + 1) * 127)"


def pictures(spark: SparkSession, d: str) -> DataFrame:
    level = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor((x + 1) * 127).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", level.alias("p")).select("vec_id", F.expr("transform(sequence(0, 7), r -> slice(p, 8 * r + 1, 8))").alias("picture"))


_AT = "p[8 * {0} + {1} + 1]"
_LAPLACE = f"{_AT.format('abs(r - 1)', 'c')} + {_AT.format('(7 - abs(6 - r))', 'c')} + {_AT.format('r', 'abs(c - 1)')} + {_AT.format('r', '(7 - abs(6 - c))')} - 4 * {_AT.format('r', 'c')}"


@query(
    "m14_laplacian_variance",
    f"WITH s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: {_LEVEL}) AS p FROM embeddings), l AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, p FROM s, unnest(range(0, 64)) u(i)) SELECT vec_id, round(var_pop({_LAPLACE}), 6) AS variance FROM l GROUP BY vec_id",
)
def m14(spark: SparkSession, d: str) -> DataFrame:
    return pictures(spark, d).select("vec_id", F.round(laplacian_variance(F.col("picture")), 6).alias("variance"))


#: The two-dimensional transform as plain sums over 64 places for each of 64 frequencies.
_SUM = "list_sum(list_transform(range(0, 64), lambda i: p[i + 1] * {0}(2 * pi() * ((i // 8) * (k // 8) + (i % 8) * (k % 8)) / 8)))"


@query(
    "m14_high_frequency_share",
    f"WITH s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: {_LEVEL}) AS p FROM embeddings), f AS (SELECT vec_id, k, sqrt(pow({_SUM.format('cos')}, 2) + pow({_SUM.format('sin')}, 2)) AS m FROM s, unnest(range(0, 64)) u(k)), "
    "g AS (SELECT vec_id, m, pow((k // 8 + 4) % 8 - 4, 2) + pow((k % 8 + 4) % 8 - 4, 2) > 9 AS high FROM f) SELECT vec_id, round(sum(CASE WHEN high THEN m ELSE 0 END) / sum(m), 6) AS share FROM g GROUP BY vec_id",
)
def m14_high(spark: SparkSession, d: str) -> DataFrame:
    """The share of a picture's spectrum beyond three quarters of the radius."""
    return pictures(spark, d).select("vec_id", F.round(high_share_of("picture"), 6).alias("share"))
