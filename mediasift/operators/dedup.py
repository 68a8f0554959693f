"""Exact, perceptual and acoustic duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.operators.nearest import acoustic_costs, hamming_costs, near_hashes, nearest_others
from mediasift.operators.registry import query
from mediasift.sources.views import MEDIA_SQL, media, table

CANDIDATES, ACOUSTIC = 100, 0.80


def exact_duplicates(df: DataFrame, key: str, order: list[str], id: str) -> DataFrame:
    """(id, duplicate_of): for each row whose key another has, the earliest other by `order`.

    The two earliest of a key are found by partial aggregates, so a key with a third of all rows costs a
    task one row; the first row of a key is a duplicate of the second.
    """
    place = F.struct(*order, id)
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(id).alias("id"), place.alias("p"))
    first = rows.groupBy("k").agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    both = rows.join(first, "k")
    second = both.filter("p != first").groupBy("k").agg(F.min("p").alias("second"))
    found = both.join(second, "k")
    return found.select(F.col("id").alias(id), F.when(F.col("p") == F.col("first"), F.col(f"second.{id}")).otherwise(F.col(f"first.{id}")).alias("duplicate_of"))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes; -1 if either isn't one."""
    valid = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    return F.when(valid, F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))).otherwise(-1)


def bits_of_hex(a: Column) -> Column:
    """64 binary digits, most significant first; null unless there are 16 hex digits."""
    return F.when(F.length(a) == 16, F.lpad(F.conv(a, 16, 2), 64, "0"))


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / 64.0)


def perceptual_hashes(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, bits): 64 bits of an embedding, bit i set if component i exceeds the next one round."""
    bits = F.expr("array_join(transform(sequence(0, 63), i -> IF(embedding[i] > embedding[(i + 1) % 64], '1', '0')), '')")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("media_id"), bits.alias("bits"))


PHASH_SQL = "ph AS (SELECT vec_id AS media_id, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > embedding[(i + 1) % 64 + 1] THEN '1' ELSE '0' END), '') AS bits FROM embeddings)"


def perceptual_duplicates(hashes: DataFrame, threshold: int, candidates: int = CANDIDATES) -> DataFrame:
    """(media_id, duplicate_of, distance): nearest of the first `candidates` others within the threshold, the earliest of equals.

    The operator's own bound on candidates makes the broadcast side at most candidates + 1 rows.
    """
    number = hashes.select("media_id", F.conv("bits", 2, -10).cast("long").alias("h"))
    first = number.orderBy("media_id").limit(candidates + 1).agg(F.array_sort(F.collect_list(F.struct("media_id", "h"))).alias("c"))
    nearest = F.expr(f"array_min(transform(slice(filter(c, x -> x.media_id != media_id), 1, {candidates}), x -> struct(bit_count(x.h ^ h) AS distance, x.media_id AS other)))")
    return number.join(F.broadcast(first)).withColumn("m", nearest).filter(F.col("m.distance") <= threshold).select("media_id", F.col("m.other").alias("duplicate_of"), F.col("m.distance").cast("long").alias("distance"))


def perceptual_duplicates_all(hashes: DataFrame, threshold: int) -> DataFrame:
    """(media_id, duplicate_of, distance): nearest of all others within the threshold, the earliest of equals. Up to 11 bits
    by parts that are near, beyond by blocks."""
    number = hashes.select("media_id", F.conv("bits", 2, -10).cast("long").alias("print"))
    near = near_hashes(number, threshold) if threshold < 12 else nearest_others(number, hamming_costs, threshold)
    return near.select("media_id", "duplicate_of", F.col("cost").cast("long").alias("distance"))


def acoustic_similarity(a: Column, b: Column) -> Column:
    """Best 1 - bit error rate of two arrays of 16-bit frames over small shifts; 0 if either is empty."""
    def at(s: Column) -> Column:
        first, second = F.greatest(F.lit(0), s), F.greatest(F.lit(0), -s)
        n = F.least(F.size(a) - first, F.size(b) - second)
        wrong = F.aggregate(F.zip_with(F.slice(a, first + 1, n), F.slice(b, second + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(65535).cast("long")))), F.lit(0), lambda t, x: t + x)
        return F.when(n > 0, 1 - wrong / (16.0 * n)).otherwise(0.0)

    m = F.least(F.lit(5), F.floor(F.least(F.size(a), F.size(b)) / 2).cast("int"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_max(F.transform(F.sequence(-m, m), at))).otherwise(0.0)


def cascade(m: DataFrame, exact: DataFrame, near: DataFrame, heard: DataFrame) -> DataFrame:
    """For each medium the first of exact (e), near (h, distance) and heard (a, s) that it has."""
    kind = F.when(F.col("e").isNotNull(), "EXACT").when(F.col("h").isNotNull(), "PERCEPTUAL").when(F.col("a").isNotNull(), "ACOUSTIC").otherwise("NONE")
    score = F.when(F.col("e").isNotNull(), 1.0).when(F.col("h").isNotNull(), similarity(F.col("distance"))).otherwise(F.coalesce("s", F.lit(0.0)))
    joined = m.join(exact, "media_id", "left").join(near, "media_id", "left").join(heard, "media_id", "left")
    return joined.select("media_id", F.coalesce("e", "h", "a").alias("duplicate_of"), kind.alias("match_type"), score.alias("similarity"))


def acoustic_prints(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, print): the perceptual hash of a sound cut into four 16-bit frames."""
    frames = F.expr("transform(sequence(0, 3), i -> cast(conv(substring(bits, 16 * i + 1, 16), 2, 10) as bigint))")
    return perceptual_hashes(spark, d).filter("media_id % 4 = 2").select("media_id", frames.alias("print"))


ACOUSTIC_SQL = (
    "au AS (SELECT media_id, bits FROM ph WHERE media_id % 4 = 2), "
    "sh AS (SELECT a.media_id, c.media_id AS other, max(1 - hamming(substr(a.bits, 16 * greatest(0, s) + 1, 16 * (4 - abs(s))), substr(c.bits, 16 * greatest(0, -s) + 1, 16 * (4 - abs(s)))) / (16.0 * (4 - abs(s)))) AS similarity "
    "FROM au a JOIN au c ON a.media_id <> c.media_id, unnest(range(-2, 3)) AS t(s) GROUP BY a.media_id, c.media_id), "
    "ac AS (SELECT media_id, arg_min(other, (-similarity, other)) AS other, max(similarity) AS similarity FROM sh WHERE similarity >= 0.8 GROUP BY media_id)"
)


def acoustic_duplicates(prints: DataFrame, threshold: float = ACOUSTIC) -> DataFrame:
    """(media_id, duplicate_of, similarity): most similar of all others from the threshold on, the earliest of equals."""
    return nearest_others(prints, acoustic_costs, -threshold).select("media_id", "duplicate_of", (-F.col("cost")).alias("similarity"))


@query(
    "j1_exact_duplicate",
    f"WITH {MEDIA_SQL} SELECT a.media_id, min(b.media_id) AS duplicate_of, 1.0 AS similarity FROM media a JOIN media b ON a.sha256 = b.sha256 AND a.media_id <> b.media_id GROUP BY a.media_id",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    return exact_duplicates(media(spark, d), "sha256", [], "media_id").withColumn("similarity", F.lit(1.0))


@query(
    "t1_tie_break",
    f"WITH {MEDIA_SQL}, m AS (SELECT media_id, sha256, (media_id * 7919) % 101 AS created FROM media) SELECT a.media_id, arg_min(b.media_id, (b.created, b.media_id)) AS duplicate_of FROM m a JOIN m b ON a.sha256 = b.sha256 AND a.media_id <> b.media_id GROUP BY a.media_id",
)
def t1(spark: SparkSession, d: str) -> DataFrame:
    """Exact duplicates by time of creation (here a number that isn't in the order of ids), then id."""
    return exact_duplicates(media(spark, d).select("media_id", "sha256", (F.col("media_id") * 7919 % 101).alias("created")), "sha256", ["created"], "media_id")


@query(
    "j2_perceptual_duplicate",
    f"WITH {PHASH_SQL}, h AS (SELECT a.media_id, c.media_id AS other, CAST(hamming(a.bits, c.bits) AS BIGINT) AS distance FROM ph a JOIN ph c ON a.media_id <> c.media_id WHERE a.media_id % 4 = 0 AND c.media_id % 4 = 0) "
    "SELECT media_id, arg_min(other, (distance, other)) AS duplicate_of, min(distance) AS distance FROM h WHERE distance <= 20 GROUP BY media_id",
)
def j2(spark: SparkSession, d: str) -> DataFrame:
    """Among all other images. Threshold 20, as these hashes have no pair within the usual 10. `perceptual_duplicates` keeps
    the reference's bound of 100 candidates for who needs its very results."""
    return perceptual_duplicates_all(perceptual_hashes(spark, d).filter("media_id % 4 = 0"), 20)


@query(
    "j2_perceptual_duplicate_all",
    f"WITH {PHASH_SQL}, h AS (SELECT a.media_id, c.media_id AS other, CAST(hamming(a.bits, c.bits) AS BIGINT) AS distance FROM ph a JOIN ph c ON a.media_id <> c.media_id) "
    "SELECT media_id, arg_min(other, (distance, other)) AS duplicate_of, min(distance) AS distance FROM h WHERE distance <= 16 GROUP BY media_id",
)
def j2_all(spark: SparkSession, d: str) -> DataFrame:
    """Among all others."""
    return perceptual_duplicates_all(perceptual_hashes(spark, d), 16)


#: Every vector's print, and for every third one that differs from it by up to twelve bits.
COPIES_SQL = f"{PHASH_SQL}, pc AS (SELECT media_id, bits FROM ph UNION ALL SELECT 1000000000 + media_id, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN i % 5 = media_id % 5 AND i <= 5 * (media_id % 13) THEN CASE WHEN bits[i] = '1' THEN '0' ELSE '1' END ELSE bits[i] END), '') FROM ph WHERE media_id % 3 = 0)"


def copied_hashes(spark: SparkSession, d: str) -> DataFrame:
    own = perceptual_hashes(spark, d)
    flipped = F.expr("array_join(transform(sequence(1, 64), i -> IF(i % 5 = media_id % 5 AND i <= 5 * (media_id % 13), IF(substr(bits, i, 1) = '1', '0', '1'), substr(bits, i, 1))), '')")
    return own.unionByName(own.filter("media_id % 3 = 0").select((F.col("media_id") + 1_000_000_000).alias("media_id"), flipped.alias("bits")))


@query(
    "j2_perceptual_duplicate_10",
    f"WITH {COPIES_SQL}, h AS (SELECT a.media_id, c.media_id AS other, CAST(hamming(a.bits, c.bits) AS BIGINT) AS distance FROM pc a JOIN pc c ON a.media_id <> c.media_id) SELECT media_id, arg_min(other, (distance, other)) AS duplicate_of, min(distance) AS distance FROM h WHERE distance <= 10 GROUP BY media_id",
)
def j2_ten(spark: SparkSession, d: str) -> DataFrame:
    """Among all others, at the reference's own threshold."""
    return perceptual_duplicates_all(copied_hashes(spark, d), 10)


@query(
    "j4_duplicate_cascade",
    f"WITH {MEDIA_SQL}, {PHASH_SQL}, {ACOUSTIC_SQL}, e AS (SELECT a.media_id, min(b.media_id) AS other FROM media a JOIN media b ON a.sha256 = b.sha256 AND a.media_id <> b.media_id GROUP BY a.media_id), "
    "h AS (SELECT a.media_id, arg_min(c.media_id, (hamming(a.bits, c.bits), c.media_id)) AS other, min(hamming(a.bits, c.bits)) AS distance FROM ph a JOIN ph c ON a.media_id <> c.media_id WHERE a.media_id % 4 = 0 AND c.media_id % 4 = 0 AND hamming(a.bits, c.bits) <= 20 GROUP BY a.media_id) "
    "SELECT m.media_id, coalesce(e.other, h.other, ac.other) AS duplicate_of, CASE WHEN e.other IS NOT NULL THEN 'EXACT' WHEN h.other IS NOT NULL THEN 'PERCEPTUAL' WHEN ac.other IS NOT NULL THEN 'ACOUSTIC' ELSE 'NONE' END AS match_type, "
    "CASE WHEN e.other IS NOT NULL THEN 1.0 WHEN h.other IS NOT NULL THEN 1 - h.distance / 64.0 WHEN ac.other IS NOT NULL THEN ac.similarity ELSE 0.0 END AS similarity FROM media m LEFT JOIN e USING (media_id) LEFT JOIN h USING (media_id) LEFT JOIN ac USING (media_id)",
)
def j4(spark: SparkSession, d: str) -> DataFrame:
    """Exact before perceptual (images alone) before acoustic (sounds alone) before none."""
    m = media(spark, d).select("media_id", "sha256")
    exact = exact_duplicates(m, "sha256", [], "media_id").withColumnRenamed("duplicate_of", "e")
    near = perceptual_duplicates_all(perceptual_hashes(spark, d).filter("media_id % 4 = 0"), 20).withColumnRenamed("duplicate_of", "h")
    heard = acoustic_duplicates(acoustic_prints(spark, d)).select("media_id", F.col("duplicate_of").alias("a"), F.col("similarity").alias("s"))
    return cascade(m, exact, near, heard)


@query("j3_acoustic_duplicate", f"WITH {PHASH_SQL}, {ACOUSTIC_SQL} SELECT media_id, other AS duplicate_of, similarity FROM ac")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return acoustic_duplicates(acoustic_prints(spark, d))


@query(
    "j4_duplicate_cascade_all",
    f"WITH {MEDIA_SQL}, {PHASH_SQL}, {ACOUSTIC_SQL}, e AS (SELECT a.media_id, min(b.media_id) AS other FROM media a JOIN media b ON a.sha256 = b.sha256 AND a.media_id <> b.media_id GROUP BY a.media_id), "
    "h AS (SELECT a.media_id, arg_min(c.media_id, (hamming(a.bits, c.bits), c.media_id)) AS other, min(hamming(a.bits, c.bits)) AS distance FROM ph a JOIN ph c ON a.media_id <> c.media_id WHERE hamming(a.bits, c.bits) <= 16 GROUP BY a.media_id) "
    "SELECT m.media_id, coalesce(e.other, h.other, ac.other) AS duplicate_of, CASE WHEN e.other IS NOT NULL THEN 'EXACT' WHEN h.other IS NOT NULL THEN 'PERCEPTUAL' WHEN ac.other IS NOT NULL THEN 'ACOUSTIC' ELSE 'NONE' END AS match_type, "
    "CASE WHEN e.other IS NOT NULL THEN 1.0 WHEN h.other IS NOT NULL THEN 1 - h.distance / 64.0 WHEN ac.other IS NOT NULL THEN ac.similarity ELSE 0.0 END AS similarity FROM media m LEFT JOIN e USING (media_id) LEFT JOIN h USING (media_id) LEFT JOIN ac USING (media_id)",
)
def j4_all(spark: SparkSession, d: str) -> DataFrame:
    """Exact before perceptual before acoustic before none, each among all media."""
    m = media(spark, d).select("media_id", "sha256")
    exact = exact_duplicates(m, "sha256", [], "media_id").withColumnRenamed("duplicate_of", "e")
    near = perceptual_duplicates_all(perceptual_hashes(spark, d), 16).withColumnRenamed("duplicate_of", "h")
    heard = acoustic_duplicates(acoustic_prints(spark, d)).select("media_id", F.col("duplicate_of").alias("a"), F.col("similarity").alias("s"))
    return cascade(m, exact, near, heard)


@query(
    "m1_hamming_distance",
    f"WITH {MEDIA_SQL} SELECT media_id, CAST(bit_count(xor(('0x' || sha256[1:16])::UBIGINT, ('0x' || sha256[17:32])::UBIGINT)) AS BIGINT) AS distance, greatest(0.0, 1 - bit_count(xor(('0x' || sha256[1:16])::UBIGINT, ('0x' || sha256[17:32])::UBIGINT)) / 64.0) AS similarity FROM media",
)
def m1(spark: SparkSession, d: str) -> DataFrame:
    distance = hamming_hex(F.substring("sha256", 1, 16), F.substring("sha256", 17, 16))
    return media(spark, d).select("media_id", distance.cast("long").alias("distance"), similarity(distance).alias("similarity"))


@query("x12_hash_bits", f"WITH {MEDIA_SQL} SELECT media_id, lpad(bin(('0x' || sha256[1:16])::UBIGINT), 64, '0') AS bits FROM media")
def x12(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).select("media_id", bits_of_hex(F.substring("sha256", 1, 16)).alias("bits"))


@query(
    "a5_acoustic_similarity",
    f"WITH {MEDIA_SQL}, f AS (SELECT media_id, list_transform(range(0, 8), lambda i: ('0x' || sha256[i * 4 + 1:i * 4 + 4])::BIGINT) AS a, list_transform(range(8, 16), lambda i: ('0x' || sha256[i * 4 + 1:i * 4 + 4])::BIGINT) AS b FROM media), "
    "s AS (SELECT media_id, s, greatest(0, s) AS i, greatest(0, -s) AS j, 8 - abs(s) AS n, a, b FROM f, unnest(range(-4, 5)) AS t(s)) "
    "SELECT media_id, max(1 - list_sum(list_transform(range(1, n + 1), lambda k: bit_count(xor(a[i + k], b[j + k])))) / (16.0 * n)) AS similarity FROM s GROUP BY media_id",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    """The first and second half of a digest as two prints of eight frames."""
    frame = lambda at: F.expr(f"transform(sequence({at}, {at + 7}), i -> cast(conv(substring(sha256, i * 4 + 1, 4), 16, 10) as bigint))")
    return media(spark, d).select("media_id", frame(0).alias("a"), frame(8).alias("b")).select("media_id", acoustic_similarity(F.col("a"), F.col("b")).alias("similarity"))
