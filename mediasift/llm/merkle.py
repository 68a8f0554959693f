"""Merkle manifest of a dataset (operator 13): a leaf for each row, a tree for each group, a tree over the groups.

Rows are numbered by ranges of (group, key), so a hot group is spread over tasks as any other. The numbered nodes of
a group are cut into runs of `fanout ** levels` neighbours, at most 256. Within such a run every level is a window:
columns that lag and lead by a fixed offset (1, 2, 4, .. rows), masked by a row's slot among its siblings and by the
length of their run, hold the siblings, and the row of the first child hashes the parent. What is left of a run, one
node, goes to the next tier, where 256 times fewer are left. So a window never holds more than 256 rows, a tree of
10^11 leaves takes five tiers, and the upper tiers' paths are joined downwards, each with 256 times as many rows as
the one above. Everything is an expression of Spark; digests are lowercase hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, materialize, shuffle_partitions, table

RUN = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Groups by part that are broadcast; beyond it they are joined by a shuffle.
FEW_GROUPS = 50_000


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The digest of values one after another: '-' for null, else the bytes of its UTF-8 text, ':' and the text."""
    own = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return digest(F.concat(*own))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path of (before, after) give."""
    return F.aggregate(path, start, lambda so_far, x: digest(F.concat(x["before"], so_far, x["after"])))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `pos`, its place from 0 in the order of the columns (nulls first), and `part`, a range of places.

    Rows go to as many ranges as there are shuffle partitions; what is gathered is one count for each range.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "merkle-ranged")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("__before"))
    return ranged.join(F.broadcast(before), "part").withColumn("pos", F.col("__before") + F.col("__at")).drop("__at", "__before")


def _levels(fanout: int) -> int:
    levels = 1
    while fanout ** (levels + 1) <= RUN:
        levels += 1
    return levels


def _tier(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes(g, i, n, h, ..) with `run`, `path` (the siblings of the node and of its ancestors within the run, from
    below) and, on a run's first row, `top`, what is left of the run. `n` is the number of nodes of the group."""
    w = W.partitionBy("g", "run").orderBy("i")
    rows = nodes.withColumn("run", F.floor(F.col("i") / fanout**levels)).withColumn("h0", F.col("h"))
    for level in range(levels):
        step = fanout**level
        own = F.col(f"h{level}")
        rows = rows.withColumns({f"__{d}": (F.lead(own, d * step) if d > 0 else F.lag(own, -d * step)).over(w) for d in range(1 - fanout, fanout) if d})
        slot, holds, open_ = F.floor(F.col("i") / step) % fanout, F.col("i") % step == 0, F.col("n") > step
        before = F.concat(F.lit(""), *(F.when(slot + d >= 0, F.col(f"__{d}")).otherwise("") for d in range(1 - fanout, 0)))
        after = F.concat(F.lit(""), *(F.when(slot + d < fanout, F.coalesce(F.col(f"__{d}"), F.lit(""))).otherwise("") for d in range(1, fanout)))
        sides = F.when(holds & open_, F.struct(before.alias("before"), after.alias("after")))
        parent = F.when(F.col("i") % (step * fanout) == 0, F.when(open_, digest(F.concat(own, F.col(f"s{level}.after")))).otherwise(own))
        rows = rows.withColumn(f"s{level}", sides).withColumn(f"h{level + 1}", parent).drop(*(f"__{d}" for d in range(1 - fanout, fanout) if d), f"h{level}")
    # a row's ancestor at a level is held by the last row before it that begins one
    spread = [F.last(f"s{level}", ignorenulls=True).over(w) if level else F.col("s0") for level in range(levels)]
    rows = rows.withColumn("path", F.filter(F.array(*spread), lambda x: x.isNotNull())).withColumnRenamed(f"h{levels}", "top")
    return rows.drop(*(f"s{level}" for level in range(levels)))


def trees(nodes: DataFrame, fanout: int = 2) -> DataFrame:
    """nodes(g, i, n, h, ..) with `path` and `root` of each node: the nodes of a group g, numbered i from 0 to n - 1,
    in runs of `fanout`, the last of fewer, each run hashed to one node until one is left. A lone node is its root."""
    levels = _levels(fanout)
    tiers = [nodes]
    while (tiers[-1].agg(F.max("n").alias("m")).first()["m"] or 0) > fanout**levels:
        whole = _tier(tiers[-1].select("g", "i", "n", "h"), fanout, levels).filter("top IS NOT NULL")
        tiers.append(materialize(whole.select("g", F.col("run").alias("i"), F.ceil(F.col("n") / fanout**levels).alias("n"), F.col("top").alias("h")), "merkle-tier"))
    above = None
    for tier in reversed(tiers):
        rows = _tier(tier, fanout, levels)
        if above is None:
            done = rows.withColumn("root", F.first("top", ignorenulls=True).over(W.partitionBy("g", "run").orderBy("i")))
        else:
            upper = above.select("g", F.col("i").alias("run"), F.col("path").alias("__path"), "root")
            done = rows.join(upper, ["g", "run"]).withColumn("path", F.concat("path", "__path")).drop("__path")
        above = done.drop("run", "top")
    return above


def manifest(rows: DataFrame, group: str = "lang", key: str = "doc_id", leaf: str = "leaf", fanout: int = 2) -> DataFrame:
    """rows(group, key, leaf, ..) with `subroot` of their group, `root` of everything and `path`, the siblings from
    the leaf to the root as (before, after): `folded(leaf, path)` is the root.

    Within a group leaves ascend by key, those of one key by their digest (rows that repeat both have one leaf, so
    their order changes no digest). Null keys come first, and a null group is the first group; groups ascend by the
    bytes of their UTF-8. Texts count only by their leaf. Other columns stay as they are, whatever their names, unless
    they are those that this adds. An empty table gives no rows.
    """
    names = rows.columns
    own = {name: f"c{k}" for k, name in enumerate(names)}
    group, key = own[group], own[key]
    placed = numbered(materialize(rows.toDF(*own.values()).withColumnRenamed(own[leaf], "h"), "merkle-leaves"), group, key, "h")
    # of each group in each range the first place and the rows: a row for each group, and one more for each range
    parts = materialize(placed.groupBy("part", group).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("own")), "merkle-groups")
    whole = parts.groupBy(F.col(group).alias("of")).agg(F.min("first").alias("g"), F.sum("own").alias("n"))
    named = parts.select(F.col("part").alias("at"), group).join(whole, F.col(group).eqNullSafe(F.col("of"))).select("at", "of", "g", "n")
    few = parts.count() <= FEW_GROUPS
    met = placed.join(F.broadcast(named) if few else named, (F.col("part") == F.col("at")) & F.col(group).eqNullSafe(F.col("of")))
    nodes = materialize(met.select(*(c for n, c in own.items() if n != leaf), "h", "g", (F.col("pos") - F.col("g")).alias("i"), "n"), "merkle-nodes")
    below = trees(nodes, fanout)
    # a row for each group: the first leaf's root is the group's
    subroots = numbered(materialize(below.filter("i = 0").select("g", F.col("root").alias("h")), "merkle-subroots"), "g")
    number = subroots.count()
    upper = trees(subroots.select(F.lit(0).cast("long").alias("g"), F.col("pos").alias("i"), F.lit(number).cast("long").alias("n"), "h", F.col("g").alias("of")), fanout)
    upper = materialize(upper.select(F.col("of").alias("g"), F.col("path").alias("rest"), F.col("root").alias("whole")), "merkle-upper")
    out = below.join(F.broadcast(upper) if number <= FEW_GROUPS else upper, "g")
    return out.select(*(F.col("h" if n == leaf else c).alias(n) for n, c in own.items()), F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("path", "rest").alias("path"))


def verify(listed: DataFrame, now: str, leaf: str = "leaf") -> DataFrame:
    """manifest's rows with `folded_root`, recomputed from the digests in column `now` (those of the leaf where null)
    and the listed siblings, and `verified`, whether that is the root."""
    found = listed.withColumn("folded_root", folded(F.coalesce(F.col(now), F.col(leaf)), F.col("path")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, from below, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, verified against rows of which a seventh have one more in n_chars."""
    docs = table(spark, sf_dir, "documents")
    touched = F.when((fold("doc_id", 7) == 0) & F.col("n_chars").isNotNull(), leaf(*(F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS)))
    rows = docs.select("doc_id", "lang", leaf(*map(F.col, FIELDS)).alias("leaf"), touched.alias("now"))
    found = verify(manifest(rows), "now")
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


#: crc32 of a decimal number's text, bit by bit.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"
_VALUE = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256({})"
_PLAIN, _TOUCHED = (_LEAF.format(" || ".join(_VALUE.format(f"({c} + 1)" if more and c == "n_chars" else c) for c in FIELDS)) for more in (False, True))
_NODE = "sha256(string_agg(h, '' ORDER BY i))"
OP13_SQL = (
    f"WITH RECURSIVE dk AS (SELECT *, CAST(doc_id AS VARCHAR) AS k FROM documents), dl AS (SELECT doc_id, lang, {_PLAIN} AS leaf, CASE WHEN doc_id IS NOT NULL AND ({_CRC}) % 7 = 0 THEN {_TOUCHED} ELSE {_PLAIN} END AS now FROM dk), "
    "lf AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM dl), "
    f"lo AS (SELECT 0 AS level, g, i, n, leaf AS h FROM lf UNION ALL SELECT level + 1, g, i // 2, CAST(ceil(max(n) / 2) AS BIGINT), {_NODE} FROM lo WHERE n > 1 GROUP BY level, g, i // 2), "
    "sr AS (SELECT g, h FROM lo WHERE n = 1), "
    f"hi AS (SELECT 0 AS level, g AS i, (SELECT count(*) FROM sr) AS n, h FROM sr UNION ALL SELECT level + 1, i // 2, CAST(ceil(max(n) / 2) AS BIGINT), {_NODE} FROM hi WHERE n > 1 GROUP BY level, i // 2), "
    "al AS (SELECT level, g, i, n, h, coalesce(max(level) OVER (PARTITION BY g), 0) AS top FROM lo), "
    "pa AS (SELECT f.g, f.i AS leaf, a.level AS place, (f.i >> a.level) % 2 AS slot, coalesce(s.h, '') AS h FROM lf f JOIN lo a ON a.g = f.g AND a.i = f.i >> a.level AND a.n > 1 LEFT JOIN lo s ON s.g = a.g AND s.level = a.level AND s.i = xor(a.i, 1) "
    "UNION ALL SELECT f.g, f.i, 1000 + a.level, (f.g >> a.level) % 2, coalesce(s.h, '') FROM lf f JOIN hi a ON a.i = f.g >> a.level AND a.n > 1 LEFT JOIN hi s ON s.level = a.level AND s.i = xor(a.i, 1)), "
    "pl AS (SELECT g, leaf AS i, sha256(string_agg(h, '' ORDER BY place)) AS proof_sha256, list({'slot': slot, 'h': h} ORDER BY place) AS path FROM pa GROUP BY g, leaf), "
    "fo AS (SELECT f.g, f.i, 0 AS step, f.now AS h, p.path FROM lf f LEFT JOIN pl p USING (g, i) UNION ALL SELECT g, i, step + 1, CASE WHEN path[step + 1].slot = 1 THEN sha256(path[step + 1].h || h) ELSE sha256(h || path[step + 1].h) END, path FROM fo WHERE step < len(path)), "
    "fe AS (SELECT g, i, arg_max(h, step) AS folded_root FROM fo GROUP BY g, i) "
    "SELECT f.doc_id, f.leaf, sr.h AS subroot, (SELECT h FROM hi WHERE n = 1) AS root, coalesce(pl.proof_sha256, sha256('')) AS proof_sha256, fe.folded_root, fe.folded_root = (SELECT h FROM hi WHERE n = 1) AS verified FROM lf f JOIN sr USING (g) LEFT JOIN pl USING (g, i) JOIN fe USING (g, i)"
)
