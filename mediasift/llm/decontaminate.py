r"""Benchmark decontamination by winnowing (operator 6), with DataFrame functions only.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. The
5-grams of a text are hashed and of every 9 consecutive hashes the least is kept as a fingerprint, so any
13 consecutive words that two texts share give both the same fingerprint. Fingerprints of documents and
benchmark items are joined; only around the 5-grams that met are the 13-word windows of a document
written out and joined with the items' windows, word for word.

For fingerprints the text is upper-cased as a whole, which is fast and a function of each character
alone: words that are equal after A-Z are lower-cased are equal in upper case, so nothing is lost.
Windows are compared as the contract says. Items of fewer than 13 words are one window each; for each
such length that the benchmark has (at most 12) the documents' grams of that length join with the items'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    """The words of a text, their case unchanged; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _grams(of: str, size: int) -> Column:
    """Hashes of the grams of `size` words; [] for a text with fewer."""
    return F.expr(f"CASE WHEN size({of}) >= {size} THEN transform(sequence(1, size({of}) - {size - 1}), i -> xxhash64({size}, slice({of}, i, {size}))) ELSE CAST(array() AS array<bigint>) END")


def _winnowed(of: str) -> Column:
    return F.expr(f"CASE WHEN size({of}) >= {SPAN} THEN array_distinct(transform(sequence(1, size({of}) - {SPAN - 1}), i -> array_min(slice({of}, i, {SPAN})))) ELSE CAST(array() AS array<bigint>) END")


def _fingerprints(texts: DataFrame, short: list[int]) -> DataFrame:
    """texts(.., __w upper-case words) with __fp: winnowed 5-gram hashes and all hashes of the short lengths."""
    marked = texts.withColumn("__g", _grams("__w", GRAM)).withColumn("__f", _winnowed("__g"))
    for size in short:
        marked = marked.withColumn("__f", F.concat("__f", F.array_distinct(_grams("__w", size))))
    return marked


def _small(df: DataFrame, size: int) -> DataFrame:
    """df to be broadcast if its `size` in bytes is allowed for that, else to be shuffled."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _near(met: DataFrame, prints: DataFrame, gram: int, window: int) -> DataFrame:
    """(doc_id, h, s, len, win): windows of `window` words of the texts in met (doc_id, h, __w, lw) that hold a gram of `prints`.

    Each place of a gram carries the words within a window of it and no more, so a long text costs no more than its length.
    """
    reach = window - gram
    # the number of places is checked inside the explode: a filter on grams would be pushed below the arrays, which would be computed anew for each place
    places = met.withColumn("__g", _grams("__w", gram)).select("doc_id", "h", F.explode(F.expr(
        f"CASE WHEN size(lw) >= {window} THEN transform(__g, (fp, i) -> struct(i + 1 AS p, fp, size(lw) AS n, slice(lw, greatest(1, i + 1 - {reach}), i + 1 + {window} - greatest(1, i + 1 - {reach})) AS near)) END"
    )).alias("x")).select("doc_id", "h", "x.*")
    first, last = f"greatest(1, p - {reach})", f"least(p, n - {window - 1})"
    starts = F.expr(f"transform(sequence({first}, {last}), s -> struct(s AS s, {window} AS len, array_join(slice(near, s - {first} + 1, {window}), ' ') AS win))")
    held = places.join(prints, "fp", "left_semi").filter(f"{first} <= {last}")
    return held.select("doc_id", "h", F.explode(starts).alias("x")).select("doc_id", "h", "x.*")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, text_hash) for each row of docs.

    A document word inside an occurrence of a window is hit; contaminated if a twentieth of the words or
    more are. Null and empty texts have no words and aren't contaminated; items without words or without
    an item_id are left out; repeated items and rows give repeated results, each as if it stood alone;
    rows that share a doc_id are told apart by their text. Other columns aren't read. Empty tables give
    no rows, or no hits.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.upper(item_text)).alias("__w"), words(lowered(F.col(item_text))).alias("lw")).filter("item IS NOT NULL AND size(lw) > 0")
    short = sorted(r["n"] for r in items.select(F.size("lw").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())  # 12 numbers at most
    windows = items.select("item", F.explode_outer(F.expr(f"CASE WHEN size(lw) >= {WINDOW} THEN transform(sequence(1, size(lw) - {WINDOW - 1}), i -> array_join(slice(lw, i, {WINDOW}), ' ')) ELSE array(array_join(lw, ' ')) END")).alias("win")).distinct()
    item_prints = _fingerprints(items.filter(F.size("lw") >= WINDOW), []).select(F.explode_outer("__f").alias("fp"))
    for size in short:
        item_prints = item_prints.unionByName(items.filter(F.size("lw") == size).select(F.explode_outer(_grams("__w", size)).alias("fp")))
    item_prints = item_prints.filter("fp IS NOT NULL").distinct()
    known = _small(item_prints, 64 * item_prints.count())
    width = windows.agg(F.sum(F.octet_length("win") + F.octet_length("item") + 64).alias("n")).first()["n"] or 0

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    prints = _fingerprints(own.select("doc_id", "h", words(F.upper("text")).alias("__w")), short).select("doc_id", "h", F.explode_outer("__f").alias("fp")).filter("fp IS NOT NULL")
    hits = prints.join(known, "fp", "left_semi").select("doc_id", "h").distinct()

    met = own.alias("d").join(hits.alias("m"), F.expr("d.h = m.h AND d.doc_id <=> m.doc_id"), "left_semi").select("d.doc_id", "d.h", words(F.upper("d.text")).alias("__w"), words(lowered(F.col("d.text"))).alias("lw"))
    near = _near(met, known, GRAM, WINDOW)
    for size in short:
        near = near.unionByName(_near(met, known, size, size))
    # a window that many items hold stays one row here; its items are joined to documents once for each document that has it
    found = near.join(_small(windows.select("win").distinct(), width), "win", "left_semi").groupBy("doc_id", "h", "win").agg(F.collect_set(F.struct("s", "len")).alias("at"))
    covered = found.groupBy("doc_id", "h").agg(F.expr("size(array_distinct(flatten(transform(flatten(collect_list(at)), x -> sequence(x.s, x.s + x.len - 1)))))").cast("long").alias("n_hit"))
    held = found.select("doc_id", "h", "win").join(_small(windows, width), "win").select("doc_id", "h", "item").distinct().groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    result = covered.alias("a").join(held.alias("b"), F.expr("a.h = b.h AND a.doc_id <=> b.doc_id")).select("a.doc_id", "a.h", "n_hit", "item_ids")
    counted = own.select("doc_id", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.alias("c").join(result.alias("f"), F.expr("c.h = f.h AND c.doc_id <=> f.doc_id"), "left")
    none = F.expr("CAST(array() AS array<string>)")
    return (
        out.select("c.doc_id", F.col("c.h").alias("text_hash"), "c.n_words", F.coalesce("f.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("f.item_ids", none).alias("item_ids"))
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256))
        .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the contaminated rows, each judged by its own text, with or without an id; clean rows keep all
    their columns, whatever their names."""
    gone = contamination(docs, benchmark, doc_id, text).filter("contaminated").select(F.col("doc_id").alias("__gone"), "text_hash").distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["__gone"]) & (F.xxhash64(docs[text]) == gone["text_hash"]), "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
  FROM b, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
