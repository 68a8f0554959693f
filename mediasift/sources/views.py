"""The media tables that the queries run on, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with its session set to at most `rows` rows in a batch for Python: a batch holds whole texts and all that is found in them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def spread(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df, dealt anew if it comes in fewer parts than there are cores or with more than `most` rows a part: for work on
    texts that outweighs moving them, so that no task's work grows with the table."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))
    return small_batches(df.repartition(parts) if df.rdd.getNumPartitions() < parts else df)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows: one for each document, in the order of ids."""
    kind = F.element_at(F.array(*map(F.lit, ("IMAGE", "VIDEO", "AUDIO", "TEXT"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("media_id"), F.col("source").alias("uploader"), kind.alias("media_type"), F.col("n_chars").alias("file_size"), F.sha2("text", 256).alias("sha256"), "lang", "text"
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored frames: a user's events in order of time; t in seconds, score in 0 to 1."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("media_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.least(F.lit(1.0), F.col("value") / 500).alias("score"), "event_type", "props"
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments of three seconds: the turns of a conversation."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg"), (3 * F.col("turn")).cast("double").alias("start"), (3 * F.col("turn") + 3).cast("double").alias("end"), "role", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text regions: a document's lines, one second and one row of the picture each."""
    docs = table(spark, sf_dir, "documents")
    out = docs.select(F.col("doc_id").alias("media_id"), "lang", F.posexplode(F.split("text", "\n")).alias("y", "text"))
    return out.select("media_id", "lang", F.col("y").cast("long").alias("y"), F.col("y").cast("double").alias("start"), (F.col("y") + 1).cast("double").alias("end"), "text")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y_true, y_prob): quality labels with a length-based score."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y_true"), F.least(F.lit(1.0), F.col("n_chars") / 2000).alias("y_prob"))


_N = "CAST(o_orderkey % 90 + 10 AS STRING)"
OPENER = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'Dr. Smith announced 25 percent growth in 1995.' WHEN 1 THEN 'The U.S. economy grew 3.5% and employs millions!' WHEN 2 THEN 'Click here to subscribe now.' "
    "WHEN 3 THEN 'Is it really true?' WHEN 4 THEN 'I think this is the best result ever.' ELSE 'Personally, nothing changed...' END"
)
BODY = (
    f"CASE o_orderkey % 7 WHEN 0 THEN 'Company X acquired Company Y in 2024 and employs ' || {_N} || ' people.' WHEN 1 THEN 'Microsoft invested $1,' || {_N} || '0 million in OpenAI while analysts doubted it.' "
    f"WHEN 2 THEN 'Version 2. 5 was released by Acme Labs Inc. in May 12, 2020.' WHEN 3 THEN 'What if prices rise by ' || {_N} || ' euros' WHEN 4 THEN 'Prof. Jane Doe visited Paris on Monday; she stated nothing.' "
    f"WHEN 5 THEN 'Prices increased e.g. by ' || {_N} || ' euros... then fell.' ELSE 'Look at that!' END"
)
TAIL = "CASE o_orderkey % 4 WHEN 0 THEN 'Senator Bob Lee reported 10% of cases as well as loses.' WHEN 1 THEN 'Short one.' WHEN 2 THEN 'The Paris Climate Summit was held in London yesterday' ELSE '' END"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, a, b, c): English text in three parts for each order, as the documents hold none."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS media_id", f"{OPENER} AS a", f"{BODY} AS b", f"{TAIL} AS c")


STATEMENTS_SQL = f"st AS (SELECT o_orderkey AS media_id, {OPENER} AS a, {BODY} AS b, {TAIL} AS c FROM orders), tx AS (SELECT media_id, trim(concat_ws(' ', a, b, c)) AS text FROM st)"


#: The same views for the SQL side, to be put before a query.
MEDIA_SQL = "media AS (SELECT doc_id AS media_id, source AS uploader, (['IMAGE','VIDEO','AUDIO','TEXT'])[CAST(doc_id % 4 + 1 AS INT)] AS media_type, n_chars AS file_size, sha256(text) AS sha256, lang, text FROM documents)"
FRAMES_SQL = "frames AS (SELECT user_id AS media_id, event_id, epoch_us(ts) / 1e6 AS t, least(1.0, value / 500) AS score, event_type, props FROM events)"
SEGMENTS_SQL = "segments AS (SELECT conv_id AS media_id, turn AS seg, CAST(3 * turn AS DOUBLE) AS start, CAST(3 * turn + 3 AS DOUBLE) AS \"end\", role, text FROM conversations)"
LINES_SQL = "lines AS (SELECT doc_id AS media_id, lang, CAST(i - 1 AS BIGINT) AS y, CAST(i - 1 AS DOUBLE) AS start, CAST(i AS DOUBLE) AS \"end\", parts[i] AS text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i))"
SCORED_SQL = "scored AS (SELECT l.doc_id AS id, CAST(quality AS INT) AS y_true, least(1.0, n_chars / 2000) AS y_prob FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
