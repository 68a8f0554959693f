"""Catalogue queries: lookups, filters, access rules, upserts and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediasift.operators.registry import query
from mediasift.sources.blobs import clean_key, exists, load, remove, scratch_folder, store
from mediasift.sources.views import FRAMES_SQL, LINES_SQL, MEDIA_SQL, SEGMENTS_SQL, frames, lines, media, segments, table

ELEVATED = ("ANALYST", "MODERATOR", "ADMIN")
#: File endings by MIME type; others end in bin.
ENDINGS = {
    "image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tiff",
    "video/mp4": "mp4", "video/quicktime": "mov", "video/x-msvideo": "avi", "video/webm": "webm", "video/x-matroska": "mkv",
    "audio/mpeg": "mp3", "audio/wav": "wav", "audio/x-wav": "wav", "audio/ogg": "ogg", "audio/flac": "flac", "audio/x-m4a": "m4a", "audio/aac": "aac",
    "text/plain": "txt", "text/csv": "csv", "text/html": "html", "application/json": "json", "application/pdf": "pdf",
}
#: What an upload may be.
ACCEPTED = {
    "IMAGE": "image/jpeg image/png image/webp image/gif image/bmp image/tiff image/x-ms-bmp",
    "VIDEO": "video/mp4 video/quicktime video/x-msvideo video/webm video/x-matroska video/mpeg",
    "AUDIO": "audio/mpeg audio/mp3 audio/wav audio/x-wav audio/wave audio/vnd.wave audio/ogg audio/flac audio/x-flac audio/x-m4a audio/mp4 audio/aac audio/x-aiff",
    "TEXT": "text/plain text/csv text/tab-separated-values application/json application/pdf",
}
CATEGORIES = {mime: kind for kind, mimes in ACCEPTED.items() for mime in mimes.split()}
#: Types that uploads take in turn here: all known ones and two that aren't.
TYPES = [*dict.fromkeys([*ENDINGS, *CATEGORIES]), "application/x-odd", "text/plain; charset=utf-8"]
#: Which media an analysis takes.
ANALYSES = {"image": ["IMAGE"], "video": ["VIDEO"], "audio": ["AUDIO"], "av_sync": ["VIDEO"], "ocr": ["IMAGE", "VIDEO"], "transcript": ["AUDIO", "VIDEO"]}
MOST_BYTES = 100 * 1024 * 1024


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key, by a partial aggregate and not a window: a hot key costs a task one row."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def mime_of(id: str) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), (F.col(id) % len(TYPES) + 1).cast("int"))


TYPES_SQL = f"([{', '.join(repr(t) for t in TYPES)}])[CAST(media_id % {len(TYPES)} + 1 AS INT)]"


def case_sql(values: dict[str, str], on: str, other: str = "NULL") -> str:
    return f"CASE {on} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a CHECK, once for each; as in SQL a check that is null passes."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())
    return df.withColumn("violation", F.explode(broken))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a UNIQUE constraint that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows with a non-null key that no parent has."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def visible(owner: Column, user: Column, role: Column) -> Column:
    return (owner == user) | role.isin(*ELEVATED)


@query("s1_point_lookup", f"WITH {MEDIA_SQL} SELECT media_id, uploader, media_type, file_size FROM media WHERE media_id = 42")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).filter("media_id = 42").select("media_id", "uploader", "media_type", "file_size")


_KEY = "CASE doc_id % 7 WHEN 0 THEN '/a/' || source WHEN 1 THEN '../' || source WHEN 2 THEN 'a/../b/./' || source WHEN 3 THEN 'a/../../' || source WHEN 4 THEN ' ' WHEN 5 THEN 'a//b/..' ELSE source || '/x.txt' END"


@query("s2_blob_keys", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'a/' || source WHEN 2 THEN 'b/' || source WHEN 5 THEN 'a' WHEN 6 THEN source || '/x.txt' END AS key FROM documents")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """Keys that stay inside the folder; files themselves are written and read in a test."""
    return table(spark, d, "documents").select("doc_id", clean_key(F.expr(_KEY)).alias("key"))


@query("s2_blob_files", "SELECT 'f' || CAST(doc_id % 10 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) AS key, strlen(text) AS bytes, sha256(text) AS sha256, doc_id % 3 <> 0 AS there FROM documents WHERE text IS NOT NULL")
def s2_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: written, read back, every third removed, all looked for."""
    folder = scratch_folder(spark, "blobs")
    files = table(spark, d, "documents").filter("text IS NOT NULL").select(F.expr("'./f' || doc_id % 10 || '/' || doc_id").alias("key"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    store(files.select("key", "content"), folder).write.parquet(f"{folder}-written")
    load(spark, files.select("key"), folder).select("key", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")).write.parquet(f"{folder}-read")
    remove(files.filter("doc_id % 3 = 0").select("key"), folder).write.parquet(f"{folder}-removed")
    there = exists(files.select("key"), folder).withColumnRenamed("done", "there")
    return spark.read.parquet(f"{folder}-read").join(there, "key").select("key", "bytes", "sha256", "there")


@query(
    "s3_storage_key",
    f"WITH {MEDIA_SQL}, m AS (SELECT *, {TYPES_SQL} AS mime FROM media) SELECT media_id, 'quarantine/' || lower(media_type) || '/2024-01-01/' || sha256[1:32] || '.' || {case_sql(ENDINGS, 'mime', repr('bin'))} AS storage_key FROM m",
)
def s3(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).select("media_id", storage_key(F.lower("media_type"), F.lit("2024-01-01"), F.substring("sha256", 1, 32), mime_of("media_id")).alias("storage_key"))


def storage_key(kind: Column, day: Column, name: Column, mime: Column) -> Column:
    return F.concat(F.lit("quarantine/"), kind, F.lit("/"), day, F.lit("/"), name, F.lit("."), F.coalesce(F.try_element_at(literal_map(ENDINGS), mime), F.lit("bin")))


@query("s11_json_documents", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """Malformed JSON gives null, as the permissive reader does."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query(
    "s11_json_arrays",
    "WITH j AS (SELECT user_id AS media_id, CAST(to_json(list({'event_id': event_id, 'k': event_id % 17} ORDER BY event_id)) AS VARCHAR) AS json, count(*) AS n, CAST(sum(event_id % 17) AS BIGINT) AS total FROM events GROUP BY user_id) SELECT media_id, md5(json) AS json_md5, CASE WHEN media_id % 5 = 0 THEN 0 ELSE n END AS n, CASE WHEN media_id % 5 = 0 THEN 0 ELSE total END AS total FROM j",
)
def s11_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Nested arrays stored as JSON and read again; what can't be read (every fifth is cut short) is an empty array."""
    made = table(spark, d, "events").groupBy(F.col("user_id").alias("media_id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 17).alias("k"))))).alias("json"))
    stored = F.when(F.col("media_id") % 5 == 0, F.col("json").substr(F.lit(2), F.length("json"))).otherwise(F.col("json"))
    read = made.withColumn("a", json_array(stored, "event_id bigint, k bigint"))
    return read.select("media_id", F.md5("json").alias("json_md5"), F.size("a").cast("long").alias("n"), F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x["k"]).alias("total"))


def json_array(text: Column, fields: str) -> Column:
    """An array of structs from JSON text; empty for null and for what isn't a whole array of them."""
    kind = f"array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in fields.split(','))}>>"
    whole = F.trim(text).startswith("[") & F.trim(text).endswith("]")
    return F.coalesce(F.when(whole, F.from_json(text, kind)), F.expr(f"CAST(array() AS {kind})"))


@query(
    "s12_upsert_latest",
    f"WITH {FRAMES_SQL} SELECT media_id, event_type, arg_max(event_id, (t, event_id)) AS event_id, arg_max(score, (t, event_id)) AS score FROM frames GROUP BY media_id, event_type",
)
def s12(spark: SparkSession, d: str) -> DataFrame:
    return latest(frames(spark, d).select("media_id", "event_type", "event_id", "score", "t"), ["media_id", "event_type"], [F.col("t"), F.col("event_id")]).drop("t")


@query("s13_purge_expired", "SELECT event_id, user_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-15 00:00:00')")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """What stays when everything that expired before the cutoff is deleted."""
    return table(spark, d, "events").filter(~(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))).select("event_id", "user_id")


@query(
    "s14_compute_if_absent",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE CAST(n_chars >= 1000 AS BIGINT) END AS quality, l.doc_id IS NULL AS computed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def s14(spark: SparkSession, d: str) -> DataFrame:
    docs, stored = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels")
    absent = docs.join(stored, "doc_id", "left_anti").select("doc_id", (F.col("n_chars") >= 1000).cast("long").alias("quality"), F.lit(True).alias("computed"))
    return docs.join(stored, "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), F.lit(False).alias("computed")).unionByName(absent)


def flagged(df: DataFrame, score: str, threshold: float, also: list[Column] = []) -> DataFrame:
    keep = F.col(score) >= threshold
    for c in also:
        keep = keep | c
    return df.filter(keep)


@query("f1_flagged_images", f"WITH {FRAMES_SQL} SELECT event_id, score FROM frames WHERE score >= 0.5 OR event_type = 'purchase' OR event_type = 'signup' ORDER BY score DESC, event_id")
def f1(spark: SparkSession, d: str) -> DataFrame:
    """Flagged by probability or by either finding; here event types stand for the findings."""
    return flagged(frames(spark, d), "score", 0.5, [F.col("event_type") == "purchase", F.col("event_type") == "signup"]).select("event_id", "score").orderBy(F.desc("score"), "event_id")


@query("f2_flagged_video", f"WITH {FRAMES_SQL} SELECT event_id, score FROM frames WHERE score >= 0.5 ORDER BY score DESC, event_id LIMIT 20 OFFSET 20")
def f2(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty, highest score first."""
    return flagged(frames(spark, d), "score", 0.5).orderBy(F.desc("score"), "event_id").offset(20).limit(20).select("event_id", "score")


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """A page of df in order, each row with `total`, the number of rows on all pages."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))  # one row
    return df.orderBy(*order).offset(offset).limit(size).join(total)


@query("t2_page_with_total", f"WITH {FRAMES_SQL} SELECT event_id, score, count(*) OVER () AS total FROM frames WHERE score >= 0.2 ORDER BY score DESC, event_id LIMIT 25 OFFSET 50")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return page(flagged(frames(spark, d), "score", 0.2).select("event_id", "score"), [F.desc("score"), F.col("event_id")], 50, 25)


@query("f3_flagged_audio", f"WITH {FRAMES_SQL} SELECT media_id, max(score) AS score FROM frames WHERE event_type <> 'error' GROUP BY media_id HAVING max(score) >= 0.5 ORDER BY score DESC, media_id")
def f3(spark: SparkSession, d: str) -> DataFrame:
    """Media whose highest score reaches a half, highest first."""
    return flagged(frames(spark, d).filter("event_type <> 'error'").groupBy("media_id").agg(F.max("score").alias("score")), "score", 0.5).orderBy(F.desc("score"), "media_id")


@query("f13_report_search", "SELECT o_orderkey FROM orders WHERE (contains(lower(o_orderpriority), 'low') OR contains(lower(CAST(o_orderkey AS VARCHAR)), 'low') OR contains(lower(CAST(o_custkey AS VARCHAR)), 'low')) AND o_orderstatus = 'F'")
def f13(spark: SparkSession, d: str) -> DataFrame:
    """Reports by a text in title, number or case, whatever its case and the spaces around it, and by status."""
    reports = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("title"), F.col("o_orderkey").cast("string").alias("number"), F.col("o_custkey").cast("string").alias("case"))
    return search(reports.filter("o_orderstatus = 'F'"), " LOW ".strip(), ["title", "number", "case"]).select("o_orderkey")


#: First bytes of pictures.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif87": "474946383761", "gif89": "474946383961", "bmp": "424D"}


def is_picture(content: Column) -> Column:
    """Whether bytes begin as a PNG, JPEG, GIF, BMP or WebP does; eight bytes at least."""
    hit = (F.substring(content, 1, 4) == F.unhex(F.lit("52494646"))) & (F.length(content) >= 12) & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250")))
    for bytes_ in MAGIC.values():
        hit = hit | (F.substring(content, 1, len(bytes_) // 2) == F.unhex(F.lit(bytes_)))
    return F.coalesce((F.length(content) >= 8) & hit, F.lit(False))


_HEAD = "CASE doc_id % 8 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FF' WHEN 2 THEN '474946383761' WHEN 3 THEN '474946383961' WHEN 4 THEN '424D' WHEN 5 THEN '524946460000000057454250' WHEN 6 THEN '5249464600000000' ELSE '' END"


@query("f16_picture_bytes", f"WITH h AS (SELECT doc_id, n_chars, {_HEAD} || CASE WHEN doc_id % 3 > 0 THEN hex(encode(text)) ELSE '' END AS h FROM documents) SELECT doc_id, length(h) >= 16 AND (starts_with(h, '89504E470D0A1A0A') OR starts_with(h, 'FFD8FF') OR starts_with(h, '474946383761') OR starts_with(h, '474946383961') OR starts_with(h, '424D') OR starts_with(h, '52494646') AND h[17:24] = '57454250') AS picture FROM h")
def f16(spark: SparkSession, d: str) -> DataFrame:
    content = F.expr(f"unhex({_HEAD} || CASE WHEN doc_id % 3 > 0 THEN hex(encode(text, 'UTF-8')) ELSE '' END)")
    return table(spark, d, "documents").select("doc_id", is_picture(content).alias("picture"))


def bounded_json(tree: Column, most_bytes: int = 512 * 1024, most_chars: int = 150) -> Column:
    """A map of directories to maps of tags as JSON; one that is too large holds its first directories, long values cut,
    up to the one that passes the bound less two kilobytes. {} for null and empty."""
    cut = F.transform_values(tree, lambda _, tags: F.transform_values(tags, lambda _, v: F.when(F.length(v) > most_chars, F.concat(F.substring(v, 1, most_chars), F.lit("... [truncated]"))).otherwise(v)))
    entries = F.map_entries(cut)
    start = F.struct(F.slice(entries, 1, 0).alias("kept"), F.lit(2).cast("long").alias("bytes"))

    def add(s: Column, e: Column) -> Column:
        size = s["bytes"] + F.octet_length(F.to_json(F.map_from_entries(F.array(e)))) - 2 + F.when(F.size(s["kept"]) > 0, 1).otherwise(0)
        return F.when(s["bytes"] > most_bytes - 2048, s).otherwise(F.struct(F.array_append(s["kept"], e).alias("kept"), size.alias("bytes")))

    kept = F.map_from_entries(F.aggregate(entries, start, add, lambda s: s["kept"]))
    whole = F.to_json(tree)
    note = F.lit(f'{{"_metadata_status":"TRUNCATED","_max_bytes":{most_bytes},"_warning":"Raw metadata exceeded maximum allowed payload size of 512 KB and was safely bounded.","directories":')
    return F.when(tree.isNull() | (F.size(tree) == 0), "{}").when(F.octet_length(whole) <= most_bytes, whole).otherwise(F.concat(note, F.to_json(kept), F.lit("}")))


@query("s10_bounded_json", "SELECT doc_id, CASE WHEN octet_length(encode(j)) <= 700 THEN j ELSE NULL END AS json FROM (SELECT doc_id, '{\"A\":{\"lang\":\"' || lang || '\"},\"B\":{\"text\":' || CAST(to_json(text) AS VARCHAR) || '}}' AS j FROM documents)")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Whole trees of 700 bytes at most; the others are cut, which a test shows, and null here."""
    tree = F.create_map(F.lit("A"), F.create_map(F.lit("lang"), F.col("lang")), F.lit("B"), F.create_map(F.lit("text"), F.col("text")))
    made = table(spark, d, "documents").select("doc_id", bounded_json(tree, 700).alias("json"))
    return made.select("doc_id", F.when(~F.contains("json", F.lit('"_metadata_status":"TRUNCATED"')), F.col("json")).alias("json"))


#: A document's text in directories of 200 characters, of which those before the bound stay, their values cut at 150.
_PARTS_SQL = (
    "pt AS (SELECT doc_id, k, substr(text, 200 * k + 1, 200) AS t FROM documents, range(0, 40) u(k) WHERE length(text) > 200 * k), pe AS (SELECT doc_id, k, '\"D' || lpad(CAST(k AS VARCHAR), 2, '0') || '\":{\"text\":' AS h, CAST(to_json(t) AS VARCHAR) AS whole, CAST(to_json(CASE WHEN length(t) > 150 THEN substr(t, 1, 150) || '... [truncated]' ELSE t END) AS VARCHAR) AS cut FROM pt), "
    "ps AS (SELECT *, 2 + coalesce(sum(strlen(h || cut) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size FROM pe), "
    "pj AS (SELECT doc_id, '{' || string_agg(h || whole || '}', ',' ORDER BY k) || '}' AS j, string_agg(h || cut || '}', ',' ORDER BY k) FILTER (WHERE size - CASE WHEN k > 0 THEN 1 ELSE 0 END <= 1952) AS kept FROM ps GROUP BY doc_id)"
)
_NOTE = '{"_metadata_status":"TRUNCATED","_max_bytes":4000,"_warning":"Raw metadata exceeded maximum allowed payload size of 512 KB and was safely bounded.","directories":'


@query("s10_bounded_directories", f"WITH {_PARTS_SQL} SELECT doc_id, CASE WHEN j IS NULL THEN '{{}}' WHEN strlen(j) <= 4000 THEN j ELSE '{_NOTE}{{' || kept || '}}}}' END AS json FROM documents LEFT JOIN pj USING (doc_id)")
def s10_directories(spark: SparkSession, d: str) -> DataFrame:
    """Forty directories at most, whole if they take 4,000 bytes or fewer, else the first of them, cut."""
    parts = F.expr("map_from_entries(transform(filter(sequence(0, 39), k -> length(text) > 200 * k), k -> struct('D' || lpad(k, 2, '0') AS key, map('text', substr(text, 200 * k + 1, 200)) AS value)))")
    return table(spark, d, "documents").select("doc_id", bounded_json(parts, 4000).alias("json"))


def delete_then_insert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored without the keys that fresh holds, and fresh: a recomputation replaces all rows of its keys."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


@query("s13_recomputed", f"WITH {SEGMENTS_SQL} SELECT media_id, seg, text FROM segments WHERE media_id % 3 <> 0 UNION ALL SELECT media_id, seg, text || '!' FROM segments WHERE media_id % 3 = 0 AND seg % 2 = 0")
def s13_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """Every third medium recomputed: its old rows go, half as many come."""
    stored = segments(spark, d).select("media_id", "seg", "text")
    fresh = stored.filter("media_id % 3 = 0 AND seg % 2 = 0").withColumn("text", F.concat("text", F.lit("!")))
    return delete_then_insert(stored, fresh, "media_id")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """stored with fresh's rows in place of its own of the same key, or beside them; of several the latest by `order`."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    return latest(both, keys, [F.col("__new"), *order]).drop("__new")


@query("s12_upserted", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 - quality ELSE quality END AS quality, doc_id % 2 = 0 AS renewed FROM labels UNION ALL SELECT doc_id, 1 AS quality, true FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def s12_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Labels of even documents renewed, and made where there were none."""
    stored = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.lit(False).alias("renewed"))
    docs = table(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id")
    fresh = docs.join(stored, "doc_id", "left").select("doc_id", F.coalesce(1 - F.col("quality"), F.lit(1).cast("long")).alias("quality"), F.lit(True).alias("renewed"))
    return upsert(stored, fresh, ["doc_id"], [F.col("quality")])


@query("f5_is_duplicate", f"WITH {MEDIA_SQL} SELECT media_id FROM media WHERE sha256 IN (SELECT sha256 FROM media GROUP BY sha256 HAVING count(*) > 1)")
def f5(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d).select("media_id", "sha256")
    return m.join(repeated_keys(m, ["sha256"]), "sha256", "left_semi").select("media_id")


@query("f7_newest_of_user", f"WITH {MEDIA_SQL} SELECT media_id, file_size FROM media WHERE uploader = 'src1' ORDER BY media_id DESC LIMIT 10 OFFSET 10")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).filter("uploader = 'src1'").orderBy(F.desc("media_id")).offset(10).limit(10).select("media_id", "file_size")


@query(
    "f8_row_access",
    "WITH u AS (SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'ANALYST' WHEN 'MACHINERY' THEN 'ADMIN' WHEN 'FURNITURE' THEN 'RESEARCHER' ELSE 'USER' END AS role FROM customer) "
    "SELECT o_orderkey AS media_id, user_id, role, o_custkey = user_id OR role IN ('ANALYST', 'MODERATOR', 'ADMIN') AS allowed FROM orders JOIN u ON user_id = CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE CAST(o_totalprice AS BIGINT) % 1000 END",
)
def f8(spark: SparkSession, d: str) -> DataFrame:
    """Whether the user who asks for a medium may see it: the owner, or an elevated user. Every order is a request, half of
    them by the owner and half by some customer."""
    role = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'ANALYST' WHEN 'MACHINERY' THEN 'ADMIN' WHEN 'FURNITURE' THEN 'RESEARCHER' ELSE 'USER' END")
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), role.alias("role"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), F.col("o_custkey").alias("owner"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE CAST(bround(o_totalprice) AS BIGINT) % 1000 END").alias("user_id"))
    return asked.join(users, "user_id").select("media_id", "user_id", "role", visible(F.col("owner"), F.col("user_id"), F.col("role")).alias("allowed"))


ROLE_SQL = "u AS (SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'ANALYST' WHEN 'MACHINERY' THEN 'ADMIN' WHEN 'FURNITURE' THEN 'RESEARCHER' ELSE 'USER' END AS role FROM customer)"


def access(users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, role, media_id) for all users (user_id, role) and items (media_id, owner): one row for each
    item that a user owns, and for an elevated user one row with a null media_id, which stands for every item.

    An elevated user's own items are part of everything and aren't listed.
    """
    high = F.col("role").isin(*ELEVATED)
    own = users.filter(~F.coalesce(high, F.lit(False))).join(items, F.col("user_id") == F.col("owner")).select("user_id", "role", "media_id")
    return own.unionByName(users.filter(high).select("user_id", "role", F.lit(None).cast(items.schema["media_id"].dataType).alias("media_id")))


@query("f8_row_access_all", f"WITH {ROLE_SQL} SELECT user_id, role, o_orderkey AS media_id FROM u JOIN orders ON o_custkey = user_id WHERE role NOT IN ('ANALYST', 'MODERATOR', 'ADMIN') UNION ALL SELECT user_id, role, NULL AS media_id FROM u WHERE role IN ('ANALYST', 'MODERATOR', 'ADMIN')")
def f8_all(spark: SparkSession, d: str) -> DataFrame:
    """What every user may see; everything is one row."""
    role = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'ANALYST' WHEN 'MACHINERY' THEN 'ADMIN' WHEN 'FURNITURE' THEN 'RESEARCHER' ELSE 'USER' END")
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), role.alias("role"))
    return access(users, table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), F.col("o_custkey").alias("owner")))


@query(
    "f9_redaction",
    f"WITH {MEDIA_SQL} SELECT media_id, CASE WHEN uploader = 'src1' THEN media_id END AS shown_id, CASE WHEN uploader = 'src1' THEN sha256 ELSE 'Verified Reference Item' END AS shown_name FROM media",
)
def f9(spark: SparkSession, d: str) -> DataFrame:
    see = visible(F.col("uploader"), F.lit("src1"), F.lit("USER"))
    return media(spark, d).select("media_id", F.when(see, F.col("media_id")).alias("shown_id"), F.when(see, F.col("sha256")).otherwise("Verified Reference Item").alias("shown_name"))


@query("f10_type_guard", f"WITH {MEDIA_SQL}, g AS (SELECT unnest({[[k, t] for k, ts in ANALYSES.items() for t in ts]}) AS g) SELECT media_id, g[1] AS analysis FROM media JOIN g ON g[2] = media_type")
def f10(spark: SparkSession, d: str) -> DataFrame:
    """The analyses that take a medium."""
    takes = F.filter(F.array(*(F.when(F.col("media_type").isin(*kinds), F.lit(name)) for name, kinds in ANALYSES.items())), lambda x: x.isNotNull())
    return media(spark, d).select("media_id", F.explode(takes).alias("analysis"))


@query("f11_token_validity", "SELECT o_orderkey AS token_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def f11(spark: SparkSession, d: str) -> DataFrame:
    revoked = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("token_id"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("token_id")).join(revoked, "token_id", "left_anti")


@query("f12_claim_search", f"WITH {SEGMENTS_SQL} SELECT media_id, seg FROM segments WHERE role = 'user' AND seg % 4 < 3 AND (contains(lower(text), 'the') OR contains(lower(role), 'the'))")
def f12(spark: SparkSession, d: str) -> DataFrame:
    """By kind (role), by entity (every fourth turn has another) and by text."""
    return search(segments(spark, d).filter("role = 'user' AND seg % 4 < 3"), "the", ["text", "role"]).select("media_id", "seg")


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with a column that holds the text, whatever its case; null columns don't."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return df.filter(hit)


@query("f14_confidence_filter", f"WITH {LINES_SQL} SELECT media_id, y, (length(text) % 101) / 100.0 AS confidence FROM lines WHERE length(text) % 101 >= 40 AND trim(text) != ''")
def f14(spark: SparkSession, d: str) -> DataFrame:
    raw = F.length("text") % 101
    return lines(spark, d).filter((raw >= 40) & (F.trim("text") != "")).select("media_id", "y", (raw / 100).alias("confidence"))


@query(
    "f15_upload_validation",
    f"WITH {MEDIA_SQL}, m AS (SELECT *, {TYPES_SQL} AS mime, '../a/' || uploader || ':' || media_id || '?.bin' AS name FROM media), c AS (SELECT *, {case_sql(CATEGORIES, 'mime')} AS category FROM (SELECT * REPLACE (trim(string_split(mime, ';')[1]) AS mime) FROM m)) "
    "SELECT media_id, category, regexp_replace(regexp_replace(name, '^.*[/\\\\]', ''), '[:*?\"<>|]', '_', 'g') AS file_name, file_size > 0 AND file_size <= 104857600 AND category IS NOT NULL AS accepted FROM c",
)
def f15(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d).withColumn("mime", F.trim(F.substring_index(mime_of("media_id"), ";", 1))).withColumn("name", F.concat(F.lit("../a/"), "uploader", F.lit(":"), F.col("media_id").cast("string"), F.lit("?.bin")))
    category = F.try_element_at(literal_map(CATEGORIES), F.col("mime"))
    return m.select("media_id", category.alias("category"), safe_name(F.col("name")).alias("file_name"), (F.col("file_size").between(1, MOST_BYTES) & category.isNotNull()).alias("accepted"))


def safe_name(name: Column) -> Column:
    """The last part of a path without control characters, reserved characters replaced, at most 255 long with its ending."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1f\x7f]", ""), r"^.*[/\\]", ""), r'[:*?"<>|]', "_")
    ending = F.regexp_extract(base, r"(\.[^.]{1,20})?$", 0)
    return F.when(F.length(base) > 255, F.concat(base.substr(F.lit(1), 255 - F.length(ending)), ending)).otherwise(base)


@query("f17_account_rules", "SELECT c_custkey, lower(trim(' ' || c_name || '@Example.ORG ')) AS email FROM customer WHERE c_mktsegment != 'HOUSEHOLD'")
def f17(spark: SparkSession, d: str) -> DataFrame:
    """Normalised addresses of accounts that aren't suspended (here: of one segment)."""
    return table(spark, d, "customer").filter("c_mktsegment != 'HOUSEHOLD'").select("c_custkey", F.lower(F.trim(F.concat(F.lit(" "), "c_name", F.lit("@Example.ORG ")))).alias("email"))


@query("f18_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def f18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("j5_analysis_with_media", f"WITH {MEDIA_SQL} SELECT m.media_id, m.media_type, l.quality FROM media m JOIN labels l ON l.doc_id = m.media_id")
def j5(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).join(table(spark, d, "labels").withColumnRenamed("doc_id", "media_id"), "media_id").select("media_id", "media_type", "quality")


@query("j6_user_roles", "SELECT n_name, count(DISTINCT c_custkey) AS users, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS roles FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def j6(spark: SparkSession, d: str) -> DataFrame:
    users, groups, regions = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    joined = users.join(groups, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("users"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("roles"))


@query("j7_existence", f"WITH {MEDIA_SQL} SELECT media_id FROM media WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = media_id)")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("media_id")), "media_id", "left_semi").select("media_id")


@query("a1_count_by_key", f"WITH {SEGMENTS_SQL} SELECT media_id, count(*) AS n FROM segments GROUP BY media_id")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))


@query("a2_conditional_counts", "SELECT user_id, count(*) AS total, count_if(event_type = 'click') AS clicks, count_if(event_type = 'view') AS views, count_if(value > 100) AS large FROM events GROUP BY user_id")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("value") > 100).alias("large"))


@query("a15_response_rollup", f"WITH {SEGMENTS_SQL} SELECT media_id, CAST(sum(length(text)) AS BIGINT) AS text_length, count(*) AS sentences, count(*) AS claims FROM segments GROUP BY media_id")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("media_id").agg(F.sum(F.length("text")).alias("text_length"), F.count(F.lit(1)).alias("sentences"), F.count(F.lit(1)).alias("claims"))


#: The CHECK constraints of the catalogue's tables, over rows that hold the columns of all of them.
_SHARE = "{c} >= 0.0 AND {c} <= 1.0"
CHECKS = {
    "user_status": "user_status IN ('ACTIVE', 'SUSPENDED', 'PENDING_VERIFICATION')", "media_type": "media_type IN ('IMAGE', 'VIDEO', 'AUDIO', 'TEXT')", "upload_status": "upload_status IN ('UPLOADED', 'PROCESSING', 'COMPLETED', 'FAILED')", "file_size": "file_size > 0",
    "match_type": "match_type IN ('NONE', 'EXACT_SHA256', 'NEAR_MATCH_PHASH', 'ACOUSTIC_MATCH')", "analysis_status": "analysis_status IN ('PENDING', 'PROCESSING', 'COMPLETED', 'FAILED')",
    **{c: _SHARE.format(c=c) for c in "forensic_score ai_prob manipulation_prob deepfake_prob synthetic_voice_prob sync_score confidence_score".split()},
}
#: Rows with all checked columns, from events, some of them wrong or null.
_CHECKED = {
    "user_status": "CASE event_id % 5 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'SUSPENDED' WHEN 2 THEN 'GONE' WHEN 3 THEN 'PENDING_VERIFICATION' END", "media_type": "CASE WHEN event_id % 7 = 0 THEN 'OTHER' ELSE 'IMAGE' END", "upload_status": "CASE WHEN event_id % 11 = 0 THEN 'LOST' ELSE 'UPLOADED' END",
    "file_size": "event_id % 13", "match_type": "CASE event_id % 6 WHEN 0 THEN 'NONE' WHEN 1 THEN 'EXACT_SHA256' WHEN 2 THEN 'NEAR' ELSE NULL END", "analysis_status": "CASE WHEN event_id % 17 = 0 THEN '' ELSE 'FAILED' END",
    **{c: f"CASE WHEN event_id % {19 + 2 * i} > 0 THEN CAST(event_id % {23 + i} AS DOUBLE) / {20 + i} END" for i, c in enumerate("forensic_score ai_prob manipulation_prob deepfake_prob synthetic_voice_prob sync_score confidence_score".split())},
}
CHECKED_SQL = "ck AS (SELECT event_id, " + ", ".join(f"{e} AS {c}" for c, e in _CHECKED.items()) + " FROM events)"


@query("d1_check_violations", f"WITH {CHECKED_SQL} " + " UNION ALL ".join(f"SELECT event_id, '{c}' AS violation FROM ck WHERE NOT ({e})" for c, e in CHECKS.items()))
def d1(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_id", *(f"{e} AS {c}" for c, e in _CHECKED.items()))
    return violations(rows, {c: F.expr(e) for c, e in CHECKS.items()}).select("event_id", "violation")


def cascaded(parents_gone: DataFrame, levels: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What ON DELETE CASCADE takes at each level: rows (key) of a table whose parent key is gone at the level above."""
    gone, out = parents_gone, []
    for df, key, parent in levels:
        gone = df.join(gone.toDF(parent).distinct(), parent, "left_semi").select(key).distinct()
        out.append(gone)
    return out


@query(
    "d3_cascade_closure",
    "WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal <= 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) SELECT 'orders' AS level, o_orderkey AS key FROM o UNION ALL SELECT 'lineitem', l_orderkey FROM l",
)
def d3_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their lines that go with the customers in debt."""
    gone = table(spark, d, "customer").filter("c_acctbal <= 0").select("c_custkey")
    orders, lines_ = cascaded(gone, [(table(spark, d, "orders"), "o_orderkey", "o_custkey"), (table(spark, d, "lineitem").withColumn("o_orderkey", F.col("l_orderkey")), "l_orderkey", "o_orderkey")])
    return orders.select(F.lit("orders").alias("level"), F.col("o_orderkey").alias("key")).unionByName(lines_.select(F.lit("lineitem").alias("level"), F.col("l_orderkey").alias("key")))


@query("d3_set_null", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN o_custkey END AS o_custkey FROM orders")
def d3_set_null(spark: SparkSession, d: str) -> DataFrame:
    """Orders after ON DELETE SET NULL of the customers in debt."""
    kept = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey").distinct()
    return table(spark, d, "orders").join(kept, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("c_custkey").alias("o_custkey"))


@query("d2_unique_violations", f"WITH {LINES_SQL} SELECT media_id, lower(trim(text)) AS text, count(*) AS n FROM lines GROUP BY 1, 2 HAVING count(*) > 1")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return repeated_keys(lines(spark, d).select("media_id", F.lower(F.trim("text")).alias("text")), ["media_id", "text"])


@query("d3_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey")


@query("t5_reading_order", f"WITH {LINES_SQL} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY y // 15, length(text), y) AS place, y FROM lines")
def t5(spark: SparkSession, d: str) -> DataFrame:
    """Reading order within a document: rows of 15, then x (here the length of the text)."""
    w = W.partitionBy("media_id").orderBy(F.floor(F.col("y") / 15), F.length("text"), "y")
    return lines(spark, d).select("media_id", F.row_number().over(w).cast("long").alias("place"), "y")
