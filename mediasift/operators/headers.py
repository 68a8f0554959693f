"""Metadata of files from what readers of their headers found: directories of tags, or the JSON of command-line tools.

A tree, map<directory, map<tag, text>>, is resolved by a table of rules: of each field the first that gives a value.
What a tool printed comes first if it is usable, and else the tree; everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.operators.registry import query
from mediasift.sources.views import spread, table

# Where each field is looked up, in this order: (field, kind, directory, tag).
RULES = [
    ("camera_make", "text", "Exif IFD0", "Make"),
    ("camera_model", "text", "Exif IFD0", "Model"),
    ("lens_model", "text", "Exif SubIFD", "Lens Model"),
    ("software", "text", "Exif IFD0", "Software"),
    ("software", "text", "XMP", "xmp:CreatorTool"),
    ("software", "text", "XMP", "tiff:Software"),
    ("software", "text", "WAV", "Software"),
    ("captured_at", "time", "Exif SubIFD", "Date/Time Original"),
    ("captured_at", "time", "MP4", "Creation Time"),
    ("modified_at", "time", "Exif IFD0", "Date/Time"),
    ("modified_at", "time", "MP4", "Modification Time"),
    ("width", "int", "MP4 Video", "Width"),
    ("width", "int", "Exif IFD0", "Image Width"),
    ("width", "int", "Exif SubIFD", "Exif Image Width"),
    ("width", "int", "JPEG", "Image Width"),
    ("width", "int", "PNG-IHDR", "Image Width"),
    ("width", "int", "WebP", "Image Width"),
    ("height", "int", "MP4 Video", "Height"),
    ("height", "int", "Exif IFD0", "Image Height"),
    ("height", "int", "Exif SubIFD", "Exif Image Height"),
    ("height", "int", "JPEG", "Image Height"),
    ("height", "int", "PNG-IHDR", "Image Height"),
    ("height", "int", "WebP", "Image Height"),
    ("gps_altitude", "double", "GPS", "GPS Altitude"),
    ("duration", "double", "MP4", "Duration in Seconds"),
    ("frame_rate", "double", "MP4 Video", "Frame Rate"),
    ("video_codec", "text", "MP4 Video", "Compression Type"),
    ("audio_codec", "text", "MP4 Sound", "Format"),
    ("audio_sample_rate", "int", "MP4 Sound", "Sample Rate"),
    ("audio_channels", "int", "MP4 Sound", "Number of Channels"),
]
CONTAINERS = [("MP4", "MP4"), ("QuickTime", "QuickTime"), ("WAV", "WAV"), ("MP3", "MP3"), ("AVI", "AVI")]
EXIF = ("Exif IFD0", "Exif SubIFD", "GPS")
WAV_CODEC, MP3_CODEC = "PCM", "MPEG-1/2 Audio Layer 3"
FIELDS = "camera_make string, camera_model string, lens_model string, software string, captured_at timestamp, modified_at timestamp, width int, height int, gps_latitude double, gps_longitude double, gps_altitude double, duration double, frame_rate double, video_codec string, audio_codec string, audio_sample_rate int, audio_channels int, bitrate bigint, container string, exif_present boolean"


def as_kind(text: Column, kind: str) -> Column:
    """A tag's text as text without white space at its ends, a number or a time; null if it is empty or none."""
    own = F.trim(text)
    if kind == "time":
        return F.coalesce(F.try_to_timestamp(own, F.lit("yyyy:MM:dd HH:mm:ss")), own.try_cast("timestamp"))
    return F.when(own != "", own) if kind == "text" else own.try_cast(kind)


def tag(tree: Column, directory: str, name: str, kind: str = "text") -> Column:
    return as_kind(F.try_element_at(F.try_element_at(tree, F.lit(directory)), F.lit(name)), kind)


def has(tree: Column, directory: str) -> Column:
    return F.coalesce(F.map_contains_key(tree, directory), F.lit(False))


def resolved(tree: Column) -> Column:
    """The fields of FIELDS from a tree; all null, exif_present false, for a null or an empty one. Tags that are no
    number or time where one is wanted count as missing."""
    own: dict[str, Column] = {}
    for field in dict.fromkeys(r[0] for r in RULES):
        own[field] = F.coalesce(*(tag(tree, d, n, kind) for f, kind, d, n in RULES if f == field))
    # QuickTime gives what MP4 doesn't; a picture of which the width is unknown takes both sides from it, sound likewise
    wide, rate = own["width"].isNull(), own["audio_sample_rate"].isNull()
    own["height"] = F.coalesce(F.when(wide, tag(tree, "QuickTime Video", "Height", "int")), own["height"])
    own["width"] = F.coalesce(own["width"], tag(tree, "QuickTime Video", "Width", "int"))
    own["audio_channels"] = F.coalesce(F.when(rate, tag(tree, "QuickTime Sound", "Number of Channels", "int")), own["audio_channels"])
    own["audio_sample_rate"] = F.coalesce(own["audio_sample_rate"], tag(tree, "QuickTime Sound", "Sample Rate", "int"))
    own["duration"] = F.coalesce(own["duration"], F.when(~has(tree, "MP4"), tag(tree, "QuickTime", "Duration in Seconds", "double")))
    # sound files
    mode = F.lower(tag(tree, "MP3", "Mode"))
    own["audio_codec"] = F.coalesce(own["audio_codec"], F.when(has(tree, "WAV"), WAV_CODEC).when(has(tree, "MP3"), MP3_CODEC))
    own["audio_sample_rate"] = F.coalesce(own["audio_sample_rate"], tag(tree, "WAV", "Samples Per Second", "int"), tag(tree, "MP3", "Frequency (Hz)", "int"))
    own["audio_channels"] = F.coalesce(own["audio_channels"], tag(tree, "WAV", "Channels", "int"), F.when(mode.isin("mono", "single channel"), 1).when(mode.isNotNull(), 2))
    own["bitrate"] = F.coalesce(tag(tree, "WAV", "Bytes Per Second", "bigint") * 8, tag(tree, "MP3", "Bitrate (kbps)", "bigint") * 1000)
    own["duration"] = F.coalesce(own["duration"], tag(tree, "WAV", "Duration", "double"))
    container = F.coalesce(*(F.when(has(tree, d), name) for d, name in CONTAINERS))
    for side in ("Width", "Height"):
        own[side.lower()] = F.coalesce(own[side.lower()], F.when(container == "AVI", tag(tree, "AVI", side, "int")))
    latitude, longitude = tag(tree, "GPS", "GPS Latitude", "double"), tag(tree, "GPS", "GPS Longitude", "double")
    placed = (latitude != 0) | (longitude != 0)
    own |= {"gps_latitude": F.when(placed & longitude.isNotNull(), latitude), "gps_longitude": F.when(placed & latitude.isNotNull(), longitude), "container": container}
    own["exif_present"] = has(tree, EXIF[0]) | has(tree, EXIF[1]) | has(tree, EXIF[2])
    return F.struct(*(own[f.split(" ")[0]].cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in FIELDS.split(", ")))


def compiled_apart(df: DataFrame, bytes_: int = 8000) -> DataFrame:
    """df, with its session set to leave stages whose method is longer than the JVM compiles to the plans' own operators,
    whose expressions are cut into methods of their own; interpreted, a lookup costs ten times as much."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(df.sparkSession.conf.get(name)) > bytes_:
        df.sparkSession.conf.set(name, str(bytes_))
    return df


def with_fields(df: DataFrame, tree: str = "tree") -> DataFrame:
    """df with the fields of FIELDS from a tree; the tree is a column that is there or is computed once."""
    return compiled_apart(df).withColumn("__x", resolved(F.col(tree))).select(*df.columns, "__x.*")


def printed(exiftool: Column, mediainfo: Column) -> Column:
    """The fields of FIELDS from the JSON that two tools print, that of the first before that of the second. Broken JSON
    gives nothing; a number that isn't one is 0 for the first tool and missing for the second."""
    tags = F.try_element_at(F.from_json(exiftool, "array<map<string, string>>"), F.lit(1))
    there = lambda n: F.coalesce(F.map_contains_key(tags, n), F.lit(False))
    text = lambda n: F.when(there(n), F.coalesce(F.try_element_at(tags, F.lit(n)), F.lit("null")))
    number = lambda n, kind: F.when(there(n), F.coalesce(F.try_element_at(tags, F.lit(n)).try_cast("double").try_cast(kind), F.lit(0).cast(kind)))
    tracks = F.from_json(mediainfo, "media struct<track: array<map<string, string>>>")["media"]["track"]

    def first(of: str, name: str, kind: str) -> Column:
        own = F.transform(F.filter(tracks, lambda t: F.lower(F.try_element_at(t, F.lit("@type"))) == of), lambda t: F.try_element_at(t, F.lit(name)).try_cast(kind))
        return F.try_element_at(F.filter(own, lambda x: x.isNotNull()), F.lit(1))

    own = {
        "camera_make": text("Make"), "camera_model": text("Model"), "software": text("Software"), "lens_model": text("LensModel"), "gps_latitude": number("GPSLatitude", "double"), "gps_longitude": number("GPSLongitude", "double"),
        "width": F.coalesce(number("ImageWidth", "int"), first("video", "Width", "int")), "height": F.coalesce(number("ImageHeight", "int"), first("video", "Height", "int")),
        "exif_present": there("Make") | there("Model") | there("GPSLatitude") | there("GPSLongitude"), "container": first("general", "Format", "string"), "duration": first("general", "Duration", "double"), "bitrate": first("general", "OverallBitRate", "bigint"),
        "video_codec": first("video", "Format", "string"), "frame_rate": first("video", "FrameRate", "double"), "audio_codec": first("audio", "Format", "string"), "audio_sample_rate": first("audio", "SamplingRate", "int"), "audio_channels": first("audio", "Channels", "int"),
    }
    return F.struct(*(own.get(f.split(" ")[0], F.lit(None)).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in FIELDS.split(", ")))


def usable(found: Column) -> Column:
    """Whether fields say enough to be taken: EXIF, a width, a duration or a sample rate."""
    return found["exif_present"] | found["width"].isNotNull() | found["duration"].isNotNull() | found["audio_sample_rate"].isNotNull()


def with_metadata(df: DataFrame, tree: str = "tree", exiftool: str = "exiftool", mediainfo: str = "mediainfo") -> DataFrame:
    """df with the fields of FIELDS and `engine`, CLI or JAVA: what the tools printed if it is usable, else the tree's."""
    both = compiled_apart(df).withColumn("__cli", printed(F.col(exiftool), F.col(mediainfo))).withColumn("__tree", resolved(F.col(tree)))
    # explode keeps the optimiser from computing each field's source anew
    chosen = both.withColumn("__m", F.explode(F.array(F.when(usable(F.col("__cli")), F.struct(F.lit("CLI").alias("engine"), F.col("__cli").alias("x"))).otherwise(F.struct(F.lit("JAVA").alias("engine"), F.col("__tree").alias("x"))))))
    return chosen.select(*df.columns, "__m.x.*", F.col("__m.engine").alias("engine"))


_DAY = "lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0')"
#: What is in the headers of an event's file: when a directory is there, and its tags (absent where null).
_THERE = {
    "Exif IFD0": "event_id % 2 = 0", "Exif SubIFD": "event_id % 3 = 0", "JPEG": "event_id % 5 = 0", "PNG-IHDR": "event_id % 7 = 0", "WebP": "event_id % 11 = 0", "GPS": "event_id % 4 = 1", "XMP": "event_id % 3 = 1", "MP4": "event_id % 13 < 4", "MP4 Video": "event_id % 13 < 3",
    "MP4 Sound": "event_id % 13 < 2", "QuickTime": "event_id % 17 < 5", "QuickTime Video": "event_id % 17 < 4", "QuickTime Sound": "event_id % 17 BETWEEN 2 AND 6", "WAV": "event_id % 19 < 4", "MP3": "event_id % 23 < 5", "AVI": "event_id % 29 < 20",
}
_TAGS = {
    ("Exif IFD0", "Make"): "CASE event_id % 5 WHEN 0 THEN ' Canon ' WHEN 1 THEN '  ' WHEN 2 THEN 'SONY' END", ("Exif IFD0", "Model"): "CASE WHEN event_id % 4 = 0 THEN 'M' || CAST(user_id AS STRING) END",
    ("Exif IFD0", "Software"): "CASE event_id % 7 WHEN 0 THEN 'GIMP' WHEN 1 THEN '' WHEN 2 THEN ' ' || event_type END", ("Exif IFD0", "Date/Time"): f"CASE event_id % 3 WHEN 0 THEN '2021:05:' || {_DAY} || ' 10:00:00' WHEN 1 THEN 'yesterday' END",
    ("Exif IFD0", "Image Width"): "CASE event_id % 8 WHEN 0 THEN CAST(event_id % 4000 AS STRING) WHEN 2 THEN 'wide' END", ("Exif IFD0", "Image Height"): "CASE WHEN event_id % 8 = 0 THEN CAST(event_id % 3000 AS STRING) END",
    ("Exif SubIFD", "Lens Model"): "CASE WHEN event_id % 9 = 0 THEN 'L' || CAST(event_id % 50 AS STRING) END", ("Exif SubIFD", "Date/Time Original"): f"CASE WHEN event_id % 6 = 0 THEN '2020:02:' || {_DAY} || ' 23:59:59' END",
    ("Exif SubIFD", "Exif Image Width"): "CASE WHEN event_id % 9 = 0 THEN '640' END", ("Exif SubIFD", "Exif Image Height"): "CASE WHEN event_id % 9 = 3 THEN '480' END",
    ("JPEG", "Image Width"): "CAST(event_id % 1000 AS STRING)", ("JPEG", "Image Height"): "CASE WHEN event_id % 10 = 0 THEN CAST(event_id % 900 AS STRING) END", ("PNG-IHDR", "Image Width"): "'71'", ("PNG-IHDR", "Image Height"): "'72'", ("WebP", "Image Width"): "'111'", ("WebP", "Image Height"): "'112'",
    ("GPS", "GPS Latitude"): "CASE WHEN event_id % 3 = 0 THEN '0' ELSE CAST(event_id % 90 AS STRING) || '.5' END", ("GPS", "GPS Longitude"): "CASE event_id % 6 WHEN 0 THEN '0.0' WHEN 3 THEN '0.0' WHEN 1 THEN NULL ELSE '-' || CAST(event_id % 180 AS STRING) END", ("GPS", "GPS Altitude"): "CASE WHEN event_id % 8 = 1 THEN '12.25' ELSE 'high' END",
    ("XMP", "xmp:CreatorTool"): "CASE WHEN event_id % 4 = 0 THEN 'Tool ' || event_type END", ("XMP", "tiff:Software"): "'tiff'",
    ("MP4", "Creation Time"): f"'2019:11:' || {_DAY} || ' 01:02:03'", ("MP4", "Modification Time"): "CASE WHEN event_id % 2 = 1 THEN '2019:12:01 00:00:00' END", ("MP4", "Duration in Seconds"): "CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 600 AS STRING) || '.5' END",
    ("MP4 Video", "Width"): "CASE WHEN event_id % 2 = 0 THEN '1920' END", ("MP4 Video", "Height"): "'1080'", ("MP4 Video", "Frame Rate"): "'29.97'", ("MP4 Video", "Compression Type"): "'avc1'",
    ("MP4 Sound", "Sample Rate"): "CASE WHEN event_id % 2 = 0 THEN '48000' END", ("MP4 Sound", "Number of Channels"): "'2'", ("MP4 Sound", "Format"): "'mp4a'",
    ("QuickTime", "Duration in Seconds"): "'33.5'", ("QuickTime Video", "Width"): "CASE WHEN event_id % 3 = 0 THEN '320' END", ("QuickTime Video", "Height"): "'240'", ("QuickTime Sound", "Sample Rate"): "'22050'", ("QuickTime Sound", "Number of Channels"): "'6'",
    ("WAV", "Samples Per Second"): "'44100'", ("WAV", "Channels"): "'1'", ("WAV", "Bytes Per Second"): "CASE WHEN event_id % 2 = 0 THEN '176400' ELSE 'fast' END", ("WAV", "Duration"): "'7.75'", ("WAV", "Software"): "'Lavf58'",
    ("MP3", "Frequency (Hz)"): "'32000'", ("MP3", "Mode"): "CASE event_id % 4 WHEN 0 THEN 'Mono' WHEN 1 THEN 'SINGLE CHANNEL' WHEN 2 THEN 'Joint Stereo' END", ("MP3", "Bitrate (kbps)"): "CAST(event_id % 320 AS STRING)", ("AVI", "Width"): "'720'", ("AVI", "Height"): "'576'",
}
_EXIFTOOL = "CASE event_id % 31 WHEN 0 THEN '[{\"Make\":\"Nikon\",\"ImageWidth\":' || CAST(event_id AS STRING) || ',\"GPSLatitude\":\"north\"}]' WHEN 1 THEN '[{\"Software\":\"x\"}]' WHEN 2 THEN '[]' WHEN 3 THEN '{broken' WHEN 4 THEN '[{\"Model\":7,\"LensModel\":\"l\",\"ImageHeight\":\"9\",\"GPSLongitude\":-1.5}]' END"
_MEDIAINFO = "CASE event_id % 37 WHEN 0 THEN '{\"media\":{\"track\":[{\"@type\":\"General\",\"Format\":\"Matroska\",\"Duration\":\"12.5\",\"OverallBitRate\":\"9000\"},{\"@type\":\"Video\",\"Format\":\"VP9\",\"Width\":\"w\"},{\"@type\":\"video\",\"Format\":\"AV1\",\"Width\":\"854\",\"Height\":\"480\",\"FrameRate\":\"25\"}]}}' WHEN 1 THEN '{\"media\":{\"track\":[{\"@type\":\"Audio\",\"Format\":\"Opus\",\"SamplingRate\":\"16000\",\"Channels\":\"1\"}]}}' WHEN 2 THEN '{\"media\":{\"track\":[{\"@type\":\"Audio\",\"Format\":\"Opus\"}]}}' WHEN 3 THEN '{\"media\":{}}' END"


def headers(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, tree, exiftool, mediainfo): the headers of a file for each event."""
    own = {}
    for directory, when in _THERE.items():
        entries = [f"struct('{n}' AS key, {e} AS value)" for (of, n), e in _TAGS.items() if of == directory]
        own[directory] = f"struct('{directory}' AS key, CASE WHEN {when} THEN map_from_entries(filter(array({', '.join(entries)}), x -> x.value IS NOT NULL)) END AS value)"
    tree = f"map_from_entries(filter(array({', '.join(own.values())}), x -> x.value IS NOT NULL))"
    given = spread(table(spark, d, "events").select("event_id", "user_id", "event_type"), 200_000)
    return given.selectExpr("event_id", f"{tree} AS tree", f"{_EXIFTOOL} AS exiftool", f"{_MEDIAINFO} AS mediainfo")


_NAME = {k: f"t{i}" for i, k in enumerate(_TAGS)}
_DIR = {k: f"d{i}" for i, k in enumerate(_THERE)}


def _sql(directory: str, name: str, kind: str = "text") -> str:
    own = _NAME[directory, name]
    return {"text": f"nullif(trim({own}), '')", "time": f"try_strptime({own}, '%Y:%m:%d %H:%M:%S')"}.get(kind, f"TRY_CAST({own} AS {kind.upper()})")


def _first(field: str) -> str:
    return ", ".join(_sql(d, n, kind) for f, kind, d, n in RULES if f == field)


HEADERS_SQL = (
    "hd AS (SELECT event_id, " + ", ".join(f"{w} AS {_DIR[k]}" for k, w in _THERE.items()) + ", " + ", ".join(f"CASE WHEN {_THERE[k[0]]} THEN {e} END AS {_NAME[k]}" for k, e in _TAGS.items()) + " FROM events), "
    f"h1 AS (SELECT *, coalesce({_first('width')}) AS w1, coalesce({_first('height')}) AS e1, coalesce({_first('audio_sample_rate')}) AS r1, coalesce({_first('audio_channels')}) AS c1, CASE "
    + " ".join(f"WHEN {_DIR[k]} THEN '{n}'" for k, n in CONTAINERS)
    + f" END AS container, {_sql('GPS', 'GPS Latitude', 'double')} AS la, {_sql('GPS', 'GPS Longitude', 'double')} AS lo FROM hd), "
    "h2 AS (SELECT event_id, "
    + ", ".join(f"coalesce({_first(f)}) AS {f}" for f in ("camera_make", "camera_model", "lens_model", "software", "gps_altitude", "frame_rate", "video_codec"))
    + ", "
    + ", ".join(f"strftime(coalesce({_first(f)}), '%Y-%m-%d %H:%M:%S') AS {f}" for f in ("captured_at", "modified_at"))
    + f", coalesce(w1, {_sql('QuickTime Video', 'Width', 'int')}, CASE WHEN container = 'AVI' THEN {_sql('AVI', 'Width', 'int')} END) AS width, coalesce(CASE WHEN w1 IS NULL THEN {_sql('QuickTime Video', 'Height', 'int')} END, e1, CASE WHEN container = 'AVI' THEN {_sql('AVI', 'Height', 'int')} END) AS height, "
    "CASE WHEN lo IS NOT NULL AND (la <> 0 OR lo <> 0) THEN la END AS gps_latitude, CASE WHEN la IS NOT NULL AND (la <> 0 OR lo <> 0) THEN lo END AS gps_longitude, "
    f"coalesce({_first('duration')}, CASE WHEN NOT {_DIR['MP4']} THEN {_sql('QuickTime', 'Duration in Seconds', 'double')} END, {_sql('WAV', 'Duration', 'double')}) AS duration, coalesce({_first('audio_codec')}, CASE WHEN {_DIR['WAV']} THEN '{WAV_CODEC}' WHEN {_DIR['MP3']} THEN '{MP3_CODEC}' END) AS audio_codec, "
    f"coalesce(r1, {_sql('QuickTime Sound', 'Sample Rate', 'int')}, {_sql('WAV', 'Samples Per Second', 'int')}, {_sql('MP3', 'Frequency (Hz)', 'int')}) AS audio_sample_rate, coalesce(CASE WHEN r1 IS NULL THEN {_sql('QuickTime Sound', 'Number of Channels', 'int')} END, c1, {_sql('WAV', 'Channels', 'int')}, CASE WHEN lower({_NAME['MP3', 'Mode']}) IN ('mono', 'single channel') THEN 1 WHEN {_NAME['MP3', 'Mode']} IS NOT NULL THEN 2 END) AS audio_channels, "
    f"coalesce({_sql('WAV', 'Bytes Per Second', 'bigint')} * 8, {_sql('MP3', 'Bitrate (kbps)', 'bigint')} * 1000) AS bitrate, container, {' OR '.join(_DIR[k] for k in EXIF)} AS exif_present FROM h1)"
)


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("captured_at", "modified_at")})


@query("s9_header_fields", f"WITH {HEADERS_SQL} SELECT * FROM h2")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return _shown(with_fields(headers(spark, d)).drop("tree", "exiftool", "mediainfo"))


_BY_INFO = {0: {"width": "854", "height": "480", "container": "'Matroska'", "duration": "12.5", "bitrate": "9000", "video_codec": "'VP9'", "frame_rate": "25.0"}, 1: {"audio_codec": "'Opus'", "audio_sample_rate": "16000", "audio_channels": "1"}, 2: {"audio_codec": "'Opus'"}}
_BY_TOOL = {0: {"camera_make": "'Nikon'", "width": "CAST(event_id AS INT)", "gps_latitude": "0.0", "exif_present": "true"}, 1: {"software": "'x'"}, 4: {"camera_model": "'7'", "lens_model": "'l'", "height": "9", "gps_longitude": "-1.5", "exif_present": "true"}}


def _cli_sql(field: str) -> str:
    own = [f"WHEN event_id % 31 = {k} THEN {v[field]}" for k, v in _BY_TOOL.items() if field in v] + [f"WHEN event_id % 37 = {k} THEN {v[field]}" for k, v in _BY_INFO.items() if field in v]
    return f"CASE {' '.join(own)} END" if own else "NULL"


_COLUMNS = [f.split(" ")[0] for f in FIELDS.split(", ")]
_TAKEN = "(event_id % 31 IN (0, 4) OR event_id % 37 IN (0, 1))"


@query(
    "s8_tools_before_headers",
    f"WITH {HEADERS_SQL} SELECT event_id, CASE WHEN {_TAKEN} THEN 'CLI' ELSE 'JAVA' END AS engine, " + ", ".join(f"CASE WHEN {_TAKEN} THEN {'coalesce(' + _cli_sql(c) + ', false)' if c == 'exif_present' else _cli_sql(c)} ELSE {c} END AS {c}" for c in _COLUMNS) + " FROM h2",
)
def s8(spark: SparkSession, d: str) -> DataFrame:
    """What the tools printed for some of the files, the headers' fields for the others."""
    return _shown(with_metadata(headers(spark, d)).drop("tree", "exiftool", "mediainfo"))
