import datetime
import json

from mediasift.operators import headers

TREE = "id int, tree map<string, map<string, string>>, exiftool string, mediainfo string, engine0 string"


def fields(spark, *rows):
    """The fields that aren't null of each row (tree, exiftool, mediainfo)."""
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], TREE)
    found = headers.with_metadata(df).drop("tree", "exiftool", "mediainfo").orderBy("id").collect()
    assert all(r["engine0"] == "x" for r in found)
    return [{k: v for k, v in r.asDict().items() if v is not None and k not in ("id", "engine0")} for r in found]


def of_trees(spark, *trees):
    return [{k: v for k, v in x.items() if k != "engine"} for x in fields(spark, *((t, None, None) for t in trees))]


def test_pictures(spark):
    none, plain, jpeg, blank = of_trees(
        spark,
        None,
        {"Exif IFD0": {"Make": " Canon ", "Software": "  ", "Image Width": "wide", "Date/Time": "2021:05:06 07:08:09"}, "Exif SubIFD": {"Exif Image Width": "640", "Date/Time Original": "never"}, "XMP": {"tiff:Software": "t", "xmp:CreatorTool": "c"}, "PNG-IHDR": {"Image Width": "1", "Image Height": "2"}},
        {"JPEG": {"Image Width": "5", "Image Height": "6"}, "WebP": {"Image Width": "7", "Image Height": "8"}, "XMP": {"tiff:Software": "t"}},
        {"GPS": {"GPS Latitude": "0.0", "GPS Longitude": "0", "GPS Altitude": "3"}},
    )
    assert none == {"exif_present": False}
    assert plain == {"camera_make": "Canon", "software": "c", "width": 640, "height": 2, "modified_at": datetime.datetime(2021, 5, 6, 7, 8, 9), "exif_present": True}
    assert jpeg == {"software": "t", "width": 5, "height": 6, "exif_present": False}
    assert blank == {"gps_altitude": 3.0, "exif_present": True}


def test_places(spark):
    placed, half = of_trees(spark, {"GPS": {"GPS Latitude": "0.0", "GPS Longitude": "-7.5"}}, {"GPS": {"GPS Latitude": "4"}})
    assert placed == {"gps_latitude": 0.0, "gps_longitude": -7.5, "exif_present": True} and half == {"exif_present": True}


def test_films(spark):
    mp4, both, quick, avi, late = of_trees(
        spark,
        {"MP4": {"Duration in Seconds": "12.5", "Creation Time": "2020-01-02 03:04:05"}, "MP4 Video": {"Width": "1920", "Compression Type": "avc1"}, "Exif IFD0": {"Image Width": "3", "Image Height": "4"}, "MP4 Sound": {"Number of Channels": "2"}, "QuickTime Sound": {"Sample Rate": "8000", "Number of Channels": "6"}},
        {"MP4": {}, "QuickTime": {"Duration in Seconds": "9"}, "QuickTime Video": {"Width": "10", "Height": "20"}, "PNG-IHDR": {"Image Height": "99"}},
        {"QuickTime": {"Duration in Seconds": "9"}, "WAV": {"Duration": "8", "Bytes Per Second": "100"}},
        {"AVI": {"Width": "7", "Height": "8"}},
        {"AVI": {"Width": "7", "Height": "8"}, "MP3": {"Mode": "Stereo", "Bitrate (kbps)": "128"}},
    )
    assert mp4 == {"container": "MP4", "duration": 12.5, "captured_at": datetime.datetime(2020, 1, 2, 3, 4, 5), "width": 1920, "height": 4, "video_codec": "avc1", "audio_channels": 6, "audio_sample_rate": 8000, "exif_present": True}
    assert both == {"container": "MP4", "width": 10, "height": 20, "exif_present": False}
    assert quick == {"container": "QuickTime", "duration": 9.0, "bitrate": 800, "audio_codec": "PCM", "exif_present": False}
    assert avi == {"container": "AVI", "width": 7, "height": 8, "exif_present": False}
    assert late == {"container": "MP3", "audio_codec": "MPEG-1/2 Audio Layer 3", "audio_channels": 2, "bitrate": 128000, "exif_present": False}


def test_tools_come_first_if_usable(spark):
    tree = {"JPEG": {"Image Width": "5", "Image Height": "6"}}
    info = lambda *tracks: json.dumps({"media": {"track": list(tracks)}})
    camera, weak, broken, sound, film, null = fields(
        spark,
        (tree, '[{"Make": "Nikon", "ImageWidth": "x", "GPSLatitude": 1.5}, {"Make": "other"}]', None),
        (tree, '[{"Software": "s"}]', info({"@type": "Audio", "Format": "Opus"})),
        (tree, "{", "["),
        (tree, None, info({"@type": "AUDIO", "SamplingRate": "fast"}, {"@type": "audio", "SamplingRate": "16000", "Format": "Opus"})),
        (tree, '[{"ImageWidth": 3}]', info({"@type": "Video", "Width": "4", "Height": "5"}, {"@type": "General", "Duration": "1.5", "OverallBitRate": "7"})),
        (tree, '[{"Make": null}]', None),
    )
    assert camera == {"engine": "CLI", "camera_make": "Nikon", "width": 0, "gps_latitude": 1.5, "exif_present": True}
    assert weak == broken == {"engine": "JAVA", "width": 5, "height": 6, "exif_present": False}
    assert sound == {"engine": "CLI", "audio_sample_rate": 16000, "audio_codec": "Opus", "exif_present": False}
    assert film == {"engine": "CLI", "width": 3, "height": 5, "duration": 1.5, "bitrate": 7, "exif_present": False}
    assert null == {"engine": "CLI", "camera_make": "null", "exif_present": True}
    assert headers.with_metadata(spark.createDataFrame([], TREE)).count() == 0


def test_work_on_one_file_is_dealt(spark, tmp_path):
    """One small file is a part for every core, and methods too long for the compiler aren't made."""
    spark.range(100).selectExpr("id AS event_id", "id AS user_id", "'x' AS event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    fields = headers.s9(spark, str(tmp_path))
    assert fields.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert fields.count() == 100 and fields.filter("width IS NOT NULL").count() > 0
