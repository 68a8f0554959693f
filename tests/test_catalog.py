from pyspark.sql import functions as F

from mediasift.operators import registry
from mediasift.operators.catalog import latest, orphans, repeated_keys, safe_name, search, violations
from mediasift.operators.dedup import acoustic_similarity, bits_of_hex, exact_duplicates, hamming_hex, perceptual_duplicates
from mediasift.sources.blobs import load, store


def test_every_sql_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())


def test_first_of_a_group_is_a_duplicate_of_the_second(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, None), (6, None)], "id long, k string")
    assert {tuple(r) for r in exact_duplicates(df, "k", [], "id").collect()} == {(1, 3), (3, 1), (4, 1)}


def test_hamming(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("0f00000000000000", "0000000000000000"), ("xyz", "0000000000000000")], "a string, b string")
    assert [r[0] for r in df.select(hamming_hex(F.col("a"), F.col("b"))).collect()] == [64, 4, -1]
    assert [r[0] and len(r[0]) for r in df.select(bits_of_hex(F.col("a"))).collect()] == [64, 64, None]


def test_perceptual_prefers_the_earliest_of_equals(spark):
    df = spark.createDataFrame([(1, "0" * 64), (2, "0" * 63 + "1"), (3, "0" * 62 + "10"), (4, "1" * 64)], "media_id long, bits string")
    assert {tuple(r) for r in perceptual_duplicates(df, 10).collect()} == {(1, 2, 1), (2, 1, 1), (3, 1, 1)}


def test_acoustic(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [9, 1, 2, 3]), ([7], [7]), ([], [1])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(acoustic_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0]


def test_quality_reports(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1), (3, 7)], "id int, x int")
    assert [(r.id, r.violation) for r in violations(df, {"positive": F.col("x") > 0}).collect()] == [(3, "positive")]
    assert [tuple(r) for r in repeated_keys(df, ["id"]).collect()] == [(3, 2)]
    parent = spark.createDataFrame([(5,)], "p int")
    assert {r.id for r in orphans(df, parent, "x", "p").collect()} == {3}
    assert {tuple(r) for r in latest(df, ["id"], [F.col("x")]).collect()} == {(1, 5), (2, None), (3, 7)}


def test_names_and_search(spark):
    df = spark.createDataFrame([("../x/a:b?.png", None), ("C:\\t\\" + "n" * 300 + ".jpg", "The End")], "n string, t string")
    names = [r[0] for r in df.select(safe_name(F.col("n"))).collect()]
    assert names[0] == "a_b_.png" and len(names[1]) == 255 and names[1].endswith(".jpg")
    assert search(df, "the", ["t"]).count() == 1


def test_files_are_read_by_their_keys(spark, tmp_path):
    """No list of all files: whatever a name begins with, only what is asked for is opened, and missing ones give no row."""
    folder = f"file://{tmp_path}/blobs"
    blobs = spark.createDataFrame([("a/_x", b"1"), ("b/.y", b""), ("c", b"333"), ("a/z", b"4")], "key string, content binary")
    assert store(blobs, folder).count() == 4
    keys = spark.createDataFrame([("a/_x",), ("./a/_x",), ("b/.y",), ("c",), ("a",), ("none/d",), ("../c",), (None,)], "key string")
    got = load(spark, keys, folder, 1)
    assert "BinaryFile" not in got._jdf.queryExecution().executedPlan().toString() and "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.key, bytes(r.content)) for r in got.collect()) == [("a/_x", b"1"), ("b/.y", b""), ("c", b"333")]
