from mediasift.operators.catalog import access


def test_access_of_every_user(spark):
    users = spark.createDataFrame([(1, "USER"), (4, "ADMIN"), (5, "RESEARCHER"), (6, "USER"), (7, None)], "user_id long, role string")
    items = spark.createDataFrame([(10, 1), (11, 5), (12, 4), (13, None), (14, 7), (15, 5)], "media_id long, owner long")
    got = sorted((x.user_id, x.media_id or 0) for x in access(users, items).collect())
    assert got == [(1, 10), (4, 0), (5, 11), (5, 15), (7, 14)]
