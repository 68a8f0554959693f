import random

import pandas as pd
import pytest

from mediasift.operators import scan
from mediasift.operators.timeline import apart_spans, consolidate_text, half_up, merge_intervals


def rows(found):
    return sorted(map(tuple, found.collect()), key=repr)


def test_a_scan_in_ranges_is_that_from_the_start(spark):
    """A state that is kept forever: the number of rows before, and the last seven values."""
    r = random.Random(1)
    data = [(r.choice(["a", "b", "b", "b", None]), i, (1 << 60) + r.randrange(100)) for i in range(400)] + [("c", 1000, 5)]
    df = spark.createDataFrame(data, "k string, i long, v long")

    def step(state, own: pd.DataFrame):
        n, last = state or (0, [])
        out = []
        for i, v in zip(own["i"].tolist(), own["v"].tolist()):
            n, last = n + 1, [*last, v][-7:]
            out.append((i, n, sum(x % 1000 for x in last), v))
        return (n, last), pd.DataFrame(out, columns=["i", "n", "s", "v"])

    want = []
    for k in {x[0] for x in data}:
        want += [(k, *x) for x in step(None, pd.DataFrame(sorted((x for x in data if x[0] == k), key=lambda x: x[1]), columns=["k", "i", "v"]))[1].values.tolist()]
    got = scan.carried(df, ["k"], ["i"], step, "i long, n long, s long, v long", size=12)
    assert rows(got) == sorted(map(tuple, want), key=repr)
    assert scan.carried(df.limit(0), ["k"], ["i"], step, "i long, n long, s long, v long", size=3).count() == 0


def test_keys_by_size(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 1)] + [(None, 2)] * 4, "k string, v int")
    few, large = scan.by_size(df, ["k"], 2)
    assert rows(few) == [("b", 1)] and rows(large) == sorted([("a", 1)] * 3 + [(None, 2)] * 4, key=repr)
    few, large = scan.by_size(df, ["k"], 9)
    assert large is None and few.count() == 8


@pytest.mark.parametrize("many", [0, 40])
def test_merging_a_hot_medium_in_ranges(spark, many):
    r = random.Random(4)
    data = []
    for k in range(260):
        start = r.uniform(0, 200)
        data.append((r.choice([1, 1, 1, 2]), r.choice("xxy"), start, start + r.uniform(0, 1.5), r.choice(["HIGH", "MEDIUM"]), round(r.uniform(-300, 300), 1), k))
    df = spark.createDataFrame(data, "media_id long, kind string, start double, end double, severity string, offset_ms double, seq long")
    want = rows(merge_intervals(df, 0.25))
    assert rows(merge_intervals(df, 0.25, many, 12)) == want and len(want) > 20


@pytest.mark.parametrize("many", [0, 30])
def test_consolidating_a_hot_medium_in_ranges(spark, many):
    r = random.Random(5)
    data = [(r.choice([1, 1, 2]), float(k // 2), k // 2 + r.choice([1.0, 2.0]), k, r.choice(["Sale ", "sale", "EXIT", " "]), round(r.uniform(0.3, 1), 4)) for k in range(240)]
    df = spark.createDataFrame(data, "media_id long, start double, end double, y long, text string, confidence double")
    want = rows(consolidate_text(df, 1.0))
    assert rows(consolidate_text(df, 1.0, many, 12)) == want and len(want) > 3


@pytest.mark.parametrize("many", [100_000, 0, 20])
def test_spans_of_a_hot_text_in_ranges(spark, many):
    r = random.Random(6)
    data = []
    for k in range(300):
        start = r.randrange(400)
        data.append((r.choice([1, 1, 1, 2, None]), start, start + r.choice([0, 1, 4, 30]), k))
    want = []
    for m in (1, 2, None):
        until = None
        for start, back, k in sorted((s, -e, k) for n, s, e, k in data if n == m):
            if until is None or start >= until:
                want.append((m, start, -back, k))
                until = -back
    got = apart_spans(spark.createDataFrame(data, "media_id long, start_char int, end_char int, id long"), ["media_id"], many, 12)
    assert rows(got) == sorted(want, key=repr)


def test_halves():
    assert [half_up(x, 1) for x in (0.25, -0.25, 1.05, 2.449, -7.35)] == [0.3, -0.3, 1.1, 2.4, -7.4]
