"""What a sentence costs: no array of its words, no method too long for the compiler, no pattern where it can't begin."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from mediasift.functions import text as X
from mediasift.operators import claims
from mediasift.operators.registry import queries

MARKED = re.compile(r"Subtree \d+ / \d+ \(maxMethodCodeSize:(\d+)")


def method_sizes(df):
    """Bytes of the longest method of each whole stage; HotSpot leaves those beyond 8,000 to its interpreter."""
    spark = df.sparkSession
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    return [int(n) for n in MARKED.findall(debug.codegenString(df._jdf.queryExecution().executedPlan()))]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d, con = tmp_path_factory.mktemp("tables"), duckdb.connect()
    con.execute(f"COPY (SELECT i AS o_orderkey FROM range(40) r(i)) TO '{d}/orders.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["x8_triples", "x9_clauses", "x10_claims"])
def test_generated_methods_are_compiled(spark, tables, name):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = queries()[name](spark, tables)
        sizes, plan = method_sizes(df), df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) < 8000
    assert "transform(" not in plan


def plain_triple(clause):
    words = [w for w in clause.split(" ") if w]
    k = next((i for i, w in enumerate(words) if w.lower().strip(X.MARKS) in {*X.VERBS, *X.AUXILIARIES}), 0)
    if k:
        out = [x.strip(X.MARKS) for x in (" ".join(words[:k]), words[k], " ".join(words[k + 1 :]))]
    else:
        out = [*words[:2], *[None] * (2 - len(words)), " ".join(words[2:])]
    return tuple(x.strip(X.ENDS) if x else None for x in out)


def test_triples_are_those_of_word_lists(spark):
    r = random.Random(4)
    words = "is Is, 'WAS' was. island this were;! cut. Acme, ... , : \" x. É has İs ist won't won reported,, a b\tis".split(" ") + [""]
    own = ["", " ", "is", "  is  is ", "a is", ", is ,", "Acme. , is"] + [" ".join(r.choice(words) for _ in range(r.randrange(9))) for _ in range(600)]
    got = {x.sentence_index: (x.subject, x.action, x.value) for x in claims.triples(spark.createDataFrame([(1, i, t) for i, t in enumerate(own)], "media_id long, sentence_index int, sentence string")).collect()}
    assert got == {i: plain_triple(t) for i, t in enumerate(own)}


def test_hash_of_parts_is_that_of_raw_ones(spark):
    df = spark.createDataFrame([("A b.", None, "is", "ΑΣ"), ("", "x", "", None), ("ΟΔΟΣ", "Ö", "É", "İ")], "a string, b string, c string, d string")
    parts = [F.col(c) for c in "abcd"]
    assert all(r.x == r.y for r in df.select(X.normal_hash(*parts).alias("x"), X.claim_hash(*parts).alias("y")).collect())
