"""One pass of Python over a text, in batches and tasks that don't grow with the table."""

import duckdb
import pytest
from pyspark.sql import functions as F

from mediasift.functions import text as X
from mediasift.operators import claims  # noqa: F401  registers the queries
from mediasift.operators.registry import queries
from mediasift.sources.views import spread


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d, con = tmp_path_factory.mktemp("tables"), duckdb.connect()
    con.execute(f"COPY (SELECT i AS o_orderkey FROM range(40) r(i)) TO '{d}/orders.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT i AS doc_id, 'One. Two  three! ' || i AS text FROM range(40) r(i)) TO '{d}/documents.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["x5_sentences", "x9_clauses", "x9_document_clauses", "x6_document_entities", "j10_entities_in_sentence", "j11_entities_in_clause"])
def test_a_task_has_one_python_worker(spark, tables, name):
    """A chain of Python functions holds a worker for each of them in every task."""
    plan = queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_raw_texts_as_normalised_ones(spark):
    texts = ["", " \t ", "A b.  Is\x07 it? ﬁne\n3. 5 x", "In 1999 Acme Inc. paid ＄5 million. No 7", "One.", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    both = [("s", X.sentences), ("e", X.entities), ("d", lambda c, **kw: X.spans(c, r"[^ ]*\d[^ ]*", **kw))]
    for _, f in both:
        got = df.select(f(F.col("t"), raw=True).alias("a"), f(X.normalized(F.col("t"))).alias("b")).collect()
        assert all(r.a == r.b for r in got) and any(r.a for r in got)
    assert df.filter("t IS NULL").select(X.sentences(F.col("t")).alias("a")).first().a is None


def test_parts_grow_with_rows(spark, tables):
    assert spread(spark.read.parquet(f"{tables}/orders.parquet"), 5).rdd.getNumPartitions() == 8
