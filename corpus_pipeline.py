"""documents through quality, near-duplicates, repeated passages, benchmark contamination and packing.

All stages: nulls in any column pass through; a null text is one without words, a null doc_id is larger than every
other. Rows that repeat an id are judged each on its own. Columns beyond doc_id and text stay as they are, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm.common import materialize, table
from mediasift.llm.decontaminate import drop_contaminated
from mediasift.llm.packing import pack
from mediasift.llm.quality import keep_good, learn_quality
from mediasift.llm.simhash import drop_near_duplicates
from mediasift.llm.substring import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good; it learns from the labels of the documents table.

    A null or empty text is judged as one without words, a long one whole; equal texts share one verdict. Without
    labels of both classes every document stays.
    """
    return keep_good(docs, learn_quality(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Texts without words are near duplicates of each other. Rows that repeat the smallest id of a group all stay, and
    so do all rows of a group in which none has an id.
    """
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id holds; words are joined by one space and
    n_chars, where there is one, is counted anew. A null text becomes an empty one."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.toDF(*(c if c in ("doc_id", "text") else f"c{rest.index(c)}" for c in docs.columns))
    found = remove_repeats(plain, keep=tuple(f"c{i}" for i in range(len(rest))))
    text = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*(text.get(c, F.col(f"c{rest.index(c)}") if c in rest else None).alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are in benchmark passages; texts without words stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1,024 tokens; a text without words is one end token."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontaminated", decontaminated), ("packed", packed)]

#: Trained scores, XXH64 fingerprints and token ids can't be written in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
