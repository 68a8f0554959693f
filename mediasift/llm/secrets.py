"""Secret scan with an incremental ledger of blobs (operator 11).

A version of a file is addressed by the SHA-256 of its text. The ledger, a Parquet table in a shared folder, says for
each blob under which rules at which version it was read and what was found. A scan reads a blob only under the rules
that the ledger doesn't have for it: a text that came before, under whatever path, isn't read again, and a rule with a
new version reads every blob once, alone. Findings are joined back to all rows that hold a blob.

The texts of unseen blobs move once, grouped by their address: a task passes on one copy of each blob, so a text that
a third of all rows hold moves once for each task and is read once. Spans count code points, their ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, small_batches, table


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has `least` characters or more; `hints`, in lower case, are texts of which
    every match holds one. Whoever changes a rule raises its version."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules and their order. A run that is too short holds no longer one, so the two of one class
# ask for their length in the pattern.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=1, least=12, hints=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]{14,}", hints=("akia",)),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Public formats of keys that the base rules know in part or not at all.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", hints=("eyj",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("gh",)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
)
RULES = (*BASE, *ADDED)

FOUND = "array<struct<kind: string, start: int, end: int>>"
LEDGER = f"blob binary, rules array<string>, found {FOUND}"


def _scan(rules: tuple[Rule, ...]):
    by_name = {r.name: (r, re.compile(r.pattern, re.ASCII)) for r in rules}

    def spans(text: str, names: list[str]) -> list[dict]:
        out, low = [], text.lower()
        for name in names:
            rule, pattern = by_name[name]
            if not rule.hints or any(h in low for h in rule.hints):
                out += [{"kind": name, "start": m.start(), "end": m.end()} for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"blob": pdf["blob"], "rules": pdf["rules"], "found": [spans(t, n) for t, n in zip(pdf["text"], pdf["rules"])]})

    return run


def address(text: Column) -> Column:
    """The address of a text's blob; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class BlobLedger:
    """What was found in which blob under which rules, in a table at `path` that grows by appending.

    A scan that is broken off leaves no row or rows that are right; the next one reads what is missing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
        """(blob, rules, text): each blob of versions once, with the names of the rules under which it wasn't read."""
        wanted = F.array(*(F.lit(r.name) for r in rules))
        blobs = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        if not self.rows().isEmpty():
            seen = self.rows().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
            # without their texts first: few new blobs among many are then picked without moving the others
            open_ = blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("seen", F.array())).alias("rules")).filter("size(rules) > 0")
            blobs = blobs.join(materialize(open_, "ledger-open"), "blob")
        else:
            blobs = blobs.withColumn("rules", wanted)
        return blobs.groupBy("blob").agg(F.any_value("rules").alias("rules"), F.any_value("text").alias("text"))

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
        """Read the unseen pairs of blob and rule, and append what was found, nothing too."""
        if len({r.kind for r in rules}) < len(rules):
            raise ValueError("two rules of one kind")
        unseen = small_batches(self.unseen(versions, rules, text))
        unseen.mapInPandas(_scan(rules), LEDGER).write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, found) of the blobs in which the rules at their versions found something: spans by start, then by the
        order of the rules. A pair that two scans at once have read counts once."""
        place = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.struct(F.lit(k).alias("place"), F.lit(r.kind).alias("kind")))))
        each = self.rows().filter("size(found) > 0").select("blob", F.explode("found").alias("x")).filter(F.col("x.kind").isin([r.name for r in rules]))
        own = each.select("blob", "x.start", F.element_at(place, F.col("x.kind")).alias("r"), "x.end").select("blob", F.struct("start", F.col("r.place").alias("place"), F.col("r.kind").alias("kind"), "end").alias("y"))
        return own.groupBy("blob").agg(F.array_sort(F.collect_set("y")).alias("y")).select("blob", F.transform("y", lambda y: F.struct(y["kind"].alias("kind"), y["start"].alias("start"), y["end"].alias("end"))).alias("found"))


def find_secrets(versions: DataFrame, ledger: BlobLedger, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, blob, found) for each row of versions, after a scan of the blobs that the ledger lacks.

    Null and empty texts are the empty blob, in which nothing is found. Rows that repeat an id, a text or both stay
    rows of their own. Columns other than `keep` and `text` aren't read. An empty table gives no rows.
    """
    ledger.scan(versions, rules, text)
    found = materialize(ledger.findings(rules), "ledger-found").withColumnRenamed("blob", "__blob")
    paths = versions.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), address(F.col(text)).alias("blob"))
    met = paths.join(found, F.col("blob") == F.col("__blob"), "left")
    return met.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "blob", F.coalesce("found", F.expr(f"CAST(array() AS {FOUND})")).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents through a new ledger."""
    found = find_secrets(table(spark, sf_dir, "documents"), BlobLedger(spark, scratch_path(spark, "ledger")))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *(of(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _spans_sql(place: int, rule: Rule) -> str:
    """The spans of a rule from the lengths of the matches and of what is between them."""
    pattern = rule.pattern.replace("'", "''")
    held = f"regexp_extract(held, '{pattern}', {rule.group})"
    return (
        f"SELECT row, {place} AS place, '{rule.kind}' AS kind, stop - length(held) AS start, stop FROM (SELECT row, held, sum(length(gap) + length(held)) OVER (PARTITION BY row ORDER BY i) AS stop FROM (SELECT row, gaps[i] AS gap, helds[i] AS held, i "
        f"FROM (SELECT row, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS helds FROM d), unnest(range(1, len(helds) + 1)) u(i))) WHERE length({held}) >= {rule.least}"
    )


OP11_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(_spans_sql(k, r) for k, r in enumerate(RULES)) + "), "
    "x AS (SELECT row, " + ", ".join(f"count_if(place = {k}) AS n_{r.kind}" for k, r in enumerate(BASE)) + f", string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place) FILTER (WHERE place < {len(BASE)}) AS base, "
    "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place) AS spans FROM s GROUP BY row) "
    "SELECT doc_id, " + ", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE) + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (row)"
)
