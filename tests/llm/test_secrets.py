import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mediasift.llm import secrets
from mediasift.llm.common import scratch_path

SCHEMA = "doc_id long, text string, blob string, found string, k0 string"
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PLAIN = [("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]


def brute(text, base=True):
    out = [(m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(PLAIN) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    if not base:
        out += [(m.start(), 3 + k, r.kind, m.end()) for k, r in enumerate(secrets.ADDED) for m in re.finditer(r.pattern, text or "")]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def texts(seed=5):
    r = random.Random(seed)
    bits = ["token", "TOKEN:", "secret=", "api_key", "apikey = '", "paſſword=", "passwd:\"", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "deadbeef", "=", ":", " ", "\n", "é", "😀", "toKen=abcdefghijklmnop", "token:token:abcdefghijklmnop"]
    bits += ["eyJhbGci.eyJzdWIi.c2ln", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-1234567890-ab", "/+_.-"]
    rows = [None, "", " ", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "f" * 15, "f" * 16, "secret=" + "x" * 11, "secret=" + "x" * 12, "ü" * 100_000 + " password = 'correct-horse-battery' "]
    rows += ["".join(r.choice(bits) for _ in range(r.choice([2, 5, 30, 200]))) for _ in range(120)]
    rows = [(i, t, "b", "f", "k") for i, t in enumerate(rows)]
    rows += [(7, rows[8][1], "b", "f", "k"), (7, rows[8][1], "b", "f", "k"), (None, rows[20][1], "b", "f", "k"), (None, None, "b", "f", "k")] + [(1000 + i, rows[30][1], "b", "f", "k") for i in range(40)]
    r.shuffle(rows)
    return rows


def ledger(spark):
    return secrets.BlobLedger(spark, scratch_path(spark, "ledger"))


def test_query_equals_plain_patterns(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = secrets.op11_secret_scan(spark, str(tmp_path)).collect()
    count = lambda s, kind: sum(x.startswith(f"{kind}:") for x in s.split(","))
    want = [(i, *(count(brute(t), k[0]) for k in PLAIN), hashlib.sha256(brute(t).encode()).hexdigest(), brute(t, False)) for i, t, *_ in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert any(x[1] for x in want) and any(x[2] for x in want) and any(x[3] for x in want)


def test_only_unseen_pairs_are_read(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA)
    own, base = ledger(spark), secrets.BASE
    blobs = len({t or "" for _, t, *_ in rows})
    own.scan(docs.filter("doc_id < 60"), base)
    before = own.rows().count()
    assert before == len({t or "" for i, t, *_ in rows if i is not None and i < 60})
    unseen = own.unseen(docs, base).collect()
    assert len(unseen) == len({r["text"] for r in unseen}) == blobs - before
    own.scan(docs, base)
    assert own.rows().count() == blobs and own.unseen(docs, base).count() == 0
    own.scan(docs.select(F.col("doc_id") + 5000, "text").toDF("doc_id", "text"), base)  # moved files are known blobs
    assert own.rows().count() == blobs
    newer = (secrets.Rule("hex", r"[0-9a-f]{32,}", version=2), *base[:2])
    open_ = own.unseen(docs, newer).collect()
    assert len(open_) == blobs and {tuple(r["rules"]) for r in open_} == {("hex@2",)}


def test_a_new_version_replaces_the_old(spark):
    docs = spark.createDataFrame([(1, "f" * 20 + " " + "e" * 40), (2, "f" * 20)], "doc_id long, text string")
    own = ledger(spark)
    old = {r["doc_id"]: [tuple(x) for x in r["found"]] for r in secrets.find_secrets(docs, own, secrets.BASE).collect()}
    assert old == {1: [("hex", 0, 20), ("hex", 21, 61)], 2: [("hex", 0, 20)]}
    new = {r["doc_id"]: [tuple(x) for x in r["found"]] for r in secrets.find_secrets(docs, own, (secrets.Rule("hex", r"[0-9a-f]{32,}", version=2),)).collect()}
    assert new == {1: [("hex", 21, 61)], 2: []}


def test_two_scans_at_once_count_once(spark):
    docs = spark.createDataFrame([(1, "f" * 20)], "doc_id long, text string")
    own = ledger(spark)
    own.scan(docs, secrets.BASE)
    own.rows().write.mode("append").parquet(own.path)
    assert [tuple(x) for x in secrets.find_secrets(docs, own, secrets.BASE).first()["found"]] == [("hex", 0, 20)]


def test_other_columns_empty_table_and_rules_of_one_kind(spark):
    rows = texts()[:20]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = secrets.find_secrets(docs, ledger(spark), keep=("doc_id", "k0"))
    assert found.columns == ["doc_id", "k0", "blob", "found"] and found.count() == 20 and {r["k0"] for r in found.collect()} == {"k"}
    assert secrets.find_secrets(docs.limit(0), ledger(spark)).count() == 0
    with pytest.raises(ValueError, match="one kind"):
        ledger(spark).scan(docs, (secrets.BASE[0], secrets.BASE[0]))
