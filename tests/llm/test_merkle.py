import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mediasift.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos string, part string, g string, i string, h string, run string, root2 string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(leaves, fanout):
    """(root, siblings of each leaf by level as (before, after))."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // fanout * fanout
            run = level[first : first + fanout]
            paths[k].append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
        level = [h("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], paths


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], h("".join(map(value, r[:5])))))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for lang in order:
        own[lang] = sorted(groups[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    done = {lang: climb([x[1] for x in own[lang]], fanout) for lang in order}
    root, above = climb([done[lang][0] for lang in order], fanout)
    return sorted(((doc, leaf, done[lang][0], root, tuple(done[lang][1][k] + above[n])) for n, lang in enumerate(order) for k, (doc, leaf) in enumerate(own[lang])), key=repr)


def rows_of(sizes, seed=1):
    r = random.Random(seed)
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7 % 5003, r.choice(["a", None, "é"]), lang, r.choice([None, 5, 77]), r.choice([None, "", "x", "ü" * 50, "long " * 2000 if r.random() < 0.01 else "y"])))
    rows += [(None, "s", "en", 1, "no id"), (None, "s", "en", 1, "no id"), (3, "s", "en", 1, "twice"), (3, "s", "en", 1, "twice"), (3, "t", "en", 1, "twice")]
    r.shuffle(rows)
    return [(*x, "p", "q", "r", "s", "t", "u", "v") for x in rows]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumn("leaf", merkle.leaf(*map(F.col, merkle.FIELDS))).drop("source", "n_chars", "text")


def got(found):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((x["before"], x["after"]) for x in r["path"])) for r in found.collect()), key=repr)


@pytest.mark.parametrize(("sizes", "fanout"), [({"en": 700, None: 1, "de": 256, "": 3, "zh": 257, "Ä": 2}, 2), ({"en": 100, "de": 9, "fr": 10}, 3), ({"en": 0}, 2)])
def test_manifest(spark, sizes, fanout):
    rows = rows_of(sizes)
    found = merkle.manifest(frame(spark, rows), fanout=fanout)
    assert got(found) == brute(rows, fanout)
    assert {(r["pos"], r["part"], r["g"], r["i"], r["h"], r["run"]) for r in found.collect()} == {("p", "q", "r", "s", "t", "u")}
    assert all(r["folded_root"] == r["root"] and r["verified"] for r in merkle.verify(found.withColumn("now", F.lit(None).cast("string")), "now").collect())


def test_three_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RUN", 4)
    rows = rows_of({"en": 90, "de": 17, "fr": 16, "es": 1})
    monkeypatch.setattr(merkle, "FEW_GROUPS", 0)
    assert got(merkle.manifest(frame(spark, rows))) == brute(rows, 2)


def test_single_row_and_empty_table(spark):
    one = [(1, None, None, None, None, *"pqrstuv")]
    r = merkle.manifest(frame(spark, one)).first()
    assert r["leaf"] == r["subroot"] == r["root"] == h("1:1----") and r["path"] == []
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_query_finds_what_was_touched(spark, tmp_path):
    rows = rows_of({"en": 300, "de": 40})
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    plain = {}
    for doc, leaf, subroot, root, path in brute(rows, 2):
        plain.setdefault((doc, leaf), []).append((subroot, root, h("".join(a + b for a, b in path)), path))
    leaves = {}
    for r in rows:
        touched = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        leaves[(r[0], h("".join(map(value, r[:5]))))] = h("".join(map(value, (*r[:3], r[3] + 1, r[4])))) if touched else None
    seen = 0
    for r in found.collect():
        subroot, root, proof, path = plain[(r["doc_id"], r["leaf"])].pop(next(k for k, x in enumerate(plain[(r["doc_id"], r["leaf"])]) if x[2] == r["proof_sha256"]))
        now = leaves[(r["doc_id"], r["leaf"])] or r["leaf"]
        for before, after in path:
            now = h(before + now + after)
        assert (r["subroot"], r["root"], r["folded_root"], r["verified"]) == (subroot, root, now, now == root)
        seen += not r["verified"]
    assert seen and not any(plain.values())
