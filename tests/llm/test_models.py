"""The trained operators against plain versions: segments, discriminant, centroids, samples."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm import langid, quality, simhash, sstable, toxicity
from mediasift.llm.common import bounded_sample, sampled, scratch_path, shares_of, shared_dir

CLASHING = "doc_id long, text string, score double, predicted string, passages int, lang_pred string, rejected int, x string, label string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 7.5, "p", 1, "l", 2, "x", "y") for i, t in rows], CLASHING)


def every_segment(s):
    """Maximal segments by definition: from the whole, take the best (the earliest, then the shortest), then what is on either side."""
    found = []

    def cut(a, b):
        best = max(((sum(s[i:j]), -i, -j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return
        i, j = -best[1], -best[2]
        found.append((i, j))
        cut(a, i)
        cut(j, b)

    cut(0, len(s))
    return sorted(found)


def test_segments_are_those_of_the_definition():
    r = random.Random(8)
    for _ in range(300):
        s = [r.choice([-3, -2, -1.25, 1, 2.5, 4]) * r.choice([1, 1.01, 0.97]) for _ in range(r.randrange(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(s))] == every_segment(s)


def test_toxicity_model_and_scores(spark):
    r = random.Random(4)
    common_words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(r.choice(common_words) for _ in range(40)) + (" vile brute filth" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(labelled)
    count, apart = [Counter(), Counter()], {x.doc_id for x in toxicity._apart(labelled).collect()}
    assert 300 < len(apart) < 400  # some share a minimum by the toxic words that they share
    for _, t, y in (x for x in rows if x[0] in apart):
        count[y].update({x for w in set(t.split()) for x in toxicity._terms(w)})
    n = [sum(c.values()) for c in count]
    prior = min(n)
    a = prior * (count[0]["brute"] + count[1]["brute"]) / sum(n)
    odds = [math.log((count[y]["brute"] + a) / (n[y] + prior - count[y]["brute"] - a)) for y in (0, 1)]
    assert model.scores["brute"] == pytest.approx(odds[1] - odds[0] - math.sqrt(1 / (count[1]["brute"] + a) + 1 / (count[0]["brute"] + a)))
    assert not any(w in model.scores for w in common_words)
    out = toxicity.score_toxicity(labelled, model).collect()
    for x in out:
        own = toxicity.words(x.text)
        s = [model.scores.get(w, next((model.scores[w[:k] + "*"] for k in (6, 5, 4) if len(w) >= k and w[:k] + "*" in model.scores), toxicity.DRIFT)) for w in own]
        want = [(i, j, model.rate * sum(s[i:j]) - math.log(max(0.1 * len(own), 1))) for i, j, _ in toxicity.segments(np.array(s))]
        assert [(p.first, p.after) for p in x.passages] == [(i, j) for i, j, z in want if z > 0]
        assert x.score == pytest.approx(model.probability(sum(z for *_, z in want if z > 0))) and x.predicted == x.label
    odd = clashing(spark, [(1, None), (2, ""), (3, "vile brute filth " * 20_000), (4, rows[0][1]), (4, rows[0][1])])
    scored = toxicity.score_toxicity(odd, model)
    got = {x.doc_id: x for x in scored.collect()}
    assert scored.count() == 5 and got[1].score == got[2].score < 0.5 and got[3].predicted == got[4].predicted == 1 and got[1].x == "x"
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0 and {x.score for x in toxicity.score_toxicity(odd, None).collect()} == {0.0}
    assert toxicity.fit(labelled.filter("label = 0")) is None


def test_quality_is_the_plain_discriminant(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9)))
    good = [" ".join(word() for _ in range(r.randrange(5, 60))) + "." for _ in range(120)]
    bad = ["$$ " * r.randrange(1, 9) + " ".join(word().upper() for _ in range(r.randrange(1, 30))) + "\n!!" for _ in range(60)]
    labelled = spark.createDataFrame([(i, t, int(i < 120)) for i, t in enumerate(good + bad)], "doc_id long, text string, label int")
    x, y = np.array([quality.statistics(t) for t in good + bad]), np.array([1] * 120 + [0] * 60)
    d, mean, cov = x.shape[1], [], []
    for c in (0, 1):
        mean.append(x[y == c].mean(axis=0))
        cov.append(np.cov(x[y == c].T, bias=True))
    pooled = (60 * cov[0] + 120 * cov[1]) / 180
    toward = lambda m: 0.95 * m + 0.05 * np.diag(np.diag(m))
    shrunk = [0.9 * toward(cov[c]) + 0.1 * (toward(pooled) + 1e-6 * np.eye(d)) + 1e-6 * np.eye(d) for c in (0, 1)]
    density = lambda v, c: -0.5 * ((v - mean[c]) @ np.linalg.inv(shrunk[c]) @ (v - mean[c]) + np.linalg.slogdet(shrunk[c])[1])
    model = quality.fit(labelled)
    out = quality.score_quality(clashing(spark, enumerate(good + bad)), model)
    for row in out.collect():
        z = math.log(120 / 60) + density(x[row.doc_id], 1) - density(x[row.doc_id], 0)
        assert row.score == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, z)))), abs=1e-6) and row.predicted == int(row.score >= 0.3)
    odd = clashing(spark, [(1, None), (2, ""), (2, ""), (3, "long " * 50_000)])
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and quality.score_quality(odd, model).count() == 4 and quality.score_quality(odd.limit(0), model).count() == 0
    assert {tuple(x) for x in kept.collect()} == {tuple(x) for x in odd.collect() if quality.score_quality(odd.filter(F.col("doc_id") == x.doc_id), model).first().predicted}
    assert quality.fit(labelled.filter("label = 1")) is None and {x.score for x in quality.score_quality(odd, None).collect()} == {0.5}


def plain_trigrams(text):
    own = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())) + " "
    return Counter(own[i : i + 3] for i in range(len(own) - 2))


def test_languages_are_those_of_the_nearest_centroid(spark):
    r = random.Random(2)
    lexicon = {"aa": [f"ka{c}o" for c in "bdfglmnprst"], "bb": [f"z{c}iß" for c in "bdfglmnprst"], "cc": [f"{c}ü{c}yn" for c in "bdfglmnprst"]}
    rows = [(k * 1000 + i, " ".join(r.choice(w) for _ in range(12)) + " 42!", k_name) for k, (k_name, w) in enumerate(lexicon.items()) for i in range(40 if k < 2 else 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert set(model.languages) == set(lexicon)
    weighted = {}  # of each centroid, by bucket
    for row in langid.identify(docs, model).collect():
        counts = Counter(langid.trigrams(row.text).tolist())
        plain = plain_trigrams(row.text)
        assert counts.total() == plain.total() and 0.9 * len(plain) <= len(counts) <= len(plain)  # a few share a bucket
        v = {b: math.log1p(n) * model.idf[b] for b, n in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(math.log1p(n) * model.weighted[b, k] for b, n in counts.items()) / size for k in range(len(model.languages))]
        assert row.lang_pred == model.languages[int(np.argmax(cosines))] == row.lang and row.score == pytest.approx(max(cosines), abs=1e-5)
    odd = clashing(spark, [(1, None), (2, ""), (3, "12 ?"), (4, rows[0][1] * 3000), (5, "Ωμέγα Ψυχή Δίψα Ζωή Ωμέγα"), (5, "kabo kabo kado kafo kalo")])
    got = [(x.doc_id, x.lang_pred, x.rejected) for x in langid.identify(odd, model).orderBy("doc_id", "text").collect()]
    assert got[:4] == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "aa", False)] and [x[2] for x in got[4:]] == [False, True]
    assert langid.identify(odd.limit(0), model).count() == 0 and {x.lang_pred for x in langid.identify(odd, None).collect()} == {"und"} and langid.fit(docs.limit(0)) is None


def test_samples_hold_rare_classes_and_very_large_tables(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3000 == 7, "rare").when(F.col("id") % 3 == 0, "b").otherwise("a").alias("c"))
    got = {r.c: (r.n, r.w) for r in bounded_sample(df, "doc_id", "c", 3000).groupBy("c").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert got["rare"][0] == 20 and all(1300 < got[c][0] < 1700 for c in "ab") and got["a"][1] == pytest.approx(39_990, rel=0.1)
    assert bounded_sample(df.limit(0), "doc_id", "c", 10).count() == 0 and bounded_sample(df.limit(50), "doc_id", "c", 100).count() == 50
    # of 1e11 rows 3,000: the share isn't rounded to nothing
    share = shares_of({"x": 10**11}, 3000)["x"]
    assert share == pytest.approx(3e-8)
    kept = spark.range(2_000_000).filter(sampled("id", F.lit(1e-5))).count()
    assert 5 <= kept <= 45


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_shards_are_read_in_place(spark):
    rows = [(i * 3 - 50, f"text {i} " * (i % 7)) for i in range(400)] + [(7, "again"), (None, "lost")]
    folder = scratch_path(spark, "places")
    manifest = sstable.write_shards(spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, n_tokens int"), folder, shard_chars=2000, block_bytes=256).orderBy("shard").collect()
    read, whole = 0, 0
    for m in manifest:
        reader = sstable.Reader.open(m.path)
        inner = reader.read
        calls = []
        reader.read = lambda at, n, calls=calls, inner=inner: calls.append(n) or inner(at, n)
        ids = [i for i, *_ in sstable.Reader.open(m.path)]
        assert all(reader.get(i) is not None for i in ids) and reader.get(10**9) is None
        read, whole = max(read, max(calls, default=0)), whole + m.bytes
    assert read < whole / 4 and sum(m.n_docs for m in manifest) == 401
    assert [m.start for m in manifest] == [sum(x.n_tokens for x in manifest[:k]) for k in range(len(manifest))]
    many = spark.createDataFrame([(i, f"p{i}", i, 1, 3, 9) for i in range(3000)], sstable.MANIFEST)
    assert sstable._started(many).filter("start != 3 * shard").count() == 0 and sstable._started(many).count() == 3000
    assert sstable.read_shards(sstable.write_shards(spark.createDataFrame([], "doc_id long, text string"), f"{folder}-none"), f"{folder}-none").count() == 0


def test_near_duplicates_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "q r s t u v"), (5, "q r s t u v"), (None, "other words here only"), (None, "other words here only")], "doc_id long, text string")
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.text) for x in simhash.drop_near_duplicates(docs).collect())
    assert got == [(-1, "other words here only"), (-1, "other words here only"), (3, "a b c d e"), (3, "q r s t u v")]
