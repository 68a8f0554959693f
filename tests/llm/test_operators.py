import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from mediasift.llm import decontaminate, embedding, langid, licenses, packing, quality, simhash, sstable, substring, tokens, toxicity
from mediasift.llm.common import scratch_path
from mediasift.llm.components import components

SCHEMA = "doc_id long, text string, fp string, block string, n_words string"
WORDS = [f"w{i}" for i in range(60)] + ["é", "Ünder", "x1"]


def documents(spark, n=60, seed=1):
    """Random texts with copies, near copies, shared passages, nulls, empty and repeated rows, and clashing columns."""
    r = random.Random(seed)
    passage = [r.choice(WORDS) for _ in range(20)]
    rows = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1003, "one"), (None, "no id"), (None, None)]
    for i in range(n):
        w = [r.choice(WORDS) for _ in range(r.choice([3, 12, 13, 40, 200]))]
        if i % 3 == 0:
            at = r.randrange(len(w))
            w[at:at] = passage[r.randrange(5) :]
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    rows += [(500 + i, rows[20 + i][1]) for i in range(10)] + [(600, rows[30][1] + " more"), (601, "Word " * 30_000)]
    r.shuffle(rows)
    return rows, spark.createDataFrame([(*x, "a", "b", "c") for x in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(140)] + [(300 + i, 301 + i) for i in range(40)] + [(5, None), (7, 7)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [256, 1])
def test_simhash_links(spark, most):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(50)}
    for x in list(fps)[:30]:
        for _ in range(6):
            y = x
            for b in r.sample(range(64), r.choice([1, 2, 3])):
                y ^= 1 << b
            fps.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.fingerprint_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), most_verified=most)
    got = {x.node: x.component for x in components(links).collect()}
    up = {signed(x): signed(x) for x in fps}
    find = lambda x: x if up[x] == x else find(up[x])
    for x in fps:
        for y in fps:
            if x != y and (x ^ y).bit_count() <= 2:
                a, b = find(signed(x)), find(signed(y))
                up[max(a, b)] = min(a, b)
    assert {x: got.get(x, x) for x in up} == {x: find(x) for x in up}


def test_simhash(spark, docs):
    rows, df = docs
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.fp % (1 << 64)) for x in simhash.near_duplicates(df).collect())
    assert got == sorted((i if i is not None else -1, brute_fingerprint(t)) for i, t in rows)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(df).columns == df.columns


def test_substring(spark, docs):
    rows, df = docs
    key = lambda i: float("inf") if i is None else i
    words = [(key(i), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            win = tuple(w[k : k + 13])
            first[win] = min(first.get(win, i), i)
    want = []
    for i, w in words:
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    got = substring.remove_repeats(df, keep=("fp",), block_chars=5000).collect()
    assert sorted((key(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in got) == sorted(want)
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_decontamination(spark, docs):
    rows, df = docs
    text = max((t for _, t in rows if t and len(t) < 5000), key=len).split()
    items = [(1, " ".join(text[3:20])), (2, " ".join(text[5:9])), (3, None), (4, ""), (None, "w1 w2"), (10, " ".join(text[3:20]).upper()), (11, "é x1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        if i is not None and w:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    want = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        want.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = decontaminate.contamination(df, bench).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == sorted(want)
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert not decontaminate.contamination(df, bench.limit(0)).filter("contaminated").count()


def test_encoder(monkeypatch):
    e = tokens.Encoder(tokens.default_path())
    odd = ["a.\nB c", "x.  y", "it's, ok. 'tis", "a\n\nb c", "\n a", "ß, é. 9, a9. b", "a,, b", "<|endoftext|> a. b", "é́. x", "no 3. 5, ½. ²,", "\x00 a", "x 　y. z", " ", ""]
    assert list(e.encode(odd)) == [e.known.whole(x) if x else b"" for x in odd]
    many = [*odd, None] * 50
    for most, chunk in ((tokens.MOST_REMEMBERED, tokens.CHUNK_CHARS), (3, 40)):
        monkeypatch.setattr(tokens, "MOST_REMEMBERED", most)
        monkeypatch.setattr(tokens, "CHUNK_CHARS", chunk)
        assert list(e.encode(many)) == [e.known.whole(x) if x else b"" for x in many]


def test_packing(spark, docs):
    rows, df = docs
    e = tokens.Encoder(tokens.default_path())
    want = Counter()
    for i, t in rows:
        ids = e.known.whole(t) + b"\2\0\0\0" if t else b"\2\0\0\0"
        want[(i, len(ids) // 4, zlib.crc32(ids) if len(ids) <= 4096 else None)] += 1
    got = packing.pack(df).toPandas()
    assert got.length.max() <= 1024 and got.length.sum() == sum(n * k for (_, n, _), k in want.items())
    whole = got[(got.piece == 0) & ~got.doc_id.isin(got[got.piece > 0].doc_id)]
    assert Counter((None if np.isnan(i) else int(i), n, c) for i, n, c in zip(whole.doc_id, whole.length, whole.ids_crc32)) == Counter({k: v for k, v in want.items() if k[2] is not None})
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate(([0], s.length.cumsum()[:-1]))).all() and s.length.sum() <= 1024
    assert packing.pack(empty(spark)).count() == 0


def best_fit_decreasing(counts):
    rooms, n = [], 0
    for x in sorted(counts.elements(), reverse=True):
        i = bisect.bisect_left(rooms, x)
        n += i == len(rooms)
        bisect.insort(rooms, (1024 if i == len(rooms) else rooms.pop(i)) - x)
    return n


@pytest.mark.parametrize("draw", [lambda r: r.randrange(1, 1024), lambda r: min(1023, int(r.expovariate(1 / 300)) + 1), lambda r: r.randrange(200, 600)])
def test_plan_is_no_longer_than_best_fit(draw):
    r = random.Random(2)
    counts = Counter(draw(r) for _ in range(20_000))
    assert packing.plan_packing(counts).sequences <= 1.002 * best_fit_decreasing(counts)


def test_shards(spark, docs):
    rows, df = docs
    folder = scratch_path(spark, "shards")
    manifest = sstable.write_shards(df, folder, shard_chars=20_000, block_bytes=512)
    e, at, want = tokens.Encoder(tokens.default_path()), 0, []
    ids = {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        ids[i] = (e.known.whole(t) if t else b"") + b"\0\0\0\0"
        want.append((i, at, len(ids[i]) // 4, zlib.crc32(ids[i])))
        at += len(ids[i]) // 4
    assert sorted(tuple(x) for x in sstable.read_shards(manifest, folder).collect()) == want
    for m in manifest.collect():
        reader = sstable.Reader(open(m.path.removeprefix("file://"), "rb").read())
        held = {i for i, _, _ in reader}
        assert all(reader.get(i) == (ids[i] if i in held else None) for i in [*list(ids)[:30], -5, 10**12])


def test_embedding(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(700, 16))
    v = np.concatenate([base, base[:200] + 0.05 * r.normal(size=(200, 16)), np.repeat(base[:1], 300, axis=0) + 0.01 * r.normal(size=(300, 16)), base[5:8]])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, []), (2004, [None] * 16)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=128).toPandas().set_index("vec_id")
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert got.n_links[: len(v)].sum() >= 0.9 * links.sum() and (got.loc[range(len(v))].n_links.to_numpy() <= links).all()
    assert (got.loc[[2000, 2001, 2002, 2003, 2004]].n_links == 0).all() and len(got) == len(rows)
    up = list(range(len(v)))
    find = lambda k: k if up[k] == k else find(up[k])
    for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1))):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert np.mean([got.component_id[k] == find(k) for k in range(len(v))]) > 0.99 and (got.kept == (got.index == got.component_id)).all()


def test_embedding_blocks_repeats_and_none(spark):
    """A crowd that no split parts, in blocks of 64: every link counts once. An id of two vectors joins nothing."""
    r = np.random.default_rng(3)
    crowd = np.ones(16) + 0.05 * r.normal(size=(300, 16))
    rows = [(i, x.tolist(), "a") for i, x in enumerate(crowd)] + [(900, [1.0, *[0.0] * 15], "b"), (900, [*[0.0] * 15, 1.0], "c"), (901, [1.0, 0.001, *[0.0] * 14], "d"), (None, [1.0, *[0.0] * 15], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    got = embedding.near_duplicates(df, leaf=32, block=64).toPandas()
    x = crowd / np.linalg.norm(crowd, axis=1, keepdims=True)
    own = got[got.vec_id < 300].sort_values("vec_id")
    assert own.n_links.tolist() == ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist() and (own.component_id == 0).all()
    assert sorted(got[got.vec_id == 900].n_links) == [0, 1] and (got[got.vec_id == 901].component_id == 900).all() and len(got) == len(rows)
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_embedding_leaves_of_a_small_sample_are_fitted_again(spark, monkeypatch):
    """A sample of about 60 of 1,200 vectors gives leaves of hundreds; they get samples of their own, in parts of 100 rows."""
    monkeypatch.setattr(embedding, "SAMPLE", 60)
    monkeypatch.setattr(embedding, "PART", 100)
    r = np.random.default_rng(5)
    base = r.normal(size=(900, 16))
    v = np.concatenate([base, base[:300] + 0.04 * r.normal(size=(300, 16))])
    classes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(v)], "rep long, v binary")
    planted = embedding.plant(classes, 16, trees=8, leaf=16, spill=0.05).distinct().toPandas()
    sizes = planted.groupby(["tree", "leaf"]).size()
    assert planted.rep.nunique() == len(v) and sizes.max() < 600 and len(sizes) > 8 * 6
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    leaves = [frozenset(k) for k in planted.groupby("rep").leaf.apply(set)]
    pairs = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    assert np.mean([bool(leaves[a] & leaves[b]) for a, b in pairs]) > 0.97


def test_embedding_lengths_and_kinds(spark):
    """Vectors of one length link among themselves, few of a length as many; floats give what doubles give."""
    r = np.random.default_rng(6)
    rows = []
    for k, d in enumerate((2, 3, 5, 8)):
        base = r.normal(size=(40, d)).astype(np.float32)
        rows += [(1000 * k + i, x.tolist()) for i, x in enumerate(np.concatenate([base, base * np.float32(3.0)]))]
    want = None
    for kind in ("float", "double"):
        got = embedding.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), leaf=16).toPandas().set_index("vec_id").sort_index()
        want = got if want is None else want
        assert got.equals(want)
    for k, d in enumerate((2, 3, 5, 8)):
        x = np.array([v for i, v in rows if i // 1000 == k])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert (want.n_links[[i for i, _ in rows if i // 1000 == k]].to_numpy() <= (x @ x.T >= 0.95).sum(axis=1) - 1).all()
        assert (want.component_id[[1000 * k + 40 + i for i in range(40)]].to_numpy() <= [1000 * k + i for i in range(40)]).all()


def test_segments():
    s = np.array([1, -5, 2, -1, 3, -9, 1, -1, 1.0])
    assert toxicity.segments(s) == [(0, 1, 1.0), (2, 5, 4.0), (6, 7, 1.0), (8, 9, 1.0)]


def test_classifiers(spark, docs):
    rows, df = docs
    r = random.Random(4)
    clean = [" ".join(r.choice(WORDS) for _ in range(50)) for _ in range(300)]
    labelled = spark.createDataFrame([(i, t + (" vile brute" if i % 4 == 0 else ""), int(i % 4 == 0)) for i, t in enumerate(clean)], "doc_id long, text string, label int")
    model = toxicity.fit(labelled)
    out = {x.doc_id: x.predicted for x in toxicity.score_toxicity(labelled, model).collect()}
    assert all(out[i] == (i % 4 == 0) for i in out)
    assert toxicity.score_toxicity(df, model).count() == len(rows) and toxicity.fit(labelled.limit(0)) is None
    junk = spark.createDataFrame([(i, t.upper().replace(" ", "!! ") if i % 3 == 0 else t, int(i % 3 != 0)) for i, t in enumerate(clean)], "doc_id long, text string, label int")
    out = quality.score_quality(junk, quality.fit(junk))
    assert out.filter("predicted != label").count() == 0
    assert quality.score_quality(df, quality.fit(junk)).filter("score is null").count() == 0
    two = spark.createDataFrame([(i, "the of and to" if i % 2 else "le des est une", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    centroids = langid.fit(two)
    assert langid.identify(two, centroids).filter("lang != lang_pred").count() == 0
    assert {x.lang_pred for x in langid.identify(spark.createDataFrame([(1, None), (2, "12 !"), (3, "")], "doc_id long, text string"), centroids).collect()} == {"und"}


def test_licenses(spark):
    texts = ["x y\nReleased under the MIT license!\nz", None, "", "one", "Licensed under the Apache License Version 2.0", "licensed under the law"]
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x.license for x in out] == ["MIT", None, None, None, "Apache-2.0", None]
    for i, t in enumerate(texts):
        w = licenses.words(t)
        best = 0.0
        for x in licenses.TEMPLATES.values():
            b = Counter(licenses.bigrams(licenses.words(x)))
            n = min(len(w), sum(b.values()) + 1)
            best = max([best, *(licenses.dice(Counter(licenses.bigrams(w[k : k + n])), b) for k in range(len(w) - n + 1) if n > 1)])
        assert (out[i].score if out[i].score else 0) == pytest.approx(best if best >= 0.8 else 0)
