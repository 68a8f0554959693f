import math
import random
import re
import zlib

import corpus_pipeline
from mediasift.llm import quality, tokens
from mediasift.llm.simhash import fingerprint

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnopqrst") + str(r.randrange(40))
    texts = [" ".join(word() for _ in range(r.choice([5, 30, 90]))) for _ in range(30)]
    texts += texts[3:9] + [texts[10] + " ", texts[11].upper(), "", "one"]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(100 + i, texts[k], "en", "s", len(texts[k])) for i, k in enumerate(order)]


def test_near_duplicates_keeps_the_smallest_of_each_group(spark):
    docs = rows()
    prints = {d[0]: fingerprint(d[1]) for d in docs}
    group = {i: i for i in prints}
    find = lambda x: x if group[x] == x else find(group[x])
    for a in prints:
        for b in prints:
            if ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    out = STAGES["near_duplicates"](spark, spark.createDataFrame(docs, SCHEMA), "")
    assert sorted(tuple(x) for x in out.collect()) == sorted(d for d in docs if find(d[0]) == d[0])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len({find(i) for i in prints}) < len(docs)


def test_decontaminated_drops_a_twentieth(spark, tmp_path):
    docs = rows()
    r = random.Random(6)
    items = [" ".join(f"b{r.randrange(900)}" for _ in range(20)) for _ in range(5)] + ["b1 b2 b3"]
    docs += [(500 + i, f"{docs[i][1]} {items[i % 6]}", "en", "s", 1) for i in range(12)] + [(600, " ".join([d[1] for d in docs[:30]] + [items[0]]), "en", "s", 1)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())

    def kept(text):
        w, hit = words(text), set()
        for b in map(words, items):
            n = min(13, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
            hit |= {k for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        return not hit or 20 * len(hit) < len(w)

    want = sorted(d for d in docs if kept(d[1]))
    assert sorted(tuple(x) for x in STAGES["decontaminated"](spark, spark.createDataFrame(docs, SCHEMA), str(tmp_path)).collect()) == want
    assert 600 in {d[0] for d in want} and len(want) < len(docs)


CLASHING = SCHEMA + ", block long, n_words string, kept_text string, __text string, score double, predicted string, fp string, text_hash long, component_id long, item string, h string, `a.b` timestamp"


def with_clashing(spark, docs):
    import datetime

    return spark.createDataFrame([(*d, 2**60 + 1 if d[0] % 2 else None, "n", None, "t", 7.5, "p", "f", 1, 2, "i", "h", datetime.datetime(2024, 1, 2)) for d in docs], CLASHING)


def test_quality_keeps_what_the_model_predicts(spark, tmp_path):
    r = random.Random(1)
    docs = [(i, "$$ @@ ## " * 9 if i % 4 == 0 else " ".join(r.choice("the quick brown fox jumps over".split()) for _ in range(30)) + ".", "en", "s", 1) for i in range(200)] + [(300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labelled = [(t, int(i % 4 != 0)) for i, t, *_ in docs[:200:2] if zlib.crc32(str(i).encode()) % 5]
    model = quality.fit(spark.createDataFrame(labelled, "text string, label int"))
    wide = with_clashing(spark, [d for d in docs if d[0] is not None])
    out = STAGES["quality"](spark, wide, str(tmp_path))
    want = {d[0] for d in docs if float(model.logit(quality.statistics(d[1])[None, :])[0]) >= math.log(0.3 / 0.7)}
    assert out.columns == wide.columns and {x.doc_id for x in out.collect()} == want and {x.score for x in out.collect()} == {7.5}
    assert STAGES["quality"](spark, wide.limit(0), str(tmp_path)).count() == 0


def test_repeated_passages_go_and_columns_stay(spark):
    docs = rows(9)
    passage = " ".join(f"p{k}" for k in range(40))
    docs += [(900 + i, f"{passage} own{i} {docs[i][1]}", "en", "s", 1) for i in range(4)] + [(990, None, "en", "s", None), (991, "", None, None, 0), (991, passage, None, None, 0)]
    first = {}
    for i, t, *_ in docs:
        w = (t or "").split()
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    want = []
    for i, t, lang, source, _ in docs:
        w = (t or "").split()
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, kept, len(kept), 2**60 + 1 if i % 2 else None, "n", None, "t"))
    wide = with_clashing(spark, docs)
    out = STAGES["repeated_passages"](spark, wide, "")
    assert out.schema == wide.schema
    got = [(x.doc_id, x.text, x.n_chars, x.block, x.n_words, x.kept_text, x["__text"]) for x in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(len(t.split()) < 40 for i, t, *_ in got if 901 <= i < 904)
    assert STAGES["repeated_passages"](spark, wide.limit(0), "").count() == 0


def test_other_stages_keep_columns(spark, tmp_path):
    wide = with_clashing(spark, rows(3) + [(700, None, "en", "s", None), (701, "", "en", "s", 0)])
    spark.createDataFrame([(1, "b1 b2 b3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("near_duplicates", "decontaminated"):
        out = STAGES[name](spark, wide, str(tmp_path))
        assert out.schema == wide.schema and 0 < out.count() <= wide.count() and STAGES[name](spark, wide.limit(0), str(tmp_path)).count() == 0


def test_packed_pieces_are_the_texts(spark):
    docs = rows(5) + [(800, "Word, more words. " * 900 + "end", "en", "s", 1), (801, None, "en", "s", 1), (802, "", "en", "s", 1)]
    encoder = tokens.Encoder(tokens.default_path())
    got = STAGES["packed"](spark, with_clashing(spark, docs), "").toPandas()
    for i, t, *_ in docs:
        ids = (encoder.known.whole(t) if t else b"") + b"\2\0\0\0"
        own = got[got.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() * 4 == len(ids)
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and (own.length.iloc[1:] == 1024).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(own.start, own.length)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert STAGES["packed"](spark, with_clashing(spark, docs).limit(0), "").count() == 0
