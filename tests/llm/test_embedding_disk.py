import os
import re
import threading

import numpy as np

from mediasift.llm import common, embedding


def _clusters(n, d, seed, crowd):
    """n vectors, a third of them near others, and a crowd that no split parts."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[: n // 3] = x[r.integers(n // 3, n, n // 3)] + r.uniform(0.05, 0.35, (n // 3, 1)) * r.normal(size=(n // 3, d))
    x[n - crowd :] = x[-1] + 0.1 * r.normal(size=(crowd, d))
    return x[r.permutation(n)].astype(np.float32)


def test_embedding_rounds_change_nothing(spark, monkeypatch):
    """Leaves compared and fitted again in many rounds, and crowds in blocks dealt over rounds, give what one round gives: no link above brute force's."""
    monkeypatch.setattr(embedding, "SAMPLE", 150)
    monkeypatch.setattr(embedding, "PART", 100)
    v = _clusters(1200, 16, 7, 120)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    one = embedding.near_duplicates(df, leaf=24, spill=0.05, block=48).toPandas().set_index("vec_id").sort_index()
    rounds, told = embedding._rounds, []
    monkeypatch.setattr(embedding, "ROUND", 1)
    monkeypatch.setattr(embedding, "_rounds", lambda moved, whole: told.append(rounds(moved, whole)) or min(told[-1], 5))
    many = embedding.near_duplicates(df, leaf=24, spill=0.05, block=48).toPandas().set_index("vec_id").sort_index()
    assert max(told) >= 5 and len(told) >= 3 and many.equals(one)
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert (many.n_links <= links).all() and many.n_links.sum() >= 0.97 * links.sum() and links.max() > 100


def test_embedding_disk_holds_a_few_times_the_vectors(spark, monkeypatch):
    """Vectors are in some 24 leaves each, but neither the shared folder nor the executors' own holds them as often at any time."""
    monkeypatch.setattr(embedding, "ROUND", 1, raising=False)
    v = _clusters(4000, 64, 8, 0)
    path = common.scratch_path(spark, "test").removeprefix("file://").removeprefix("file:")
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(path)
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()] + [os.path.dirname(path)]

    def held():
        total = 0
        for folder in folders:
            for at, _, files in os.walk(folder):
                for f in files:
                    try:
                        total += os.path.getsize(f"{at}/{f}") if re.search(r"^shuffle|^part-|^temp_shuffle", f) else 0
                    except OSError:  # it went meanwhile
                        pass
        return total

    before, seen, over = held(), [], threading.Event()

    def watch():
        while not over.wait(0.1):
            seen.append(held() - before)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        got = embedding.near_duplicates(spark.read.parquet(path), leaf=32)
        assert got.count() == len(v)
    finally:
        over.set()
        thread.join()
    assert max([*seen, held() - before]) < 6 * v.nbytes, (max(seen), held() - before, v.nbytes)


def test_embedding_bits_tell_shared_leaves():
    r = np.random.default_rng(9)
    codes = np.array([np.pad(np.sort(r.choice(900, n, replace=False)), (0, 12 - n), constant_values=-1) for n in r.integers(0, 13, 200)])
    bits, sets = embedding._bits(codes), [set(c[c >= 0].tolist()) for c in codes]
    assert bits.shape[1] > 1 and all(bool((bits[a] & bits[b]).any()) == bool(sets[a] & sets[b]) for a in range(200) for b in range(a))
