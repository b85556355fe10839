"""op4: every previous word has a restaurant of its own."""

import numpy as np
import pytest
import xxhash

from sigspark.llm import op4_lm
from sigspark.llm import pitman_yor as P


def alike(n):
    """Words with one last byte whose hashes agree in their last four bits."""
    words = (f"v{i}e" for i in range(10_000))
    return [w for w in words if xxhash.xxh3_64_intdigest(w.encode()) % 16 == 5][:n]


def ids(held, n):
    return [i for i in range(10_000) if op4_lm.held_out(i) == held][:n]


def test_words_of_one_class_predict_their_own_followers(spark):
    """Each of eight words is always followed by a word of its own; a text with the followers swapped is far less likely."""
    before = alike(8)
    train = [(i, " ".join(f"{w} f{k}" for k, w in enumerate(before))) for i in ids(False, 40)]
    right, swapped = ids(True, 2)
    texts = [(right, f"{before[0]} f0"), (swapped, f"{before[0]} f1")]
    docs = spark.createDataFrame(train + texts, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in op4_lm.model_scores(docs).collect()}
    assert got[right] > got[swapped] + 1.5


def test_scores_do_not_depend_on_blocks_or_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 4 = 0")
    one = {r["doc_id"]: r["score"] for r in op4_lm.model_scores(docs, blocks=1, sweeps=2, burn_in=0).collect()}
    many = {r["doc_id"]: r["score"] for r in op4_lm.model_scores(docs, blocks=11, sweeps=2, burn_in=0, part_tokens=3_000).collect()}
    assert many == pytest.approx(one, rel=1e-5)


def crowd(rooms=60, words=5, seed=4):
    """Many restaurants of three classes that serve a few words, as one block and as one block a word."""
    rng = np.random.default_rng(seed)
    codes = np.sort(np.array([k % 3 << P.CLASS_SHIFT | int(x) for k, x in enumerate(rng.integers(0, 1 << P.CLASS_SHIFT, rooms))], np.uint64))
    counts = rng.integers(0, 8, (words, rooms))
    hashes = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    context = np.tile(np.arange(rooms), words)
    whole = P.Block(hashes, np.full(words, rooms), context, counts.ravel(), codes=codes)
    return whole, [P.Block(hashes[i : i + 1], [rooms], np.arange(rooms), counts[i], codes=codes) for i in range(words)]


def local(blocks):
    rooms = len(blocks[0].codes)
    customers, tables = (sum(np.bincount(b.context, weights=x(b), minlength=rooms) for b in blocks) for x in (lambda b: b.count, lambda b: b.t2))
    return P.Totals.unpacked(sum(b.totals().packed() for b in blocks)).local(customers, tables)


def test_restaurants_of_words_add_up_after_sampling():
    """More restaurants of a class than rounds: counts stay possible, blocks agree, probabilities add up to one."""
    whole, parts = crowd()
    hyper = ((0.6, 1.0), (0.6, 3.0), (0.7, 0.5))
    for number in range(6):
        g = local([whole])
        for b in (whole, *parts):
            b.sweep(g, hyper, number) if number else b.start(g, hyper)
        assert np.concatenate([b.t2 for b in parts]).tolist() == whole.t2.tolist()
        for c, t in ((whole.count, whole.t2), (whole.c1, whole.t1), (whole.c0, whole.t0)):
            assert ((t >= (c > 0)) & (t <= c)).all()
    g = local([whole])
    (d0, s0), (d1, s1), (d2, s2) = hyper
    p = whole.predictive(g, hyper).reshape(-1, len(whole.codes)).sum(axis=0)
    k = whole.class_of
    unknown = (s0 + d0 * g.t[0][0]) / (g.types + 1) / (s0 + g.c[0][0]) * (s1 + d1 * g.t[1][k]) / (s1 + g.c[1][k])
    assert p + unknown * (s2 + d2 * g.t[2]) / (s2 + g.c[2]) == pytest.approx(np.ones(len(k)), rel=1e-9)


def test_rounds_predict_as_one_by_one(monkeypatch):
    """Sixty restaurants of three classes in 16 rounds against each drawn after the other."""
    hyper, means = ((0.6, 1.0), (0.6, 3.0), (0.7, 0.5)), []
    for rounds in (16, 60):
        whole, _ = crowd()
        sizes = np.bincount(whole.up[whole.open])
        whole.round = (np.arange(len(whole.open)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) % rounds
        monkeypatch.setattr(P, "FAN", rounds)
        whole.start(local_one(whole), hyper)
        got = 0.0
        for number in range(1, 601):
            whole.sweep(local_one(whole), hyper, number)
            got = got + whole.predictive(local_one(whole), hyper)
        means.append(got / 600)
        monkeypatch.undo()
    assert means[0] == pytest.approx(means[1], abs=0.006)


def local_one(block):
    """As local, without the sums for discounts and strengths, which fixed ones don't need."""
    sums = lambda key, x, n: np.bincount(key, weights=x, minlength=n)
    n = len(block.codes)
    c = [np.array([float(block.c0.sum())]), sums(block.group_class, block.c1, P.CLASSES), sums(block.context, block.count, n)]
    t = [np.array([float(block.t0.sum())]), sums(block.group_class, block.t1, P.CLASSES), sums(block.context, block.t2, n)]
    return P.Totals(c, t, float((block.known > 0).sum()), np.zeros((3, len(P.DISCOUNTS))))
