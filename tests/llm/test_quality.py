import itertools
import random
import zlib

import numpy as np

from lectern.llm import quality


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        s, t = rng.normal(size=n), rng.normal(size=(2, 2))
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            weight[y] = np.exp(sum(s[i] for i in range(n) if y[i]) + sum(t[a, b] for a, b in itertools.pairwise(y)))
        whole = sum(weight.values())
        want = [sum(w for y, w in weight.items() if y[i]) / whole for i in range(n)]
        assert np.allclose(quality.marginals(s, t), want)


def documents(n=400):
    rng = random.Random(3)
    words = "the of and to in is that it was for on are with as his they at be this".split()
    out = []
    for i in range(n):
        good = i % 3 > 0
        lines = [" ".join(rng.choice(words) + rng.choice(["ing", "ed", "", "er"]) for _ in range(rng.randint(5, 30))) + "." for _ in range(rng.randint(1, 9))]
        if not good:
            lines = [" ".join(w + rng.choice(["$$$", "%%%", "&&&"]) for w in x.split()) for x in lines]
        out.append((i, "\n".join(lines), int(good)))
    return out


def test_held_out_accuracy(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows] + [(1000, None, "en", 1.0), (1001, "", "x", 1.0), (1002, " \n ", None, 1.0), (None, "The end.", None, 1.0), (1003, "word " * 100_000, None, 1.0), (1004, "x\n" * 30_000, None, 1.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (1, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None) and not got[None].held_out
    right = [got[i].predicted == y for i, _, y in rows if got[i].held_out]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[1000].score == got[1001].score == got[1002].score == 0
    again = {r.doc_id: r.score for r in quality.scores(docs.repartition(3), labels.repartition(2)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "A line."), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in quality.scores(docs, none).collect()} == {1: 0.5, 2: 0.0}
    assert quality.scores(docs.limit(0), none).count() == 0


def test_whole_lines_and_neighbours():
    same, varied = "a " * 1200, "a " * 1200 + "bcdefghijklmnopqrstuvwxyz"
    (x,), (y,) = quality.line_features(same)[0], quality.line_features(varied)[0]
    assert sum(abs(x - y) > 0.4) == 1  # the distinct characters, at the end of a long line
    for n in (1, 47, 48, 49, 500):
        at = np.arange(n)[quality.neighbours(n, 7)]
        assert len(at) == min(n, quality.SAMPLE_LINES) and (np.diff(at) == 1).all()
    assert len({quality.neighbours(500, k).start for k in range(50)}) > 30


def test_rows_that_share_an_id_are_learnt_from_once(spark, monkeypatch):
    rows = documents(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows for _ in range(20)] + [(i, t + "\nmore") for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda chains, labels, **k: seen.append((len(chains), sum(labels))))
    quality.train(docs, labels, sample=20)
    assert seen == [(20, 10)]


def test_gradient(monkeypatch):
    """The fit stands where brute-force likelihood of whole chains has its best."""
    rng = np.random.default_rng(4)
    chains = [rng.normal(size=(rng.integers(1, 4), 3 * len(quality.OWN))) * (np.arange(3 * len(quality.OWN)) < 3) for _ in range(12)]
    labels = [int(c[:, :3].sum() + rng.normal() > 0) for c in chains]
    m = quality.fit(chains, labels, steps=3000, rate=0.02, ridge=0.05)

    def loss(w, t):
        total = 0.0
        for c, y in zip(chains, labels, strict=True):
            s = ((c - m.mean) / m.scale) @ w
            score = lambda z, s=s: sum(s[i] for i in range(len(z)) if z[i]) + sum(t[a, b] for a, b in itertools.pairwise(z))
            whole = np.log(sum(np.exp(score(z)) for z in itertools.product((0, 1), repeat=len(s))))
            total -= (score((y,) * len(s)) - whole) / labels.count(y) / 2 / len(s)
        return total + 0.05 * ((w**2).sum() + (t**2).sum()) / 2

    best = loss(m.weights, m.chain)
    for _ in range(60):
        assert loss(m.weights + rng.normal(size=len(m.weights)) * 0.05, m.chain + rng.normal(size=(2, 2)) * 0.05) > best - 1e-4


def test_lines_of_a_mixed_document_are_told_apart(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    good, bad = ([x for _, t, y in rows if y == k for x in t.split("\n") if len(x.split()) > 4] for k in (1, 0))
    own, _ = quality.line_features("\n".join(good[:7] + bad[:5]))
    got = quality.marginals(((quality.chain_features(own) - model.mean) / model.scale) @ model.weights, model.chain)
    assert got[:6].min() > 0.5 > got[8:].max()


def test_own_columns_stay(spark):
    docs = spark.createDataFrame([(1, "A line.", "mine", 2)], "doc_id long, text string, quality_score string, score int")
    kept = quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [tuple(r) for r in kept.collect()] == [(1, "A line.", "mine", 2)]
