import math
import random

import numpy as np
import pytest

from lectern.llm import vectors


def plain(rows, cosine):
    def fits(r):
        i, v, label = r[:3]
        return i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if fits(rows[a]) and fits(rows[b]) and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                    n[a] += 1
                    n[b] += 1
                    up[find(a)] = find(b)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return sorted(((r[0], n[k], low.get(find(k)) if r[0] is not None else None, r[0] is not None and low[find(k)] == r[0]) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("size,cosine,tile", [(64, 0.93, 1024), (64, 0.93, 16), (20, 0.9, 8), (3, 0.99, 1024)])
def test_against_brute_force(spark, monkeypatch, size, cosine, tile):
    monkeypatch.setattr(vectors, "TILE", tile * size)
    monkeypatch.setattr(vectors, "LEAST", 1)
    rng = np.random.default_rng(size)
    near = math.sqrt(2 - 2 * cosine) / math.sqrt(size)
    rows, k = [], 0
    for _ in range(25):
        center = rng.normal(size=size)
        center /= np.linalg.norm(center)
        for _ in range(rng.integers(1, 14)):
            v = center + rng.normal(size=size) * near * rng.choice([0, 0.3, 0.7, 0.75, 1.0])
            rows.append((k, (v * rng.choice([1, 1, 3])).astype(np.float32).tolist(), int(rng.integers(0, 3)), "x", 1))
            k += 1
    ok = rows[0][1]
    bad = [None, [], [0.0] * size, [None, *ok[1:]], [float("nan"), *ok[1:]], [float("inf"), *ok[1:]], ok[1:], [1e30 * x for x in ok], [1e-30 * x for x in ok]]
    rows += [(1000 + i, v, rows[0][2], "y", 2) for i, v in enumerate(bad)]
    rows += [(2000, ok, None, "y", 2), (None, ok, rows[0][2], "y", 2), (2001, ok, rows[0][2], "y", 2), (2001, ok, rows[0][2], "y", 2), (2002, [-x for x in ok], rows[0][2], "", 0)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string, block int")
    got = sorted((tuple(r) for r in vectors.linked_vectors(df, cosine=cosine).collect()), key=str)
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]
    want = plain(rows, cosine)
    assert got == want
    assert sum(r[1] for r in want) > 100


def test_empty(spark):
    assert vectors.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
