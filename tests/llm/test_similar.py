import random

import pytest

from lectern.llm import similar


def alike(rows):
    """Ids that are not the smallest of their component, by comparing all sets of shingles."""
    sets = sorted((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, t in rows if i is not None for w in [(t or "").lower().split()])
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i for i in up if find(i) != i}


def varied(rng, words, n):
    out = list(words)
    for _ in range(n):
        k, p = rng.randrange(3), rng.randrange(len(out))
        if k == 0:
            out[p] = "new"
        elif k == 1:
            out.insert(p, "more")
        elif len(out) > 1:
            del out[p]
    return out


@pytest.mark.parametrize("tile,hot", [(64, 8), (4, 2)])
def test_against_brute_force(spark, monkeypatch, tile, hot):
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "HOT", hot)
    monkeypatch.setattr(similar, "SAMPLE", 2)
    rng = random.Random(11)
    draw = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n)]
    rows = []
    for i in range(60):
        w = draw(rng.randint(60, 200))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(varied(rng, w, rng.randint(1, max(1, len(w) // 30)))))]
    base, chain = draw(120), draw(150)
    for i in range(40):  # a large group of near copies, and a chain whose ends are far apart
        rows.append((1000 + i, " ".join(varied(rng, base, rng.randint(0, 3)))))
        chain = varied(rng, chain, 1)
        rows.append((2000 + 3 * i % 40, " ".join(chain)))
    shared = draw(60)
    rows += [(3000 + i, " ".join(shared + draw(rng.randint(3, 40)))) for i in range(30)]  # a passage in common
    rows += [(500, "a b"), (501, "A  b"), (502, "a c"), (503, None), (504, ""), (506, "w " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows] + [(None, "a b", 1, "x", "y")], "doc_id long, text string, gone int, row string, name string")
    want = alike(rows)
    assert 60 < len(want) < len(rows) - 60
    kept = similar.keep_one_similar(docs)
    assert kept.columns == docs.columns
    kept = [r.doc_id for r in kept.collect()]
    assert set(kept) == {i for i, _ in rows} - want | {None} and len(kept) == len(rows) + 1 - len(want)


def test_empty(spark):
    assert similar.keep_one_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_that_repeat(spark):
    w = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, w), (2, w), (2, "quite another text of its own"), (3, "quite another text of its own")], "doc_id long, text string")
    got = {tuple(r) for r in similar.similar_components(docs).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 2)}


def test_simhash_groups(spark):
    """Fingerprints within two bits are grouped by the index, as comparing all of them does; the stage takes its candidates from there."""
    rng = random.Random(12)
    draw = lambda n: [f"w{rng.randrange(10**4)}" for _ in range(n)]
    rows = []
    for _ in range(60):
        w = draw(300)
        rows += [" ".join(w), " ".join([*w, "end"]), " ".join(["begin", *w])]
    sets = [similar.shingles(t) for t in rows]
    fps = [similar.fingerprint(s) for s in sets]
    for s, f in zip(sets[:9], fps, strict=False):
        assert f == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    got = {r.fp: r.simhash for r in similar.simhash_groups(spark.createDataFrame([(k, signed(f)) for k, f in enumerate(fps)], "name long, fp long")).collect()}
    up = list(range(len(fps)))
    for _ in up:
        new = [min(up[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
        if new == up:
            break
        up = new
    assert [got[signed(f)] for f in fps] == up and len(set(up)) < len(fps) - 60
