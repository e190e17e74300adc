import random

import numpy as np
import xxhash

from lectern.llm import simhash
from lectern.llm.common import connected_components


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    if not words:
        return 0
    hs = [xxhash.xxh64(p.encode(), 42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(rows, limit):
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, f in rows:
        for j, g in rows:
            if i is not None and j is not None and bin(f ^ g).count("1") <= limit:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint():
    for t in [None, "", " \n", "A", "one two", "a b c", "É x Y z", "la  la la la\tla " * 9, "w " * 70000]:
        assert simhash.fingerprint(t) == plain(t)


def test_search_finds_all_pairs():
    rng = random.Random(1)
    for n in (2, 3, 9, 70, 600):
        codes = {rng.getrandbits(16) for _ in range(n)} | {rng.getrandbits(4) for _ in range(n)}
        rank = lambda c: c ^ c >> 1 ^ c >> 2 ^ c >> 3 ^ c >> 4 ^ c >> 5 ^ c >> 6 ^ c >> 7 ^ c >> 8 ^ c >> 9 ^ c >> 10 ^ c >> 11 ^ c >> 12 ^ c >> 13 ^ c >> 14 ^ c >> 15
        a = np.array(sorted(codes, key=rank), np.uint16)
        for limit in (0, 1, 2):
            x, y = simhash.search(a, limit)
            want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if bin(int(a[i] ^ a[j])).count("1") <= limit}
            assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(want)


def test_search_prunes_groups():
    """Nodes compared grow far slower than pairs: whole groups fall away by what their members share."""
    rng = np.random.default_rng(5)
    shares = []
    for n in (500, 2000, 8000):
        codes = np.sort(rng.choice(1 << 16, n, replace=False).astype(np.int64))
        looked = []
        simhash.search((codes ^ codes >> 1).astype(np.uint16), 2, looked=looked)
        shares.append(sum(looked) / (n * (n - 1) / 2))
    assert shares[0] > 2 * shares[2] and shares[2] < 0.25, shares


def test_forests_of_bounded_size(spark, monkeypatch):
    from lectern.llm import common

    monkeypatch.setattr(common, "HELD", 20)
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000 + i, 999 + i) for i in range(1, 100)], "a long, b long").repartition(3)
    got = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 100)}}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(0, 160, 4):
        base = [rng.choice(words) for _ in range(400)]
        for k in range(4):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(400)] = "zz"
            rows.append((i + k, " ".join(t), "clash", 1))
    rows += [(500, None, None, None), (501, "", "x", 2), (502, " ", "x", 3), (503, "one", "x", 3), (503, "one", "x", 3), (None, "one", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, rep long")
    got = [r.asDict() for r in simhash.simhash_components(df).collect()]
    fps = [(r[0], plain(r[1])) for r in rows]
    want = groups(fps, 2)
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in got) == sorted((i or -1, f"{f:016x}") for i, f in fps)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert 0 < len(set(want.values())) < len(want)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | {None}
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, None), (7, 7)], "a long, b long").repartition(8)
    got = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}
