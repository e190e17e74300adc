import itertools

import numpy as np
import pandas as pd
import pytest

from lectern.llm import images


def textures(n, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return np.clip(127.5 + 50 * v @ images._basis(), 0, 255).astype(np.uint8).reshape(n, images.SIDE, images.SIDE)


def test_files():
    x = textures(1)[0][:, :90]
    assert (images.decode(images.encode(x)) == x).all()
    assert (images.decode(b"P5 # made by hand\n2 1\n# top\n255\n\x01\x02") == [[1, 2]]).all()
    assert images.decode(b"P6 1 1 255\n\xff\xff\xff").shape == (1, 1)
    for bad in (None, b"", b"GIF89a", b"P5\n2 2\n255\n\x01", b"P5\n2", b"P5\n0 0\n255\n", b"P5 #"):
        assert images.decode(bad) is None


def test_turning_and_brightness_leave_descriptors():
    x = textures(1, 5).astype(float)
    a = images.describe(x)
    b = images.describe(np.round(x * 0.7 + 20))
    c = images.describe(np.ascontiguousarray(np.rot90(x, axes=(1, 2))))
    for other, least in ((b, 0.8), (c, 0.6)):
        apart = np.bitwise_count(a["words"][:, None] ^ other["words"][None]).sum(2).min(1)
        assert (apart <= images.MAX_BITS).mean() > least


def plain(query, target):
    """Query corners that agree, without tables and over all offsets."""
    q, t = images.describe(query[None].astype(float), images.FINER), images.describe(target[None].astype(float))
    if not len(q["y"]) or not len(t["y"]):
        return 0
    near = np.bitwise_count(q["words"][:, None] ^ t["words"][None]).sum(2) <= images.MAX_BITS
    i, j = np.nonzero(near & (q["scale"][:, None] == t["scale"][None]))
    ty, tx, turn = t["y"][j] - q["y"][i], t["x"][j] - q["x"][i], (t["turn"][j] - q["turn"][i]) % images.TURNS
    return max([len(set(i[(abs(ty - a) <= 4) & (abs(tx - b) <= 4) & (turn == c)])) for a, b, c in zip(ty, tx, turn, strict=True)], default=0)


def test_finds_crops_edits_and_turns(spark):
    x = textures(60)
    rows = [(i, images.encode(x[i]), 1, "y") for i in range(40)]
    rows += [(100, images.encode(x[3]), 1, "y"), (101, None, 1, "y"), (102, b"", 1, "y"), (103, b"P5\n9 9\n255\nxx", 1, "y"), (None, images.encode(x[4]), 1, "y"), (104, images.encode(np.full((50, 50), 9)), 1, "y"), (105, images.encode(x[5][:10, :10]), 1, "y")]
    df = spark.createDataFrame(rows, "id long, image binary, key int, corner string")
    rng = np.random.default_rng(2)
    cut = [np.clip(x[i][5:85, 11:93] * 0.8 + 12 + rng.normal(0, 1, (80, 82)), 0, 255).round().astype(np.uint8) for i in range(30)]
    turned = [np.ascontiguousarray(np.rot90(x[i], k % 4)) for k, i in enumerate(range(30, 40))]
    strange = list(x[40:])
    asked = [(i, images.encode(y)) for i, y in enumerate([*cut, *turned, *strange])] + [(900, None), (901, b"junk"), (7, images.encode(cut[7]))]
    got = images.find_copies(df, spark.createDataFrame(asked, "id long, image binary")).collect()
    assert len(got) == len(asked)
    by = {r["query"]: r for r in got}
    right = [by[i].best == i for i in range(40)]
    assert np.mean(right) >= 0.9
    assert by[3].n_copies == 2 and by[3].classes == [3]
    wrong = sum(len(set(by[i].classes) - {i}) for i in range(40)) + sum(len(by[i].classes) for i in range(40, 60))
    assert wrong <= 2
    assert all(by[i].n_copies == 0 and by[i].best is None and by[i].classes == [] for i in (900, 901))
    # recall against comparing all descriptors
    links = [(q, t) for q in range(0, 30, 3) for t in range(40) if plain(cut[q], x[t]) >= images.AGREEING]
    assert len(links) >= 10 and np.mean([t in by[q].classes for q, t in links]) >= 0.9


def test_equal_images_without_corners(spark):
    flat = images.encode(np.full((40, 40), 9))
    df = spark.createDataFrame([(1, flat), (2, flat), (3, images.encode(np.full((40, 40), 8)))], "id long, image binary")
    (r,) = images.find_copies(df, spark.createDataFrame([(7, flat)], "id long, image binary")).collect()
    assert (r.n_copies, r.best, r.classes) == (2, 1, [1])


def _resized(x, f):
    h, w = (round(n * f) for n in x.shape)
    at = [np.clip((np.arange(n) + 0.5) / f - 0.5, 0, m - 1) for n, m in zip((h, w), x.shape, strict=True)]
    i, j = (np.minimum(a.astype(int), m - 2) for a, m in zip(at, x.shape, strict=True))
    u, v = (at[0] - i)[:, None], at[1] - j
    return (x[i][:, j] * (1 - u) + x[i + 1][:, j] * u) * (1 - v) + (x[i][:, j + 1] * (1 - u) + x[i + 1][:, j + 1] * u) * v


def _tilted(x, degrees):
    a, (h, w) = np.deg2rad(degrees), x.shape
    y, z = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    i, j = np.cos(a) * y - np.sin(a) * z + (h - 1) / 2, np.sin(a) * y + np.cos(a) * z + (w - 1) / 2
    i, j = np.clip(i, 0, h - 1.001), np.clip(j, 0, w - 1.001)
    p, q = i.astype(int), j.astype(int)
    u, v = i - p, j - q
    return (x[p, q] * (1 - u) + x[p + 1, q] * u) * (1 - v) + (x[p, q + 1] * (1 - u) + x[p + 1, q + 1] * u) * v


@pytest.mark.parametrize("kind", ["blurred", "noisy", "smaller", "much smaller", "larger", "tilted", "faint", "weak part"])
def test_recall_of_edits(spark, kind):
    x = textures(30, 9).astype(float)
    rng = np.random.default_rng(8)
    change = {
        "blurred": lambda y: images._box(y[None], 1)[0], "noisy": lambda y: y + rng.normal(0, 6, y.shape), "smaller": lambda y: _resized(y, 0.8), "much smaller": lambda y: _resized(y, 0.6),
        "larger": lambda y: _resized(y, 1.3), "tilted": lambda y: _tilted(y, 9)[10:86, 10:86], "faint": lambda y: y * 0.25 + 60, "weak part": lambda y: y[6:90, 6:46],
    }[kind]
    if kind == "weak part":
        x[:, :, :48] = x[:, :, :48] * 0.3 + 80
    asked = [(i, images.encode(np.clip(np.round(change(y)), 0, 255))) for i, y in enumerate(x)]
    rows = [(i, images.encode(np.clip(y, 0, 255))) for i, y in enumerate(x)]
    got = images.find_copies(*[spark.createDataFrame(r, "id long, image binary") for r in (rows, asked)]).collect()
    assert np.mean([r["query"] in r.classes for r in got]) >= 0.9
    assert sum(len(set(r.classes) - {r["query"]}) for r in got) <= 1


@pytest.mark.parametrize("rows", [0, 3])
def test_rendered(spark, rows):
    v = np.random.default_rng(3).normal(size=(3, 64)).tolist()
    data = [(0, v[0]), (100, v[1]), (1, v[0]), (200, None), (300, [0.0] * 64), (2, [1.0])][: rows * 2]
    got = {r["query"]: r for r in images.search_rendered(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == ({0, 100, 200, 300} if rows else set())
    if rows:
        assert (got[0].best, got[0].n_copies, got[100].classes, got[200].n_copies, got[300].best) == (0, 2, [100], 0, None)


def test_votes_that_cannot_reach_are_not_sorted(monkeypatch):
    x = textures(24, 4).astype(float)
    blob = lambda y, scales: next(images._descriptors(iter([pd.DataFrame({"key": [0], "image": [images.encode(y.round())]})]), scales))["corners"][0]
    asked = [blob(y[8:88, 12:92] * 0.8 + 10, images.FINER) for y in x[:12]]
    tables, (corners, image) = images.Tables(asked), images.stacked([blob(y, images.SCALES) for y in x])
    sorted_rows = []
    distinct = images.distinct
    monkeypatch.setattr(images, "distinct", lambda rows: sorted_rows.append(len(rows)) or distinct(rows))
    got = {(int(q), int(k)): int(n) for q, k, n in zip(*tables.agreeing(corners, image), strict=True)}
    # all votes of all matches, window by window
    votes: dict = {}
    for a, b in zip(*tables.matches(corners), strict=True):
        q, c = tables.corners[a], corners[b]
        zoom, turn = int(c["scale"]) - int(q["scale"]), (int(c["turn"]) - int(q["turn"])) % images.TURNS
        ratio, angle = 2.0 ** (zoom / 4), 2 * np.pi * turn / images.TURNS
        ty = int(np.floor((c["y"] - ratio * (np.sin(angle) * q["x"] + np.cos(angle) * q["y"])) / images.CELL))
        tx = int(np.floor((c["x"] - ratio * (np.cos(angle) * q["x"] - np.sin(angle) * q["y"])) / images.CELL))
        for z, r, u, v in itertools.product((0, 1), repeat=4):
            votes.setdefault((int(tables.query[a]), int(image[b])), {}).setdefault((zoom + z, (turn + r) % images.TURNS, ty + u, tx + v), set()).add((int(a), zoom, turn, ty, tx))
    most = {pair: max(map(len, windows.values())) for pair, windows in votes.items()}
    assert got == {pair: n for pair, n in most.items() if n >= tables.least[pair[0]]} and len(got) >= 11
    assert max(sorted_rows) < sum(map(len, votes.values())) / 10


def _blobs(x):
    blob = lambda y, scales: next(images._descriptors(iter([pd.DataFrame({"key": [0], "image": [images.encode(y.round())]})]), scales))["corners"][0]
    return [blob(y[8:88, 12:92] * 0.8 + 10, images.FINER) for y in x], [blob(y, images.SCALES) for y in x]


def test_matches_that_no_shift_brings_together_are_not_looked_into(monkeypatch):
    asked, blobs = _blobs(textures(16, 6).astype(float))
    tables, (corners, image) = images.Tables(asked), images.stacked(blobs)
    hashed = []
    slot = images._slot
    monkeypatch.setattr(images, "_slot", lambda *a: hashed.append(len(a[-1])) or slot(*a))
    q, k, _ = tables.agreeing(corners, image)
    assert {(i, i) for i in range(16)} <= set(zip(q.tolist(), k.tolist(), strict=True))
    own = (tables.query[(m := tables.matches(corners))[0]] == image[m[1]]).sum()  # true copies, whose matches all may pass
    assert len(m[0]) > 10 * own and max(hashed) < own + len(m[0]) / 20


@pytest.mark.parametrize("held", [1, 1000, 1 << 18])
def test_matches_are_those_of_any_table(monkeypatch, held):
    asked, blobs = _blobs(textures(5, 7).astype(float))
    monkeypatch.setattr(images, "HELD", held)
    tables, (corners, _) = images.Tables([*asked, b""]), images.stacked([b"", *blobs])
    i, j = tables.matches(corners)
    a, b = images.table_keys(tables.corners["words"]), images.table_keys(corners["words"])
    met = (a[:, None] == b[None]).any(2) & (np.bitwise_count(tables.corners["words"][:, None] ^ corners["words"][None]).sum(2) <= images.MAX_BITS)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == list(zip(*(x.tolist() for x in np.nonzero(met)), strict=True))
    for none in (images.Tables([]), images.Tables([b""])):
        assert [len(x) for x in none.agreeing(*images.stacked(blobs))] == [0, 0, 0]
    assert [len(x) for x in tables.agreeing(*images.stacked([b""]))] == [0, 0, 0]
