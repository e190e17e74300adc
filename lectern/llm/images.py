"""Cropped and edited copies of images, by local descriptors.

Corners are found at several scales, half an octave apart, in queries a quarter; what counts as one depends on
the contrast around it, and each part of an image gives its strongest, so that weak
regions have some too. A corner is described by 128 comparisons of pixel pairs, turned
with the corner's own orientation, so that brightness, contrast and rotation do not
matter. Blocks of queries are joined with tiles of all images; in each, descriptors meet
through Hamming tables, each keyed by 24 of the 128 bits: near descriptors agree in all
bits of some table. Matches of two images vote for the shift, turn and scale between them;
enough corners that agree make a copy. Votes are counted by shift alone first, which few pass by chance. Images are binary PGM or PPM in a binary column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise, remove, turn_to

#: Levels of size, in quarter octaves: of all images, and of queries.
SCALES, FINER = range(0, 9, 2), range(9)
RADIUS, TESTS, TURNS = 8, 128, 24
#: Hamming tables, and bits of the key of each.
TABLES, KEY_BITS = 20, 24
#: Side of the parts of an image that give corners of their own, and how many each.
PART, STRONGEST = 16, 2
#: A corner's weaker gradient, squared, is this share of the mean one around it, and this much at least.
SHARE, FLOOR = 0.15, 0.5
#: Bits in which matching descriptors may differ, cell of a vote in pixels, and corners that must agree: so many, and one of so many of the query's.
MAX_BITS, CELL, AGREEING, PORTION = 20, 8, 5, 16
SIDE, SEED = 96, 42
#: Corners that equal images count as having in common.
EQUAL = 1 << 20
#: Queries of a block, images of a tile, images whose votes are counted at a time, and candidates that are held for that.
BLOCK, TILE, SOME, HELD = 1024, 1024, 2, 1 << 18
#: Steps of shift after which the first count of votes begins again, and bits of the hash by which votes are counted then, at most.
SHIFTS, SLOT_BITS = 16, 20


def _pattern() -> np.ndarray:
    """Offsets (turn, test, y0 x0 y1 x1) of the compared pixels."""
    rng = np.random.default_rng(SEED)
    p = np.clip(rng.normal(0, RADIUS / 2.2, (TESTS, 2, 2)), -RADIUS + 2, RADIUS - 2) * 0.95
    p *= np.minimum(1, (RADIUS - 1) / np.maximum(np.linalg.norm(p, axis=2, keepdims=True), 1e-9))
    a = 2 * np.pi * np.arange(TURNS) / TURNS
    y, x = p[None, :, :, 0], p[None, :, :, 1]
    c, s = np.cos(a)[:, None, None], np.sin(a)[:, None, None]
    return np.stack([s * x + c * y, c * x - s * y], 3).round().astype(np.int64).reshape(TURNS, TESTS, 4)


PATTERN = _pattern()
_DY, _DX = (g.ravel() for g in np.mgrid[-RADIUS + 1 : RADIUS, -RADIUS + 1 : RADIUS])
_DISC = _DY**2 + _DX**2 < RADIUS**2
_DY, _DX = _DY[_DISC], _DX[_DISC]


def encode(pixels: np.ndarray) -> bytes:
    """Grey pixels as binary PGM."""
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels of a binary PGM or PPM of 8 bits; None for what is not one, or is cut off."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    fields: list[int] = []
    at = 2
    while len(fields) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    depth = 3 if data[:2] == b"P6" else 1
    body = data[at + 1 : at + 1 + w * h * depth]
    if not (0 < top < 256 and w and h) or len(body) < w * h * depth:
        return None
    x = np.frombuffer(body, np.uint8).reshape(h, w, depth)
    return x[:, :, 0] if depth == 1 else (x @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1) squared pixels, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis, dtype=np.float64)
        n = a.shape[axis]
        a = (np.take(c, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, range(n), axis)) / (2 * r + 1)
    return a


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p = np.pad(a, pad, constant_values=-np.inf)
        n = a.shape[axis]
        a = np.max([np.take(p, range(k, k + n), axis) for k in range(2 * r + 1)], 0)
    return a


def corners(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x, turn) of the corners of equally large grey images, away from the edges."""
    _, h, w = stack.shape
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if min(h, w) < 2 * RADIUS + 3:
        return none
    smooth = np.round(_box(stack, 1) * 8) / 8
    gy, gx = np.zeros_like(smooth), np.zeros_like(smooth)
    gy[:, 1:-1] = smooth[:, 2:] - smooth[:, :-2]
    gx[:, :, 1:-1] = smooth[:, :, 2:] - smooth[:, :, :-2]
    yy, xx, xy = _box(gy * gy, 2), _box(gx * gx, 2), _box(gx * gy, 2)
    answer = (yy + xx) / 2 - np.sqrt(((yy - xx) / 2) ** 2 + xy * xy)  # smaller eigenvalue
    peak = (answer >= _highest(answer, 2) - 1e-9) & (answer > FLOOR) & (answer > SHARE * _box((yy + xx) / 2, 4))
    edge = RADIUS
    peak[:, :edge], peak[:, -edge:], peak[:, :, :edge], peak[:, :, -edge:] = False, False, False, False
    i, y, x = np.nonzero(peak)
    strength = answer[i, y, x]
    part = (i * (h // PART + 1) + y // PART) * (w // PART + 1) + x // PART
    order = np.lexsort((-strength, part))
    i, y, x, part = i[order], y[order], x[order], part[order]
    on = np.arange(len(i)) - np.searchsorted(part, part) < STRONGEST
    i, y, x = i[on], y[on], x[on]
    patch = smooth[i[:, None], y[:, None] + _DY, x[:, None] + _DX]
    angle = np.arctan2((patch * _DY).sum(1), (patch * _DX).sum(1))
    return i, y, x, np.round(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS


def _smaller(stack: np.ndarray, h: int, w: int) -> np.ndarray:
    """Smoothed images at another size, between the nearest pixels."""
    smooth = _box(stack, 1)
    for axis, n in ((1, h), (2, w)):
        size = smooth.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.minimum(at.astype(np.int64), size - 2) if size > 1 else np.zeros(n, np.int64)
        share = (at - low).reshape((1, -1, 1) if axis == 1 else (1, 1, -1))
        smooth = np.take(smooth, low, axis) * (1 - share) + np.take(smooth, np.minimum(low + 1, size - 1), axis) * share
    return smooth


def describe(stack: np.ndarray, scales: range = SCALES) -> dict[str, np.ndarray]:
    """Corners of all scales with their descriptors as two 64-bit words; places are those of the full size."""
    out: dict[str, list] = {k: [] for k in ("image", "y", "x", "scale", "turn", "words")}
    whole = stack.astype(np.float64)
    _, height, width = whole.shape
    for scale in scales:
        h, w = round(height / 2 ** (scale / 4)), round(width / 2 ** (scale / 4))
        if min(h, w) < 2 * RADIUS + 3:
            break
        level = whole
        for _ in range(scale // 4):  # smoothed at each octave
            level = _smaller(level, round(level.shape[1] / 2), round(level.shape[2] / 2))
        if scale % 4:
            level = _smaller(level, h, w)
        i, y, x, turn = corners(level)
        if len(i):
            smooth = np.round(_box(level, 1) * 8) / 8
            p = PATTERN[turn]
            bits = smooth[i[:, None], y[:, None] + p[:, :, 0], x[:, None] + p[:, :, 1]] < smooth[i[:, None], y[:, None] + p[:, :, 2], x[:, None] + p[:, :, 3]]
            out["words"].append(np.packbits(bits, axis=1).view(">i8").astype(np.int64))
            sizes = height / level.shape[1], width / level.shape[2]
            for k, v in (("image", i), ("y", (y + 0.5) * sizes[0]), ("x", (x + 0.5) * sizes[1]), ("scale", np.full(len(i), scale)), ("turn", turn)):
                out[k].append(v)
    if not out["image"]:
        return {k: np.zeros((0, 2) if k == "words" else 0, np.int64) for k in out}
    return {k: np.concatenate(v) for k, v in out.items()}


CORNERS = np.dtype([("y", "<f4"), ("x", "<f4"), ("scale", "u1"), ("turn", "u1"), ("words", "<i8", (2,))])


def _descriptors(parts: Iterator[pd.DataFrame], scales: range = SCALES) -> Iterator[pd.DataFrame]:
    for p in parts:
        by_shape: dict[tuple, list] = {}
        for k, data in zip(p["key"].tolist(), p["image"], strict=True):
            pixels = decode(data)
            if pixels is not None:
                by_shape.setdefault(pixels.shape, []).append((k, pixels))
        for shape, some in by_shape.items():
            step = max(1, 600_000 // (shape[0] * shape[1]))
            for a in range(0, len(some), step):
                turn_to("image corners")
                d = describe(np.stack([x for _, x in some[a : a + step]]), scales)
                c = np.zeros(len(d["image"]), CORNERS)
                for f in CORNERS.names:
                    c[f] = d[f]
                cut = np.searchsorted(d["image"][order := np.argsort(d["image"], kind="stable")], np.arange(len(some[a : a + step]) + 1))
                c = c[order]
                yield pd.DataFrame({"key": [k for k, _ in some[a : a + step]], "corners": [c[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]})


def descriptors(images: DataFrame, scales: range = SCALES) -> DataFrame:
    """(key, corners) of (key, image) rows: an array of CORNERS for each readable image."""
    return images.select("key", "image").mapInPandas(lambda parts: _descriptors(parts, scales), "key long, corners binary")


_BITS = np.stack([np.sort(np.random.default_rng([SEED, t]).permutation(TESTS)[:KEY_BITS]) for t in range(TABLES)])


def table_keys(words: np.ndarray) -> np.ndarray:
    """The key of each descriptor in each table, stirred so that any of its bits will do."""
    bits = np.unpackbits(np.ascontiguousarray(words.astype(">i8")).view(np.uint8).reshape(-1, 16), axis=1)
    packed = np.packbits(bits[:, _BITS.ravel()].reshape(len(words), TABLES, KEY_BITS), axis=2).astype(np.uint64)
    out = (packed[:, :, 0] << np.uint64(16) | packed[:, :, 1] << np.uint64(8) | packed[:, :, 2]) + (np.arange(TABLES, dtype=np.uint64) << np.uint64(KEY_BITS))
    out = (out + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (out ^ out >> np.uint64(29)).view(np.int64)


def stacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All corners of some images, and the row each belongs to."""
    each = [np.frombuffer(c, CORNERS) for c in blobs]
    return np.concatenate([np.zeros(0, CORNERS), *each]), np.repeat(np.arange(len(each)), [len(c) for c in each])


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in order, which of them each row is, how often each comes) of whole numbers, sorted by column rather than as bytes."""
    order = np.lexsort(rows.T[::-1])
    sorted_ = rows[order]
    new = np.concatenate(([True], (sorted_[1:] != sorted_[:-1]).any(1))) if len(rows) else np.zeros(0, bool)
    at = np.empty(len(rows), np.int64)
    at[order] = np.cumsum(new) - 1
    return sorted_[new], at, np.bincount(at, minlength=int(new.sum()))


def _slot(bits: int, *columns: np.ndarray) -> np.ndarray:
    """A hash of so many bits."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


#: Steps of a pose, of which scale and turn make one; and sine, cosine and size of every difference of two.
POSES = 2 * TURNS
_POSES = np.arange(-256 * POSES, 256 * POSES)
_ZOOM = (_POSES + TURNS) // POSES
_ANGLE = 2 * np.pi * ((_POSES - _ZOOM * POSES) % TURNS) / TURNS
_POSES = np.sin(_ANGLE), np.cos(_ANGLE), 2.0 ** (_ZOOM / 4)


class Tables:
    """Hamming tables over the corners of a block of queries."""

    def __init__(self, blobs: list[bytes]) -> None:
        self.corners, self.query = stacked(blobs)
        keys = table_keys(self.corners["words"]).ravel()  # of all tables, which have no key in common
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.begin, self.members = keys[begin], np.append(begin, len(keys)), (order // TABLES).astype(np.int32)
        self.least = np.maximum(AGREEING, -(-np.bincount(self.query, minlength=len(blobs)) // PORTION))
        self.words = [np.ascontiguousarray(self.corners["words"][:, x]) for x in (0, 1)]
        self.y, self.x = (self.corners[f].astype(np.float64) for f in "yx")
        self.pose = self.corners["scale"].astype(np.int32) * POSES + self.corners["turn"]

    def matches(self, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query corner, corner) pairs near each other, each once though it may be in several tables."""
        out = [(np.zeros(0, np.intp), np.zeros(0, np.intp))]
        keys = table_keys(corners["words"]).ravel()
        order = np.argsort(keys)
        at = np.empty(len(keys), np.int64)
        at[order] = np.searchsorted(self.keys, keys[order])
        at[at == len(self.keys)] = 0
        low = self.begin[at] if len(self.keys) else at
        n = np.where(self.keys[at] == keys, self.begin[at + 1] - low, 0) if len(self.keys) else np.zeros(len(keys), np.int64)
        upto = np.cumsum(n.reshape(-1, TABLES).sum(1))
        words = [np.ascontiguousarray(corners["words"][:, x]) for x in (0, 1)]
        start = 0
        while start < len(corners):  # so many candidates at a time, all of a corner together
            end = max(start + 1, int(np.searchsorted(upto, HELD + (upto[start - 1] if start else 0), "right")))
            m, first = n[start * TABLES : end * TABLES], low[start * TABLES : end * TABLES]
            bits = (end - start - 1).bit_length()
            kind = np.int32 if len(self.corners) << bits < 1 << 31 else np.int64
            places = np.repeat(first - (np.cumsum(m) - m), m)
            places += np.arange(len(places))
            pair = self.members.take(places).astype(kind)
            pair <<= kind(bits)
            pair |= np.repeat(np.repeat(np.arange(end - start, dtype=kind), TABLES), m)
            pair.sort()
            theirs, mine = (pair >> kind(bits)).astype(np.intp), (pair & kind((1 << bits) - 1)).astype(np.intp) + start
            apart = np.bitwise_count(self.words[0].take(theirs) ^ words[0].take(mine))
            apart += np.bitwise_count(self.words[1].take(theirs) ^ words[1].take(mine))
            near = apart <= MAX_BITS
            near[1:] &= pair[1:] != pair[:-1]
            near = np.flatnonzero(near)
            out.append((theirs.take(near), mine.take(near)))
            start = end
        return out[-1] if len(out) == 2 else tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def agreeing(self, corners: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, image, corners) where enough matches agree on one shift, turn and scale.

        Counts reach over two steps in shift, turn and scale, and begin at each, so that
        what agrees is never divided; a query's corner votes once in a step.
        """
        i, j = self.matches(corners)
        width = int(image.max(initial=0)) + 1
        # turn and scale between two corners as one number, by which sines and sizes are looked up
        pose = (corners["scale"].astype(np.int32) * POSES + corners["turn"]).take(j) - self.pose.take(i)
        x, y, sin, cos, ratio = self.x.take(i), self.y.take(i), *(v.take(pose + len(v) // 2) for v in _POSES)
        ty = np.floor((corners["y"].astype(np.float64).take(j) - ratio * (sin * x + cos * y)) / CELL).astype(np.int64)
        tx = np.floor((corners["x"].astype(np.float64).take(j) - ratio * (cos * x - sin * y)) / CELL).astype(np.int64)
        # no window holds more votes than its shifts have matches, whatever their scales and turns
        at = (self.query * width).take(i) + image.take(j)
        pair = np.flatnonzero(np.bincount(at))
        numbers = np.zeros(int(pair.max(initial=0)) + 1, np.int64)
        numbers[pair] = np.arange(len(pair))
        at = numbers.take(at)
        cell = (at * SHIFTS + (ty & SHIFTS - 1)) * SHIFTS + (tx & SHIFTS - 1)
        on = np.flatnonzero(_in_window(cell, (len(pair), SHIFTS, SHIFTS), self.least[pair // width]))
        i, j, ty, tx, pair = i[on], j[on], ty[on], tx[on], pair[at[on]]
        zoom = corners["scale"].astype(np.int64)[j] - self.corners["scale"].astype(np.int64)[i]
        turn = (corners["turn"].astype(np.int64)[j] - self.corners["turn"].astype(np.int64)[i]) % TURNS
        # nor than its scales and turns have
        some, at = np.unique(pair, return_inverse=True)
        low, steps = (int(zoom.min()), int(np.ptp(zoom)) + 2) if len(zoom) else (0, 2)  # with one that has none, as scales do not go round
        on = np.flatnonzero(_in_window((at * steps + zoom - low) * TURNS + turn, (len(some), steps, TURNS), self.least[some // width]))
        i, zoom, turn, ty, tx, pair = i[on], zoom[on], turn[on], ty[on], tx[on], pair[on]
        if not len(i):
            return (np.zeros(0, np.int64),) * 3
        shifts = [(0, z, r, a, b) for z in (0, 1) for r in (0, 1) for a in (0, 1) for b in (0, 1)]
        # windows by hash, of which some fall together: those of too few votes for sure go before they are sorted
        own = np.stack([pair, zoom, turn, ty, tx])
        bits = min(SLOT_BITS, (32 * len(i)).bit_length())
        slots = np.stack([_slot(bits, own[0], own[1] + z, (own[2] + r) % TURNS, own[3] + a, own[4] + b) for _, z, r, a, b in shifts])
        on = (np.bincount(slots.ravel(), minlength=1 << bits).astype(np.int32)[slots] >= self.least[pair // width]).any(0)
        votes = distinct(np.stack([*own, i], 1)[on])[0][:, :5]
        cells, _, n = distinct(votes)
        windows = np.concatenate([cells + np.array(x) for x in shifts]) if len(cells) else cells
        windows[:, 2] %= TURNS
        windows, at, _ = distinct(windows)
        total = np.bincount(at, np.tile(n, len(shifts)) if len(cells) else None, minlength=len(windows)).astype(np.int64)
        pairs, at = np.unique(windows[:, 0], return_inverse=True)
        most = np.zeros(len(pairs), np.int64)
        np.maximum.at(most, at, total)
        on = most >= self.least[pairs // width] if len(pairs) else np.zeros(0, bool)
        return pairs[on] // width, pairs[on] % width, most[on]


def _in_window(cell: np.ndarray, shape: tuple[int, int, int], least: np.ndarray) -> np.ndarray:
    """Which cells, of layers that go round both ways, lie in two by two that hold so many of them."""
    n = np.bincount(cell, minlength=shape[0] * shape[1] * shape[2]).astype(np.int32).reshape(shape)
    for axis in (1, 2):  # with the next one
        n = n + np.concatenate((n[:, 1:], n[:, :1]) if axis == 1 else (n[:, :, 1:], n[:, :, :1]), axis)
    enough = n >= least.astype(np.int32)[:, None, None]
    for axis in (1, 2):
        enough = enough | np.concatenate((enough[:, -1:], enough[:, :-1]) if axis == 1 else (enough[:, :, -1:], enough[:, :, :-1]), axis)
    return enough.ravel().take(cell)


def _search(key: tuple, asked: pd.DataFrame, images: pd.DataFrame) -> pd.DataFrame:
    """(query, key, corners) of a block of queries and a tile of images."""
    turn_to("image search")
    out = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query", "key", "corners")})]
    if len(asked) and len(images):
        tables, names, keys = Tables(asked["corners"].tolist()), asked["key"].to_numpy(), images["key"].to_numpy()
        for a in range(0, len(images), SOME):
            q, k, n = tables.agreeing(*stacked(images["corners"].iloc[a : a + SOME].tolist()))
            out.append(pd.DataFrame({"query": names[q], "key": keys[a + k], "corners": n}))
    return pd.concat(out, ignore_index=True)


def agreeing(asked: DataFrame, images: DataFrame) -> DataFrame:
    """(query, key, corners) of (key, corners) queries and images, by blocks and tiles dealt by hash.

    Queries are copied to each tile and images to each block: with a set share of the
    rows as queries, this grows with the square of the table, as comparing them does.
    """
    blocks, tiles = (max(1, -(-d.count() // n)) for d, n in ((asked, BLOCK), (images, TILE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    q = asked.select("key", "corners", dealt(blocks).alias("block"), every(tiles).alias("tile"))
    x = images.select("key", "corners", dealt(tiles).alias("tile"), every(blocks).alias("block"))
    return q.groupBy("block", "tile").cogroup(x.groupBy("block", "tile")).applyInPandas(_search, "query long, key long, corners long")


def find_copies(images: DataFrame, queries: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """(query, n_copies, best, classes): for each query image, the images it is a copy of, or that are copies of it.

    Both tables have (id_col, image_col). Equal images form a class, named by its
    smallest id, and are searched once: ``classes`` lists the classes found, n_copies
    counts their members, ``best`` is the class that most corners agree on (the
    smallest on a tie; null if there is none). Every query has one row for each of its
    rows; null, empty and damaged images have no corners and find nothing. Rows with a
    null id are left out. Other columns are ignored. Equal images are found whether they
    have corners or not.
    """
    spark = images.sparkSession
    own = images.where(F.col(id_col).isNotNull() & F.col(image_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), F.col(image_col).alias("image"))
    hashes = materialise(own.select("key", F.sha2("image", 256).alias("hash")), "image-hashes")
    classes = materialise(hashes.groupBy("hash").agg(F.min("key").alias("first"), F.count("*").alias("members")), "image-classes")
    # the first of each class is searched; of rows that share an id, all
    firsts = materialise(classes.select(F.col("first").alias("key"), "hash"), "image-firsts")
    one = own.withColumn("hash", F.sha2("image", 256)).join(firsts, ["key", "hash"], "left_semi")
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), F.col(image_col).alias("image"))
    of_queries = materialise(descriptors(asked, FINER), "image-queries")
    of_images = materialise(descriptors(one), "image-corners")
    found = agreeing(of_queries, of_images)
    equal = asked.where(F.col("image").isNotNull() & (F.length("image") > 0)).select(F.col("key").alias("query"), F.sha2("image", 256).alias("hash")).join(classes, "hash").select("query", F.col("first").alias("key"), F.lit(EQUAL).cast("long").alias("corners"))
    found = materialise(found.unionByName(equal).groupBy("query", "key").agg(F.max("corners").alias("corners")), "image-found")
    sizes = classes.groupBy(F.col("first").alias("key")).agg(F.sum("members").alias("members"))
    best = F.max_by("key", F.struct("corners", -F.col("key")))
    answers = found.join(sizes, "key").groupBy("query").agg(F.sum("members").alias("n_copies"), best.alias("best"), F.sort_array(F.collect_list("key")).alias("classes"))
    a = asked.select(F.col("key").alias("q")).join(answers, F.col("q") == F.col("query"), "left")
    out = materialise(a.select(F.col("q").alias("query"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), "best", F.coalesce("classes", F.array().cast("array<long>")).alias("classes")), "image-copies")
    for done in (hashes, classes, firsts, of_queries, of_images, found):
        remove(spark, done.scratch_path)
    return out


def _basis() -> np.ndarray:
    """64 fixed smooth textures."""
    noise = np.random.default_rng(SEED).normal(size=(64, SIDE, SIDE))
    for r in (2, 2, 1):
        noise = _box(noise, r)
    return (noise / noise.std((1, 2), keepdims=True)).reshape(64, -1)


def rendered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", edited: bool = False) -> DataFrame:
    """(id, image): a texture for each vector of 64 finite components, null for others.

    Near vectors give near images. ``edited`` gives a cropped, darker copy instead.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis = _basis()
        for p in parts:
            for a in range(0, len(p), 128):
                some = p.iloc[a : a + 128]
                out: list[bytes | None] = []
                for v in some["vec"]:
                    x = None if v is None else np.asarray(v, np.float64)
                    n = 0.0 if x is None or x.shape != (64,) else float(np.sqrt((x * x).sum()))
                    if not n or not np.isfinite(n):
                        out.append(None)
                        continue
                    pixels = np.clip(127.5 + 50 * (x / n) @ basis, 0, 255).astype(np.uint8).reshape(SIDE, SIDE)
                    if edited:
                        pixels = np.round(pixels[8:88, 12:92] * 0.8 + 10).astype(np.uint8)
                    out.append(encode(pixels))
                yield pd.DataFrame({"id": some["id"].to_numpy(), "image": pd.Series(out, dtype=object)})

    d = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return d.mapInPandas(run, "id long, image binary")


def search_rendered(vectors: DataFrame) -> DataFrame:
    """The search over a table of vectors: edited copies of the images whose id is divisible by 100, among all images."""
    return find_copies(rendered(vectors), rendered(vectors.where(F.col("vec_id") % 100 == 0), edited=True))
