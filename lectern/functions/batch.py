"""The two aligners over many pairs at once.

Pairs of similar size are laid side by side and filled row by row; within a row the
step from cell to cell is a running minimum, so that a row of all pairs is a handful of
array operations. The tags follow from the costs around each cell, by the same rules as
the plain aligners in :mod:`lectern.functions.align`, which the tests hold this against.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Cells that are filled at a time, for all pairs together.
CELLS = 4_000_000
C, S, D, I = (ord(x) for x in "csdi")
Rule = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _filled(rows: list[Sequence], columns: list[Sequence], by_row: int, by_column: int, change: int, rule: Rule, row_tag: int, column_tag: int) -> list[str]:
    """Tags of some pairs, from the end of each alignment to its beginning."""
    count = len(rows)
    m, n = max(map(len, rows)), max(map(len, columns))
    known: dict = {}
    code = lambda x: known.setdefault(x, len(known))
    a, b = np.full((count, m), -1, np.int32), np.full((count, n), -2, np.int32)
    for k in range(count):
        a[k, : len(rows[k])] = [code(x) for x in rows[k]]
        b[k, : len(columns[k])] = [code(x) for x in columns[k]]
    slope = np.arange(n + 1, dtype=np.int32) * by_column
    above = np.broadcast_to(slope, (count, n + 1)).copy()
    tags = np.zeros((m, count, n), np.uint8)
    for r in range(m):
        same = b == a[:, r : r + 1]
        corner = above[:, :-1]
        best = np.empty_like(above)
        best[:, 0] = above[:, 0] + by_row
        best[:, 1:] = np.minimum(corner + np.where(same, 0, change), above[:, 1:] + by_row)
        here = np.minimum.accumulate(best - slope, axis=1) + slope
        tags[r] = rule(corner, above[:, 1:], here, same)
        above = here
    i, j = np.array([len(x) for x in rows]), np.array([len(x) for x in columns])
    size = np.zeros(count, np.int64)
    out = np.zeros((count, m + n), np.uint8)
    every = np.arange(count)
    while len(every):
        x, y = i[every], j[every]
        op = tags[np.maximum(x, 1) - 1, every, np.maximum(y, 1) - 1] if m and n else np.zeros(len(every), np.uint8)
        op = np.where(x == 0, column_tag, np.where(y == 0, row_tag, op))
        on = (x > 0) | (y > 0)
        every, op = every[on], op[on]
        out[every, size[every]] = op
        size[every] += 1
        i[every] -= op != column_tag
        j[every] -= op != row_tag
    return [out[k, : size[k]].tobytes().decode() for k in range(count)]


def _all(rows: list[Sequence], columns: list[Sequence], *how) -> list[str]:
    out: list[str] = [""] * len(rows)
    order = sorted(range(len(rows)), key=lambda k: (len(rows[k]), len(columns[k])))
    start = 0
    while start < len(order):
        end, wide = start, 0
        while end < len(order):
            wide = max(wide, len(columns[order[end]]))
            if end > start and (end - start + 1) * (len(rows[order[end]]) + 1) * (wide + 1) > CELLS:
                break
            end += 1
        some = order[start:end]
        for k, t in zip(some, _filled([rows[k] for k in some], [columns[k] for k in some], *how), strict=True):
            out[k] = t
        start = end
    return out


def tags(truths: list[Sequence], tests: list[Sequence], insert: int = 3, delete: int = 3, substitute: int = 4) -> list[str]:
    """The weighted aligner's tags of each pair."""

    def rule(corner: np.ndarray, above: np.ndarray, here: np.ndarray, same: np.ndarray) -> np.ndarray:
        by_delete, by_insert = here[:, :-1] + delete, above + insert
        changed = corner + substitute
        indel = np.where(by_delete <= by_insert, D, I)
        matched = same & (corner <= by_delete) & (corner <= by_insert)
        return np.where(matched, C, np.where(~same & (changed < by_delete) & (changed <= by_insert), S, indel))

    return [t[::-1] for t in _all(tests, truths, insert, delete, substitute, rule, I, D)]


def unit_counts(truths: list[Sequence], tests: list[Sequence]) -> list[tuple[int, int, int, int, int]]:
    """(S, D, I, C, N) of a shortest edit script of each pair."""

    def rule(corner: np.ndarray, above: np.ndarray, here: np.ndarray, same: np.ndarray) -> np.ndarray:
        cost, left = here[:, 1:], here[:, :-1]
        return np.where(above + 1 == cost, D, np.where(left < corner, I, np.where(same, C, S)))

    x, y = [], []
    for truth, test in zip(truths, tests, strict=True):
        a, b, most = 0, 0, min(len(truth), len(test))
        while a < most and truth[a] == test[a]:
            a += 1
        while b < most - a and truth[-1 - b] == test[-1 - b]:
            b += 1
        x.append(truth[a : len(truth) - b])
        y.append(test[a : len(test) - b])
    out = []
    for truth, test, t in zip(truths, tests, _all(x, y, 1, 1, 1, rule, D, I), strict=True):
        if truth:
            s, d = t.count("s"), t.count("d")
            out.append((s, d, t.count("i"), len(truth) - s - d, len(truth)))
        else:
            out.append((0, 0, len(test), 0, 0))
    return out
