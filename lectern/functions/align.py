"""Alignment of token sequences, and the fused row scorer that uses it.

Two aligners: a weighted one whose tags tell what happened to each token, and a
unit-cost one for error rates. Spark has neither, so both run in one Arrow-batched
function per row batch that returns every count at once; each pair of texts in a batch
is aligned once. ``tags_sql`` is the weighted aligner in higher-order functions, for
checking and for use without Python workers.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import batch

#: The penalties of an insertion, a deletion and a substitution.
INSERT, DELETE, SUBSTITUTE = 3, 3, 4
FINE = ("sub", "ins", "del")


def tags(truth: Sequence, test: Sequence, insert: int = INSERT, delete: int = DELETE, substitute: int = SUBSTITUTE) -> str:
    """One of c, s, d, i for each step of the best alignment of ``test`` to ``truth``.

    A match is taken unless an indel is strictly cheaper; a substitution only if it is
    strictly cheaper than a deletion and no dearer than an insertion; else a deletion
    wins ties against an insertion.
    """
    n = len(truth)
    above = list(range(0, (n + 1) * delete, delete)) if delete else [0] * (n + 1)
    steps = []
    for row, t in enumerate(test, 1):
        here = [row * insert]
        took = bytearray(n)
        left = here[0]
        for j in range(n):
            by_delete, by_insert, corner = left + delete, above[j + 1] + insert, above[j]
            same = truth[j] == t
            if same and corner <= by_delete and corner <= by_insert:
                left, took[j] = corner, 99  # c
            elif not same and corner + substitute < by_delete and corner + substitute <= by_insert:
                left, took[j] = corner + substitute, 115  # s
            elif by_delete <= by_insert:
                left, took[j] = by_delete, 100  # d
            else:
                left, took[j] = by_insert, 105  # i
            here.append(left)
        steps.append(took)
        above = here
    i, j, out = len(test), n, bytearray()
    while i or j:
        op = 100 if not i else 105 if not j else steps[i - 1][j - 1]
        out.append(op)
        i -= op != 100
        j -= op != 105
    out.reverse()
    return out.decode()


def paired(truth: Sequence, test: Sequence, ops: str) -> list[tuple]:
    """(test token, truth token, tag) for each step, with '-' for a gap."""
    a, b = iter(test), iter(truth)
    return [(next(a) if o != "d" else "-", next(b) if o != "i" else "-", o) for o in ops]


def unit_counts(truth: Sequence, test: Sequence) -> tuple[int, int, int, int, int]:
    """(S, D, I, C, N) of a shortest edit script.

    Among shortest scripts: common ends are matched first; then, from the end, a deletion
    if it lies on a shortest script, else an insertion if what it leads to is strictly
    nearer than the diagonal, else the diagonal.
    """
    if not truth:
        return 0, 0, len(test), 0, 0
    whole = len(truth)
    a, b = 0, 0
    while a < min(len(truth), len(test)) and truth[a] == test[a]:
        a += 1
    while b < min(len(truth), len(test)) - a and truth[-1 - b] == test[-1 - b]:
        b += 1
    x, y = truth[a : len(truth) - b], test[a : len(test) - b]
    rows = [list(range(len(y) + 1))]
    for i, u in enumerate(x, 1):
        last, here = rows[-1], [i]
        for j, v in enumerate(y, 1):
            here.append(min(last[j] + 1, here[-1] + 1, last[j - 1] + (u != v)))
        rows.append(here)
    i, j, s, d, n = len(x), len(y), 0, 0, 0
    while i or j:
        if i and rows[i - 1][j] + 1 == rows[i][j]:
            d, i = d + 1, i - 1
        elif j and (not i or rows[i][j - 1] < rows[i - 1][j - 1]):
            n, j = n + 1, j - 1
        else:
            s += x[i - 1] != y[j - 1]
            i, j = i - 1, j - 1
    return s, d, n, whole - s - d, whole


def fine_counts(steps: Sequence[tuple]) -> tuple[int, ...]:
    """(tp, fp, fn) for s, i and d over (predicted, true, tag) steps of aligned tag sequences."""
    out = []
    for k in "sid":
        tp = sum(p == k and t == k for p, t, _ in steps)
        out += [tp, sum(p == k for p, _, _ in steps) - tp, sum(t == k for _, t, _ in steps) - tp]
    return tuple(out)


def placed_errors(canonical: Sequence, other: Sequence, ops: str | None = None) -> list[tuple[int, str]]:
    """(place, tag) of each error: s and d at the canonical token, i at a place that deletions do not advance."""
    if not canonical:
        return []
    if not other:
        return [(k, "d") for k in range(len(canonical))]
    out, token, place = [], 0, 0
    for op in tags(canonical, other) if ops is None else ops:
        if op != "c":
            out.append((place if op == "i" else token, op))
        token += op != "i"
        place += op != "d"
    return out


def placed_counts(canonical: Sequence, truth: Sequence, test: Sequence, ops: tuple[str | None, str | None] = (None, None)) -> tuple[int, ...]:
    """(tp, fp, fn) for s, d and i, comparing sets of placed errors."""
    a, b = set(placed_errors(canonical, truth, ops[0])), set(placed_errors(canonical, test, ops[1]))
    out = []
    for k in "sdi":
        x, y = {e for e in a if e[1] == k}, {e for e in b if e[1] == k}
        out += [len(x & y), len(y - x), len(x - y)]
    return tuple(out)


def _struct(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType() if f.startswith("tags") else T.LongType()) for f in fields])


UNIT = [f"{k}_{pair}" for pair in ("ref_hyp", "can_ref", "can_hyp") for k in "SDICN"]
META = ["tags_can_ref", "tags_can_hyp", "tags_mer", "S_mer", "D_mer", "I_mer", "C_mer", "N_mer"] + [f"{k}_{x}" for k in FINE for x in ("tp", "fp", "fn")]
PLACED = [f"{k}_{x}" for k in "SDI" for x in ("TP", "FP", "FN")]


def scores(can: Column, ref: Column, hyp: Column) -> Column:
    """Struct of all counts of normalised (CAN, REF, HYP) texts, from one function.

    Unit-cost counts of REF to HYP, CAN to REF and CAN to HYP; tags of CAN to REF and CAN
    to HYP; the alignment of these two tag sequences and its counts, over all (mer) and
    by kind of mistake.
    """

    def run(cans: pd.Series, refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
        keys = list(zip(cans, refs, hyps, strict=True))
        place = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        c, r, h = ([(k[x] or "").split() for k in place] for x in range(3))
        true, pred = batch.tags(c, r), batch.tags(c, h)
        meta = batch.tags(true, pred)
        counts = zip(batch.unit_counts(r, h), batch.unit_counts(c, r), batch.unit_counts(c, h), true, pred, meta, strict=True)
        rows = [(*a, *b, *d, t, p, m, m.count("s"), m.count("d"), m.count("i"), m.count("c"), len(t), *fine_counts(paired(t, p, m))) for a, b, d, t, p, m in counts]
        return pd.DataFrame([rows[place[k]] for k in keys], columns=UNIT + META)

    return F.pandas_udf(run, _struct(UNIT + META))(can, ref, hyp)


def error_counts(truth: Column, test: Column) -> Column:
    """Struct of S, D, I, C and N of a unit-cost alignment of normalised texts."""

    def run(truths: pd.Series, tests: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(batch.unit_counts([(a or "").split() for a in truths], [(b or "").split() for b in tests]), columns=list("SDICN"))

    return F.pandas_udf(run, _struct(list("SDICN")))(truth, test)


def tag_sequence(truth: Column, test: Column, insert: int = INSERT, delete: int = DELETE, substitute: int = SUBSTITUTE) -> Column:
    """The weighted aligner's tags as a text, for normalised texts."""

    def run(truths: pd.Series, tests: pd.Series) -> pd.Series:
        return pd.Series(batch.tags([(a or "").split() for a in truths], [(b or "").split() for b in tests], insert, delete, substitute), dtype=object)

    return F.pandas_udf(run, "string")(truth, test)


def placed_scores(can: Column, ref: Column, hyp: Column) -> Column:
    """Struct of tp, fp and fn by kind of placed error, for texts as they are."""

    def run(cans: pd.Series, refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
        c, r, h = ([(x or "").split() for x in some] for some in (cans, refs, hyps))
        return pd.DataFrame([placed_counts(*row[:3], row[3:]) for row in zip(c, r, h, batch.tags(c, r), batch.tags(c, h), strict=True)], columns=PLACED)

    return F.pandas_udf(run, _struct(PLACED))(can, ref, hyp)


def errors_at(can: Column, other: Column) -> Column:
    """Array of (place, type) of the errors of one reading."""
    kind = T.ArrayType(T.StructType([T.StructField("place", T.LongType()), T.StructField("type", T.StringType())]))

    def run(cans: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([[{"place": p, "type": k} for p, k in placed_errors((a or "").split(), (b or "").split())] for a, b in zip(cans, others, strict=True)], dtype=object)

    return F.pandas_udf(run, kind)(can, other)


def aligned_tokens(truth: Column, test: Column) -> Column:
    """Array of (test, truth, tag) steps."""
    kind = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("test", "truth", "tag")]))

    def run(truths: pd.Series, tests: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(truths, tests, strict=True):
            x, y = (a or "").split(), (b or "").split()
            out.append([dict(zip(("test", "truth", "tag"), s, strict=True)) for s in paired(x, y, tags(x, y))])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind)(truth, test)


def tags_sql(truth: Column, test: Column) -> Column:
    """The weighted aligner over token arrays in higher-order functions: a fold over rows of folds over cells."""
    cell = lambda cost, path: F.struct(cost.cast("long").alias("c"), path.alias("p"))
    count = F.size(truth)
    columns = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    start = F.concat(F.array(cell(F.lit(0), F.lit(""))), F.transform(columns, lambda j: cell(j * DELETE, F.repeat(F.lit("d"), j))))

    def row(above: Column, token: Column) -> Column:
        first = cell(F.element_at(above, 1)["c"] + INSERT, F.concat(F.element_at(above, 1)["p"], F.lit("i")))

        def step(here: Column, j: Column) -> Column:
            left, up, corner = F.element_at(here, -1), F.element_at(above, j + 1), F.element_at(above, j)
            by_d, by_i = left["c"] + DELETE, up["c"] + INSERT
            same = F.element_at(truth, j) == token
            sub = corner["c"] + SUBSTITUTE
            best = (
                F.when(same & (corner["c"] <= by_d) & (corner["c"] <= by_i), cell(corner["c"], F.concat(corner["p"], F.lit("c"))))
                .when(~same & (sub < by_d) & (sub <= by_i), cell(sub, F.concat(corner["p"], F.lit("s"))))
                .when(by_d <= by_i, cell(by_d, F.concat(left["p"], F.lit("d"))))
                .otherwise(cell(by_i, F.concat(up["p"], F.lit("i"))))
            )
            return F.concat(here, F.array(best))

        return F.aggregate(columns, F.array(first), step)

    return F.element_at(F.aggregate(test, start, row), -1)["p"]
