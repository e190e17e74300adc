"""Rates and scores from counts, as Column expressions; a rate without a denominator is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("S", "D", "I", "C", "N")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def total(c: Column | str) -> Column:
    """Sum that leaves out null and NaN; 0 where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(F.when(~F.isnan(c.cast("double")), c)), F.lit(0))


def mean(c: Column | str) -> Column:
    """Mean that leaves out null and NaN but not infinity."""
    c = F.col(c) if isinstance(c, str) else c
    return F.avg(F.when(~F.isnan(c), c))


def error_rate(s: Column, d: Column, i: Column, n: Column) -> Column:
    return F.try_divide(100.0 * (s + d + i).cast("double"), n.cast("double"))


def wer(s: Column, d: Column, i: Column, n: Column) -> Column:
    """Percent; infinite where there is no truth but something was inserted, null where there is neither."""
    return F.when((n == 0) & (i > 0), F.lit(float("inf"))).otherwise(error_rate(s, d, i, n))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return F.try_divide(2 * p * r, p + r)


def prf(tp: Column, fp: Column, fn: Column, zero: bool = True) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; without a denominator 0, or null if not ``zero``."""
    fill = (lambda c: F.coalesce(c, F.lit(0.0))) if zero else (lambda c: c)
    p, r = fill(precision(tp, fp)), fill(recall(tp, fn))
    return p, r, fill(f1(p, r))


def agreement(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    return ratio_or_zero(tp + tn, tp + tn + fp + fn)


def balanced_agreement(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    return (ratio_or_zero(tp, tp + fn) + ratio_or_zero(tn, tn + fp)) / 2


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of the rows that have both; null for fewer than two rows or no variance.

    corr() divides by zero under ANSI where one side is constant, even behind a condition.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = (F.when(both, c.cast("double")) for c in (x, y))
    return F.when(F.count(x) > 1, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def line(x: Column, y: Column) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line of y over x."""
    x, y = x.cast("double"), y.cast("double")
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def pair_metrics(s: Column, d: Column, i: Column, c: Column, n: Column) -> dict[str, Column]:
    """What one comparison's counts give: WER, ACC, COR, accuracy of COR, precision, recall, F1."""
    p, r = ratio(c, c + i), ratio(c, c + d)
    return {"WER": wer(s, d, i, n), "ACC": ratio(c, n), "COR": n - s - d, "ACC_COR": ratio(n - s - d, n), "precision": p, "recall": r, "f1": f1(p, r)}


def levenshtein_of(s: Column, d: Column, i: Column) -> Column:
    return s + d + i


def alignment_accuracy(c: Column, i: Column, n: Column) -> Column:
    """(matches - insertions) / N; 0 without truth."""
    return F.coalesce(ratio(c - i, n), F.lit(0.0))


def alignment_wer(s: Column, d: Column, i: Column, n: Column) -> Column:
    """Errors / N; 1 without truth."""
    return F.coalesce(ratio(s + d + i, n), F.lit(1.0))
