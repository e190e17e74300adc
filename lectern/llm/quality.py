"""Document quality from a linear-chain CRF over lines.

Each line is labelled good or bad. Its features describe the line and the lines before
and after it; transitions tie neighbours together. Forward-backward gives the marginal
probability that a line is good, and the score of a document is the mean of its lines'
marginals, weighted by their length.

Labels are known for documents only. The model is fitted on a bounded sample of them
by gradient descent on the negative log-likelihood of the chain whose lines all carry
their document's label, each document counting once whatever its length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import boxed, few, turn_to

#: Bounds of the sample the model is fitted on: documents, and lines of each (spread over the whole document).
SAMPLE_DOCS, SAMPLE_LINES = 2000, 48
THRESHOLD = 0.3
FOLDS = 5

_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[^\w\s.,;:'\"()!?-]")
OWN = ("bias", "letters", "upper", "digits", "marks", "shouts", "stops", "repeated words", "word length", "long words", "mixed words", "length", "short", "no end", "seen before", "same as last", "distinct characters")


class Model(NamedTuple):
    weights: np.ndarray  # a weight of label "good" for each feature
    chain: np.ndarray  # 2 x 2: score of a label after another; 1 is good
    mean: np.ndarray
    scale: np.ndarray


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(a row of own features for each line with a word, the lines' lengths)."""
    rows, sizes, seen, last = [], [], set(), None
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        letters = len(_LETTER.findall(line))
        rows.append(
            (
                1.0,
                letters / n,
                sum(map(str.isupper, line)) / max(letters, 1),
                len(_DIGIT.findall(line)) / n,
                min(1.0, 5 * len(_MARK.findall(line)) / n),
                min(1.0, 20 * (line.count("!") + line.count("?")) / n),
                min(1.0, 10 * (line.count(".") + line.count(",") + line.count(";") + line.count(":")) / n),
                1 - len(set(words)) / k,
                min(2.0, (n - k + 1) / k / 8),
                sum(len(w) > 20 for w in words) / k,
                sum(not w[0].isalnum() or not (w[-1].isalnum() or w[-1] in ".,;:") for w in words) / k,
                min(1.0, np.log1p(n) / 8),
                float(k < 3),
                float(line.rstrip()[-1] not in ".!?:\"'"),
                float(line in seen),
                float(line == last),
                min(1.0, len(set(line)) / 40),
            )
        )
        sizes.append(n)
        seen.add(line)
        last = line
    return np.array(rows, np.float64).reshape(-1, len(OWN)), np.array(sizes, np.float64)


def chain_features(own: np.ndarray) -> np.ndarray:
    """Own features with those of the line before and after (zero beyond the ends)."""
    zero = np.zeros((1, own.shape[1]))
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero])])


def marginals(score: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Probability of label 1 at each place; label 0 scores zero everywhere."""
    n = len(score)
    c00, c01, c10, c11 = (float(x) for x in chain.ravel())
    before, after = [0.0] * n, [0.0] * n  # log-odds that the lines on one side add to label 1
    s, x = score.tolist(), 0.0
    for i in range(1, n):
        o = s[i - 1] + x
        x = _log_odds(o, c00, c01, c10, c11)
        before[i] = x
    x = 0.0
    for i in range(n - 2, -1, -1):
        o = s[i + 1] + x
        x = _log_odds(o, c00, c10, c01, c11)
        after[i] = x
    return 1 / (1 + np.exp(-np.clip(score + before + after, -500, 500)))


def _log_odds(o: float, c00: float, c01: float, c10: float, c11: float) -> float:
    """log(exp(c01) + exp(o + c11)) - log(exp(c00) + exp(o + c10))"""
    return _log_sum(c01, o + c11) - _log_sum(c00, o + c10)


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def score(text: str | None, model: Model) -> float:
    """0 to 1, higher for better text; a text without words scores 0."""
    own, sizes = line_features(text)
    if not len(own):
        return 0.0
    x = (chain_features(own) - model.mean) / model.scale
    return float(np.average(marginals(x @ model.weights, model.chain), weights=sizes))


def fit(chains: list[np.ndarray], labels: list[int], steps: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Adam on the mean negative log-likelihood of whole chains, all at once.

    Chains are padded to one length; a step runs forward and backward over the places
    for all chains together. Documents of both labels count alike in sum.
    """
    if not chains:
        k = 3 * len(OWN)
        return Model(np.zeros(k), np.zeros((2, 2)), np.zeros(k), np.ones(k))
    every = np.vstack(chains)
    mean, scale = every.mean(0), every.std(0)
    for c in range(0, every.shape[1], len(OWN)):
        mean[c], scale[c] = 0.0, 1.0  # the bias columns
    scale[scale < 1e-9] = 1.0
    n, longest = len(chains), max(map(len, chains))
    x = np.zeros((n, longest, every.shape[1]))
    on = np.zeros((n, longest))
    for i, c in enumerate(chains):
        x[i, : len(c)], on[i, : len(c)] = (c - mean) / scale, 1
    y = np.array(labels, float)
    share = np.where(y == 1, 1 / max(y.sum(), 1), 1 / max((1 - y).sum(), 1)) / 2 / on.sum(1)
    w, t = np.zeros(x.shape[2]), np.zeros((2, 2))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, t)]
    for step in range(1, steps + 1):
        s = x @ w
        fore = np.zeros((n, longest, 2))
        back = np.zeros((n, longest, 2))
        fore[:, 0, 1] = s[:, 0]
        for i in range(1, longest):
            f = np.logaddexp(fore[:, i - 1, :1] + t[0], fore[:, i - 1, 1:] + t[1])
            f[:, 1] += s[:, i]
            fore[:, i] = np.where(on[:, i, None] > 0, f, fore[:, i - 1])
        for i in range(longest - 2, -1, -1):
            e = back[:, i + 1] + np.stack([np.zeros(n), s[:, i + 1]], 1)
            b = np.logaddexp(t[:, 0][None] + e[:, :1], t[:, 1][None] + e[:, 1:])
            back[:, i] = np.where(on[:, i + 1, None] > 0, b, 0)
        whole = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        p = np.exp(fore + back - whole[:, None, None])[:, :, 1] * on
        gw = np.einsum("nl,nlk->k", (p - y[:, None] * on) * share[:, None], x)
        gt = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                edge = fore[:, :-1, a] + t[a, b] + b * s[:, 1:] + back[:, 1:, b] - whole[:, None]
                want = (y == a) & (y == b)
                gt[a, b] = ((np.exp(np.minimum(edge, 0)) - want[:, None]) * on[:, 1:] * share[:, None]).sum()
        for v, g, (m, u) in zip((w, t), (gw + ridge * w, gt + ridge * t), state, strict=True):
            m += 0.1 * (g - m)
            u += 0.001 * (g * g - u)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-8)
    return Model(w, t, mean, scale)


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % FOLDS == 0


def neighbours(n: int, key: int) -> slice:
    """SAMPLE_LINES lines of ``n`` in a row, all if there are fewer, from a place that ``key`` decides."""
    at = zlib.crc32(str(key).encode()) % max(1, n - SAMPLE_LINES + 1)
    return slice(at, at + SAMPLE_LINES)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample`` labelled documents whose crc32(id) mod 5 is not 0.

    The sample is the one with the smallest hashes of the id, half of it for each
    label where there are enough. Null labels are left out; a document with several
    labels has the most frequent, 1 on a tie. Of rows that share an id, that whose text
    has the smallest hash is learnt from, so that no more than ``sample`` rows reach the
    driver. Null texts have no lines to learn from.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for y in (0, 1)]
    chosen = pick[0].unionByName(pick[1])
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = d.join(F.broadcast(chosen), "id")  # ``sample`` rows at most on that side
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for i, text, y in zip(p["id"], p["text"], p["y"], strict=True):
                x = chain_features(line_features(text)[0])
                if len(x):
                    out.append((int(i), int(y), x[neighbours(len(x), int(i))].ravel().tolist()))
            yield pd.DataFrame(out, columns=["id", "y", "x"])

    got = sorted(rows.mapInPandas(features, "id long, y int, x array<double>").collect(), key=lambda r: r.id)
    return fit([np.array(r.x).reshape(-1, 3 * len(OWN)) for r in got], [r.y for r in got])


def scorer(model: Model):
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        turn_to("quality")
        return pa.array([score(t, model) for t in few(texts)], pa.float64())

    return scored


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``score_col``, which must be new; see :func:`score`.

    Only the text enters a score. Null and empty texts, and texts of white space,
    score 0. Without any label to learn from, every text with a word scores 0.5.
    Repeated rows score alike.
    """
    if score_col in docs.columns:
        raise ValueError(f"there is a column {score_col} already")
    return docs.withColumn(score_col, scorer(train(docs, labels, id_col, text_col, label_col))(F.col(text_col)))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    d = quality(docs.select("doc_id", "text"), labels)
    return d.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns whatever they are called."""
    scored = scorer(train(docs, labels))
    return boxed(docs).withColumn("score", scored(F.col("row")["text"])).where(F.col("score") >= THRESHOLD).select("row.*")
