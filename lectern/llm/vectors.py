"""Links between embeddings of a label at or above a cosine, by a subspace pigeonhole join.

Unit vectors with a cosine of at least c lie within a squared distance of 2 - 2c. They
are turned by a fixed random rotation, so that distance spreads evenly, and split into
blocks of about sixteen dimensions, each with the share of that budget that its
dimensions have of all. (Vectors without any structure hardly ever come that near in so
many dimensions, and in fewer blocks a vector is entered fewer times.) A pair within the whole budget is within its share in some
block. For each block, vectors are cut into slabs along the block's first axis, a
slab as wide as the block's radius, and a slab is joined with itself and the next one.
A pair that several blocks propose is verified only in the block where it uses least
of its share, so that each link is found once.

Slabs with many vectors are cut into tiles by hash, and each pair of tiles is a task;
a task returns counts of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import connected_components, materialise, remove, roots

COSINE = 0.93
BLOCK = 16
#: Components of the vectors of a tile, and vectors of one at least.
TILE, LEAST = 1 << 19, 256
#: Vectors of a tile that are joined with another tile at a time.
SLICE = 128
SEED = 42


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, size]).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def blocks(size: int) -> list[tuple[int, int]]:
    ends = np.linspace(0, size, max(1, round(size / BLOCK)) + 1).round().astype(int).tolist()
    return list(zip(ends[:-1], ends[1:], strict=True))


def units(vectors: list) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotated(x: np.ndarray) -> np.ndarray:
    """Each row by the same operations, whatever rows are beside it."""
    turn = np.ascontiguousarray(rotation(x.shape[1]).T)
    step = max(1, 4_000_000 // x.shape[1] ** 2)
    return np.vstack([(x[i : i + step, None, :] * turn).sum(2) for i in range(0, len(x), step)])


def slabs_of(vectors: list, cosine: float) -> np.ndarray:
    """For each vector the slab it lies in, in each block."""
    x = rotated(units(vectors))
    size = x.shape[1]
    out = [np.floor(x[:, a] / (np.sqrt((2 - 2 * cosine) * (b - a) / size) * (1 + 1e-9) + 1e-12)) for a, b in blocks(size)]
    return np.stack(out, 1).astype(np.int64)


def join_tile(x: np.ndarray, turned: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (one of ``left``, one of ``right``) that are linked and belong to ``block``."""
    parts = blocks(x.shape[1])
    share = np.array([(2 - 2 * cosine) * (b - a) / x.shape[1] for a, b in parts]) + 1e-12
    a, b = parts[block]
    p, q = turned[left, a:b], turned[right, a:b]
    near = (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * p @ q.T <= share[block] * (1 + 1e-9) + 1e-12
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    found = []
    starts = [s for s, _ in parts]
    for k in range(0, len(i), 16_384):
        u, v = i[k : k + 16_384], j[k : k + 16_384]
        used = np.add.reduceat((turned[u] - turned[v]) ** 2, starts, axis=1) / share
        on = (used.argmin(1) == block) & (u != v)
        u, v = u[on], v[on]
        on = (x[u] * x[v]).sum(1) >= cosine
        found.append((u[on], v[on]))
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _task(cosine: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, block, _, across, i, j = key
        x, side, own = units(rows["vec"].tolist()), rows["side"].to_numpy(), rows["tile"].to_numpy()
        turned = rotated(x)
        left, right = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if across else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        n, every = np.zeros(len(rep), np.int64), np.arange(len(rep))
        root = every
        for a in range(0, len(left), SLICE):
            u, v = join_tile(x, turned, left[a : a + SLICE], right, block, cosine)
            if not across and i == j:
                u, v = u[u < v], v[u < v]
            np.add.at(n, u, copies[v])
            np.add.at(n, v, copies[u])
            root = roots(len(rep), np.concatenate((u, every)), np.concatenate((v, root)))
        on = np.flatnonzero(n)
        return pd.DataFrame({"rep": rep[on], "n": n[on], "root": rep[root[on]]})

    return run


def linked_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per input row.

    Vectors are compared when their labels are equal and not null and their lengths
    agree. A vector that is null, empty or zero, or holds a null or non-finite
    component, links with nothing; so does a row without label or id (a null id has
    a null component and is not kept). Copies, and rows that share an id, count each
    other as links. Other columns are ignored.
    """
    d = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    whole = F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0), F.lit(False))
    fit = d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole).withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0)))
    classes = fit.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))

    @F.pandas_udf("array<long>")
    def slabs(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        for _, at in pd.Series(range(len(vectors))).groupby(vectors.map(len).to_numpy()):
            for k, s in zip(at, slabs_of([vectors.iloc[k] for k in at], cosine), strict=True):
                out[k] = s.tolist()
        return pd.Series(out, dtype=object)

    classes = materialise(classes.select("label", F.size("vec").alias("dim"), "vec", "rep", "copies", slabs("vec").alias("slabs")), "vec-classes")
    cell = ["label", "dim", "block", "slab"]
    places = classes.select("label", "dim", F.posexplode("slabs").alias("block", "slab"))
    cells = places.groupBy(*cell).count().withColumn("tiles", F.ceil(F.col("count") / F.greatest(F.floor(TILE / F.col("dim")), F.lit(LEAST))).cast("int"))
    along = Window.partitionBy("label", "dim", "block").orderBy("slab")
    beside = lambda f, step: F.when(f("slab").over(along) == F.col("slab") + step, f("tiles").over(along)).otherwise(0)
    cells = materialise(cells.select(*cell, "tiles", beside(F.lead, 1).alias("next"), beside(F.lag, -1).alias("last")), "vec-cells")
    put = classes.select("label", "dim", "vec", "rep", "copies", F.posexplode("slabs").alias("block", "slab")).join(cells, cell).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    row = lambda slab, side, i, j: F.struct(slab.alias("at"), F.lit(side > 0).alias("across"), F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    tile = F.col("tile")
    tasks = F.concat(
        F.transform(upto("tiles"), lambda k: row(F.col("slab"), 0, F.least(tile, k), F.greatest(tile, k))),
        F.transform(upto("next"), lambda k: row(F.col("slab"), 1, tile, k)),
        F.transform(upto("last"), lambda k: row(F.col("slab") - 1, 2, k, tile)),
    )
    put = put.withColumn("task", F.explode(tasks)).select("label", "dim", "block", F.col("task.at").alias("slab"), "task.across", "task.i", "task.j", "task.side", "tile", "rep", "copies", "vec")
    found = put.groupBy("label", "dim", "block", "slab", "across", "i", "j").applyInPandas(_task(cosine), "rep long, n long, root long")
    found = materialise(found, "vec-links")
    counts = found.groupBy(F.col("rep").alias("r")).agg(F.sum("n").alias("n"))
    tree = connected_components(found.select("rep", "root").distinct(), "rep", "root")
    known = classes.join(counts, F.col("rep") == F.col("r"), "left").join(tree, F.col("rep") == F.col("node"), "left")
    known = materialise(known.select(F.col("label").alias("l"), F.col("vec").alias("v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component")), "vec-known")
    remove(rows.sparkSession, found.scratch_path)
    remove(rows.sparkSession, cells.scratch_path)
    linked = fit.join(known, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v"))).select("id", "n_links", "component")
    alone = d.where(F.col("id").isNull() | F.col("label").isNull() | ~whole).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


SQL = f"""
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (
  WITH RECURSIVE r AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
  SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN reach ON a = e.vec_id
"""
