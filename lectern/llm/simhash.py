"""Near-duplicate documents by SimHash with a Gray-order hierarchical index.

Fingerprints that differ in at most two bits agree on six of their eight bytes at
least, so each distinct fingerprint is entered under the 28 masks that leave two
bytes free. What shares a mask and the pattern under it is one upper node of the
index, and the rows of a node are sorted by Gray rank. Below that, runs of
neighbours in Gray order become nodes that hold the bits all their members share;
a search adds up the differences from level to level and prunes a node, with
everything below it, once they pass the limit. A node of the first level has 2**16
members at most, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import boxed, connected_components, few, materialise, remove, roots, turn_to

SEED = 42
WORDS = 3
MAX_BITS = 2
FAN = 8
#: Searches of one node that go down the index together.
QUERIES = 256


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the word shingles; 0 for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    n = len(w) - words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        j = min(n, i + 65536)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i:j].tolist(), ends[i + words - 1 : j + words - 1].tolist(), strict=True)], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    turn_to("fingerprints")
    return pa.array(np.array([fingerprint(t) for t in few(texts)], dtype=np.uint64).view(np.int64))


def gray_rank(code: Column) -> Column:
    """Place of a 16-bit code in Gray order."""
    for k in (1, 2, 4, 8):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def entries(fps: DataFrame) -> DataFrame:
    """(mask, shared, rank, rep): one row for each of the 28 upper nodes a fingerprint belongs to."""
    rows = []
    for m, (i, j) in enumerate(combinations(range(8), 2)):
        keep = (~(0xFF << 8 * i | 0xFF << 8 * j) + 2**63) % 2**64 - 2**63  # as a signed long
        high = F.shiftrightunsigned("fp", 8 * j).bitwiseAND(F.lit(0xFF))
        low = F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(0xFF))
        rows.append(F.struct(F.lit(m).cast("byte").alias("mask"), F.col("fp").bitwiseAND(F.lit(keep)).alias("shared"), gray_rank(high * 256 + low).cast("int").alias("rank")))
    return fps.select(F.explode(F.array(*rows)).alias("e"), "rep").select("e.*", "rep")


def index_levels(codes: np.ndarray, fan: int = FAN) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared pattern, mask) arrays from the leaves up, over codes in Gray order."""
    patterns, masks = codes.astype(np.uint16), np.full(len(codes), 0xFFFF, np.uint16)
    out = [(patterns, masks)]
    while len(patterns) > fan:
        at = np.arange(0, len(patterns), fan)
        ones, zeros = np.bitwise_and.reduceat(patterns, at), np.bitwise_or.reduceat(patterns, at)
        masks = np.bitwise_and.reduceat(masks, at) & ~(ones ^ zeros)
        patterns = ones & masks
        out.append((patterns, masks))
    return out


def search(codes: np.ndarray, limit: int, fan: int = FAN, looked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of codes (in Gray order) that differ in at most ``limit`` bits; ``looked`` takes how many nodes were compared."""
    levels = index_levels(codes, fan)
    top = len(levels[-1][0])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(codes), QUERIES):  # bounds the frontier
        q = np.arange(start, min(len(codes), start + QUERIES), dtype=np.int32)
        query, node = np.repeat(q, top), np.tile(np.arange(top, dtype=np.int32), len(q))
        seen = np.zeros(len(query), np.uint16)
        apart = np.zeros(len(query), np.uint8)
        for k in range(len(levels) - 1, -1, -1):
            patterns, masks = levels[k]
            if looked is not None:
                looked.append(len(query))
            apart = apart + np.bitwise_count((codes[query] ^ patterns[node]) & masks[node] & ~seen)
            on = apart <= limit
            query, node, apart, seen = query[on], node[on], apart[on], masks[node[on]]
            if k:
                below = len(levels[k - 1][0])
                node = (node[:, None] * fan + np.arange(fan, dtype=np.int32)).ravel()
                query, apart, seen = np.repeat(query, fan), np.repeat(apart, fan), np.repeat(seen, fan)
                on = (node < below) & ((node + 1) * fan ** (k - 1) > query)  # a node that ends before the query holds no later code
                query, node, apart, seen = query[on], node[on], apart[on], seen[on]
        on = query < node
        found.append((query[on], node[on]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _links(limit: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for p in parts:
            held = p if held is None else pd.concat([held, p], ignore_index=True)
            mask, shared = held["mask"].to_numpy(), held["shared"].to_numpy()
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (shared[1:] != shared[:-1])) + 1
            if len(cut):
                last = int(cut[-1])
                yield links_of(held.iloc[:last], np.concatenate(([0], cut)), limit)
                held = held.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield links_of(held, np.array([0, len(held)]), limit)

    return run


def links_of(rows: pd.DataFrame, bounds: np.ndarray, limit: int) -> pd.DataFrame:
    """A spanning forest of the links in each upper node; ``bounds`` are where nodes begin, and the end."""
    rank, rep = rows["rank"].to_numpy(np.int64), rows["rep"].to_numpy()
    codes = (rank ^ (rank >> 1)).astype(np.uint16)
    size = np.diff(bounds)
    two = bounds[:-1][size == 2]
    two = two[np.bitwise_count(codes[two] ^ codes[two + 1]) <= limit]
    a, b = [rep[two]], [rep[two + 1]]
    for start, n in zip(bounds[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        root = roots(n, *search(codes[start : start + n], limit))
        own, far = rep[start : start + n], np.flatnonzero(root != np.arange(n))
        a.append(own[far])
        b.append(own[root[far]])
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fingerprint, component_id), one row per input row.

    Fingerprints that differ in ``max_bits`` (0 to 2) bits or fewer are linked;
    component_id is the smallest id that links reach. A null text counts as empty;
    texts without words share fingerprint zero and are linked like others. Rows of
    equal fingerprints, exact copies included, enter the index once. A row whose id
    is null keeps its fingerprint but joins no component (component_id null); rows
    that share an id are returned once each. Other columns are ignored. An empty
    table gives an empty result.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the index is exact for up to 2 differing bits")
    own = materialise(docs.select(F.col(id_col).cast("long").alias("id"), fingerprints(F.col(text_col)).alias("fp")), "simhash")
    fps = materialise(own.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-fps")
    rows = entries(fps).repartition(F.col("mask"), F.col("shared")).sortWithinPartitions("mask", "shared", "rank")
    links = rows.mapInPandas(_links(max_bits), "a long, b long")
    roots = connected_components(links, "a", "b")
    labelled = fps.join(roots, fps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    labelled = materialise(labelled, "simhash-labels")
    remove(docs.sparkSession, fps.scratch_path)
    return own.join(labelled, "fp", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay."""
    found = simhash_components(docs, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return boxed(docs).join(gone.withColumnRenamed(id_col, "gone"), F.col("row")[id_col].cast("long") == F.col("gone"), "left_anti").select("row.*")
