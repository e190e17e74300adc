"""What the corpus operators share: reading tables, a shared scratch area, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = "[\\x20\\x09-\\x0D]"
#: Bits of a map of wanted values, at most: 8 MB.
MAP_BITS = 1 << 26

#: Setting by which Spark deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """Folder of this application under the shared checkpoint folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a folder below
    the warehouse is used; that is shared only if the warehouse is, so that on a cluster
    a warehouse on a local disk is refused. The folder goes when the application ends.
    """
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.master.startswith("local"):
        warehouse = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
        if warehouse.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file":
            raise ValueError(f"spark.checkpoint.dir must name a shared folder; the warehouse {warehouse.toString()} may be on one machine")
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/lectern-{spark.sparkContext.applicationId}"
    if path not in _made:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(p)
        files.deleteOnExit(p)
        _made.add(path)
    return path


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, wherever it is, and finished queries' shuffle files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage, as Spark keeps a finished query's shuffle files on the executors' disks until then."""
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind, whatever still refers to its plan; those of others stay."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, what: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder and read it back.

    Cuts lineage and stops repeated work; survives the loss of any executor. The
    result carries its folder as ``df.scratch_path`` for :func:`remove`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def ascii_words(text: Column) -> Column:
    """Array of the words ``[^\x20\x09-\x0D]+``; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words ``[^\x20\x09-\x0D]+``; null has none."""
    return F.size(ascii_words(text)).cast("long")


def boxed(df: DataFrame) -> DataFrame:
    """``df`` with each row in one column, ``row``, so that whatever is joined to it clashes with no name."""
    return df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row"))


def slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f (a minimum or maximum) over each window of ``width``, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = f(a[:-step], a[step:])
        have += step
    return a


def word_hashes(words: list[bytes], known: dict[bytes, int], most: int = 200_000) -> np.ndarray:
    """64-bit hashes of words; ``known`` remembers up to ``most`` of them."""
    got = list(map(known.get, words))
    if None in got:
        if len(known) > most:
            known.clear()
        for i, g in enumerate(got):
            if g is None:
                got[i] = known.setdefault(words[i], xxhash.xxh64_intdigest(words[i], 7))
    return np.array(got, np.uint64)


def _marked(column: str, bits: int):
    """A map in which the bits of a column's values are set."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("map")
        own = np.zeros(bits, bool)
        for p in parts:
            own[p[column].to_numpy() & (bits - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(own).tobytes(), 1)], pa.binary())], ["map"])

    return run


def _united(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = None
    for p in parts:
        for x in p["map"]:
            m = np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
            got = m if got is None else got | m
    if got is not None:
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(got.tobytes(), 1)], pa.binary())], ["map"])


def bit_map(df: DataFrame, column: str, values: int) -> np.ndarray:
    """Map of the values of a long column, of MAP_BITS bits at most: some others seem to be in it, none is missing.

    ``values`` is how many there are, roughly. Each task makes a map of its own; 32
    tasks unite them, and the driver what is left.
    """
    bits = 1 << min(MAP_BITS.bit_length() - 1, max(16, (16 * values).bit_length()))
    some = df.select(column).mapInArrow(_marked(column, bits), "map binary").withColumn("part", F.spark_partition_id() % 32).repartition(32, "part").select("map")
    got = np.zeros(bits // 8, np.uint8)
    for r in some.mapInArrow(_united, "map binary").toLocalIterator():
        got = got | np.frombuffer(zlib.decompress(r["map"]), np.uint8)
    return got


def in_map(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values the map has."""
    at = values.view(np.int64) & (len(known) * 8 - 1)
    return (known[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


#: What operators keep in a worker between tasks, as functions that let go of it.
kept: list[Callable[[], None]] = []
_busy = [""]


def turn_to(work: str) -> None:
    """Say in a worker what it does next; at each change it gives back the memory of what it did before.

    Workers serve one stage after another, and wait in between: without this each would
    hold the most that any stage took.
    """
    if _busy[0] != work:
        _busy[0] = work
        for let_go in kept:
            let_go()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


def few(texts: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The texts of an Arrow column, of which a few at a time are Python objects."""
    for at in range(0, len(texts), rows):
        yield from texts.slice(at, rows).to_pylist()


class Forest:
    """Union-find in which the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def link(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list:
        return [(x, self.find(x)) for x in list(self.up)]


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component, of 0 to n - 1 linked by the pairs (x, y)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y, root[x], root[y]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


#: Nodes of a forest that a task holds at a time.
HELD = 500_000


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning forests of a partition's links as (node, smaller root), a bounded one at a time; no larger than its input."""

    turn_to("forest")

    def told(f: Forest) -> Iterator[pd.DataFrame]:
        got = np.array(f.edges(), dtype=np.int64).reshape(-1, 2)
        for i in range(0, len(got), 100_000):
            yield pd.DataFrame({"node": got[i : i + 100_000, 0], "root": got[i : i + 100_000, 1]})

    f = Forest()
    for p in parts:
        for a, b in zip(p["node"].tolist(), p["root"].tolist(), strict=True):
            f.link(a, b)
        if len(f.up) > HELD:
            yield from told(f)
            f = Forest()
    yield from told(f)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    ``links`` has two long columns. Each partition first reduces its links to a
    spanning forest; alternating large-star and small-star steps (Kiveris et al.,
    2014) then run until every node hangs from its root. Each step is written to
    shared storage, so a lost executor costs one step. Minima are combined before
    the shuffle; the joins back on a hub's id are plain sort-merge joins that
    adaptive execution splits. Null ends and loops are ignored.
    """
    spark = links.sparkSession
    # Written before it is reduced, so that no task runs two Python workers at a time.
    links = materialise(links.select(a, b), "links")
    e = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("root"), F.greatest(a, b).alias("node"))
    e = _reduced(e.select("node", "root"), links)
    while True:
        twice = e.groupBy("node").agg(F.countDistinct("root").alias("n")).where("n > 1").select("node")
        chained = e.select("node").join(e.select(F.col("root").alias("node")), "node", "left_semi")
        if e.edges <= HELD or twice.unionByName(chained).isEmpty():  # a single forest is resolved
            return e.distinct()
        e = _reduced(_small_star(_large_star(e)), e)


def _reduced(e: DataFrame, source: DataFrame) -> DataFrame:
    """The links (node, root) as spanning forests; ``source``, which they are made of, is removed.

    Forests of tasks that hold the same nodes repeat each other, once for each task. So they
    are brought together, HELD links a task, as long as that takes away a quarter of them.
    """
    spark = e.sparkSession
    before = None
    while True:
        e = materialise(e.mapInPandas(_forest, "node long, root long"), "cc")
        remove(spark, source.scratch_path)
        source, n = e, e.count()
        e.edges = n if before == 1 else HELD + n  # of one task's forest, or of several
        if before == 1 or (before and n > 0.75 * last):
            return e
        last, before = n, max(1, -(-n // HELD))
        e = e.coalesce(before)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(e.select(F.col("root").alias("u"), F.col("node").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("node").agg(F.min("root").alias("m"))
    j = e.join(low, "node")
    return j.select("node", F.col("m").alias("root")).unionByName(j.where("root > m").select(F.col("root").alias("node"), F.col("m").alias("root"))).distinct()
