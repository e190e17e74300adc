"""Mix sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

Slots are numbered from zero. Slot n has the point frac(n * golden ratio), in fixed
point; the cumulative target shares map it to a source, and its rank among the slots
of that source says which block it plays. A source's documents, shuffled by a keyed
hash, form one stream of words, which begins again when it ends, three times at most; that
is cut into blocks of equal size, so that no block is short but the very last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, boxed, materialise

#: Words of a block.
BLOCK = 32
#: A source, and each of its documents, is played this often at most.
REPEATS = 3
#: Weights by the sources' order, repeating.
WEIGHTS = (1, 2, 3)
SEED = 42
#: 2**40 / golden ratio, made odd; points are multiples of 2**-40.
STEP, ONE = 679_545_190_911 | 1, 1 << 40
CELLS = 4096
CHUNK = 65_536
DOCS_A_BUCKET = 512


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+")
    words = F.size(parts) - F.when(parts[0] == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.cast("long").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """(k, source, source_size, target, lo, hi) from (source, source_size): a row a source.

    By increasing cap a weight, a source is capped as long as an equal share a weight
    of what is left lies above its cap; the first source not capped fixes that share.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    fill = Window.orderBy("ratio", "k")
    every = Window.partitionBy()
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    s = sizes.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("k"))
    s = s.withColumn("weight", weights[F.col("k") % len(WEIGHTS)]).withColumn("cap", REPEATS * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    spent = lambda c: F.coalesce(F.sum(c).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("source_size").over(every) - spent("cap")
    s = s.withColumn("share", left.cast("double") / (F.sum("weight").over(every) - spent("weight")))
    free = F.max(F.when(F.col("share") <= F.col("ratio"), F.col("share"))).over(every)
    s = s.withColumn("target", F.when(F.col("share") > F.col("ratio"), F.col("cap").cast("double")).otherwise(free * F.col("weight")))
    by_k = Window.orderBy("k")
    to = F.sum("target").over(by_k.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.nullif(F.sum("source_size").over(every).cast("double"), F.lit(0.0))
    last = F.max(F.when(F.col("target") > 0, F.col("k"))).over(every)
    s = s.withColumn("to", to)
    s = s.withColumn("lo", F.coalesce(F.lag("to").over(by_k), F.lit(0.0)) / whole).withColumn("hi", F.when(F.col("k") == last, 2.0).otherwise(F.col("to") / whole))
    return s.select("k", "source", "source_size", "target", "lo", "hi")


def point(n: Column) -> Column:
    """frac(n / golden ratio) in 40-bit fixed point, without overflow for n below 2**40."""
    high, low = F.shiftright(n, 20), n.bitwiseAND(F.lit((1 << 20) - 1))
    return F.pmod(F.pmod(high * STEP, F.lit(ONE)) * (1 << 20) + low * STEP, F.lit(ONE)) / float(ONE)


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """(n, k, rank): the source of each slot, and the slot's rank among that source's slots."""
    spark = plan.sparkSession
    cells = plan.where("target > 0 and hi > lo").select(
        "k", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.floor(F.least(F.col("hi") * CELLS, F.lit(CELLS - 1.0))).cast("int"))).alias("cell")
    )
    x = spark.range(slots).select(F.col("id").alias("n"), point(F.col("id")).alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    dealt = x.join(cells, "cell").where("x >= lo and x < hi").select("n", "k", F.shiftright("n", CHUNK.bit_length() - 1).alias("chunk"))
    counts = dealt.groupBy("k", "chunk").agg(F.count("*").alias("in_chunk"))
    before = counts.select("k", "chunk", F.coalesce(F.sum("in_chunk").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("k", "chunk").orderBy("n")) - 1)
    return ranked.join(before, ["k", "chunk"]).select("n", "k", (F.col("before") + F.col("own")).alias("rank"))


def placed(sizes: DataFrame, plan: DataFrame, rows: int, seed: int) -> DataFrame:
    """Documents with words and their first word's place ``at`` in the shuffled stream of their source.

    Places are prefix sums in two levels, over buckets of the hash and inside each
    bucket, so that no task holds a whole source.
    """
    buckets = max(1, rows // DOCS_A_BUCKET)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    d = sizes.where("size > 0").join(plan.select("k", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).select("id", "k", "size", key.alias("key"))
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / float(1 << 32)).cast("int"))
    totals = d.groupBy("k", "bucket").agg(F.sum("size").alias("words"))
    start = totals.select("k", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("k", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("inside", inside).join(start, ["k", "bucket"]).select("id", "k", "size", (F.col("start") + F.col("inside")).alias("at"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(id_col, source_col, size, source_size, target, taken), one row per input row.

    Sizes are counts of ``[^\\x20\\x09-\\x0D]+`` (null text: 0). ``taken`` is how many
    of a document's words the mix plays, repeats counted: each word 0 to 3 times.
    A null source is a source of its own, last in order. Rows without words, and
    all rows where no row has words, take nothing. Documents that share an id (or
    have none) are placed by their sizes, so reruns agree. Other columns are ignored.
    """
    sizes = materialise(sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = materialise(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-plan")
    whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count("*").alias("rows")).first()
    slots = -(-whole["words"] // block)
    # written, as the last rank of each source bounds the blocks that documents are cut into
    played = materialise(schedule(plan, slots), "mix-schedule")
    last = played.groupBy("k").agg(((F.max("rank") + 1) * block).alias("upto")).join(plan.select("k", "source_size"), "k")
    times = F.filter(F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), lambda j: F.col("at") + j * F.col("source_size")), lambda x: x < F.col("upto"))
    parts = placed(sizes, plan, whole["rows"], seed).join(last, "k").withColumn("begin", F.explode_outer(times))
    upto = F.least(F.col("begin") + F.col("size"), F.col("upto"))
    parts = parts.withColumn("block", F.explode_outer(F.sequence(F.floor(F.col("begin") / block), F.floor((upto - 1) / block))))
    parts = parts.join(played.select("k", F.col("rank").alias("block"), F.lit(1).alias("plays")), ["k", "block"], "left")
    overlap = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("begin"), F.col("block") * block)
    taken = parts.groupBy("id", "k", "size", "at").agg(F.coalesce(F.sum(overlap * F.col("plays")), F.lit(0)).alias("taken"))
    bare = placed(sizes, plan, whole["rows"], seed).join(last.select("k"), "k", "left_anti").select("id", "k", "size", F.lit(0).cast("long").alias("taken"))  # of sources without a slot
    none = sizes.where("size = 0").join(plan.select("k", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).select("id", "k", "size", F.lit(0).cast("long").alias("taken"))
    return taken.select("id", "k", "size", "taken").unionByName(bare).unionByName(none).join(plan, "k").select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def resample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as the mix plays it, to the nearest whole number."""
    plays = mix(docs, id_col, text_col, source_col).groupBy(F.col(id_col).alias("id")).agg(F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int").alias("plays"))
    d = boxed(docs).join(plays.where("plays > 0"), F.col("row")[id_col].eqNullSafe(F.col("id")))
    return d.select("row", F.explode(F.sequence(F.lit(1), F.col("plays")))).select("row.*")


SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
named AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)),
caps AS (
  SELECT *, k % 3 + 1 AS weight, {REPEATS} * source_size AS cap, CAST({REPEATS} * source_size AS DOUBLE) / (k % 3 + 1) AS ratio FROM named),
shares AS (
  SELECT *, CAST((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
    / sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM caps),
fixed AS (
  SELECT *, CASE WHEN share > ratio THEN CAST(cap AS DOUBLE) ELSE (max(CASE WHEN share <= ratio THEN share END) OVER ()) * weight END AS target FROM shares),
ends AS (
  SELECT *, sum(target) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    nullif(CAST(sum(source_size) OVER () AS DOUBLE), 0.0) AS whole, max(CASE WHEN target > 0 THEN k END) OVER () AS last_k FROM fixed),
plan AS (
  SELECT *, coalesce(lag(upto) OVER (ORDER BY k), 0.0) / whole AS lo, CASE WHEN k = last_k THEN 2.0 ELSE upto / whole END AS hi FROM ends),
points AS (
  SELECT n, ((((n >> 20) * {STEP}) % {ONE}) * {1 << 20} + (n & {(1 << 20) - 1}) * {STEP}) % {ONE} / {float(ONE)} AS x
  FROM (SELECT unnest(range(CAST(ceil(sum(size) / {BLOCK}) AS BIGINT))) AS n FROM sizes)),
ranked AS (
  SELECT p.k, 1 AS played, row_number() OVER (PARTITION BY p.k ORDER BY n) - 1 AS block FROM points JOIN plan p ON x >= lo AND x < hi),
placed AS (
  SELECT doc_id, k, size, source_size, coalesce(sum(size) OVER (PARTITION BY k ORDER BY md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM sizes JOIN plan ON sizes.source IS NOT DISTINCT FROM plan.source WHERE size > 0),
times AS (SELECT *, pos + unnest(range({REPEATS})) * source_size AS start FROM placed),
parts AS (
  SELECT *, unnest(range(CAST(start // {BLOCK} AS BIGINT), CAST((start + size - 1) // {BLOCK} AS BIGINT) + 1)) AS block FROM times),
taken AS (
  SELECT doc_id, k, size, pos, sum(CASE WHEN played IS NULL THEN 0 ELSE least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK}) END) AS taken
  FROM parts LEFT JOIN ranked USING (k, block) GROUP BY ALL)
SELECT doc_id, source, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM taken JOIN plan USING (k)
UNION ALL
SELECT s.doc_id, s.source, s.size, p.source_size, p.target, 0 FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source WHERE s.size = 0
"""
