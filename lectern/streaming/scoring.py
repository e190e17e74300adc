"""Score manifests as they arrive: an extension, as row scoring needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions import paths, rates
from lectern.operators.score import score_rows
from lectern.plans.flows import eval_rows

SCHEMA = "audio_filepath string, ref_text string, can_text string, pred_text string"


def scored_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows of the JSON lines files that appear in a folder."""
    raw = spark.readStream.schema(SCHEMA).json(folder).where("audio_filepath is not null").withColumnRenamed("pred_text", "hyp_text").withColumn("ord", F.lit(0).cast("long"))
    return score_rows(eval_rows(paths.with_audio_keys(raw, "audio_filepath")))


def running_rates(scored: DataFrame) -> DataFrame:
    """Micro error rates by category over all that has arrived; for output mode complete."""
    return scored.groupBy("audio_type").agg(F.count("*").alias("n"), *[rates.error_rate(*[rates.total(f"{k}_{p}") for k in "SDIN"]).alias(f"rate_{p}") for p in ("ref_hyp", "mer")])


def write_scored(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows as Parquet, by category; exactly once through the checkpoint."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("audio_type").trigger(availableNow=True).start()
