"""CSV sources."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_text = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
ITEMS = _text("learner_id", "audio_file", "audio_type", "canonical_text", "textgrid")
LEARNERS = T.StructType([*_text("learner_id", "gender", "region", "child_grade").fields, T.StructField("child_age", T.IntegerType())])
ENCODINGS = ("utf-8", "cp1252", "latin-1")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header; columns are picked by name and a schema gives their types, missing ones are null.

    Adds ``ord``, which follows the file.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if schema is not None:
        raw = raw.select([F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields] + [F.col(f"`{c}`") for c in raw.columns if c not in schema.fieldNames()])
    return raw.withColumn("ord", F.monotonically_increasing_id())


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ITEMS)


def read_learners(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LEARNERS).drop("ord")


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """(raw_num, passage_text) of a small CSV without header, in the first encoding that fits its bytes.

    A byte order mark, blank lines, lines of one field and further fields are dropped.
    """
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])  # a small dimension by contract
    for encoding in ENCODINGS:
        try:
            text = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        break
    rows = [r[:2] for r in csv.reader(io.StringIO(text.removeprefix("\ufeff"))) if len(r) > 1]
    return spark.createDataFrame(rows, _text("raw_num", "passage_text"))
