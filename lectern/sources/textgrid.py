"""Praat TextGrid files: intervals of all tiers, and the labels of one tier."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import strip, without_fillers

TIER = "child"
#: A field of an interval: a number, or a quoted text that may span lines and doubles its quotes.
_FIELD = re.compile(r"""^[ \t]*(?:(intervals[ \t]\[.*\]:)|(item[ \t]\[\d+\]:)|(?:(xmin|xmax)[ \t]=[ \t]*(\S+))|(?:(name|text)[ \t]=[ \t]*(?:"((?:[^"]|"")*)"|'([^']*)'|([^\n]*))))""", re.M)


def intervals(content: str) -> Iterator[tuple[int, str, float, float, str]]:
    """(idx, tier, xmin, xmax, text) of each interval block that has all three fields, in order.

    No label is left out. Lines of a text are stripped.
    """
    tier, block, n = "", None, 0

    def done() -> tuple | None:
        return (tier, block["xmin"], block["xmax"], block["text"]) if block and len(block) == 3 else None

    for m in _FIELD.finditer(content.replace("\r\n", "\n").replace("\r", "\n")):
        begins, item, field, number, named, *texts = m.groups()
        if begins or item:
            if got := done():
                yield (n, *got)
                n += 1
            block = {} if begins else None
            tier = "" if item else tier
        elif field:
            if block is not None:
                block[field] = float(number)
        else:
            text = "\n".join(x.strip() for x in next((t for t in texts if t is not None), "").split("\n"))
            if named == "name":
                if block is None:
                    tier = text
            elif block is not None:
                block["text"] = text.replace('""', '"')
    if got := done():
        yield (n, *got)


def _decoded(data: bytes) -> str:
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    return data.decode("utf-8-sig", "replace")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, tier, xmin, xmax, text) of the intervals of all TextGrid files below a path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, data in zip(p["path"], p["content"], strict=True):
                yield pd.DataFrame([(name, *row) for row in intervals(_decoded(data))], columns=["path", "idx", "tier", "xmin", "xmax", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT]ext[gG]rid").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, idx long, tier string, xmin double, xmax double, text string")


def explode_intervals(grids: DataFrame, content_col: str = "content") -> DataFrame:
    """``grids`` with (idx, tier, xmin, xmax, text) for each interval of a column of TextGrid texts."""
    kind = "array<struct<idx:long,tier:string,xmin:double,xmax:double,text:string>>"

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("idx", "tier", "xmin", "xmax", "text"), r, strict=True)) for r in intervals(t or "")] for t in texts], dtype=object)

    return grids.withColumn("_i", F.explode(F.pandas_udf(run, kind)(F.col(content_col)))).select(*[c for c in grids.columns if c != content_col], "_i.*")


def tier_text(rows: DataFrame, by: str = "path", tier: str = TIER) -> DataFrame:
    """(by, ref_text): a tier's labels in order, joined by spaces, without fillers and the enumerator's."""
    labels = rows.where(F.lower("tier") == tier.lower()).withColumn("_label", without_fillers(strip(F.col("text")))).where("_label is not null")
    ordered = F.sort_array(F.collect_list(F.struct("xmin", "idx", "_label")))
    return labels.groupBy(by).agg(F.array_join(F.transform(ordered, lambda r: r["_label"]), " ").alias("ref_text"))
