"""Segments of a recording: merge their texts to one row, or cut a recording into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.paths import group_and_order, segment, segment_path, speaker_of, stem, file_name
from lectern.functions.text import is_blank, strip


def _joined(text: str, order: Column, skip_blank: bool) -> Column:
    """The texts of a group in order, joined by spaces."""
    value = F.coalesce(strip(F.col(text)), F.lit(""))
    rows = F.sort_array(F.collect_list(F.when(~is_blank(F.col(text)) if skip_blank else F.lit(True), F.struct(order.alias("o"), value.alias("t")))))
    return strip(F.array_join(F.transform(rows, lambda r: r["t"]), " "))


def merge_segments(df: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each recording that has segments; others pass through.

    Segments are joined in the order of their numbers, rows without a number last. The
    first row is kept but for its name, which loses the segment number, and its
    ``ref_text`` and ``hyp_text``, which are joined with blank ones included. Recordings
    that fit one task are merged by one aggregation keyed by the recording's name.
    """
    seg = segment(F.coalesce("audio_file", F.lit("")))
    work = df.withColumn("_seg", seg)
    by = F.struct(F.col("_seg.number").isNull().alias("last"), F.col("_seg.number").alias("number"), F.col(order).alias("ord"))
    row = F.struct(*[F.col(c) for c in df.columns])
    texts = [c for c in ("ref_text", "hyp_text") if c in df.columns]
    g = work.groupBy(F.col("_seg.base").alias("_base")).agg(
        F.max(F.col("_seg.is_segment")).alias("_merged"), F.min_by(row, by).alias("_first"), F.collect_list(F.when(~F.col("_seg.is_segment"), row)).alias("_rest"), *[_joined(c, by, False).alias(f"_{c}") for c in texts], F.min(order).alias("_ord")
    )
    one = F.col("_first")
    for c in texts:
        one = one.withField(c, F.col(f"_{c}"))
    one = one.withField("audio_file", F.col("_base")).withField(order, F.col("_ord"))
    return g.select(F.explode(F.when(F.col("_merged"), F.array(one)).otherwise(F.col("_rest"))).alias("r")).select("r.*")


def group_texts(df: DataFrame, order: str = "ord") -> DataFrame:
    """Rows with what the older profile scores once a recording, on its first segment.

    Adds group_key, seg_order, is_first, and CAN_FG, REF_FG, HYP_FG (null but on the first
    row): the first canonical text that is not blank, or else the first row's, and the
    other texts joined without blank ones.
    """
    d = df.withColumn("_g", group_and_order(F.coalesce("audio_file", F.lit("")))).withColumns({"group_key": F.col("_g.group"), "seg_order": F.col("_g.order")}).drop("_g")
    by = F.struct(F.col("seg_order").alias("s"), F.col(order).alias("o"))
    first_can = F.min_by(F.when(~is_blank(F.col("canonical_text")), strip(F.col("canonical_text"))), F.when(~is_blank(F.col("canonical_text")), by))
    g = d.groupBy(F.col("group_key").alias("_key")).agg(
        F.min(by).alias("_first"), F.coalesce(first_can, F.min_by("canonical_text", by), F.lit("")).alias("_can"), _joined("ref_text", by, True).alias("_ref"), _joined("hyp_text", by, True).alias("_hyp")
    )
    out = d.join(g, F.col("group_key") == F.col("_key")).withColumn("is_first", by == F.col("_first"))
    for name, c in (("CAN_FG", "_can"), ("REF_FG", "_ref"), ("HYP_FG", "_hyp")):
        out = out.withColumn(name, F.when(F.col("is_first"), F.col(c)))
    return out.drop("_key", "_first", "_can", "_ref", "_hyp")


def cut(records: DataFrame, intervals: DataFrame, root: str, rate: int, keep_single_name: bool = True, at_least: int = 1) -> DataFrame:
    """A row for each usable interval of a recording, with its segment's path and sample range.

    ``records`` has ``wav`` and ``samples`` (its length, null if not known); ``intervals``
    has wav, idx, xmin, xmax, text. An interval is usable if it ends after it begins and
    holds a sample of the recording. A recording whose intervals that end after they begin
    number one keeps its name; recordings with fewer than ``at_least`` intervals are left out.
    """
    whole = Window.partitionBy("wav")
    i = intervals.withColumn("_all", F.count("*").over(whole)).where(F.col("_all") >= at_least).where("xmax > xmin").withColumn("_positive", F.count("*").over(whole))
    d = i.join(records, "wav")
    end = F.coalesce(F.col("samples"), F.lit((1 << 62)))
    d = d.withColumns({"first_sample": F.greatest(F.lit(0), F.bround(F.col("xmin") * rate).cast("long")), "last_sample": F.least(end, F.bround(F.col("xmax") * rate).cast("long"))})
    d = d.where("last_sample > first_sample").withColumn("segment", F.row_number().over(Window.partitionBy("wav").orderBy("idx")).cast("long"))
    name = segment_path(root, speaker_of(F.col("wav")), stem(file_name(F.col("wav"))), F.col("segment"))
    alone = F.concat(F.lit(root.rstrip("/") + "/"), speaker_of(F.col("wav")), F.lit("/"), file_name(F.col("wav")))
    path = F.when(F.col("_positive") == 1, alone).otherwise(name) if keep_single_name else name
    return d.withColumns({"audio_filepath": path, "duration": F.round(F.col("xmax") - F.col("xmin"), 3)}).drop("_all", "_positive")


def skip_reasons(records: DataFrame, audio: DataFrame, annotated: DataFrame, intervals: DataFrame) -> DataFrame:
    """(reason, n): how many records have no audio, no annotation, no usable interval, or are used."""
    have = lambda df, name: df.select("wav").distinct().withColumn(name, F.lit(True))
    d = records.join(have(audio, "a"), "wav", "left").join(have(annotated, "t"), "wav", "left").join(have(intervals.where("xmax > xmin"), "i"), "wav", "left")
    reason = F.when(F.col("a").isNull(), "missing_audio").when(F.col("t").isNull(), "missing_annotation").when(F.col("i").isNull(), "no_interval").otherwise("used")
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
