"""The engine's end-to-end flows, each one lazy plan from sources to a table to write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import paths
from lectern.functions.text import adjust_letters, is_blank, normalize, text_or_empty
from lectern.operators import dedup, link, score, segments, summary
from lectern.sources import audio, manifests, sinks, tables, textgrid
from lectern.sources.layout import Layout


def eval_rows(manifest: DataFrame) -> DataFrame:
    """Manifest rows as items: learner and type from the file name, null texts as ''."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = paths.audio_type(F.col("audio_stem"))
    return manifest.select(
        paths.learner_of(F.col("audio_stem")).alias("learner_id"), F.col("audio_name").alias("audio_file"), kind.alias("audio_type"),
        adjust_letters(text("can_text"), kind).alias("canonical_text"), text("ref_text").alias("ref_text"), text("hyp_text").alias("hyp_text"), "ord",
    )


def text_coverage(rows: DataFrame) -> DataFrame:
    """How many rows have each text."""
    return rows.agg(F.count("*").alias("rows"), *[F.count_if(~is_blank(F.col(c))).alias(c) for c in ("canonical_text", "ref_text", "hyp_text")])


def score_manifest(spark: SparkSession, manifest_path: str, learners_csv: str, **keys: str) -> tuple[DataFrame, DataFrame]:
    """(scored rows with metadata, category scores) of a cleaned manifest: the current profile."""
    rows = segments.merge_segments(eval_rows(manifests.read_eval_manifest(spark, manifest_path, **keys)))
    scored = link.attach_metadata(score.score_rows(rows), tables.read_learners(spark, learners_csv), ["gender", "child_grade", "child_age", "region"])
    return scored, summary.category_scores(scored)


def reference_manifest(items: DataFrame, listing: DataFrame, audio_root: str, root: str, prefix: str | None = None) -> DataFrame:
    """Manifest rows of items whose audio exists: path, duration from the header, and the three texts."""
    d = link.resolve_audio(items, listing, audio_root)
    known = audio.durations(audio.read_files(d.sparkSession, audio_root)).withColumnRenamed("path", "audio_filepath")
    text = lambda c: text_or_empty(F.coalesce(F.col(c), F.lit("")))
    d = d.join(known, "audio_filepath", "left")
    out = d.select(
        paths.under_prefix(F.col("audio_filepath"), root, prefix).alias("audio_filepath"), "duration", text("hyp_text").alias("pred_text"), text("ref_text").alias("ref_text"), text("canonical_text").alias("can_text"), "ord"
    )
    return dedup.keep_first(out, ["audio_filepath"], ["ord"])


def build_manifest(spark: SparkSession, layout: Layout, hypotheses: list[str] | None = None, passages_csv: str | None = None, match_on: str = "stem", tier: str = textgrid.TIER, prefix: str | None = None) -> DataFrame:
    """The manifest of a dataset: items, hypotheses, annotations and passages linked by recording."""
    items = paths.with_audio_keys(tables.read_items(spark, layout.items_csv))
    items = items.withColumn("canonical_text", adjust_letters(F.col("canonical_text"), F.col("audio_type")))
    items = link.attach_hypotheses(items, manifests.read_manifests(spark, hypotheses), match_on) if hypotheses else items.withColumn("hyp_text", F.lit(""))
    grids = textgrid.read_intervals(spark, layout.grids)
    path = F.regexp_replace("path", "^file:/+", "/")
    listing = audio.list_files(spark, layout.grids, "*.[tT]ext[gG]rid").select("path", paths.stem(paths.file_name(F.col("path"))).alias("stem"))
    items = link.resolve_annotations(items, listing, layout.grids)
    labels = textgrid.tier_text(grids.withColumn("path", path), tier=tier).withColumnRenamed("path", "_grid")
    items = items.join(labels, F.col("annotation_path") == F.col("_grid"), "left").withColumn("ref_text", F.coalesce("ref_text", F.lit(""))).drop("_grid")
    if passages_csv:
        items = link.attach_passages(items, tables.read_passages(spark, passages_csv))
    return reference_manifest(items, audio.list_files(spark, layout.audio), layout.audio, layout.root, prefix)


def update_manifest(spark: SparkSession, base_path: str, hypotheses: list[str], match_on: str = "stem") -> DataFrame:
    """A segment manifest with hypotheses filled in by key."""
    base = manifests.read_base_manifest(spark, base_path).withColumn("hyp_text", F.col("pred_text"))
    return link.attach_hypotheses(base, manifests.read_manifests(spark, hypotheses), match_on).withColumn("pred_text", F.col("hyp_text")).select(*sinks.MANIFEST)


def segment_manifest(spark: SparkSession, manifest_path: str, grids_path: str, out_root: str, rate: int = audio.RATE) -> tuple[DataFrame, DataFrame]:
    """(a row for each interval of each recording, counts of records used and skipped by reason)."""
    records = manifests.read_strict(spark, manifest_path).select(F.get_json_object("line", "$.audio_filepath").alias("wav"), F.get_json_object("line", "$.can_text").alias("can_text"))
    path = F.regexp_replace("path", "^file:/+", "/")
    found = textgrid.read_intervals(spark, grids_path).withColumn("stem", paths.stem(paths.file_name(path))).withColumn("folder", F.element_at(F.split(path, "/"), -2)).withColumn("path", path)
    files = found.select("path", "folder", "stem", F.lit("TextGrid").alias("ext")).distinct()
    wavs = records.select("wav", paths.speaker_of(F.col("wav")).alias("speaker"), paths.stem(paths.file_name(F.col("wav"))).alias("stem"))
    linked = link.annotation_for_recording(wavs, files).where("annotation_path is not null")
    intervals = linked.select("wav", F.col("annotation_path").alias("path")).join(found.drop("folder", "stem"), "path").select("wav", "idx", "xmin", "xmax", "text")
    out = segments.cut(records.withColumn("samples", F.lit(None).cast("long")), intervals, out_root, rate)
    return out.select("audio_filepath", "duration", F.lit("").alias("pred_text"), F.col("text").alias("ref_text"), "can_text", "wav", "first_sample", "last_sample"), segments.skip_reasons(records, records, linked, intervals)


def transcribe_segments(files: DataFrame, intervals: DataFrame, load_model: Callable[[], audio.Model], rate: int = audio.RATE) -> DataFrame:
    """Hypotheses of (path, content) recordings from their annotated intervals (wav, idx, xmin, xmax, text) alone, joined in order."""
    records = files.select(F.col("path").alias("wav"), F.lit(None).cast("long").alias("samples"))
    cuts = segments.cut(records, intervals, "", rate)
    found = audio.pieces(files, cuts, rate).join(cuts.select("audio_filepath", F.col("wav").alias("path"), F.col("idx").cast("long").alias("idx")), "audio_filepath")
    return audio.transcribe(found.select("path", "idx", "content"), load_model, rate)


def score_legacy(spark: SparkSession, items: DataFrame, learners_csv: str) -> dict[str, DataFrame]:
    """The older profile: detailed rows, the overall row, task blocks."""
    meta = tables.read_csv(spark, learners_csv).drop("ord")
    scored = score.with_categories(score.with_advanced(score.score_rows_v1(items, meta)))
    return {"detailed": scored, "overall": summary.global_v1(scored), "tasks": summary.task_blocks_v1(scored)}


def offline_manifests(items: DataFrame, hypotheses: DataFrame, audio_root: str, adjust: bool = False) -> tuple[DataFrame, DataFrame]:
    """(REF, CAN) manifests of audio_filepath, text and pred_text for an outside scorer; rows with both texts only."""
    d = items.withColumn("audio_filepath", paths.below(audio_root, F.col("learner_id"), paths.file_name(F.col("audio_file"))))
    d = link.lookup_last(d.drop("pred_text"), hypotheses, "audio_filepath", "pred_text", "ord")
    can = adjust_letters(F.col("canonical_text"), F.col("audio_type")) if adjust else F.col("canonical_text")
    return tuple(d.select("audio_filepath", text.alias("text"), "pred_text").where(~is_blank(F.col("text")) & ~is_blank(F.col("pred_text"))) for text in (F.col("ref_text"), can))


def cross_check(spark: SparkSession, manifest_path: str, tolerance: float | None = None, characters: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with their own error counts, the corpus rate); reading the rate fails above the tolerance."""
    from lectern.functions.align import error_counts

    rows = manifests.read_scored(spark, manifest_path)
    n = lambda c: normalize(F.col(c))
    each = rows.withColumn("c", error_counts(n("text"), n("pred_text"))).select("*", F.col("c.N").alias("tokens"), F.try_divide((F.col("c.S") + F.col("c.D") + F.col("c.I")).cast("double"), F.col("c.N")).alias("wer"), F.try_divide(F.levenshtein(n("text"), n("pred_text")).cast("double"), F.length(n("text"))).alias("cer")).drop("c")
    rate = summary.corpus_error_rate(rows.select(n("text").alias("t"), n("pred_text").alias("h")), "t", "h", characters)
    return each, rate if tolerance is None else summary.within_tolerance(rate, "rate", tolerance)
