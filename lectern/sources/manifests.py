"""Manifests: one JSON object a line, or JSON of looser forms."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.paths import with_audio_keys
from lectern.functions.text import is_blank, text_or_empty
from lectern.operators.dedup import keep_first, keep_last


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(ord, line) of the lines that are not blank; gzip by suffix.

    ``ord`` is (place in the list of the path that a file is, or lies in; file; place in
    the file). All paths are read at once.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    place = {re.sub("^file:/+", "/", p.rstrip("/")): i for i, p in reversed(list(enumerate(paths)))}
    known = F.create_map(*[F.lit(x) for item in place.items() for x in item])
    d = spark.read.text(paths).select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    listed = F.coalesce(F.try_element_at(known, F.col("file")), F.try_element_at(known, F.regexp_extract("file", "^(.*)/[^/]*$", 1)), F.lit(len(paths)))
    return d.select(F.struct(listed.alias("path"), "file", "block", "line").alias("ord"), F.col("value").alias("line")).where(~is_blank(F.col("line")))


def _value(key: str) -> Column:
    """The text of a top-level key, whatever characters it has; null if it is absent or JSON null."""
    return F.try_element_at(F.from_json(F.col("line"), "map<string,string>"), F.lit(key))


def objects(lines: DataFrame) -> DataFrame:
    """Lines that hold a JSON object."""
    return lines.where(F.try_parse_json(F.col("line")).isNotNull() & F.ltrim("line").startswith("{"))


def read_manifest(spark: SparkSession, path: str | list[str], audio_key: str = "audio_filepath", hyp_key: str = "pred_text", can_key: str = "can_text") -> DataFrame:
    """(audio_filepath, hyp_text, can_text, audio keys, ord); lines without an audio path, and bad ones, are skipped."""
    d = objects(_lines(spark, path)).select("ord", F.trim(F.coalesce(_value(audio_key), F.lit(""))).alias("audio_filepath"), F.coalesce(_value(hyp_key), F.lit("")).alias("hyp_text"), F.coalesce(_value(can_key), F.lit("")).alias("can_text"))
    return with_audio_keys(d.where("audio_filepath <> ''"), "audio_filepath")


def read_manifests(spark: SparkSession, paths: list[str], **keys: str) -> DataFrame:
    """Several manifests; of rows with one stem and name, the last of the last file counts."""
    return keep_last(read_manifest(spark, paths, **keys), ["audio_stem", "audio_name"], ["ord"])


def read_texts(spark: SparkSession, path: str, audio_key: str = "audio_filepath", text_key: str = "ref_text", can_key: str = "can_text") -> DataFrame:
    """(audio keys, manifest_text, manifest_can_text, ord)."""
    d = objects(_lines(spark, path)).select("ord", F.trim(F.coalesce(_value(audio_key), F.lit(""))).alias("audio"), F.coalesce(_value(text_key), F.lit("")).alias("manifest_text"), F.coalesce(_value(can_key), F.lit("")).alias("manifest_can_text"))
    return with_audio_keys(d.where("audio <> ''"), "audio").drop("audio")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(bad, good): counts of lines that are no JSON object, and that are."""
    good = F.coalesce(F.try_parse_json(F.col("line")).isNotNull() & F.ltrim("line").startswith("{"), F.lit(False))
    return _lines(spark, path).agg(F.count_if(~good).alias("bad"), F.count_if(good).alias("good"))


def scan_json(text: str) -> Iterator[dict]:
    """Every object in a text: alone, in an array, or one after another with anything between."""
    try:
        whole = json.loads(text)
    except ValueError:
        whole = None
    if whole is not None:
        yield from (x for x in (whole if isinstance(whole, list) else [whole]) if isinstance(x, dict))
        return
    decoder, at = json.JSONDecoder(), 0
    while True:
        at = min((k for k in (text.find("{", at), text.find("[", at)) if k >= 0), default=-1)
        if at < 0:
            return
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        yield from (x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict))


def read_json_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(ord, json) of each object of files of any of these forms, each object as one line of JSON.

    A file of JSON lines is read line by line in parallel; only others are read whole.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, text in zip(p["path"], p["value"], strict=True):
                rows = [json.dumps(x, ensure_ascii=False) for x in scan_json(text)]
                yield pd.DataFrame({"path": [name] * len(rows), "n": range(len(rows)), "json": rows})

    lines = spark.read.text(path).where(~is_blank(F.col("value")))
    strict = F.coalesce(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"), F.lit(False))
    if lines.where(~strict).isEmpty():
        return lines.select(F.struct(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n")).alias("ord"), F.col("value").alias("json"))
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.mapInPandas(run, "path string, n long, json string").select(F.struct("path", "n").alias("ord"), "json")


SCORED = ("wer", "tokens", "ins_rate", "del_rate", "sub_rate")


def read_eval_manifest(spark: SparkSession, path: str, audio_key: str = "audio_filepath", ref_key: str = "ref_text", can_key: str = "can_text", hyp_key: str = "pred_text") -> DataFrame:
    """Rows to score: texts, audio keys, optional scores as numbers, and whether the hypothesis key was there at all."""
    d = read_json_objects(spark, path).withColumnRenamed("json", "line")
    has = F.array_contains(F.json_object_keys("line"), hyp_key)
    text = lambda k: F.coalesce(_value(k), F.lit(""))
    out = d.select("ord", F.trim(text(audio_key)).alias("audio_filepath"), text(ref_key).alias("ref_text"), text(can_key).alias("can_text"), text(hyp_key).alias("hyp_text"), F.coalesce(has, F.lit(False)).alias("manifest_hyp_present"), *[_value(k).try_cast("double").alias(k) for k in SCORED])
    return with_audio_keys(out.where("audio_filepath <> ''"), "audio_filepath")


def read_base_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Segment manifest rows with missing durations read from the files' headers; the first row of each path."""
    from lectern.sources.audio import duration_or_zero

    d = read_json_objects(spark, path).withColumnRenamed("json", "line")
    t = lambda k: text_or_empty(F.coalesce(_value(k), F.lit("")))
    out = d.select("ord", F.trim(t("audio_filepath")).alias("audio_filepath"), _value("duration").try_cast("double").alias("duration"), t("pred_text").alias("pred_text"), t("ref_text").alias("ref_text"), t("can_text").alias("can_text"))
    out = keep_first(out.where("audio_filepath <> ''"), ["audio_filepath"], ["ord"])
    return with_audio_keys(duration_or_zero(out), "audio_filepath")


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of JSON lines; a bad line fails the job when it is read."""
    good = F.try_parse_json("line").isNotNull()
    d = _lines(spark, path)
    return d.withColumn("line", F.when(good, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.substring("line", 1, 80))).cast("string")))


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """(audio_filepath, text, pred_text); a row without pred_text fails the job when it is read."""
    d = objects(_lines(spark, path)).select("ord", _value("audio_filepath").alias("audio_filepath"), F.coalesce(_value("text"), F.lit("")).alias("text"), _value("pred_text").alias("pred_text"))
    return d.withColumn("pred_text", F.when(F.col("pred_text").isNull(), F.raise_error(F.lit("a row has no pred_text")).cast("string")).otherwise(F.col("pred_text")))


def paths_of(spark: SparkSession, path: str) -> DataFrame:
    """(ord, path): the distinct audio paths of a manifest, each where it comes first."""
    d = read_json_objects(spark, path).withColumnRenamed("json", "line").select("ord", F.trim(F.coalesce(_value("audio_filepath"), F.lit(""))).alias("path"))
    return keep_first(d.where("path <> ''"), ["path"], ["ord"])
