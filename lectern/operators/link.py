"""Joins that attach hypotheses, texts, passages, metadata and annotations to items.

All are left equi-joins. Dimension sides carry no broadcast hint: their size decides, at
run time if need be. Keys that are null never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.paths import path_order
from lectern.functions.text import is_blank, strip, text_or_empty

KEYS = {"stem": "audio_stem", "name": "audio_name", "path": "audio_path_csv"}


def _key(match_on: str, *frames: DataFrame) -> str:
    if match_on not in KEYS:
        raise ValueError(f"match_on must be one of {', '.join(KEYS)}")
    for df in frames:
        if KEYS[match_on] not in df.columns:
            raise KeyError(KEYS[match_on])
    return KEYS[match_on]


def attach_hypotheses(items: DataFrame, hypotheses: DataFrame, match_on: str = "stem") -> DataFrame:
    """Items with ``hyp_text``: their own where they have one, else the matching hypothesis, else ''.

    Several hypotheses of one key give several rows.
    """
    key = _key(match_on, items, hypotheses)
    right = hypotheses.select(F.col(key).alias("_key"), F.col("hyp_text").alias("_hyp"))
    own = F.col("hyp_text") if "hyp_text" in items.columns else F.lit(None).cast("string")
    text = F.when(text_or_empty(strip(own)) == "", F.col("_hyp")).otherwise(own)
    return items.join(right, F.col(key) == F.col("_key"), "left").withColumn("hyp_text", F.coalesce(text, F.lit(""))).drop("_key", "_hyp")


def attach_texts(items: DataFrame, texts: DataFrame, match_on: str = "stem") -> DataFrame:
    """Items whose ref_text and canonical_text are replaced by the manifest's where it has any.

    ``texts`` has the key, ``ord``, manifest_text and manifest_can_text; the last row of a
    key counts. Without a match, or with a blank text, the item's own stays.
    """
    key = _key(match_on, items, texts)
    last = texts.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("manifest_text", "manifest_can_text"), "ord").alias("_t"))
    out = items.join(last, F.col(key) == F.col("_key"), "left")
    for mine, theirs in (("ref_text", "manifest_text"), ("canonical_text", "manifest_can_text")):
        own = F.col(mine) if mine in items.columns else F.lit("")
        out = out.withColumn(mine, F.when(is_blank(F.col(f"_t.{theirs}")), own).otherwise(F.col(f"_t.{theirs}")))
    return out.drop("_key", "_t")


def passage_number(c: Column, pattern: str = "(\\d+)") -> Column:
    return F.regexp_extract(c, pattern, 1).try_cast("int")


def attach_passages(items: DataFrame, passages: DataFrame, text_col: str = "canonical_text") -> DataFrame:
    """Items of type passage_num<n> with the text of passage n, which replaces any they had.

    ``passages`` is (raw_num, passage_text); rows without a digit are left out, and "nan"
    counts as no text; white space at a text's ends goes.
    """
    right = passages.where(F.col("raw_num").rlike("\\d")).select(passage_number(F.col("raw_num")).alias("_num"), F.col("passage_text").alias("_text"))
    out = items.withColumn("passage_num", passage_number(F.col("audio_type"), "passage_num(\\d+)"))
    text = F.when(F.lower(F.trim("_text")) == "nan", None).otherwise(strip(F.col("_text")))
    out = out.join(right, F.col("passage_num") == F.col("_num"), "left")
    return out.withColumn(text_col, F.coalesce(text, F.col(text_col))).drop("_num", "_text")


def attach_metadata(scored: DataFrame, metadata: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Scored rows with a learner's metadata: the named columns, or all."""
    right = metadata if columns is None else metadata.select("learner_id", *columns)
    return scored.join(right, "learner_id", "left")


def lookup_last(items: DataFrame, table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Items with the value of the table's last row of their key; '' without one."""
    last = table.groupBy(F.col(key).alias("_key")).agg(F.max_by(value, order).alias("_value"))
    return items.join(last, F.col(key) == F.col("_key"), "left").withColumn(value, F.coalesce("_value", F.lit(""))).drop("_key", "_value")


def first_path_by_stem(paths: DataFrame) -> DataFrame:
    """(stem_key, path): the first path, part by part, of each lower-cased stem of (path, stem)."""
    return paths.groupBy(F.lower("stem").alias("stem_key")).agg(F.min_by("path", path_order(F.col("path"))).alias("path"))


def resolve_annotations(items: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    """Items with ``annotation_path``: by their audio's stem, else by the stem they name, else at the place they name.

    ``paths`` lists the annotation files as (path, stem). Existence is a join with that
    listing, not a look at the file system for each row.
    """
    index = first_path_by_stem(paths)
    one, two = (index.select(F.col("stem_key").alias(f"_k{i}"), F.col("path").alias(f"_p{i}")) for i in (1, 2))
    named = F.regexp_replace(F.regexp_extract(F.coalesce("textgrid", F.lit("")), "([^/]+)/*$", 1), "(?<=.)\\.[^.]+$", "")
    place = F.concat_ws("/", F.lit(root.rstrip("/")), "learner_id", "textgrid")
    there = paths.select(F.col("path").alias("_p3"), F.lit(True).alias("_there")).distinct()
    out = items.withColumns({"_s1": F.lower("audio_stem"), "_s2": F.lower(named), "_s3": place})
    out = out.join(one, F.col("_s1") == F.col("_k1"), "left").join(two, (F.col("_s2") == F.col("_k2")) & (F.col("_s2") != ""), "left").join(there, F.col("_s3") == F.col("_p3"), "left")
    return out.withColumn("annotation_path", F.coalesce("_p1", "_p2", "_p3")).drop("_s1", "_s2", "_s3", "_k1", "_p1", "_k2", "_p2", "_p3", "_there")


def best_candidate(candidates: DataFrame, key: str, rank: str = "priority", path: str = "path") -> DataFrame:
    """(key, path): of each key's candidates the one of the lowest rank, the first path on ties."""
    return candidates.groupBy(key).agg(F.min_by(path, F.struct(F.col(rank), path_order(F.col(path)))).alias(path))


def annotation_for_recording(recordings: DataFrame, paths: DataFrame, any_case: bool = False) -> DataFrame:
    """Recordings (wav, speaker, stem) with ``annotation_path`` by four rules, the first that applies.

    Of ``paths`` (path, folder, stem, ext): a file of the stem in the speaker's folder; one
    there whose stem begins with it; one of the stem anywhere; and if ``any_case`` one
    anywhere whose extension is in lower case.
    """
    p = paths.select("path", "folder", F.col("stem").alias("p_stem"), "ext")
    same = recordings.join(p, (F.col("stem") == F.col("p_stem")))
    lower = F.col("ext") == F.lower("ext")
    exact = same.select("wav", "path", F.when(F.col("folder") == F.col("speaker"), 1).when(~lower, 3).otherwise(4 if any_case else 3).alias("priority"))
    begins = recordings.join(p, F.col("speaker") == F.col("folder")).where(F.col("p_stem").startswith(F.col("stem"))).select("wav", "path", F.lit(2).alias("priority"))
    found = best_candidate(exact.unionByName(begins), "wav").withColumnRenamed("path", "annotation_path")
    return recordings.join(found, "wav", "left")


def resolve_audio(items: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Items whose audio file is listed, with ``audio_filepath``: as given, below root, or in the learner's folder.

    Items without a file are left out.
    """
    raw = F.coalesce("audio_file", F.lit(""))
    base = root.rstrip("/")
    name = F.regexp_extract(raw, "([^/]+)/*$", 1)
    tries = F.array(
        F.struct(F.lit(1).alias("priority"), F.when(raw.startswith("/"), raw).alias("path")),
        F.struct(F.lit(2).alias("priority"), F.when(~raw.startswith("/"), F.concat(F.lit(base + "/"), raw)).alias("path")),
        F.struct(F.lit(3).alias("priority"), F.concat_ws("/", F.lit(base), "learner_id", name).alias("path")),
    )
    wanted = items.select("ord", F.explode(tries).alias("t")).select("ord", "t.*").where("path is not null")
    found = best_candidate(wanted.join(listing.select("path").distinct(), "path", "left_semi"), "ord")
    return items.join(found.withColumnRenamed("path", "audio_filepath"), "ord")
