"""PCM recordings: listing, durations, samples, and pieces of them. Needs the standard library and numpy only."""

from __future__ import annotations

import io
import os
import uuid
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 8000


def list_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(path) of all files below a folder, in order of their parts; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return d.select(F.regexp_replace("path", "^file:/+", "/").alias("path")).orderBy(F.split("path", "/"))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return d.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def header_duration(data: bytes | None) -> float | None:
    """Frames over rate of a WAV's header; None for what is not one."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            return w.getnframes() / w.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return None


def durations(files: DataFrame) -> DataFrame:
    """(path, duration) of (path, content) rows; null for damaged files."""
    udf = F.pandas_udf(lambda c: pd.Series([header_duration(x) for x in c], dtype="float64"), "double")
    return files.select("path", F.nanvl(udf("content"), F.lit(None).cast("double")).alias("duration"))


def duration_or_zero(rows: DataFrame, path_col: str = "audio_filepath") -> DataFrame:
    """``rows`` with missing durations taken from the files' headers, 0 where there is no readable file."""
    spark = rows.sparkSession
    folder = F.regexp_extract(F.col(path_col), "^(.*)/[^/]*$", 1)
    folders = [r[0] for r in rows.where("duration is null").select(folder.alias("f")).distinct().collect() if r[0] and exists(spark, r[0])]  # folders, not files
    if not folders:
        return rows.withColumn("duration", F.coalesce("duration", F.lit(0.0)))
    known = durations(read_files(spark, folders)).select(F.col("path").alias("_path"), F.col("duration").alias("_duration"))
    found = rows.join(known, F.col(path_col) == F.col("_path"), "left")
    return found.withColumn("duration", F.coalesce("duration", "_duration", F.lit(0.0))).drop("_path", "_duration")


def samples(data: bytes, rate: int | None = RATE) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 of a WAV (the mean of its channels), resampled linearly to ``rate``."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)
    x = x.reshape(-1, channels).mean(1)
    if rate and rate != own and len(x):
        n = max(1, round(len(x) * rate / own))
        x, own = np.interp(np.arange(n) * own / rate, np.arange(len(x)), x), rate
    return x, own


def as_wav(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(x * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def pieces(files: DataFrame, cuts: DataFrame, rate: int | None = None) -> DataFrame:
    """(audio_filepath, content): the WAV of each cut (wav, audio_filepath, first_sample, last_sample) as bytes.

    The caller stores them; nothing is written to a worker's own disk.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"audio_filepath": [], "content": []})
        x, own = samples(left["content"].iloc[0], rate)
        return pd.DataFrame({"audio_filepath": right["audio_filepath"], "content": [as_wav(x[a:b], own) for a, b in zip(right["first_sample"], right["last_sample"], strict=True)]})

    return files.groupBy(F.col("path")).cogroup(cuts.groupBy(F.col("wav"))).applyInPandas(run, "audio_filepath string, content binary")


def write_pieces(found: DataFrame, path_col: str = "audio_filepath", content_col: str = "content") -> int:
    """Write each (path, bytes) row as a file, and give how many there are.

    The paths must lie where all workers reach them as files. A file appears whole, by
    renaming, so that a task that runs again does no harm.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, data in zip(p["path"], p["content"], strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
            yield pd.DataFrame({"n": [len(p)]})

    return found.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@dataclass(frozen=True)
class Decoding:
    """What a model is asked for: its decoder, how many texts each, and anything of its own."""

    decoder: str = "ctc"
    n_best: int = 1
    batch_size: int = 32
    options: tuple[tuple[str, str], ...] = ()

    def of(self, decoders: tuple[str, ...]) -> str:
        """The decoder, if a model that has these can use it."""
        if self.decoder not in decoders:
            raise ValueError(f"the model decodes with {' or '.join(decoders)}, not with {self.decoder}")
        return self.decoder


Model = Callable[[list[np.ndarray], int], list]


def by_duration(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows dealt to tasks by duration, the longest first in each, so that batches hold alike ones; any order they have is in columns."""
    known = files if "duration" in files.columns else files.withColumn("duration", F.pandas_udf(lambda c: pd.Series([header_duration(x) for x in c], dtype="float64"), "double")("content"))
    dealt = known.repartitionByRange(*([tasks] if tasks else []), F.desc("duration"))
    return dealt.sortWithinPartitions(F.desc("duration"))


def transcribe(files: DataFrame, load_model: Callable[[], Model], rate: int = RATE, batch_size: int = 32, n_best: int = 1) -> DataFrame:
    """(audio_filepath, duration, pred_text, error[, n_best]) of (path, content[, idx]) rows through a pluggable model.

    The model is loaded once a worker; it gives a text for each recording, or for
    ``n_best`` over 1 a list of them, best first. Rows of one path are pieces of it: their
    texts are joined by spaces in order, blank ones left out. A file that cannot be read
    has an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for p in parts:
            for a in range(0, len(p), batch_size):
                q = p.iloc[a : a + batch_size]
                loaded, errors = [], []
                for data in q["content"]:
                    try:
                        loaded.append(samples(data, rate)[0])
                        errors.append(None)
                    except (wave.Error, EOFError, KeyError) as e:
                        loaded.append(None)
                        errors.append(str(e) or type(e).__name__)
                texts = iter(model([x for x in loaded if x is not None], rate))
                own = [None if x is None else [y] if isinstance(y := next(texts), str) else list(y)[:n_best] for x in loaded]
                yield pd.DataFrame({"path": q["path"], "idx": q["idx"], "duration": [None if x is None else len(x) / rate for x in loaded], "text": [None if x is None else (x or [""])[0] for x in own], "n_best": own, "error": errors})

    d = files if "idx" in files.columns else files.withColumn("idx", F.lit(0).cast("long"))
    out = d.select("path", "idx", "content").mapInPandas(run, "path string, idx long, duration double, text string, n_best array<string>, error string")
    texts = F.sort_array(F.collect_list(F.when(F.trim("text") != "", F.struct("idx", F.trim("text").alias("t")))))
    more = [F.transform(F.sort_array(F.collect_list(F.struct("idx", "n_best"))), lambda x: x["n_best"]).alias("n_best")] if n_best > 1 else []
    return out.groupBy(F.col("path").alias("audio_filepath")).agg(F.round(F.sum("duration"), 3).alias("duration"), F.array_join(F.transform(texts, lambda t: t["t"]), " ").alias("pred_text"), F.max("error").alias("error"), *more)
