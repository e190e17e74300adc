"""Where a dataset keeps its files, found through Hadoop's file system."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import SparkSession

#: Names a dataset folder uses.
ITEMS_CSV, LEARNERS_CSV = "Student_Full_Canonical_EGRA*.csv", "Student_MetaData_EGRA*.csv"
ANNOTATION_DIRS, AUDIO_DIRS, GRID_DIRS = ("0_IAR", "0IAR"), ("0_Audio", "0Audio"), ("2_TextGrid",)


@dataclass(frozen=True)
class Layout:
    root: str
    items_csv: str
    learners_csv: str
    annotations: str
    audio: str
    grids: str


def _tree(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """(path, whether it is a folder) of what may matter below ``root``, at every depth, in order of path."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(top):
        raise FileNotFoundError(f"no dataset at {root}")
    out, waiting = [], [top]
    while waiting:
        for s in files.listStatus(waiting.pop()):
            path = re.sub("^file:/+", "/", s.getPath().toString())
            if s.isDirectory():
                waiting.append(s.getPath())
                out.append((path, True))
            elif path.endswith(".csv"):
                out.append((path, False))
    return sorted(out, key=lambda x: x[0].split("/"))


def _first(tree: list[tuple[str, bool]], what: str, names: tuple[str, ...], folder: bool, under: str = "") -> str:
    for name in names:
        for path, is_folder in tree:
            if is_folder == folder and path.startswith(under) and fnmatchcase(path.rsplit("/", 1)[1], name):
                return path
    raise FileNotFoundError(f"no {what}: looked for {', '.join(names)}")


def find_layout(spark: SparkSession, root: str, annotator: str | None = None) -> Layout:
    """The first match of each part at any depth, in order of path; only the audio folder and that of annotations may be missing.

    Folders of audio and annotations are looked for in the annotations' hub, if there is one.
    """
    tree = _tree(spark, root.rstrip("/"))
    root = re.sub("^file:/+", "/", root.rstrip("/"))
    items = _first(tree, "items", (ITEMS_CSV,), False)
    learners = _first(tree, "learner metadata", (LEARNERS_CSV,), False)
    try:
        hub = _first(tree, "annotations", ANNOTATION_DIRS, True)
    except FileNotFoundError:
        hub = root
    try:
        audio = _first(tree, "audio", AUDIO_DIRS, True, hub + "/")
    except FileNotFoundError:
        audio = f"{root}/{AUDIO_DIRS[0]}"
    grids = _first(tree, "TextGrid folder", GRID_DIRS, True, hub + "/")
    if annotator:
        if (f"{grids}/{annotator}", True) not in tree:
            raise FileNotFoundError(f"no annotator {annotator} below {grids}")
        grids = f"{grids}/{annotator}"
    return Layout(root, items, learners, hub, audio, grids)


def table_location(settings: dict[str, str], prefix: str) -> str:
    """A table's address from settings <prefix>_PATH, or else <prefix>_URL, which Spark reads as it is."""
    for k in ("PATH", "URL", "LOCAL"):
        if settings.get(f"{prefix}_{k}"):
            return settings[f"{prefix}_{k}"]
    raise KeyError(f"{prefix}_PATH or {prefix}_URL")
