"""Where results go: JSON lines, CSV, summary texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import clean

#: The columns a detailed report has, in order; those of no run are null.
REPORT_COLUMNS = (
    "learner_id", "audio_type", "audio_file", "CAN", "REF", "HYP",
    "WER_can_ref", "ACC_can_ref", "S_can_ref", "D_can_ref", "I_can_ref", "C_can_ref", "N_can_ref",
    "WER_can_hyp", "ACC_can_hyp", "S_can_hyp", "D_can_hyp", "I_can_hyp", "C_can_hyp", "N_can_hyp",
    "WER_ref_hyp", "ACC_ref_hyp", "S_ref_hyp", "D_ref_hyp", "I_ref_hyp", "C_ref_hyp", "N_ref_hyp",
    "EGRA_COR", "EGRA_ACC", "ASR_EGRA_COR", "ASR_EGRA_ACC", "MAE_EGRA_COR", "ASR_WER", "has_hyp",
    "gender", "child_grade", "child_age", "region", "council", "ward",
    "Kiswahili_lang1", "Kigogo_lang2", "Kirangi_lang3", "Kihaya_lang4", "Runyambo_lang5", "Kihangaza_lang6", "English_lang7",
    "ACC_can_ref_norm_for_mae", "ACC_can_hyp_norm_for_mae", "MAE_EGRA_ACC", "Bias_Baseline_MAE",
    "Mistakes_Precision", "Mistakes_Recall", "Mistakes_F1", "MER",
    "S_TP", "S_FP", "S_FN", "D_TP", "D_FP", "D_FN", "I_TP", "I_FP", "I_FN",
)


def in_order(scored: DataFrame, known: tuple[str, ...] = REPORT_COLUMNS) -> DataFrame:
    """The known columns that are there first, in their order, then the rest in theirs."""
    return scored.select(*[c for c in known if c in scored.columns], *[c for c in scored.columns if c not in known])


def with_all_columns(scored: DataFrame, known: tuple[str, ...] = REPORT_COLUMNS) -> DataFrame:
    """Every known column, null where the rows have none, and then the rest."""
    return in_order(scored.withColumns({c: F.lit(None).cast("double") for c in known if c not in scored.columns}), known)


def stamped(folder: str, when: datetime | None = None) -> str:
    """A folder for one run, named by its time."""
    return f"{folder.rstrip('/')}/exp_{(when or datetime.now()).strftime('%Y_%m_%d_%H_%M_%S')}"


def walkthrough_text(one: DataFrame) -> str:
    """The row of :func:`~lectern.operators.summary.walkthrough` as text, a step a line."""
    r = one.first()
    if r is None:
        return "No row of this type was found.\n"
    out = [f"learner_id: {r.learner_id}", f"audio_file: {r.audio_file}"]
    for name, steps, more in (("REF", r.can_to_ref, r.omitted_ref), ("HYP", r.can_to_hyp, r.omitted_hyp)):
        out += ["", f"CAN to {name} (spoken | canonical | type)"]
        out += [f"{i:4d}: {s.test} | {s.truth} | {s.tag}" for i, s in enumerate(steps, 1)]
        out += [f"      {more} more"] * (more > 0)
    return "\n".join([*out, "", f"CAN: {r.CAN}", f"REF: {r.REF}", f"HYP: {r.HYP}", ""])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text of bounded length as one file, through Spark, wherever the path is."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


MANIFEST = ("audio_filepath", "duration", "pred_text", "ref_text", "can_text")


def write_jsonl(df: DataFrame, path: str, single_file: bool = False) -> None:
    """One JSON object a line, null fields kept, characters as they are."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def cleaned(records: DataFrame, input_key: str = "ref_text", output_key: str = "ref_text", lower_can: bool = True) -> DataFrame:
    """Manifest records with a cleaned text, the canonical text in lower case, and no ``text``."""
    out = records.withColumn(output_key, clean(F.col(input_key)))
    if lower_can and "can_text" in records.columns:
        out = out.withColumn("can_text", F.lower("can_text"))
    return out.drop("text") if output_key != "text" else out


def write_cleaned(records: DataFrame, path: str, drop_empty: bool = True, **keys) -> None:
    out = cleaned(records, **keys)
    if drop_empty:
        out = out.where(F.col(keys.get("output_key", "ref_text")) != "")
    write_jsonl(out, path)


def clean_stats(records: DataFrame, bad: int = 0, drop_empty: bool = True, input_key: str = "ref_text") -> DataFrame:
    """(total_lines, bad_json_skipped, written_lines, dropped_empty_text)."""
    empty = clean(F.col(input_key)) == ""
    dropped = F.count_if(empty) if drop_empty else F.lit(0).cast("long")
    return records.agg((F.count("*") + bad).alias("total_lines"), F.lit(bad).cast("long").alias("bad_json_skipped"), (F.count("*") - dropped).alias("written_lines"), dropped.alias("dropped_empty_text"))


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True)


def write_detailed_v1(scored: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """Scored rows without repeats, under their reporting names."""
    from lectern.operators.dedup import distinct_scored

    write_csv(with_all_columns(distinct_scored(scored)).withColumnsRenamed(names or REPORT_NAMES), path)


#: Reporting names that differ from the columns'.
REPORT_NAMES = {"ACC_can_ref": "ACC_can_ref (EGRA_ACC)", "C_can_ref": "C_can_ref (EGRA_COR)", "ACC_can_hyp": "ACC_can_hyp (ASR_EGRA_ACC)", "C_can_hyp": "C_can_hyp (ASR_EGRA_COR)", "EGRA_COR": "EGRA-COR", "EGRA_ACC": "EGRA-ACC", "ASR_EGRA_COR": "ASR-EGRA-COR", "ASR_EGRA_ACC": "ASR-EGRA-ACC"}


def write_summaries_v1(categorised: DataFrame, folder: str) -> None:
    """Nine tables: for each comparison by learner with a global row, by category and by sub category."""
    from lectern.operators.summary import PAIRS, macro_summary, speaker_summary

    for pair in PAIRS:
        write_csv(speaker_summary(categorised, pair), f"{folder}/{pair}/per_speaker")
        write_csv(macro_summary(categorised, pair), f"{folder}/{pair}/per_speaker_macro")
        write_csv(macro_summary(categorised, pair, True), f"{folder}/{pair}/per_speaker_subcategory")


def summary_text(wide: DataFrame) -> str:
    """The eight blocks of the category scores (eight rows at most) as text."""
    out = []
    for r in wide.collect():
        out.append(f"[{r['category']}]")
        out += [f"{k}: {v:.4f}" if k == "corr" else f"{k}: {v:.2f}%" for k, v in r.asDict().items() if k not in ("category", "n") and v is not None]
        out.append("")
    return "\n".join(out)


def summary_text_v1(overall: DataFrame, tasks: DataFrame) -> str:
    """The older profile's table of overall metrics and its task blocks; bounded by the number of categories."""
    row = overall.first().asDict()
    out = ["Metric\tValue"] + [f"{k}\t{'NaN' if v is None else v if isinstance(v, int) else f'{v:.2f}'}" for k, v in row.items()]
    for r in sorted(tasks.collect(), key=lambda r: (r["macro_category"], r["sub_category"])):
        out += ["", f"--- {r['macro_category']}_{r['sub_category']} ---"] + [f"{k}: {'Not Available' if v is None else f'{v:.4f}'}" for k, v in r.asDict().items() if not k.endswith("_category") and k != "n"]
    return "\n".join(out) + "\n"


def scatter_points(scored: DataFrame, x: str = "C_can_ref", y: str = "C_can_hyp") -> DataFrame:
    """(audio_type, x, y, n): the points of the scatter plots, equal ones counted."""
    return scored.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("audio_type", F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
