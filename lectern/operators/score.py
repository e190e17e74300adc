"""Row scorers: every count of a reading from its canonical, annotated and recognised text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import batch, rates
from lectern.functions.align import FINE, META, PLACED, error_counts, fine_counts, paired, placed_counts, scores
from lectern.functions.paths import category, macro_and_sub
from lectern.functions.text import is_blank, normalize, normalize_ascii
from lectern.operators.segments import group_texts

KEPT = ["S_ref_hyp", "D_ref_hyp", "I_ref_hyp", "C_ref_hyp", "N_ref_hyp", "C_can_ref", "C_can_hyp"] + [c for c in META if not c.startswith("tags")]


def score_rows(items: DataFrame, with_tags: bool = False) -> DataFrame:
    """The current profile: (learner_id, audio_file, audio_type, CAN, REF, HYP) and all counts.

    ``items`` has learner_id, audio_file, audio_type, canonical_text, ref_text, hyp_text.
    Each item's type becomes its category; rows of no category are left out (see
    :func:`unscored`). One Arrow function makes all counts in one pass.
    """
    d = items.withColumn("_category", category(F.col("audio_type"))).where(F.col("_category").isNotNull())
    texts = {"CAN": "canonical_text", "REF": "ref_text", "HYP": "hyp_text"}
    d = d.withColumn("_s", scores(*[normalize(F.col(c)) for c in texts.values()]))
    extra = [c for c in META if c.startswith("tags")] if with_tags else []
    return d.select("learner_id", "audio_file", F.col("_category").alias("audio_type"), *[F.coalesce(c, F.lit("")).alias(n) for n, c in texts.items()], *[F.col(f"_s.{c}").alias(c) for c in KEPT + extra])


def error_rows(items: DataFrame) -> DataFrame:
    """(learner_id, audio_file, audio_type) and the counts of REF to HYP alone, where nothing else is asked for."""
    d = items.withColumn("_category", category(F.col("audio_type"))).where(F.col("_category").isNotNull())
    d = d.withColumn("_s", error_counts(normalize(F.col("ref_text")), normalize(F.col("hyp_text"))))
    return d.select("learner_id", "audio_file", F.col("_category").alias("audio_type"), *[F.col(f"_s.{k}").alias(f"{k}_ref_hyp") for k in "SDICN"])


def unscored(items: DataFrame) -> DataFrame:
    """Items whose type belongs to no category."""
    return items.where(category(F.col("audio_type")).isNull())


def _pair(d: DataFrame, name: str, counts: str, percent_of: str) -> DataFrame:
    c = {k: F.col(f"{counts}.{k}") for k in "SDICN"}
    m = rates.pair_metrics(c["S"], c["D"], c["I"], c["C"], c["N"])
    return d.withColumns({f"WER_{name}": m["WER"], f"ACC_{name}": m[percent_of] * 100.0, **{f"{k}_{name}": c[k] for k in "SDIN"}, f"C_{name}": c["C"]})


def score_rows_v1(items: DataFrame, metadata: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """The older profile: REF to HYP for each segment; comparisons with CAN once a recording, on its first segment.

    CAN to REF takes REF for the truth, and the correct counts are N - S - D. Comparisons
    with CAN are null on the other segments.
    """
    d = group_texts(items, order)
    first = F.col("is_first")
    n = lambda c: normalize(F.col(c))
    d = d.withColumns({"_rh": error_counts(n("ref_text"), n("hyp_text")), "_cr": error_counts(n("REF_FG"), n("CAN_FG")), "_ch": error_counts(n("CAN_FG"), n("HYP_FG"))})
    d = _pair(d, "can_ref", "_cr", "ACC_COR")
    d = _pair(d, "can_hyp", "_ch", "ACC")
    d = _pair(d, "ref_hyp", "_rh", "ACC")
    for pair in ("can_ref", "can_hyp"):
        d = d.withColumn(f"C_{pair}", F.col(f"N_{pair}") - F.col(f"S_{pair}") - F.col(f"D_{pair}"))
        for k in ("WER", "ACC", "S", "D", "I", "C", "N"):
            d = d.withColumn(f"{k}_{pair}", F.when(first, F.col(f"{k}_{pair}")))
    d = d.withColumns(
        {
            "CAN": F.col("canonical_text"), "REF": F.col("ref_text"), "HYP": F.col("hyp_text"), "has_hyp": ~is_blank(F.col("hyp_text")),
            "EGRA_COR": F.col("C_can_ref"), "EGRA_ACC": F.col("ACC_can_ref"), "ASR_EGRA_COR": F.col("C_can_hyp"), "ASR_EGRA_ACC": F.col("ACC_can_hyp"),
            "MAE_EGRA_COR": F.abs(F.col("C_can_ref") - F.col("C_can_hyp")), "ASR_WER": F.col("WER_ref_hyp"),
        }
    )
    d = d.drop("_rh", "_cr", "_ch", "group_key", "seg_order", "is_first")
    return d if metadata is None else d.join(metadata, "learner_id", "left")


def advanced_v1(can: Column, ref: Column, hyp: Column) -> Column:
    """Struct of the meta-alignment's counts over texts normalised the older way, and of placed errors of the texts as they are.

    Pairs of texts that normalising leaves alone are aligned once for both.
    """
    fields = ["S", "D", "I", "C", "N", *[f"{k}_{x}" for k in FINE for x in ("tp", "fp", "fn")]]

    def run(cans: pd.Series, refs: pd.Series, hyps: pd.Series, c: pd.Series, r: pd.Series, h: pd.Series) -> pd.DataFrame:
        plain, own = list(zip(cans, refs, hyps, strict=True)), list(zip(c, r, h, strict=True))
        pairs = list(dict.fromkeys((x[0], y) for x in [*plain, *own] for y in x[1:]))
        split = lambda x: (x or "").split()
        tags = dict(zip(pairs, batch.tags([split(x) for x, _ in pairs], [split(y) for _, y in pairs]), strict=True))
        true, pred = ([tags[x[0], x[k]] for x in plain] for k in (1, 2))
        out = []
        for t, p, m, x in zip(true, pred, batch.tags(true, pred), own, strict=True):
            fine = m.count("s"), m.count("d"), m.count("i"), m.count("c"), len(t), *fine_counts(paired(t, p, m))
            out.append((*fine, *placed_counts(*map(split, x), (tags[x[0], x[1]], tags[x[0], x[2]]))))
        return pd.DataFrame(out, columns=[*fields, *PLACED])

    kind = T.StructType([T.StructField(f, T.LongType()) for f in [*fields, *PLACED]])
    texts = can, ref, hyp
    return F.pandas_udf(run, kind)(*map(normalize_ascii, texts), *texts)


def with_advanced(scored: DataFrame) -> DataFrame:
    """Scored rows with differences of accuracy and fine-grained rates.

    Accuracies are percent by schema here; MAE_EGRA_ACC is in 0..1 and Bias_Baseline_MAE
    in percent points. The mean accuracy is a scalar subquery. MER
    is errors over N of the meta-alignment, null if there is nothing to align. Fine
    metrics are named fine_*, placed ones phono_*.
    """
    mean = scored.select(rates.mean(F.col("ACC_can_ref")).alias("m")).scalar()
    d = scored.withColumns({"ACC_can_ref_norm_for_mae": F.col("ACC_can_ref") / 100.0, "ACC_can_hyp_norm_for_mae": F.col("ACC_can_hyp") / 100.0})
    d = d.withColumns(
        {
            "MAE_EGRA_ACC": F.abs(F.col("ACC_can_ref_norm_for_mae") - F.col("ACC_can_hyp_norm_for_mae")),
            "Bias_Baseline_MAE": F.abs(F.col("ACC_can_ref") - mean.cast("double")),
            "_f": advanced_v1(F.col("CAN"), F.col("REF"), F.col("HYP")),
        }
    )
    d = d.withColumn("MER", rates.ratio(F.col("_f.S") + F.col("_f.D") + F.col("_f.I"), F.col("_f.N")))
    sums = {}
    for k, name in (("sub", "S"), ("ins", "I"), ("del", "D")):
        c = [F.col(f"_f.{k}_{x}") for x in ("tp", "fp", "fn")]
        for m, v in zip(("Precision", "Recall", "F1"), rates.prf(*c), strict=True):
            sums[f"fine_{name}_{m}"] = v
    hit = [sum((F.col(f"_f.{k}_{x}") for k in ("ins", "del")), F.col(f"_f.sub_{x}")) for x in ("tp", "fp", "fn")]
    for m, v in zip(("Precision", "Recall", "F1"), rates.prf(*hit), strict=True):
        sums[f"Mistakes_{m}"] = v
    d = d.withColumns(sums).withColumns({c: F.col(f"_f.{c}") for c in PLACED})
    for k in "SDI":
        for m, v in zip(("Precision", "Recall", "F1"), rates.prf(*[F.col(f"{k}_{x}") for x in ("TP", "FP", "FN")], zero=False), strict=True):
            d = d.withColumn(f"phono_{k}_{m}", v)
    return d.drop("_f")


def with_categories(scored: DataFrame) -> DataFrame:
    """Scored rows with macro_category and sub_category by their item type."""
    c = macro_and_sub(F.col("audio_type"))
    return scored.withColumns({"macro_category": c["macro"], "sub_category": c["sub"]})

