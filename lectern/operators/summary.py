"""Aggregates over scored rows: one grouped pass each, grouping sets instead of unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import rates
from lectern.functions.align import FINE
from lectern.functions.paths import CATEGORIES

PAIRS = ("can_ref", "can_hyp", "ref_hyp")
GLOBAL = "__GLOBAL__"
GRADED, ISOLATED = CATEGORIES[:4], CATEGORIES[4:]


def _need(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def error_rates(scored: DataFrame, by: str = "audio_type", prefixes: tuple[str, ...] = ("ref_hyp", "mer")) -> DataFrame:
    """(by, n, rate_<prefix>...): micro error rates of each group and, with a null group, of all rows.

    Rows whose group is null count in the total only.
    """
    columns = [rates.error_rate(*[rates.total(f"{k}_{p}") for k in "SDIN"]).alias(f"rate_{p}") for p in prefixes]
    g = scored.groupingSets([(F.col(by),), ()], F.col(by)).agg(F.grouping_id().alias("_whole"), F.count("*").alias("n"), *columns)
    return g.where(F.col(by).isNotNull() | (F.col("_whole") > 0)).drop("_whole")


def _block(df: DataFrame, pair: str) -> list[Column]:
    _need(df, [f"{k}_{pair}" for k in "SDICN"])
    t = {k: rates.total(f"{k}_{pair}") for k in "SDICN"}
    wer = rates.error_rate(t["S"], t["D"], t["I"], t["N"])
    acc = 100.0 * rates.ratio(t["C"], t["N"])
    return [wer.alias(f"WER_{pair}"), acc.alias(f"ACC_{pair}"), *[t[k].cast("long").alias(f"{k}_{pair}") for k in "SDICN"]]


def pair_summary(scored: DataFrame, pair: str, by: list[str] | None = None) -> DataFrame:
    """WER, ACC and summed counts of one comparison, over all rows or for each group (null groups kept)."""
    return scored.groupBy(*(by or [])).agg(*_block(scored, pair))


def speaker_summary(scored: DataFrame, pair: str) -> DataFrame:
    """:func:`pair_summary` for each learner, with a first row for all, in one pass."""
    g = scored.groupingSets([(F.col("learner_id"),), ()], F.col("learner_id")).agg(F.grouping("learner_id").alias("is_global"), *_block(scored, pair))
    return g.withColumn("learner_id", F.when(F.col("is_global") == 1, GLOBAL).otherwise(F.col("learner_id"))).orderBy(F.desc("is_global"), "learner_id").drop("is_global")


def macro_summary(categorised: DataFrame, pair: str, with_sub: bool = False) -> DataFrame:
    """:func:`pair_summary` for each learner and category; rows without a category are left out."""
    by = ["learner_id", "macro_category"] + (["sub_category"] if with_sub else [])
    return pair_summary(categorised.where(F.col("macro_category").isNotNull()), pair, by)


def placed_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Summed TP, FP and FN of placed errors by kind, with rates that are null without a denominator."""
    return scored.groupBy(*(by or [])).agg(*_placed())


def _placed() -> list[Column]:
    out = []
    for k in "SDI":
        t = [rates.total(f"{k}_{x}") for x in ("TP", "FP", "FN")]
        out += [c.cast("long").alias(f"{k}_{x}") for c, x in zip(t, ("TP", "FP", "FN"), strict=True)]
        out += [c.alias(f"{k}_{m}") for c, m in zip(rates.prf(*t, zero=False), ("Precision", "Recall", "F1"), strict=True)]
    return out


def placed_by_category(categorised: DataFrame) -> DataFrame:
    """:func:`placed_summary` over all rows, for each macro category and each sub category: one rollup.

    ``grain`` is overall, macro or sub. Rows without a category count overall only.
    """
    g = categorised.rollup("macro_category", "sub_category").agg(F.grouping_id().alias("_g"), *_placed())
    grain = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "macro").otherwise("sub")
    return g.where((F.col("_g") == 3) | F.col("macro_category").isNotNull()).withColumn("grain", grain).drop("_g")


def category_scores(scored: DataFrame, detailed: bool = False) -> DataFrame:
    """A row for each of the seven categories and for all rows ("global"), in report order.

    wer, mer; for passages and grids corr (of correct counts) and F1 by kind of mistake; for
    isolated items accuracy of telling wrong from right; with ``detailed`` also precisions,
    recalls and the line of the scatter plot. Categories without rows have nulls.
    """
    c_ref, c_hyp = F.col("C_can_ref"), F.col("C_can_hyp")
    wrong, said = c_ref == 0, c_hyp == 0
    cells = [F.count_if(wrong & said), F.count_if(~wrong & ~said), F.count_if(~wrong & said), F.count_if(wrong & ~said)]
    tp, tn, fp, fn = cells
    kinds = {k: rates.prf(*[rates.total(f"{k}_{x}") for x in ("tp", "fp", "fn")]) for k in FINE}
    p, r, f = rates.prf(tp, fp, fn)
    slope, intercept = rates.line(c_ref, c_hyp)
    columns = {"corr": rates.correlation(c_hyp, c_ref), **{f"{k}_f1": 100 * kinds[k][2] for k in FINE}}
    isolated = {"accuracy": 100 * rates.agreement(tp, tn, fp, fn)}
    if detailed:
        columns |= {f"{k}_{m}": 100 * kinds[k][i] for k in FINE for i, m in enumerate(("precision", "recall"))} | {"slope": slope, "intercept": intercept}
        isolated |= {"precision": 100 * p, "recall": 100 * r, "f1": 100 * f}
    base = {"wer": rates.error_rate(*[rates.total(f"{k}_ref_hyp") for k in "SDIN"]), "mer": rates.error_rate(*[rates.total(f"{k}_mer") for k in "SDIN"])}
    every = base | columns | isolated
    g = scored.groupingSets([(F.col("audio_type"),), ()], F.col("audio_type")).agg(F.grouping_id().alias("_whole"), F.count("*").alias("n"), *[v.alias(k) for k, v in every.items()])
    name = F.when(F.col("_whole") > 0, "global").otherwise(F.col("audio_type"))
    g = g.withColumn("category", name)
    order = _order(scored.sparkSession)
    out = order.join(g, "category", "left")
    of = lambda names, c: F.when(F.col("category").isin(*names), F.col(c)).alias(c)
    return out.select("place", "category", F.coalesce("n", F.lit(0)).alias("n"), "wer", "mer", *[of(GRADED, c) for c in columns], *[of(ISOLATED, c) for c in isolated]).orderBy("place").drop("place")


def _order(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{c}')" for i, c in enumerate(("global", *CATEGORIES)))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(place, category)")


def long_scores(wide: DataFrame) -> DataFrame:
    """(category, metric, value) of :func:`category_scores`, without nulls."""
    metrics = [c for c in wide.columns if c not in ("category", "n")]
    return wide.unpivot(["category"], metrics, "metric", "value").where("value is not null")


def global_v1(scored: DataFrame) -> DataFrame:
    """The older profile's eleven overall metrics, as one row."""
    t = {p: {k: rates.total(f"{k}_{p}") for k in "SDICN"} for p in PAIRS}
    acc = lambda p: 100.0 * rates.ratio(t[p]["C"], t[p]["N"])
    return scored.agg(
        t["can_ref"]["C"].alias("EGRA-COR"), acc("can_ref").alias("EGRA-ACC"), t["can_hyp"]["C"].alias("ASR-EGRA-COR"), acc("can_hyp").alias("ASR-EGRA-ACC"),
        rates.mean("MAE_EGRA_COR").alias("MAE_EGRA_COR"), (100 * rates.mean("MAE_EGRA_ACC")).alias("MAE_EGRA_ACC"), rates.mean("Bias_Baseline_MAE").alias("Bias_Baseline_MAE"),
        rates.mean("MER").alias("MER"), rates.mean("Mistakes_F1").alias("Mistakes_F1"), rates.error_rate(*[t["ref_hyp"][k] for k in "SDIN"]).alias("ASR_WER"),
        rates.correlation(F.col("C_can_ref"), F.col("C_can_hyp")).alias("r_correlation"),
    )


def baselines(flag: Column) -> dict[str, Column]:
    """Precision, recall and F1 of predicting no mistake ever, and always one."""
    n, hits = F.count(flag).cast("double"), F.sum(flag.cast("int")).cast("double")
    p = rates.ratio_or_zero(hits, n)
    r = F.when(hits > 0, 1.0).otherwise(0.0)
    zero = F.lit(0.0)
    return {"none_prec": zero, "none_r": zero, "none_f1": zero, "all_prec": p, "all_r": r, "all_f1": rates.ratio_or_zero(2 * p * r, p + r)}


def task_blocks_v1(categorised: DataFrame) -> DataFrame:
    """The older profile's block for each task (macro, sub) of a category, in one pass."""
    hit = [sum((rates.total(f"{k}_{x}") for k in "DI"), rates.total(f"S_{x}")) for x in ("TP", "FP", "FN")]
    p, r, f = rates.prf(*hit)
    wrong = (F.coalesce("S_can_ref", F.lit(0)) + F.coalesce("D_can_ref", F.lit(0)) + F.coalesce("I_can_ref", F.lit(0))) > 0
    kinds = {}
    for k, name in (("S", "subs"), ("D", "del"), ("I", "insert")):
        for m, c in zip(("prec", "r", "f1"), rates.prf(*[rates.total(f"{k}_{x}") for x in ("TP", "FP", "FN")]), strict=True):
            kinds[f"{name}_{m}"] = c
    every = {
        "mean_wer_ref_hyp": rates.mean("WER_ref_hyp"), "r_correlation": rates.correlation(F.col("C_ref_hyp"), F.col("C_can_ref")), "MAE_correct_counts": rates.mean("MAE_EGRA_COR"), "MER": rates.mean("MER"),
        **kinds, "mistakes_prec": p, "mistakes_r": r, "mistakes_f1": f, **{f"baseline_{k}": v for k, v in baselines(wrong).items()},
    }
    return categorised.where(F.col("macro_category").isNotNull()).groupBy("macro_category", "sub_category").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in every.items()])


def walkthrough(scored: DataFrame, audio_type: str = "passage", order: str = "ord", steps: int = 30) -> DataFrame:
    """One row of a type, a recognised one if there is any, with the first steps of its alignments."""
    from lectern.functions.align import aligned_tokens
    from lectern.functions.text import is_blank, normalize

    heard = ~is_blank(F.col("HYP"))
    one = scored.where(F.lower("audio_type").contains(audio_type)).orderBy(F.when(heard, 0).otherwise(1), order).limit(1)
    both = one.withColumns({"_r": aligned_tokens(normalize(F.col("CAN")), normalize(F.col("REF"))), "_h": aligned_tokens(normalize(F.col("CAN")), normalize(F.col("HYP")))})
    cut = lambda c: F.slice(c, 1, steps)
    return both.select("learner_id", "audio_file", "CAN", "REF", "HYP", cut("_r").alias("can_to_ref"), cut("_h").alias("can_to_hyp"), F.greatest(F.size("_r") - steps, F.lit(0)).alias("omitted_ref"), F.greatest(F.size("_h") - steps, F.lit(0)).alias("omitted_hyp"))


def tag_frequencies(tagged: DataFrame, tags_col: str, *by: str) -> DataFrame:
    """(by..., tag, n) of a column of tag sequences."""
    return tagged.select(*by, F.explode(F.filter(F.split(F.col(tags_col), ""), lambda t: t != "")).alias("tag")).groupBy(*by, "tag").agg(F.count("*").alias("n"))


def corpus_error_rate(pairs: DataFrame, truth: str, test: str, characters: bool = False) -> DataFrame:
    """One row: summed distance over summed length, by words or characters, and both sums."""
    from lectern.functions.align import error_counts

    if characters:
        d = pairs.select(F.levenshtein(F.col(truth), F.col(test)).alias("e"), F.length(truth).alias("n"))
    else:
        c = error_counts(F.col(truth), F.col(test))
        d = pairs.select(c.alias("c")).select((F.col("c.S") + F.col("c.D") + F.col("c.I")).alias("e"), F.col("c.N").alias("n"))
    return d.agg(rates.total("e").cast("long").alias("errors"), rates.total("n").cast("long").alias("length"), rates.ratio(F.sum("e"), F.sum("n")).alias("rate"))


def punctuation_error_rate(pairs: DataFrame, truth: str, test: str, marks: str = ".,?") -> DataFrame:
    """One row: error rate over the sequences of punctuation marks alone."""
    only = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.col(c), "[^" + "".join("\\" + m for m in marks) + "]", ""), "(.)", "$1 "))
    return corpus_error_rate(pairs.select(only(truth).alias("t"), only(test).alias("h")), "t", "h")


def within_tolerance(rate: DataFrame, column: str, tolerance: float) -> DataFrame:
    """``rate``, failing when it is read if the column exceeds the tolerance."""
    return rate.withColumn(column, F.when(F.col(column) > tolerance, F.raise_error(F.concat(F.lit(f"{column} exceeds {tolerance}: "), F.col(column).cast("string"))).cast("double")).otherwise(F.col(column)))


def real_time_factor(transcribed: DataFrame, seconds: float) -> DataFrame:
    return transcribed.agg(rates.total("duration").alias("audio_seconds"), (rates.total("duration") / F.lit(seconds)).alias("rtfx"))


def dashboard(scored: DataFrame, regions: list[str] = (), genders: list[str] = (), grades: list[str] = (), age: int | None = None, detailed: bool = False) -> DataFrame:
    """:func:`category_scores` of the rows that pass the filters; an empty filter passes all."""
    return category_scores(filtered(scored, regions, genders, grades, age), detailed)


def filtered(scored: DataFrame, regions=(), genders=(), grades=(), age=None) -> DataFrame:
    for column, values in (("region", regions), ("gender", genders), ("child_grade", grades)):
        if values:
            scored = scored.where(F.col(column).isin(*values))
    return scored if age is None else scored.where(F.col("child_age") == age)


def options(scored: DataFrame, column: str) -> DataFrame:
    """The values a filter can take, in order."""
    return scored.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def overview(scored: DataFrame) -> DataFrame:
    """Rows and learners."""
    return scored.agg(F.count("*").alias("rows"), F.countDistinct("learner_id").alias("learners"))
