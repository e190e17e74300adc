"""Reading-assessment tables derived from general ones, the same way in Spark and in SQL.

Readings are the lines of conversation turns: CAN is the normalised line, REF and HYP are
edited copies. Scored rows are made from order lines by arithmetic. File names are put
together from order lines. All rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import normalize, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edited(words: Column, drop: tuple[int, int], change: tuple[int, int, str], double: tuple[int, int]) -> Column:
    return F.flatten(
        F.transform(
            words,
            lambda x, i: F.when(i % drop[0] == drop[1], F.array().cast("array<string>"))
            .when(i % change[0] == change[1], F.array(F.concat(x, F.lit(change[2]))))
            .when(i % double[0] == double[1], F.array(x, x))
            .otherwise(F.array(x)),
        )
    )


REF_EDITS, HYP_EDITS = ((7, 3), (11, 5, "q"), (13, 8)), ((9, 4), (5, 2, "z"), (17, 6))
ROLE_TYPES = {"user": "passage_num1", "assistant": "syllables_grid_1", "system": "iso_letter_1"}


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(learner_id, audio_file, audio_type, canonical_text, ref_text, hyp_text, ord): one row for each line of each turn."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    d = d.repartition(spark.sparkContext.defaultParallelism)  # a table of one file would be scored by one task
    d = d.withColumn("can", tokens(normalize(F.col("line"))))
    kind = F.coalesce(*[F.when(F.col("role") == r, t) for r, t in ROLE_TYPES.items()], F.lit("unknown"))
    return d.select(
        F.concat(F.lit("L"), "conv_id").alias("learner_id"),
        F.concat(F.lit("L"), "conv_id", F.lit("-audio_"), "turn", F.lit("_"), "pos", F.lit(".wav")).alias("audio_file"),
        kind.alias("audio_type"), F.array_join("can", " ").alias("canonical_text"),
        F.array_join(_edited(F.col("can"), *REF_EDITS), " ").alias("ref_text"), F.array_join(_edited(F.col("can"), *HYP_EDITS), " ").alias("hyp_text"),
        (F.col("conv_id") * 1_000_000 + F.col("turn") * 10_000 + F.col("pos")).alias("ord"),
    )


def _sql_edited(drop: tuple[int, int], change: tuple[int, int, str], double: tuple[int, int]) -> str:
    return f"flatten(list_transform(can, lambda x, i: CASE WHEN (i - 1) % {drop[0]} = {drop[1]} THEN [] WHEN (i - 1) % {change[0]} = {change[1]} THEN [x || '{change[2]}'] WHEN (i - 1) % {double[0]} = {double[1]} THEN [x, x] ELSE [x] END))"


def sql_normalize(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(nfc_normalize({c})), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}''’À-ɏḀ-ỿ]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


SQL_READINGS = f"""
lines AS (SELECT conv_id, turn, role, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM conversations),
words AS (SELECT conv_id, turn, role, pos, list_filter(string_split({sql_normalize("line")}, ' '), lambda x: x <> '') AS can FROM lines),
readings AS (SELECT 'L' || conv_id AS learner_id, 'L' || conv_id || '-audio_' || turn || '_' || pos || '.wav' AS audio_file,
  CASE role WHEN 'user' THEN 'passage_passage' WHEN 'assistant' THEN 'syllables_grid' WHEN 'system' THEN 'letters_isolated' END AS category,
  CASE role WHEN 'user' THEN 'passage_num1' WHEN 'assistant' THEN 'syllables_grid_1' WHEN 'system' THEN 'iso_letter_1' ELSE 'unknown' END AS kind, conv_id * 1000000 + turn * 10000 + pos AS ord,
  can, {_sql_edited(*REF_EDITS)} AS ref, {_sql_edited(*HYP_EDITS)} AS hyp FROM words)"""


def sql_tags(truth: str, test: str) -> str:
    """The weighted aligner over two word lists: a fold over the test's words of folds over the truth's."""
    cells = "CAST([] AS STRUCT(c BIGINT, p VARCHAR)[])"
    return f"""list_reduce(list_concat(
  [{{'w': '', 's': list_transform(range(0, len({truth}) + 1), lambda jj: {{'c': jj * 3, 'p': repeat('d', jj)}})}}],
  list_transform({test}, lambda ww: {{'w': ww, 's': {cells}}})),
  lambda aa, tt: {{'w': tt.w, 's': list_reduce(list_concat(
    [{{'j': CAST(0 AS BIGINT), 'l': [{{'c': aa.s[1].c + 3, 'p': aa.s[1].p || 'i'}}]}}],
    list_transform(range(1, len({truth}) + 1), lambda jj: {{'j': jj, 'l': {cells}}})),
    lambda hh, xx: {{'j': xx.j, 'l': list_append(hh.l, CASE
      WHEN {truth}[xx.j] = tt.w AND aa.s[xx.j].c <= hh.l[-1].c + 3 AND aa.s[xx.j].c <= aa.s[xx.j + 1].c + 3 THEN {{'c': aa.s[xx.j].c, 'p': aa.s[xx.j].p || 'c'}}
      WHEN {truth}[xx.j] <> tt.w AND aa.s[xx.j].c + 4 < hh.l[-1].c + 3 AND aa.s[xx.j].c + 4 <= aa.s[xx.j + 1].c + 3 THEN {{'c': aa.s[xx.j].c + 4, 'p': aa.s[xx.j].p || 's'}}
      WHEN hh.l[-1].c + 3 <= aa.s[xx.j + 1].c + 3 THEN {{'c': hh.l[-1].c + 3, 'p': hh.l[-1].p || 'd'}}
      ELSE {{'c': aa.s[xx.j + 1].c + 3, 'p': aa.s[xx.j + 1].p || 'i'}} END)}}).l}}).s[-1].p"""


def sql_distance(truth: str, test: str) -> str:
    """Unit-cost edit distance of two word lists."""
    return f"""list_reduce(list_concat(
  [{{'w': '', 's': range(0, len({truth}) + 1)}}], list_transform({test}, lambda ww: {{'w': ww, 's': CAST([] AS BIGINT[])}})),
  lambda aa, tt: {{'w': tt.w, 's': list_reduce(list_concat(
    [{{'j': CAST(0 AS BIGINT), 'l': [aa.s[1] + 1]}}], list_transform(range(1, len({truth}) + 1), lambda jj: {{'j': jj, 'l': CAST([] AS BIGINT[])}})),
    lambda hh, xx: {{'j': xx.j, 'l': list_append(hh.l, least(hh.l[-1] + 1, aa.s[xx.j + 1] + 1, aa.s[xx.j] + CASE WHEN {truth}[xx.j] = tt.w THEN 0 ELSE 1 END))}}).l}}).s[-1]"""


def sql_middles(truth: str, test: str) -> tuple[str, str]:
    """Two word lists without what both begin and end with."""
    least = f"least(len({truth}), len({test}))"
    ahead = f"coalesce(list_filter(range(1, {least} + 1), lambda k: {truth}[k] <> {test}[k])[1] - 1, {least})"
    behind = f"coalesce(list_filter(range(1, {least} - {ahead} + 1), lambda k: {truth}[len({truth}) + 1 - k] <> {test}[len({test}) + 1 - k])[1] - 1, {least} - {ahead})"
    return tuple(f"list_slice({w}, {ahead} + 1, len({w}) - {behind})" for w in (truth, test))


def sql_edits(truth: str, test: str) -> str:
    """Edits of the unit-cost alignment of two word lists as :func:`sql_middles` leaves them, c, s, d or i each.

    Each cell knows the path to it: a deletion if that is on a shortest one, else an
    insertion if what it comes from is strictly nearer than the diagonal, else the diagonal.
    """
    cells = "CAST([] AS STRUCT(c BIGINT, p VARCHAR)[])"
    step = f"CASE WHEN {truth}[xx.j] = tt.w THEN 0 ELSE 1 END"
    return f"""list_reduce(list_concat(
  [{{'w': '', 's': list_transform(range(0, len({truth}) + 1), lambda jj: {{'c': jj, 'p': repeat('d', jj)}})}}],
  list_transform({test}, lambda ww: {{'w': ww, 's': {cells}}})),
  lambda aa, tt: {{'w': tt.w, 's': list_reduce(list_concat(
    [{{'j': CAST(0 AS BIGINT), 'l': [{{'c': aa.s[1].c + 1, 'p': aa.s[1].p || 'i'}}]}}],
    list_transform(range(1, len({truth}) + 1), lambda jj: {{'j': jj, 'l': {cells}}})),
    lambda hh, xx: {{'j': xx.j, 'l': list_append(hh.l, CASE
      WHEN hh.l[-1].c <= aa.s[xx.j + 1].c AND hh.l[-1].c + 1 <= aa.s[xx.j].c + {step} THEN {{'c': hh.l[-1].c + 1, 'p': hh.l[-1].p || 'd'}}
      WHEN aa.s[xx.j + 1].c < aa.s[xx.j].c THEN {{'c': aa.s[xx.j + 1].c + 1, 'p': aa.s[xx.j + 1].p || 'i'}}
      ELSE {{'c': aa.s[xx.j].c + {step}, 'p': aa.s[xx.j].p || CASE WHEN {truth}[xx.j] = tt.w THEN 'c' ELSE 's' END}} END)}}).l}}).s[-1].p"""


TYPES = ("full_letter_grid", "iso_letter_3", "iso_random_letters2_1", "full_syllable1_grid", "iso_syllable4", "rand_syllable5", "passage_num2")
CATEGORY_OF = ("letters_grid", "letters_isolated", "letters_isolated", "syllables_grid", "syllables_isolated", "syllables_isolated", "passage_passage")
MACRO_OF = (("letters", "grid"), ("letters", "isolated"), ("letters", "random"), ("syllables", "grid"), ("syllables", "isolated"), ("syllables", "random"), ("passage", "passage"))


def _counts() -> list[tuple[str, str]]:
    """(column, SQL) of every count, from the numbers of an order line."""
    out = []
    for k, pair in enumerate(("ref_hyp", "can_ref", "can_hyp", "mer")):
        out += [(f"S_{pair}", f"(l_partkey + {k}) % 5"), (f"D_{pair}", f"(l_suppkey + {k}) % 3"), (f"I_{pair}", f"(l_orderkey + {k}) % 4"), (f"C_{pair}", f"(l_partkey * {k + 3} + l_orderkey) % 6")]
        out.append((f"N_{pair}", f"(l_partkey + {k}) % 5 + (l_suppkey + {k}) % 3 + (l_partkey * {k + 3} + l_orderkey) % 6"))
    for k, name in enumerate(("sub", "ins", "del")):
        out += [(f"{name}_{x}", f"(l_partkey * {k + 2} + l_suppkey * {j + 1}) % {4 + j}") for j, x in enumerate(("tp", "fp", "fn"))]
    for k, name in enumerate("SDI"):
        out += [(f"{name}_{x}", f"(l_orderkey * {k + 2} + l_suppkey * {j + 1}) % {5 + j}") for j, x in enumerate(("TP", "FP", "FN"))]
    return out


def _sql_scored(array: str) -> str:
    pick = lambda names: f"{array}(" + ", ".join(f"'{n}'" for n in names) + ")" if array == "array" else "[" + ", ".join(f"'{n}'" for n in names) + "]"
    at = "l_linenumber - 1" if array == "array" else "l_linenumber"
    null = "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE {} END"  # rows without a canonical comparison
    cols = ", ".join(f"CAST({null.format(e) if c.endswith(('_can_ref', '_can_hyp')) else e} AS BIGINT) AS {c}" for c, e in _counts())
    item = f"({pick(TYPES)})[{at}]"
    return f"""SELECT 'L' || CAST(l_suppkey AS VARCHAR{'(20)' if array == 'array' else ''}) AS learner_id, {item} AS audio_type, ({pick(CATEGORY_OF)})[{at}] AS category,
  ({pick([m for m, _ in MACRO_OF])})[{at}] AS macro_category, ({pick([s for _, s in MACRO_OF])})[{at}] AS sub_category, {cols},
  l_extendedprice / 1000.0 AS price, l_returnflag AS region, l_linestatus AS gender FROM lineitem"""


SQL_SCORED = f"scored AS ({_sql_scored('list')})"


def scored(spark: SparkSession, sf_dir: str, by_category: bool = False) -> DataFrame:
    """Scored rows from order lines; with ``by_category`` the type is the report category."""
    d = spark.sql(_sql_scored("array").replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return d.drop("audio_type").withColumnRenamed("category", "audio_type") if by_category else d.drop("category")


NAMES = (
    "letters_grids_letters_grid", "non_words_grid_non_words_grid_segment2", "grid_syllables_1_syllables_grid_1", "iso_letter_", "iso_random_letters", "iso_non_word_", "iso_random_nw_ba_", "iso_random_nw", "iso_syllable_", "random_syl", "rand_syllable_", "passage_", "something",
)
#: What the type rules make of NAMES followed by a number n, and the category of that.
NAMED_TYPES = ("full_letter_grid", "full_nonword_grid", "full_syllable1_grid", "iso_letter_{}", "iso_random_letters{}", "iso_non_word{}", "iso_random_nw_ba_{}", "iso_random_nw_unknown", "iso_syllable{}", "random_syl{}", "rand_syllable{}", "passage_num{}", "unknown")
NAMED_CATEGORIES = ("letters_grid", "nonwords_grid", "syllables_grid", "letters_isolated", "letters_isolated", "nonwords_isolated", "nonwords_isolated", "nonwords_isolated", "syllables_isolated", "syllables_isolated", "syllables_isolated", "passage_passage", None)
