"""Keep the first or last row of each key, by an explicit order.

dropDuplicates() does not say which row survives; where the survivor matters the order
column does. min_by/max_by over the whole row combine before the shuffle, unlike a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(pick(row, F.struct(*[F.col(o) for o in order])).alias("_row")).select("_row.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _kept(df, keys, order, False)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _kept(df, keys, order, True)


#: Columns that tell scored rows apart, as far as a table has them.
IDENTITY = ("learner_id", "audio_type", "audio_file", "CAN", "REF", "HYP", "canonical_text", "reference_text", "hypothesis_text")


def distinct_scored(df: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """Scored rows without repeats of the identifying columns, or of whole rows if it has none of them."""
    keys = [c for c in IDENTITY if c in df.columns]
    return keep_first(df, keys, order) if keys else df.distinct()
