"""A point in a plan after which computed columns are plain values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Pass the rows through a one-row generator.

    The optimizer moves a filter below a projection by writing the projection's expressions into the filter. Over the
    detector's long chain of dependent columns that text grows with every step, until planning takes longer than the
    job. A filter on a generator's output stays above it. No shuffle, no copy to disk.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
