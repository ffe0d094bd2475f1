"""Missing values: NaN becomes NULL at ingest, and a comparison with a missing value is false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def nan_to_null(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n).cast("double")) for n in names})


def recover_unsigned(code: Column) -> Column:
    """A code above 127 that was stored as a signed byte."""
    return code.cast("int").bitwiseAND(F.lit(255))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, NULL when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def clip(value: Column, low, high) -> Column:
    """Clamp that keeps NULL (greatest/least alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
