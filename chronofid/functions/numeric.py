"""Numeric casts and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: str | Column) -> Column:
    """Number or null: text that is no number and NaN both become null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_long(c: str | Column) -> Column:
    """Rounded (half to even) whole number or null."""
    return F.rint(to_double(c)).try_cast("long")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Null out NaN in every float column, since Spark averages propagate NaN."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def is_whole(c: str | Column) -> Column:
    """Whether a number equals its rounded value within the usual closeness tolerance."""
    x = col(c)
    return F.abs(x - F.rint(x)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.rint(x))


def bool_to_int(c: str | Column) -> Column:
    """``true``/``false`` text, booleans or numbers to 0/1; anything else counts as 0."""
    text = F.lower(col(c).cast("string"))
    number = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(to_double(c))
    return F.coalesce(number, F.lit(0.0)).cast("int")


def clip01(c: Column) -> Column:
    """Bound to [0, 1]; null stays null (``least``/``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
