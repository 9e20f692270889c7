"""Time parsing, composition and truncation. Sessions run in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.functions.numeric import col, to_double, to_long

# Digits a strftime directive takes (where that is certain), and its Spark pattern letter group.
DIRECTIVE_WIDTH = {"%Y": 4, "%y": 2, "%m": 2, "%d": 2, "%H": 2, "%M": 2, "%S": 2}
DIRECTIVE_PATTERN = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
    "%b": "MMM", "%B": "MMMM", "%f": "SSSSSS", "%I": "hh", "%p": "a", "%j": "DDD",
}


def format_parts(strftime: str) -> list[str]:
    """Directives and the literal text between them, in order."""
    return re.findall(r"%.|[^%]+", strftime)


def spark_pattern(strftime: str) -> str:
    """Translate a strftime format to a Spark datetime pattern; literal text is quoted."""
    out = []
    for part in format_parts(strftime):
        if part in DIRECTIVE_PATTERN:
            out.append(DIRECTIVE_PATTERN[part])
        elif part.startswith("%") and part != "%%":
            raise ValueError(f"no pattern for {part!r} in {strftime!r}")
        else:
            text = "%" if part == "%%" else part
            out.append("'" + text.replace("'", "''") + "'")
    return "".join(out)


def parse_time(c: str | Column, fmt: str | None = None) -> Column:
    """Timestamp by ``fmt`` (strftime), then by the general parser; bad text becomes null."""
    text = col(c).cast("string")
    general = text.try_cast("timestamp_ntz")
    if fmt is None:
        return general
    exact = F.try_to_timestamp(text, F.lit(spark_pattern(fmt))).cast("timestamp_ntz")
    return F.coalesce(exact, general)


def parse_rate(df: DataFrame, c: str, fmt: str | None = None) -> float:
    """Share of non-null values that parse as a time."""
    parsed = parse_time(c, fmt).isNotNull().cast("double")
    rate = df.agg(F.avg(F.when(F.col(c).isNotNull(), parsed))).first()[0]
    return 0.0 if rate is None else rate


def coerce_time(df: DataFrame, c: str, fmt: str | None = None, min_rate: float = 0.8) -> DataFrame:
    """Turn a text column into timestamps if at least ``min_rate`` of it parses, else leave it."""
    if df.schema[c].dataType.typeName() != "string":
        return df
    if parse_rate(df, c, fmt) >= min_rate:
        return df.withColumn(c, parse_time(c, fmt))
    return df


def convert_time(df: DataFrame, c: str, fmt: str | None = None) -> DataFrame:
    """Turn text into timestamps, or into numbers if not one value parses as a time; other types stay."""
    if df.schema[c].dataType.typeName() != "string":
        return df
    any_time = df.agg(F.bool_or(parse_time(c, fmt).isNotNull())).first()[0]
    return df.withColumn(c, parse_time(c, fmt) if any_time else to_double(c))


def seconds(c: str | Column) -> Column:
    """Timestamp as Unix seconds with microsecond fraction."""
    return F.unix_micros(col(c).cast("timestamp")) / F.lit(1e6)


def ymd(year: str | Column, month: str | Column, day: str | Column, base: int = 0) -> Column:
    """Date from parts, ``base`` added to years below 100; impossible or missing parts give null."""
    y = to_long(year)
    y = F.when((y >= 0) & (y < 100), y + base).otherwise(y)
    text = F.format_string("%04d-%02d-%02d", y, to_long(month), to_long(day))
    known = y.isNotNull() & to_long(month).isNotNull() & to_long(day).isNotNull() & (y >= 0)
    return F.when(known, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def month_day(month: str | Column, day: str | Column) -> Column:
    """``MM-DD`` text, whose lexicographic order is the time order; null if a part is missing."""
    m, d = to_long(month), to_long(day)
    return F.when(m.isNotNull() & d.isNotNull(), F.format_string("%02d-%02d", m, d))


def digits_to_time(c: str | Column, fmt: str, numeric: bool = False) -> Column:
    """Parse dates stored as packed digits, keeping the end of the text if the year comes last.

    ``numeric`` columns are rounded first, so that ``19950101.0`` reads as eight digits. A format that has more than
    directives of fixed width is parsed as it stands.
    """
    directives = format_parts(fmt)
    text = F.trim((to_long(c) if numeric else col(c)).cast("string"))
    if not directives or not all(d in DIRECTIVE_WIDTH for d in directives):
        return parse_time(text, fmt)
    width = sum(DIRECTIVE_WIDTH[d] for d in directives)
    digits = F.regexp_replace(text, r"\D", "")
    year_last = directives[-1] in ("%Y", "%y") and directives[0] not in ("%Y", "%y")
    kept = F.right(digits, F.lit(width)) if year_last else F.left(digits, F.lit(width))
    packed = F.lpad(kept, width, "0")
    exact = F.try_to_timestamp(packed, F.lit(spark_pattern(fmt))).cast("timestamp_ntz")
    return F.coalesce(exact, text.try_cast("timestamp_ntz"))


def floor_time(c: str | Column, width_seconds: int) -> Column:
    """Floor to multiples of a width counted from the Unix epoch, as whole seconds."""
    return (F.floor(F.unix_seconds(col(c).cast("timestamp")) / width_seconds) * width_seconds).cast("long")


def day_of(c: str | Column) -> Column:
    return F.date_trunc("day", col(c)).cast("date")


def month_of(c: str | Column) -> Column:
    return F.date_trunc("month", col(c)).cast("date")


def month_number(c: str | Column) -> Column:
    """``year * 100 + month``, the form time takes as a model feature."""
    return F.year(col(c)) * 100 + F.month(col(c))
