"""Long forms: one row per feature, so that one job scores every column."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.functions.numeric import to_double

FEATURE = "feature"
VALUE = "value"


def unpivot_numbers(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    """Rows ``(ids, feature, value)`` of the numeric columns; non-numbers become null."""
    kept = [F.col(c).alias(f"_id_{c}") for c in ids]
    wide = df.select(*kept, *[to_double(c).alias(c) for c in cols])
    return _restore(wide.unpivot([f"_id_{c}" for c in ids], cols, FEATURE, VALUE), ids)


def unpivot_labels(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    """Rows ``(ids, feature, value)`` of the category columns as text."""
    kept = [F.col(c).alias(f"_id_{c}") for c in ids]
    wide = df.select(*kept, *[F.col(c).cast("string").alias(c) for c in cols])
    return _restore(wide.unpivot([f"_id_{c}" for c in ids], cols, FEATURE, VALUE), ids)


def _restore(long: DataFrame, ids: list[str]) -> DataFrame:
    return long.withColumnsRenamed({f"_id_{c}": c for c in ids})


def pair_name(a: str, b: str) -> str:
    return f"{a} x {b}"


def unpivot_pairs(df: DataFrame, ids: list[str], pairs: list[tuple[str, str]], numbers: bool) -> DataFrame:
    """Rows ``(ids, feature, a, b)``, one per column pair."""

    def cast(c: str):
        return to_double(c) if numbers else F.col(c).cast("string")

    structs = [
        F.struct(F.lit(pair_name(x, y)).alias(FEATURE), cast(x).alias("a"), cast(y).alias("b")) for x, y in pairs
    ]
    return df.select(*ids, F.inline(F.array(*structs)))


def column_pairs(cols: list[str]) -> list[tuple[str, str]]:
    return list(combinations(cols, 2))


def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Distinct non-null values per column, through one two-step aggregation."""
    long = unpivot_labels(df, [], cols).where(F.col(VALUE).isNotNull()).distinct()
    rows = long.groupBy(FEATURE).agg(F.count(F.lit(1)).alias("n")).collect()
    found = {r[FEATURE]: r["n"] for r in rows}
    return {c: found.get(c, 0) for c in cols}
