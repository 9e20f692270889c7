"""Distances and class lists on array and map columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.functions.numeric import col


def _fold(a: str | Column, b: str | Column, term) -> Column:
    parts = F.zip_with(col(a), col(b), lambda x, y: term(x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return _fold(a, b, lambda d: d * d)


def l2_distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def l1_distance(a: str | Column, b: str | Column) -> Column:
    return _fold(a, b, F.abs)


def parse_code_map(c: str | Column) -> Column:
    """Read ``{'A': 100.0, 'B': 0.0}`` text into a map."""
    return F.from_json(col(c), "map<string,double>", {"allowSingleQuotes": "true"})


def class_text(df: DataFrame, key: str, codes: str, classes: DataFrame, code: str, label: str, out: str) -> DataFrame:
    """Map the keys of each record's code map to classes: sorted distinct classes joined with ``|``."""
    listed = df.select(key, F.explode(F.map_keys(F.col(codes))).alias("_code"))
    known = classes.select(F.col(code).alias("_code"), F.col(label).alias("_class")).groupBy("_code").agg(F.min("_class").alias("_class"))
    found = listed.join(known, "_code").groupBy(key).agg(F.array_sort(F.collect_set("_class")).alias("_set"))
    text = F.coalesce(F.array_join("_set", "|"), F.lit(""))
    return df.join(found, key, "left").withColumn(out, text).drop("_set")
