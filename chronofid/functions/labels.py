"""Category labels, join keys and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.functions.numeric import col, is_whole, to_double

# Texts read as booleans, and the token that stands for a missing value.
TRUE_TEXT = ["true", "1", "1.0"]
FALSE_TEXT = ["false", "0", "0.0"]
MISSING = "__NA__"


def plain_label(c: str | Column) -> Column:
    return F.trim(col(c).cast("string"))


def whole_label(c: str | Column) -> Column:
    """Label of a whole number without its decimal part; other values keep their text."""
    number = to_double(c)
    return F.when(number.isNotNull() & is_whole(number), F.rint(number).cast("long").cast("string")).otherwise(
        plain_label(c)
    )


def boolean_label(c: str | Column) -> Column:
    text = F.lower(plain_label(c))
    return F.when(text.isin(TRUE_TEXT), "True").when(text.isin(FALSE_TEXT), "False").otherwise(plain_label(c))


def label_kinds(real: DataFrame, cats: list[str]) -> dict[str, str]:
    """Decide from the real rows alone how each column is labelled: boolean, whole or plain."""
    checks = []
    for c in cats:
        text = F.lower(plain_label(c))
        numeric = real.schema[c].dataType.typeName() in ("float", "double")
        checks.append(F.bool_and(text.isin(TRUE_TEXT + FALSE_TEXT)).alias(f"{c}|boolean"))
        checks.append((F.bool_and(is_whole(to_double(c))) if numeric else F.lit(False)).alias(f"{c}|whole"))
    row = real.agg(*checks).first()
    return {
        c: "boolean" if row[f"{c}|boolean"] else "whole" if row[f"{c}|whole"] else "plain" for c in cats
    }


def align_labels(pair: DataFrame, cats: list[str], synth: str = "is_synth") -> DataFrame:
    """Give both sides the labels the real side calls for."""
    kinds = label_kinds(pair.where(~F.col(synth)), cats)
    make = {"boolean": boolean_label, "whole": whole_label, "plain": plain_label}
    return pair.withColumns({c: make[kinds[c]](c) for c in cats})


def join_key(c: str | Column) -> Column:
    """Key text on which integers, whole floats and strings agree."""
    return whole_label(c)


def token(c: str | Column) -> Column:
    """Stable token of a value: whole floats as integers, null as a marker."""
    number = col(c).try_cast("double")
    text = F.when(number == F.rint(number), number.cast("long").cast("string")).otherwise(col(c).cast("string"))
    return F.coalesce(text, F.lit(MISSING))


def alpha_rank(c: str | Column) -> Column:
    """Letters read as a whole base-26 number (a=1 … z=26, aa=27); -1 if any other character occurs.

    Exact up to 26 letters; longer tokens have no number (null) but keep their place in ``alpha_order``.
    """
    whole = "decimal(38,0)"
    text = F.lower(col(c))
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    value = F.aggregate(letters, F.lit(0).cast(whole), lambda acc, x: (acc * 26 + F.ascii(x) - 96).cast(whole))
    fits = text.rlike("^[a-z]{1,26}$")
    return F.when(fits, value).when(text.rlike("^[a-z]+$"), F.lit(None)).otherwise(F.lit(-1)).cast(whole)


def alpha_order(c: str | Column) -> Column:
    """Sort key in the order of ``alpha_rank`` for tokens of any length: shorter ones first, then by letters."""
    text = F.lower(col(c))
    return F.when(text.rlike("^[a-z]+$"), F.struct(F.length(text).alias("n"), text.alias("t"))).otherwise(
        F.struct(F.lit(0).alias("n"), F.lit("").alias("t"))
    )


def column_token(text: str) -> str:
    """A category spelt with letters, digits and underscores only; different categories stay different.

    Any other character, the underscore too, becomes its code point in hexadecimal between underscores.
    """
    return "".join(ch if ch.isalnum() else f"_{ord(ch):x}_" for ch in text)


def indicators(c: str, categories: list[str]) -> dict[str, Column]:
    """A 0/1 column for each of ``categories`` and one for every other value; nulls read ``<NA>``.

    Column names don't tell upper from lower case, so a name that is taken gets the category's number as well.
    """
    value, out, taken = F.coalesce(col(c).cast("string"), F.lit("<NA>")), {}, {"other"}
    for number, category in enumerate(categories):
        name = column_token(category)
        while name.lower() in taken:
            name = f"{name}_{number}"
        taken.add(name.lower())
        out[f"{c}_is_{name}"] = value.eqNullSafe(F.lit(category)).cast("double")
    known = value.isin(categories) if categories else F.lit(False)
    return out | {f"{c}_is_OTHER": (~known).cast("double")}


def right_closed_bin(c: str | Column, edges: list[float]) -> Column:
    """Index of the bin ``(edge[i-1], edge[i]]`` a value falls into, open at both ends."""
    x = col(c)
    ladder = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(edges):
        ladder = ladder.when(x <= F.lit(float(edge)), i)
    return ladder.otherwise(len(edges))
