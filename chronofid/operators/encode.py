"""Encoding a table against its real reference: codes, repaired dates, filled nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.functions.labels import indicators
from chronofid.functions.numeric import bool_to_int, to_double, to_long
from chronofid.functions.times import digits_to_time, month_number, parse_time
from chronofid.operators.ordered import ordered
from chronofid.operators.shape import FEATURE, VALUE, unpivot_labels
from chronofid.session import checkpointed

NUMERIC_SHARE = 0.95
#: Columns that the categories of one column may become.
MAX_INDICATORS = 10_000
UNKNOWN = -1
#: Values, and bytes of their text, up to which a vocabulary goes to every task.
SMALL_VALUES, SMALL_BYTES = 100_000, 8 << 20


def vocabulary(reference: DataFrame, c: str, missing: str | None = None) -> DataFrame:
    """Distinct reference values as text with their zero-based rank."""
    text = F.col(c).cast("string")
    values = reference.select((text if missing is None else F.coalesce(text, F.lit(missing))).alias("_value"))
    distinct = values.where(F.col("_value").isNotNull()).distinct()
    return ordered(distinct, [], ["_value"], reference.count()).numbered("_code").result()


def category_codes(df: DataFrame, reference: DataFrame, c: str, missing: str | None = None) -> DataFrame:
    """Replace a category by its rank among the reference values; unseen values give -1."""
    text = F.col(c).cast("string")
    value = text if missing is None else F.coalesce(text, F.lit(missing))
    known = checkpointed(vocabulary(reference, c, missing))
    n, size = known.agg(F.count("_code"), F.sum(F.octet_length("_value"))).first()
    # With few values a shuffle by value would bring most rows to a few tasks.
    if n <= SMALL_VALUES and (size or 0) <= SMALL_BYTES:
        known = F.broadcast(known)
    joined = df.withColumn("_value", value).join(known, "_value", "left")
    return joined.withColumn(c, F.coalesce("_code", F.lit(UNKNOWN)).cast("int")).select(*df.columns)


def mostly_numeric(df: DataFrame, cols: list[str]) -> dict[str, bool]:
    row = df.agg(*[F.avg(to_double(c).isNotNull().cast("double")).alias(c) for c in cols]).first()
    return {c: (row[c] or 0.0) > NUMERIC_SHARE for c in cols}


def encode_values(df: DataFrame, reference: DataFrame, cols: list[str]) -> DataFrame:
    """Numbers where nearly all values of both tables are numbers, else category codes."""
    here, there = mostly_numeric(df, cols), mostly_numeric(reference, cols)
    for c in cols:
        if here[c] and there[c]:
            df = df.withColumn(c, F.coalesce(to_double(c), F.lit(float(UNKNOWN))))
        else:
            df = category_codes(df, reference, c, missing="<NA>").withColumn(c, F.col(c).cast("double"))
    return df


def reference_categories(reference: DataFrame, c: str) -> list[str]:
    """Sorted categories of the reference. They become columns, so more than ``MAX_INDICATORS`` are refused."""
    text = F.coalesce(F.col(c).cast("string"), F.lit("<NA>")).alias("v")
    found = [r["v"] for r in reference.select(text).distinct().limit(MAX_INDICATORS + 1).collect()]
    if len(found) > MAX_INDICATORS:
        raise ValueError(f"{c} has over {MAX_INDICATORS} categories; name those that should become columns, or use sparse_indicators")
    return sorted(found)


def expand_categories(df: DataFrame, reference: DataFrame, cats: list[str], declared: dict[str, list[str]] | None = None) -> DataFrame:
    """Indicator columns per category, declared or of the reference, and one for all other values."""
    columns = {}
    for c in cats:
        known = (declared or {}).get(c)
        columns.update(indicators(c, reference_categories(reference, c) if known is None else known))
    return df.withColumns(columns).drop(*cats)


def category_dictionary(reference: DataFrame, cats: list[str]) -> DataFrame:
    """``column, category, category_id``: the reference categories of each column, nulls reading ``<NA>``, numbered from 0 by name.

    The dictionary is a table like any other; it may hold any number of categories and is never brought to one place.
    """
    values = unpivot_labels(reference, [], cats).select(F.col(FEATURE).alias("column"), F.coalesce(VALUE, F.lit("<NA>")).alias("category"))
    return ordered(values.distinct(), ["column"], ["category"]).numbered("category_id").result()


def sparse_indicators(df: DataFrame, reference: DataFrame, ids: list[str], cats: list[str], dictionary: DataFrame | None = None) -> DataFrame:
    """``ids, column, category_id, indicator``: the one indicator of each row and column that is 1, in long form.

    ``expand_categories`` makes a column of each category, which suits the few that are declared; this form has one row per
    cell however many categories there are. A value outside the dictionary has the id -1, the place of all other values.
    """
    known = category_dictionary(reference, cats) if dictionary is None else dictionary
    cells = unpivot_labels(df, ids, cats).withColumn(VALUE, F.coalesce(VALUE, F.lit("<NA>")))
    names = known.select(F.col("column").alias(FEATURE), F.col("category").alias(VALUE), "category_id")
    placed = cells.join(names, [FEATURE, VALUE], "left")
    place = F.coalesce("category_id", F.lit(UNKNOWN)).cast("long").alias("category_id")
    return placed.select(*ids, F.col(FEATURE).alias("column"), place, F.lit(1.0).alias("indicator"))


def dates_by_rank(df: DataFrame, reference: DataFrame, c: str) -> DataFrame:
    """Map texts that are no dates onto the reference dates by rank.

    The smallest text takes the first reference date, the largest the last, the others evenly between.
    """
    raw = df.where(F.col(c).isNotNull()).select(F.col(c).alias("_raw")).distinct()
    ref = reference.where(F.col(c).isNotNull()).select(F.col(c).alias("_date")).distinct()
    n_raw, n_ref = raw.count(), ref.count()
    places = ordered(raw, [], ["_raw"], n_raw).numbered("_i").result()
    dates = ordered(ref, [], ["_date"], n_ref).numbered("_at").result()
    step = (n_ref - 1) / (n_raw - 1) if n_raw > 1 else 0.0
    target = F.when(F.col("_i") == n_raw - 1, F.lit(float(n_ref - 1) if n_raw > 1 else 0.0)).otherwise(F.col("_i") * F.lit(step))
    mapping = places.withColumn("_at", F.rint(target).cast("long")).join(dates, "_at").select("_raw", "_date")
    return df.join(mapping, df[c] == mapping["_raw"], "left").withColumn(c, F.col("_date")).select(*df.columns)


def repair_dates(df: DataFrame, reference: DataFrame, c: str, fmt: str | None = None) -> DataFrame:
    """Parse what parses; map the rest onto the reference dates by rank."""
    parsed = df.withColumn("_parsed", parse_time(c, fmt))
    rest = parsed.withColumn("_rest", F.when(F.col("_parsed").isNull(), F.col(c)))
    real = reference.select(parse_time(c, fmt).alias("_rest"))
    mapped = dates_by_rank(rest, real, "_rest")
    return mapped.withColumn(c, F.coalesce("_parsed", F.col("_rest").cast("timestamp_ntz"))).select(*df.columns)


def encode_dates(df: DataFrame, reference: DataFrame, c: str, fmt: str) -> DataFrame:
    """Parse dates; texts that are none are mapped onto the reference dates by rank before anything else sees them."""
    parsed = lambda frame: digits_to_time(c, fmt, frame.schema[c].dataType.typeName() != "string")
    read = df.withColumn("_parsed", parsed(df))
    if read.where(F.col(c).isNotNull() & F.col("_parsed").isNull()).isEmpty():
        return df.withColumn(c, parsed(df))
    typed = reference.schema[c].dataType.typeName().startswith(("timestamp", "date"))
    real = reference.select((F.col(c).cast("timestamp_ntz") if typed else parsed(reference)).alias("_rest"))
    if real.where(F.col("_rest").isNotNull()).isEmpty():
        raise ValueError(f"{c} holds texts that are no dates, and the reference has no dates to put in their place")
    rest = read.withColumn("_rest", F.when(F.col("_parsed").isNull(), F.col(c)))
    return dates_by_rank(rest, real, "_rest").withColumn(c, F.coalesce("_parsed", F.col("_rest").cast("timestamp_ntz"))).select(*df.columns)


def encode_table(df: DataFrame, reference: DataFrame, columns: dict[str, dict]) -> DataFrame:
    """Encode every declared column by its ``sdtype``; ids stay."""
    plain = {}
    for c, info in columns.items():
        if c not in df.columns:
            continue
        kind = info.get("sdtype")
        whole = str(info.get("computer_representation", "")).startswith("Int")
        typed = df.schema[c].dataType.typeName()
        if kind in ("numerical", "float", "integer"):
            plain[c] = to_long(c) if whole else to_double(c)
        elif kind == "boolean":
            plain[c] = bool_to_int(c)
        elif kind == "datetime" and not typed.startswith(("timestamp", "date")):
            plain[c] = digits_to_time(c, info["datetime_format"], typed != "string")
    for c in [c for c, info in columns.items() if c in plain and info.get("sdtype") == "datetime"]:
        df = encode_dates(df, reference, c, columns[c]["datetime_format"])
        del plain[c]
    df = df.withColumns(plain)
    for c, info in columns.items():
        if c in df.columns and info.get("sdtype") == "categorical":
            df = category_codes(df, reference, c)
    return df


def fill_nulls(df: DataFrame, columns: dict[str, dict]) -> DataFrame:
    """Column mean for numbers (rounded for whole ones), ``?`` for categories, ``@`` for the rest."""
    present = {c: i for c, i in columns.items() if c in df.columns}
    nums = [c for c, i in present.items() if i.get("sdtype") in ("numerical", "float", "integer")]
    cats = [c for c, i in present.items() if i.get("sdtype") in ("categorical", "boolean")]
    rest = [c for c in present if c not in nums and c not in cats]
    df = df.withColumns({c: to_double(c) for c in nums})
    if nums:
        means = df.agg(*[F.avg(c).alias(c) for c in nums]).first().asDict()
        df = df.na.fill({c: m for c, m in means.items() if m is not None})
        df = df.withColumns({c: to_long(c) for c in nums if present[c].get("computer_representation") == "Int64"})
    return df.withColumns(
        {**{c: F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in cats},
         **{c: F.coalesce(F.col(c).cast("string"), F.lit("@")) for c in rest}}
    )


def model_frame(df: DataFrame, drop: list[str]) -> DataFrame:
    """Feature columns only: named ones dropped, times as year and month number."""
    kept = df.drop(*drop)
    times = [f.name for f in kept.schema.fields if f.dataType.typeName().startswith(("timestamp", "date"))]
    return kept.withColumns({c: month_number(c) for c in times})


def varying(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with more than one value, nulls counting as a value."""
    checks = []
    for c in cols:
        one = (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))
        checks.append(F.coalesce(one, F.lit(False)).alias(c))
    row = df.agg(*checks).first()
    return [c for c in cols if row[c]]
