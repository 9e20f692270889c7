"""Reading and writing tables, variants, shards and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofid.functions.numeric import nan_to_null
from chronofid.operators.ordered import same_keys

# Variants in order of preference when the wanted one is missing.
FALLBACKS = ["default", "raw", "real"]


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, row: str | None = "row_ix") -> DataFrame:
    """Read CSV or Parquet by extension and number the rows in file order.

    CSV columns are matched by header name, so files may order them differently. The row numbers rise in
    file order and are only dense within a partition.
    """
    lower = path.lower().rstrip("/")
    if lower.endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
        if schema is not None:
            df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns])
    elif lower.endswith((".csv", ".csv.gz")):
        df = spark.read.csv(path, header=True)
        if schema is not None:
            df = df.select(*[_typed(f).alias(f.name) for f in schema.fields if f.name in df.columns])
    else:
        raise ValueError(f"unsupported file type: {path}")
    df = nan_to_null(df)
    return df if row is None else df.withColumn(row, F.monotonically_increasing_id())


def _typed(f: T.StructField) -> Column:
    if isinstance(f.dataType, T.LongType):
        return F.col(f.name).try_cast("double").try_cast("long")
    return F.col(f.name).try_cast(f.dataType)


def read_shards(spark: SparkSession, paths: list[str], schema: T.StructType, limit: int | None = None) -> DataFrame:
    """Read headerless CSV shards, gzipped or not, with declared columns; ``limit`` caps the shards."""
    chosen = sorted(paths)[:limit]
    return spark.read.schema(schema).csv(chosen)


def pick_variant(df: DataFrame, keys: list[str], wanted: str) -> DataFrame:
    """Rows of the best available variant per key: the wanted one, else the fallbacks in order."""
    order = [wanted, *[v for v in FALLBACKS if v != wanted]]
    rank = F.coalesce(*[F.when(F.col("variant") == v, i) for i, v in enumerate(order)])
    ranked = df.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_best"))
    joined = ranked.alias("l").join(best.alias("r"), same_keys("l", "r", keys) & (F.col("_rank") == F.col("_best")), "left_semi")
    return joined.select("l.*").drop("_rank")


def read_variants(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Table stored under ``variant=…`` folders; a filter on ``variant`` prunes the folders read."""
    return spark.read.format(fmt).option("header", "true").load(root)


def write_variant(df: DataFrame, root: str, variant: str, fmt: str = "parquet") -> None:
    """Write one repaired table as a partition of its variants."""
    out = df.withColumn("variant", F.lit(variant)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("variant").format(fmt).option("header", "true").save(root)


def signal_rows(
    records: DataFrame, key: str, start: str, signal: str, step_seconds: float, lead: str = "lead"
) -> DataFrame:
    """Unroll a signal of steps by leads into rows ``(key, ts, step, lead_0, …, attributes)``.

    The attributes ride along through the unrolling, so they need no join. There are as many
    leads as the widest step of all records has; narrower steps give nulls.
    """
    widest = F.aggregate(F.col(signal), F.lit(0), lambda most, step: F.greatest(most, F.size(step)))
    width = max(0, records.agg(F.max(widest)).first()[0] or 0)
    rest = [c for c in records.columns if c not in (key, start, signal)]
    steps = records.select(key, start, *rest, F.posexplode(signal).alias("step", "_leads"))
    offset = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("step") * F.lit(step_seconds)).cast("decimal(18,6)"))
    leads = [F.get("_leads", F.lit(i)).cast("double").alias(f"{lead}_{i}") for i in range(width)]
    return steps.select(key, (F.col(start) + offset).alias("ts"), "step", *leads, *rest)
