"""Shared table views for the catalogue, in Spark and in SQL. Even ids are real, odd ids synthetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofid.plans.roles import TableRoles

Query = Callable[[SparkSession, str], DataFrame]

EVENT_ROLES = TableRoles(
    key="user_id", time="ts", row="event_id", num_cols=["value", "k"], cat_cols=["event_type"]
)


class Catalogue:
    """Collects queries with their SQL; ``sql=None`` marks an operator SQL cannot express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                # The tables hold clock times without a zone; their seconds are counted in UTC.
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return rounded(query(spark, folder))

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def rounded(df: DataFrame) -> DataFrame:
    """Six decimals on every double, so that summation order cannot change a compared value."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    # Adding zero turns -0.0 into 0.0.
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in doubles})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return (
        table(spark, folder, "events")
        .withColumn("k", k)
        .withColumn("is_synth", F.col("event_id") % 2 == 1)
        .drop("props")
    )


def daily_events(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).withColumn("ts", F.date_trunc("day", "ts").cast("date"))


def sided(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    return table(spark, folder, name).withColumn("is_synth", F.col(key) % 2 == 1)


EV = """ev AS (
  SELECT event_id, ts, epoch_us(ts) / 1000000.0 AS t, CAST(ts AS DATE) AS day, user_id, event_type, value,
         CAST(regexp_extract(props, '-?[0-9]+') AS DOUBLE) AS k, event_id % 2 = 1 AS syn
  FROM events)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def ks_cte(name: str, source: str, keys: str, value: str) -> str:
    """CTE with one row per key: n_real, n_synth, ks, w1. ``keys`` is a comma list or empty."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_c AS (
  SELECT {k}{value} AS v, CAST(count(*) FILTER (NOT syn) AS DOUBLE) AS r, CAST(count(*) FILTER (syn) AS DOUBLE) AS s
  FROM {source} WHERE {value} IS NOT NULL GROUP BY {k}{value}),
{name}_f AS (
  SELECT {k}v, sum(r) OVER w / nullif(sum(r) OVER ({part}), 0) AS f, sum(s) OVER w / nullif(sum(s) OVER ({part}), 0) AS g,
         sum(r) OVER ({part}) AS n_real, sum(s) OVER ({part}) AS n_synth,
         lead(v) OVER ({part} ORDER BY v) - v AS gap
  FROM {name}_c WINDOW w AS ({part} ORDER BY v ROWS UNBOUNDED PRECEDING)),
{name} AS (
  SELECT {k}max(n_real) AS n_real, max(n_synth) AS n_synth, max(abs(f - g)) AS ks,
         sum(abs(f - g) * coalesce(gap, 0)) AS w1
  FROM {name}_f {group})"""


def tvd_cte(name: str, source: str, keys: str, cat: str) -> str:
    """CTE with one row per key: n_real, n_synth, tvd. Nulls count as a category."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_c AS (
  SELECT {k}{cat}, CAST(count(*) FILTER (NOT syn) AS DOUBLE) AS r, CAST(count(*) FILTER (syn) AS DOUBLE) AS s
  FROM {source} GROUP BY {k}{cat}),
{name} AS (
  SELECT {k}max(nr) AS n_real, max(ns) AS n_synth, 0.5 * sum(abs(r / nullif(nr, 0) - s / nullif(ns, 0))) AS tvd
  FROM (SELECT *, sum(r) OVER ({part}) AS nr, sum(s) OVER ({part}) AS ns FROM {name}_c) x {group})"""
