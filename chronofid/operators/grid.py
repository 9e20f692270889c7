"""Grid points of spans, unrolled in chunks so that no row holds a whole span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofid.operators.ordered import ordered

#: Grid points that one chunk of a span unrolls to.
CHUNK = 4096


def unrolled(spans: DataFrame, keep: list[str], steps: Column, name: str) -> DataFrame:
    """``keep`` and ``name`` = 0 to ``steps`` of every span; spans with negative ``steps`` have no rows.

    A span becomes its chunks first, and a chunk its points. If any span is longer than a chunk, the chunks are dealt out anew, so
    that one endless span does not stay with one task.
    """
    sized = spans.select(*keep, steps.cast("long").alias("_steps")).where("_steps >= 0")
    longest = sized.agg(F.max("_steps")).first()[0]
    chunks = sized.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, _steps div {CHUNK})")))
    if longest is not None and longest >= CHUNK:
        parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = chunks.repartition(parts, *keep, "_chunk")
    begin = f"_chunk * {CHUNK}"
    return chunks.select(*keep, F.explode(F.expr(f"sequence({begin}, least(_steps, {begin} + {CHUNK - 1}))")).alias(name))


def stepped(spans: DataFrame, keep: list[str], first: str, last: str, step: int | str, name: str) -> DataFrame:
    """``keep`` and the points ``first``, ``first`` + step, ... up to ``last`` as ``name``; ``step`` is a number, ``day`` or ``month``."""
    begin, end = F.col(first), F.col(last)
    if step == "month":
        # One too many at most: the end is checked below.
        steps = F.floor(F.months_between(end, begin)) + 1
        point = F.expr(f"{first} + make_ym_interval(0, CAST(_at AS INT))")
    elif step == "day" and isinstance(spans.schema[first].dataType, T.DateType):
        steps, point = F.datediff(end, begin), F.expr(f"date_add({first}, CAST(_at AS INT))")
    elif step == "day":
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        steps = F.floor((micros(end) - micros(begin)) / 86_400_000_000)
        point = F.expr(f"{first} + make_dt_interval(CAST(_at AS INT))")
    else:
        steps, point = F.floor((end - begin) / step), begin + F.col("_at") * step
    known = spans.where(begin <= end)
    points = unrolled(known, [*keep, first, last], steps, "_at")
    cast = point.cast(spans.schema[first].dataType).alias("_point")
    return points.select(*keep, last, cast).where(F.col("_point") <= F.col(last)).select(*keep, F.col("_point").alias(name))


def overlap(runs: DataFrame, cells: DataFrame, rows: int | None = None) -> DataFrame:
    """How runs of cells (``lo`` and the ``n`` cells from there) and single ``cells`` (``cell``) cover each other, in one row.

    ``total`` and ``support``: cells of all runs with and without repeats; ``shared``: those of the support that ``cells`` has;
    ``shared_mass``: their repeats among the runs; ``covered``: the sum of the lesser count of both. A run adds one at
    its start and takes one off after its end, so only its ends are rows, however long it is.
    """
    ends = runs.where("n > 0").select(F.explode(F.array(
        F.struct(F.col("lo").alias("cell"), F.lit(1).cast("long").alias("change")),
        F.struct((F.col("lo") + F.col("n")).alias("cell"), F.lit(-1).cast("long").alias("change")),
    )).alias("x")).select("x.*", F.lit(0).cast("long").alias("s"))
    single = cells.select(F.col("cell"), F.lit(0).cast("long").alias("change"), F.lit(1).cast("long").alias("s"))
    marks = ends.unionByName(single).groupBy("cell").agg(F.sum("change").alias("change"), F.sum("s").alias("s"))
    steps = ordered(marks, [], ["cell"], rows).running(r="change").lead(_next="cell").result().where("r > 0")
    here = F.col("s") > 0
    width = F.col("_next") - F.col("cell")
    return steps.agg(
        F.sum(F.col("r") * width).alias("total"),
        F.sum(F.least("r", "s")).alias("covered"),
        F.sum(width).alias("support"),
        F.sum(here.cast("long")).alias("shared"),
        F.sum(F.when(here, F.col("r"))).alias("shared_mass"),
    )
