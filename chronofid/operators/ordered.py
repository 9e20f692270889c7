"""Row-order operators (lag, lead, running sums, fills) that survive a hot key.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. When the input has at most
``segmentRows`` rows no group can exceed that, and the plain window is the best plan. Beyond it, keys
with more than half as many rows are cut into ordered pieces of an eighth at sampled split points, so that
a large key keeps many tasks busy and none of them holds much. The window runs
per segment, and what crosses a segment border (last value, sum so far, last non-null) comes from a
summary with one row per segment. Sampling only decides where the cuts fall, never the result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofid.session import MAX_SEGMENTS, checkpointed, segment_rows

SEG = "_seg"
SPLIT = "_split"
SAMPLES_PER_SEGMENT = 200
#: Pieces that as many rows as ``segmentRows`` are cut into, if a key is cut.
CUTS = 8


def same_keys(left: str, right: str, names: list[str]) -> Column:
    """Null-safe equality of key columns on two aliased frames."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


@dataclass(frozen=True)
class Ordered:
    """Rows grouped by ``keys`` and ordered by ``order``; ``split`` says whether hot keys are cut."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    split: bool = False

    @property
    def groups(self) -> list[str]:
        return [*self.keys, SEG] if self.split else list(self.keys)

    def window(self):
        return Window.partitionBy(*self.groups).orderBy(*self.order)

    def reverse(self):
        return Window.partitionBy(*self.groups).orderBy(*[F.desc(c) for c in self.order])

    def select(self, *cols: str | Column) -> DataFrame:
        return self.df.select(*cols)

    def result(self) -> DataFrame:
        return self.df.drop(SEG, SPLIT)

    def with_columns(self, **cols: Column) -> Ordered:
        return replace(self, df=self.df.withColumns(cols))

    def _position(self) -> Column:
        return F.struct(*self.order)

    def _carry(self, summary: list[Column], carried: dict[str, Column]) -> DataFrame:
        """Join one summary value per segment; only hot keys have any, at most MAX_SEGMENTS rows."""
        segments = self.df.where(SPLIT).groupBy(*self.groups).agg(*summary)
        table = segments.select(*self.groups, *[c.alias(n) for n, c in carried.items()])
        joined = self.df.alias("l").join(
            F.broadcast(table).alias("r"), same_keys("l", "r", self.groups), "left"
        )
        return joined.select("l.*", *[F.col(f"r.{n}") for n in carried])

    def _by_segment(self):
        return Window.partitionBy(*self.keys).orderBy(SEG)

    def lag(self, **cols: str) -> Ordered:
        """Previous row's value, one new column per ``name=source``."""
        w = self.window()
        if not self.split:
            return self.with_columns(**{n: F.lag(c).over(w) for n, c in cols.items()})
        last = [F.max_by(F.col(c), self._position()).alias(f"_{n}") for n, c in cols.items()]
        shift = {f"_{n}": F.lag(f"_{n}").over(self._by_segment()) for n in cols}
        df = self._carry(last, shift).withColumn("_first", F.row_number().over(w) == 1)
        df = df.withColumns(
            {n: F.when(F.col("_first"), F.col(f"_{n}")).otherwise(F.lag(c).over(w)) for n, c in cols.items()}
        )
        return replace(self, df=df.drop("_first", *shift))

    def lead(self, **cols: str) -> Ordered:
        """Next row's value, one new column per ``name=source``."""
        w = self.window()
        if not self.split:
            return self.with_columns(**{n: F.lead(c).over(w) for n, c in cols.items()})
        first = [F.min_by(F.col(c), self._position()).alias(f"_{n}") for n, c in cols.items()]
        shift = {f"_{n}": F.lead(f"_{n}").over(self._by_segment()) for n in cols}
        df = self._carry(first, shift).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
        df = df.withColumns(
            {n: F.when(F.col("_last"), F.col(f"_{n}")).otherwise(F.lead(c).over(w)) for n, c in cols.items()}
        )
        return replace(self, df=df.drop("_last", *shift))

    def running(self, **cols: str) -> Ordered:
        """Sum of ``source`` from the first row of the group up to this one."""
        w = self.window().rowsBetween(Window.unboundedPreceding, 0)
        if not self.split:
            return self.with_columns(**{n: F.sum(c).over(w) for n, c in cols.items()})
        before = self._by_segment().rowsBetween(Window.unboundedPreceding, -1)
        total = [F.sum(c).alias(f"_{n}") for n, c in cols.items()]
        carried = {f"_{n}": F.sum(f"_{n}").over(before) for n in cols}
        df = self._carry(total, carried)
        local = {n: F.sum(c).over(w) for n, c in cols.items()}
        df = df.withColumns({n: F.coalesce(x + F.col(f"_{n}"), x, F.col(f"_{n}")) for n, x in local.items()})
        return replace(self, df=df.drop(*carried))

    def numbered(self, name: str) -> Ordered:
        """Zero-based position within the group."""
        if not self.split:
            return self.with_columns(**{name: (F.row_number().over(self.window()) - 1).cast("long")})
        ones = replace(self, df=self.df.withColumn("_one", F.lit(1).cast("long")))
        out = ones.running(**{name: "_one"})
        return replace(out, df=out.df.withColumn(name, F.col(name) - 1).drop("_one"))

    def previous_known(self, **cols: str) -> Ordered:
        """Last non-null value at or before this row."""
        w = self.window().rowsBetween(Window.unboundedPreceding, 0)
        local = {n: F.last(c, ignorenulls=True).over(w) for n, c in cols.items()}
        if not self.split:
            return self.with_columns(**local)
        before = self._by_segment().rowsBetween(Window.unboundedPreceding, -1)
        known = [
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), self._position())).alias(f"_{n}")
            for n, c in cols.items()
        ]
        carried = {f"_{n}": F.last(f"_{n}", ignorenulls=True).over(before) for n in cols}
        df = self._carry(known, carried)
        df = df.withColumns({n: F.coalesce(x, F.col(f"_{n}")) for n, x in local.items()})
        return replace(self, df=df.drop(*carried))

    def next_known(self, **cols: str) -> Ordered:
        """First non-null value at or after this row.

        Runs over the reversed order: a frame open towards the end is recomputed for every row.
        """
        w = self.reverse().rowsBetween(Window.unboundedPreceding, 0)
        local = {n: F.last(c, ignorenulls=True).over(w) for n, c in cols.items()}
        if not self.split:
            return self.with_columns(**local)
        after = Window.partitionBy(*self.keys).orderBy(F.desc(SEG)).rowsBetween(Window.unboundedPreceding, -1)
        known = [
            F.min_by(F.col(c), F.when(F.col(c).isNotNull(), self._position())).alias(f"_{n}")
            for n, c in cols.items()
        ]
        carried = {f"_{n}": F.last(f"_{n}", ignorenulls=True).over(after) for n in cols}
        df = self._carry(known, carried)
        df = df.withColumns({n: F.coalesce(x, F.col(f"_{n}")) for n, x in local.items()})
        return replace(self, df=df.drop(*carried))


def ordered(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None, kept: bool = False) -> Ordered:
    """Group ``df`` by ``keys`` in ``order``. ``order`` must be total within a key.

    ``rows`` is an upper bound on the row count known to the caller (a Parquet count reads only
    footers); without it the rows are counted here. ``kept`` says that ``df`` is read from files without a shuffle (a checkpoint, or
    rows of a scan), so that reading it twice is cheaper than writing it.
    """
    spark = df.sparkSession
    limit = segment_rows(spark)
    if rows is None:
        rows = df.count()
    if rows <= limit:
        return Ordered(df, list(keys), list(order))
    cut = max(limit // CUTS, rows // MAX_SEGMENTS, 1)
    df = df if kept else checkpointed(df)
    sizes = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    # At most rows / cut <= MAX_SEGMENTS keys can be hot, so they fit on the driver.
    hot = sizes.where(F.col("count") > max(limit // 2, cut))
    hot_keys = spark.createDataFrame(hot.collect(), hot.schema)
    if hot_keys.isEmpty():
        return Ordered(df, list(keys), list(order))
    splits = _split_points(df, hot_keys, list(keys), list(order), cut)
    marked = _mark_segments(df, splits, list(keys), list(order))
    return Ordered(checkpointed(marked), list(keys), list(order), split=True)


def _split_points(
    df: DataFrame, hot_keys: DataFrame, keys: list[str], order: list[str], limit: int
) -> DataFrame:
    """Sorted split points per hot key, drawn from a hash sample of about 200 rows per segment."""
    every = max(1, limit // SAMPLES_PER_SEGMENT)
    sample = df.select(*keys, *order).where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0)
    if keys:
        sample = (
            sample.alias("l")
            .join(F.broadcast(hot_keys).alias("r"), same_keys("l", "r", keys), "left_semi")
            .select("l.*")
        )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    picked = sample.withColumn("_rn", place).where(F.col("_rn") % max(1, limit // every) == 0)
    points = F.array_sort(F.collect_list(F.struct(*order))).alias("_points")
    table = picked.groupBy(*keys).agg(points) if keys else picked.agg(points)
    return df.sparkSession.createDataFrame(table.collect(), table.schema)


def _mark_segments(df: DataFrame, splits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number of split points at or before each row, found through blocks of about sqrt(n) points."""
    block = F.ceil(F.sqrt(F.size("_points"))).cast("int")
    coarse = F.expr("transform(sequence(1, cast(size(_points) div _block as int)), i -> _points[i * _block - 1])")
    splits = (
        splits.where(F.size("_points") > 0)
        .withColumn("_block", block)
        .withColumn("_coarse", F.when(F.expr("size(_points) >= _block"), coarse))
    )
    here = F.struct(*order)

    def at_or_before(points: Column) -> Column:
        return F.size(F.filter(points, lambda p: p <= here))

    joined = df.alias("l").join(F.broadcast(splits).alias("r"), same_keys("l", "r", keys), "left")
    joined = joined.select("l.*", "_points", "_block", "_coarse")
    joined = joined.withColumn("_skip", at_or_before(F.col("_coarse")) * F.col("_block"))
    rest = F.slice("_points", F.col("_skip") + 1, F.col("_block"))
    seg = F.when(F.col("_points").isNull(), 0).otherwise(F.col("_skip") + at_or_before(rest))
    return (
        joined.withColumn(SEG, seg.cast(T.IntegerType()))
        .withColumn(SPLIT, F.col("_points").isNotNull())
        .drop("_points", "_block", "_coarse", "_skip")
    )
