"""Repair of a synthetic table: order, snap to a time grid, trim, de-duplicate, complete and fill."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofid.functions.numeric import to_double, to_long
from chronofid.functions.times import parse_time
from chronofid.operators import fill
from chronofid.operators.grid import stepped
from chronofid.operators.ordered import ordered, same_keys
from chronofid.operators.sampling import first_rows
from chronofid.operators.snap import nearest, neighbours, to_step
from chronofid.session import checkpointed

IMPUTED = "_is_imputed"
ORDER = "_order"
METHODS = ["sparse", "id_fill", "prev_fill", "interp_fill"]


@dataclass(frozen=True)
class RepairRules:
    """How one table is repaired.

    time_kind: datetime, integer, numeric, duration or date_string.
    time_action: none, snap_real_grid, snap_integer_grid, assign_daily, assign_monthly or duration_clip.
    dedup: none, full_row or key_time; ``dedup_keys`` overrides it.
    grid_kind: real, integer, numeric_step or date_range (``grid_freq`` D or MS).
    """

    key: str
    time: str
    row: str = "row_ix"
    time_kind: str = "datetime"
    time_action: str = "snap_real_grid"
    dedup: str = "key_time"
    dedup_keys: list[str] = field(default_factory=list)
    regular: bool = True
    grid_kind: str = "real"
    grid_step: int = 1
    grid_anchor: int = 0
    grid_freq: str = "D"
    row_index: str | None = None
    end: str | None = None
    dates_must_exist: bool = False
    sequence: str | None = None
    num_cols: list[str] = field(default_factory=list)
    cat_cols: list[str] = field(default_factory=list)


def coerce_time(df: DataFrame, rules: RepairRules) -> DataFrame:
    if rules.time_kind == "datetime":
        typed = df.schema[rules.time].dataType
        if isinstance(typed, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return df
        value = parse_time(rules.time)
    elif rules.time_kind == "integer":
        value = to_long(rules.time)
    elif rules.time_kind in ("numeric", "duration"):
        value = to_double(rules.time)
    elif rules.time_kind == "date_string":
        value = F.col(rules.time).cast("string")
    else:
        raise ValueError(f"unknown time_kind {rules.time_kind!r}")
    return df.withColumn(rules.time, value)


def keep_real_dates(synth: DataFrame, real: DataFrame, time: str) -> DataFrame:
    """Drop rows whose composed date is missing or does not occur in the real table."""
    return synth.join(real.select(time).distinct(), time, "left_semi")


def in_order(df: DataFrame, rules: RepairRules) -> DataFrame:
    """Rows ordered by key, then time or row index, ties in source order; for output."""
    columns = _order_columns(rules)
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def _order_columns(rules: RepairRules) -> list[str]:
    return [rules.key, rules.row_index or rules.time, rules.row]


def clip_durations(synth: DataFrame, real: DataFrame, time: str) -> DataFrame:
    top = real.agg(F.max(time).alias("_hi"))
    return synth.join(F.broadcast(top), F.col(time) <= F.col("_hi"), "inner").drop("_hi")


def trim(synth: DataFrame, real: DataFrame, time: str) -> DataFrame:
    """Keep rows within the real time range."""
    bounds = real.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    inside = (F.col(time) >= F.col("_lo")) & (F.col(time) <= F.col("_hi"))
    return synth.join(F.broadcast(bounds), inside, "inner").drop("_lo", "_hi")


def handle_time(synth: DataFrame, real: DataFrame, rules: RepairRules) -> DataFrame:
    time = rules.time
    if rules.time_action == "duration_clip":
        return clip_durations(synth, real, time)
    if rules.time_action == "snap_real_grid":
        synth = nearest(synth, real, time, rules.end)
    elif rules.time_action == "snap_integer_grid":
        synth = synth.withColumn(time, to_step(time, rules.grid_step, rules.grid_anchor))
    elif rules.time_action in ("assign_daily", "assign_monthly"):
        unit = "day" if rules.time_action == "assign_daily" else "month"
        synth = synth.withColumn(time, F.date_trunc(unit, time).cast(synth.schema[time].dataType))
    elif rules.time_action != "none":
        raise ValueError(f"unknown time_action {rules.time_action!r}")
    return trim(synth, real, time)


def deduplicate(synth: DataFrame, rules: RepairRules) -> DataFrame:
    if rules.dedup_keys:
        keys = list(rules.dedup_keys)
    elif rules.dedup == "none":
        return synth
    elif rules.dedup == "key_time":
        keys = [rules.key, rules.time]
    elif rules.dedup == "full_row":
        keys = [c for c in synth.columns if c not in (rules.row, ORDER)]
    else:
        raise ValueError(f"unknown dedup {rules.dedup!r}")
    return first_rows(synth, keys, ORDER)


def key_bounds(synth: DataFrame, real: DataFrame, rules: RepairRules) -> DataFrame:
    """Grid start and end per synthetic key.

    The range is the real range of the same key, of the whole real table for unknown keys, and starts
    no earlier than the key's own first row. An integer grid takes the key's own range.
    """
    own = synth.groupBy(rules.key).agg(F.min(rules.time).alias("_own_lo"), F.max(rules.time).alias("_own_hi"))
    if rules.grid_kind == "integer":
        return own.select(rules.key, F.col("_own_lo").alias("lo"), F.col("_own_hi").alias("hi"))
    per_key = real.groupBy(rules.key).agg(F.min(rules.time).alias("_lo"), F.max(rules.time).alias("_hi"))
    whole = real.agg(F.min(rules.time).alias("_all_lo"), F.max(rules.time).alias("_all_hi"))
    joined = own.join(per_key, rules.key, "left").join(F.broadcast(whole), F.lit(True), "left")
    return joined.select(
        rules.key,
        F.greatest(F.coalesce("_lo", "_all_lo"), "_own_lo").alias("lo"),
        F.coalesce("_hi", "_all_hi").alias("hi"),
    )


def grid_spans(bounds: DataFrame, real: DataFrame, rules: RepairRules) -> DataFrame:
    """First and last grid point per key: positions of real time points, or the points themselves."""
    key, lo, hi = rules.key, F.col("lo"), F.col("hi")
    if rules.grid_kind == "real":
        index = real_index(real, rules)
        edges = bounds.select(F.explode(F.array("lo", "hi")).alias(rules.time)).distinct()
        near = neighbours(edges, index, rules.time, 2 * bounds.count() + real.count())
        first = near.select(F.col(rules.time).alias("lo"), F.col("after")["ix"].alias("first"))
        last = near.select(F.col(rules.time).alias("hi"), F.col("before")["ix"].alias("last"))
        return bounds.join(first, "lo").join(last, "hi").select(key, "first", "last")
    if rules.grid_kind == "integer":
        return bounds.select(key, lo.cast("long").alias("first"), hi.cast("long").alias("last"))
    if rules.grid_kind == "numeric_step":
        # The last step may pass the end by less than one step.
        return bounds.select(key, lo.cast("long").alias("first"), (hi.cast("long") + rules.grid_step - 1).alias("last"))
    if rules.grid_kind == "date_range" and rules.grid_freq == "D":
        return bounds.select(key, lo.alias("first"), hi.alias("last"))
    if rules.grid_kind == "date_range" and rules.grid_freq == "MS":
        start = F.when(F.dayofmonth(lo) == 1, lo).otherwise(F.add_months(F.trunc(lo, "month"), 1))
        return bounds.select(key, start.cast(bounds.schema["lo"].dataType).alias("first"), hi.alias("last"))
    raise ValueError(f"unknown grid {rules.grid_kind!r} {rules.grid_freq!r}")


def real_index(real: DataFrame, rules: RepairRules) -> DataFrame:
    """Distinct real times numbered in order."""
    times = real.where(F.col(rules.time).isNotNull()).select(rules.time).distinct()
    return ordered(times, [], [rules.time], real.count()).numbered("ix").result()


def grid_points(spans: DataFrame, real: DataFrame, rules: RepairRules) -> DataFrame:
    """Every grid point of every key: ``(key, time)``. Long spans unroll in chunks."""
    step = {"real": 1, "integer": rules.grid_step, "numeric_step": rules.grid_step}.get(rules.grid_kind)
    if step is None:
        step = "day" if rules.grid_freq == "D" else "month"
    points = stepped(spans, [rules.key], "first", "last", step, "ix")
    if rules.grid_kind == "real":
        return points.join(real_index(real, rules), "ix").select(rules.key, rules.time)
    return points.select(rules.key, F.col("ix").cast(real.schema[rules.time].dataType).alias(rules.time))


def on_grid(synth: DataFrame, real: DataFrame, rules: RepairRules) -> DataFrame:
    """Grid points with the rows that lie on them, gaps marked.

    Rows off the grid vanish, several rows of one cell stay. A key with an empty grid keeps its rows.
    """
    keyed = synth.where(F.col(rules.key).isNotNull())
    spans = checkpointed(grid_spans(key_bounds(keyed, real, rules), real, rules))
    on = [rules.key, rules.time]
    merged = grid_points(spans, real, rules).join(keyed.withColumn("_seen", F.lit(True)), on, "left")
    merged = merged.withColumn(IMPUTED, F.col("_seen").isNull()).drop("_seen")
    without = keyed.join(spans.where(F.col("first") > F.col("last")), rules.key, "left_semi")
    return merged.unionByName(without.withColumn(IMPUTED, F.lit(False)))


def features(df: DataFrame, rules: RepairRules) -> tuple[list[str], list[str]]:
    """Numeric and category columns, by type unless named."""
    skip = {rules.key, rules.time, rules.row, ORDER, IMPUTED}
    rest = [f for f in df.schema.fields if f.name not in skip]
    numeric = T.NumericType
    nums = list(rules.num_cols) or [f.name for f in rest if isinstance(f.dataType, numeric)]
    cats = list(rules.cat_cols) or [f.name for f in rest if f.name not in nums]
    return nums, cats


def fill_gaps(merged: DataFrame, rules: RepairRules, method: str) -> DataFrame:
    """Fill a completed table. Keys without a gap stay as they are, nulls included."""
    if method == "sparse":
        return merged
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    nums, cats = features(merged, rules)
    key = rules.key
    gaps = merged.where(IMPUTED).select(key).distinct()
    if method == "id_fill":
        return _fill_by_entity(merged, rules, nums, cats)
    # Rows of untouched keys skip the sort.
    todo = merged.join(gaps, key, "left_semi")
    done = merged.join(gaps, key, "left_anti")
    order = [rules.time, ORDER]
    if method == "prev_fill":
        filled = fill.carry_forward(todo, [key], order, nums + cats)
    else:
        filled = todo
        if nums:
            filled = fill.interpolate(filled, [key], order, nums)
        if cats:
            filled = fill.carry_both(filled, [key], order, cats)
        done = done.withColumns({c: F.col(c).cast("double") for c in nums})
    return filled.select(*merged.columns).unionByName(done)


def _fill_by_entity(merged: DataFrame, rules: RepairRules, nums: list[str], cats: list[str]) -> DataFrame:
    """Gap rows take the entity's mean and smallest most frequent category of its observed rows."""
    key = rules.key
    observed = merged.where(~F.col(IMPUTED))
    fills = observed.groupBy(key).agg(*[F.avg(to_double(c)).alias(f"_m_{c}") for c in nums], F.count(F.lit(1)).alias("_n"))
    for c in cats:
        fills = fills.join(fill.modes(observed, [key], c).withColumnRenamed(c, f"_m_{c}"), key, "left")
    joined = merged.alias("l").join(fills.alias("r"), same_keys("l", "r", [key]), "left")
    joined = joined.select("l.*", *[F.col(f"r._m_{c}") for c in chain(nums, cats)])
    values = {c: F.when(F.col(IMPUTED), F.col(f"_m_{c}")).otherwise(F.col(c)) for c in chain(nums, cats)}
    return joined.withColumns(values).drop(*[f"_m_{c}" for c in chain(nums, cats)])


def repair(synth: DataFrame, real: DataFrame, rules: RepairRules, method: str = "sparse") -> DataFrame:
    """The whole pipeline. Output has the input columns and ``_is_imputed``."""
    real = coerce_time(real, rules)
    synth = coerce_time(synth, rules)
    if rules.dates_must_exist:
        synth = keep_real_dates(synth, real, rules.time)
    synth = synth.withColumn(ORDER, F.struct(*_order_columns(rules)))
    synth = deduplicate(handle_time(synth, real, rules), rules)
    if not rules.regular:
        return synth.withColumn(IMPUTED, F.lit(False)).drop(ORDER)
    # The grid needs the cleaned table twice and a fill needs the completed one three times: both are
    # written once to the shared checkpoint folder rather than computed again for each use.
    merged = on_grid(checkpointed(synth), real, rules)
    if method != "sparse":
        merged = checkpointed(merged)
    return fill_gaps(merged, rules, method).drop(ORDER)


def report(before: DataFrame, after: DataFrame, real: DataFrame, rules: RepairRules) -> DataFrame:
    """One row: rows and flows before and after, gap rows and mean flow lengths."""

    def sizes(df: DataFrame, prefix: str) -> DataFrame:
        imputed = F.count_if(IMPUTED) if IMPUTED in df.columns else F.lit(0).cast("long")
        per_key = df.groupBy(rules.key).agg(F.count(F.lit(1)).alias("n"), imputed.alias("i"))
        known = F.when(F.col(rules.key).isNotNull(), F.col("n"))
        return per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias(f"{prefix}_rows"),
            F.coalesce(F.sum("i"), F.lit(0)).alias(f"{prefix}_imputed"),
            F.count(known).alias(f"{prefix}_flows"),
            F.avg(known).alias(f"{prefix}_length"),
        )

    parts = [sizes(before, "before"), sizes(after, "after"), sizes(real, "real")]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(F.broadcast(part), F.lit(True), "left")
    ratio = F.coalesce(F.try_divide("after_imputed", "after_rows"), F.lit(0.0))
    return joined.select(
        F.col("before_rows").alias("total_rows_before"),
        F.col("after_rows").alias("total_rows_after"),
        (F.col("before_rows") - F.col("after_rows") + F.col("after_imputed")).alias("rows_removed"),
        F.col("after_imputed").alias("imputed_rows"),
        F.round(ratio, 6).alias("imputation_ratio"),
        F.col("before_flows").alias("flows_before"),
        F.col("after_flows").alias("flows_after"),
        F.col("real_flows"),
        F.round("before_length", 4).alias("avg_flow_length_before"),
        F.round("after_length", 4).alias("avg_flow_length_after"),
    )


def missing_numbers(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Per key: how many of the numbers 1 to the highest seen are missing."""
    numbers = df.select(key, F.expr(f"cast(try_cast(`{sequence}` as double) as bigint)").alias("s"))
    seen = numbers.where(F.col(key).isNotNull() & F.col("s").isNotNull()).distinct()
    inside = F.count_if(F.col("s") >= 1)
    return seen.groupBy(key).agg(F.greatest(F.max("s") - inside, F.lit(0)).alias("missing"))


def sequence_report(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """One row: keys, keys with missing numbers, share of complete keys, missing numbers and their mean."""
    gaps = F.col("missing") > 0
    stats = missing_numbers(df, key, sequence).agg(
        F.count(F.lit(1)).alias("keys_total"),
        F.count_if(gaps).alias("keys_with_gaps"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_total"),
        F.avg(F.when(gaps, F.col("missing"))).alias("avg_missing"),
    )
    complete = F.coalesce(1 - F.try_divide("keys_with_gaps", "keys_total"), F.lit(1.0))
    return stats.select(
        "keys_total", "keys_with_gaps", F.round(complete, 6).alias("complete_ratio"), "missing_total",
        F.round("avg_missing", 4).alias("avg_missing"),
    )
