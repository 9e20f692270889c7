"""Joins along foreign keys. Sides are left to adaptive execution: it broadcasts what turns out small
and splits skewed partitions of what does not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.functions.labels import join_key


@dataclass(frozen=True)
class Relationship:
    parent: str
    child: str
    parent_key: str
    child_key: str
    parent_order: str | None = None


def one_per_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the first by ``order``, else the smallest, so that every run gives the same."""
    rest = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != key))
    pick = F.min(rest) if order is None else F.min_by(rest, F.struct(F.col(f"`{order}`"), rest))
    return df.groupBy(F.col(f"`{key}`")).agg(pick.alias("_row")).select(key, "_row.*")


def attach_parent(
    child: DataFrame, parent: DataFrame, rel: Relationship, collisions: str = "prefix"
) -> DataFrame:
    """Left join of one parent row per child row.

    ``prefix`` renames colliding parent columns to ``parent.col`` and takes one parent row per key, the first by
    ``parent_order`` if the relationship names one;
    ``drop`` leaves colliding columns out.
    """
    fk, pk = rel.child_key, rel.parent_key
    if collisions == "prefix":
        parent = one_per_key(parent, pk, rel.parent_order) if len(parent.columns) > 1 else parent.distinct()
        kept = {c: (f"{rel.parent}.{c}" if c in child.columns else c) for c in parent.columns if c != pk}
    elif collisions == "drop":
        kept = {c: c for c in parent.columns if c not in child.columns}
    else:
        raise ValueError(f"collisions must be 'prefix' or 'drop', not {collisions!r}")
    right = parent.select(F.col(pk).alias("_parent_key"), *[F.col(f"`{c}`").alias(n) for c, n in kept.items()])
    if child.schema[fk].dataType == parent.schema[pk].dataType:
        on = F.col(fk) == F.col("_parent_key")
    else:
        on = join_key(fk) == join_key("_parent_key")
    return child.join(right, on, "left").drop("_parent_key")


def flatten(
    tables: dict[str, DataFrame],
    relationships: list[Relationship],
    name: str,
    collisions: str = "prefix",
    seen: tuple[str, ...] = (),
) -> DataFrame:
    """Child table with the columns of all its ancestors."""
    df = tables[name]
    for rel in relationships:
        if rel.child != name or rel.parent not in tables or rel.child_key not in df.columns:
            continue
        if rel.parent in (*seen, name):
            if collisions == "prefix":
                raise ValueError(f"relationships form a cycle at {rel.parent}")
            parent = tables[rel.parent]
        else:
            parent = flatten(tables, relationships, rel.parent, collisions, (*seen, name))
        if rel.parent_key in parent.columns:
            df = attach_parent(df, parent, rel, collisions)
    return df


def attach_sibling_sums(df: DataFrame, sibling: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Sums of a sibling table per entity, left-joined; entities the sibling lacks get null."""
    sums = sibling.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols])
    return df.join(sums, keys, "left")


def coverage(df: DataFrame, col: str) -> DataFrame:
    """Rows that found a match, rows in all, and their ratio."""
    counts = df.agg(F.count(col).alias("matched_rows"), F.count(F.lit(1)).alias("total_rows"))
    ratio = F.coalesce(F.try_divide("matched_rows", "total_rows"), F.lit(0.0))
    return counts.withColumn("coverage", ratio)


@dataclass(frozen=True)
class Hop:
    """One step of a join path: ``left.left_col = right.right_col``."""

    left: str
    left_col: str
    right: str
    right_col: str


def find_path(relationships: list[Relationship], start: str, goal: str) -> list[Hop] | None:
    """Shortest foreign-key path between two tables, in either direction; metadata only."""
    paths: dict[str, list[Hop]] = {start: []}
    queue = [start]
    while queue and goal not in paths:
        here = queue.pop(0)
        for rel in relationships:
            for a, ac, b, bc in (
                (rel.parent, rel.parent_key, rel.child, rel.child_key),
                (rel.child, rel.child_key, rel.parent, rel.parent_key),
            ):
                if a == here and b not in paths:
                    paths[b] = [*paths[here], Hop(a, ac, b, bc)]
                    queue.append(b)
    return paths.get(goal)


def khop_join(tables: dict[str, DataFrame], start: str, path: list[Hop], needed: list[tuple[str, str]]) -> DataFrame:
    """Inner join along ``path``; output columns are named ``table__column``.

    ``needed`` lists the columns the caller reads; only those and the join keys are carried.
    """
    used = set(needed) | {(h.left, h.left_col) for h in path} | {(h.right, h.right_col) for h in path}

    def prefixed(name: str) -> DataFrame:
        cols = [c for c in tables[name].columns if (name, c) in used]
        return tables[name].select(*[F.col(c).alias(f"{name}__{c}") for c in cols])

    df = prefixed(start)
    for hop in path:
        on = F.col(f"{hop.left}__{hop.left_col}") == F.col(f"{hop.right}__{hop.right_col}")
        df = df.join(prefixed(hop.right), on, "inner")
    return df


def attach_totals(flow: DataFrame, detail: DataFrame, keys: list[str], value: str, item: str, prefix: str) -> DataFrame:
    """Sum, mean, sample deviation and count of a detail table per key, left-joined with 0 for none."""
    names = [f"{prefix}_{s}" for s in ("sum", "mean", "std", "count")]
    totals = detail.groupBy(*keys).agg(
        F.sum(value).alias(names[0]),
        F.avg(value).alias(names[1]),
        F.stddev_samp(value).alias(names[2]),
        F.count(item).alias(names[3]),
    )
    return flow.join(totals, keys, "left").na.fill(0, names)


def with_labels(features: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Features of labelled entities only."""
    return features.join(labels.where(F.col(label).isNotNull()).select(key, label), key, "inner")
