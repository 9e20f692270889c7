"""Joint category tables of all column pairs, from cells that are counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.operators.distributions import SYNTH, real_count, synth_count, with_totals
from chronofid.operators.shape import FEATURE, pair_name

_CELL = "_c"


def pair_cells(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], nulls: bool) -> DataFrame:
    """``keys, feature, a, b, real_n, synth_n``: how often each pair of categories occurs on either side.

    Rows collapse to counted combinations of all columns first; only these cells are grouped again, by the
    grouping sets of the pairs. ``nulls`` tells whether a null is a category of its own or leaves its row out.
    """
    cols = sorted({c for p in pairs for c in p})
    # Text that is never null: in a grouping set, null stands for a column that is left out.
    mark = {c: f"{_CELL}{k}" for k, c in enumerate(cols)}
    text = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(mark[c]) for c in cols]
    cells = df.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], SYNTH, *text)
    groups = [f"_k{n}" for n in range(len(keys))]
    once = cells.groupBy(*groups, *mark.values()).agg(real_count().alias("real_n"), synth_count().alias("synth_n"))
    sets = [[F.col(g) for g in groups] + [F.col(mark[a]), F.col(mark[b])] for a, b in pairs]
    every = [F.col(c) for c in [*groups, *mark.values()]]
    known = once.groupingSets(sets, *every).agg(F.sum("real_n").alias("real_n"), F.sum("synth_n").alias("synth_n"), F.grouping_id().alias("_set"))

    def set_number(a: str, b: str) -> int:
        """Bits of the columns that are left out, the first column highest."""
        here = {*groups, mark[a], mark[b]}
        return sum(1 << place for place, c in enumerate(reversed([*groups, *mark.values()])) if c not in here)

    def by_set(pick):
        out = None
        for a, b in pairs:
            out = (F.when if out is None else out.when)(F.col("_set") == set_number(a, b), pick(a, b))
        return out

    named = known.select(
        *[F.col(g).alias(k) for g, k in zip(groups, keys)],
        by_set(lambda a, b: F.lit(pair_name(a, b))).alias(FEATURE),
        by_set(lambda a, b: F.col(mark[a])).alias("a"),
        by_set(lambda a, b: F.col(mark[b])).alias("b"),
        "real_n",
        "synth_n",
    )
    return named if nulls else named.where("a <> '' AND b <> ''")


def pair_distances(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], nulls: bool) -> DataFrame:
    """``keys, feature, n_real, n_synth, tvd``: total-variation distance of the joint table of each column pair."""
    group = [*keys, FEATURE]
    cells = with_totals(pair_cells(df, keys, pairs, nulls), group, n_real="real_n", n_synth="synth_n")
    gap = F.abs(F.try_divide("real_n", "n_real") - F.try_divide("synth_n", "n_synth"))
    return cells.groupBy(*group).agg(F.max("n_real").alias("n_real"), F.max("n_synth").alias("n_synth"), (F.sum(gap) * 0.5).alias("tvd"))
