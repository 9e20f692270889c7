"""Pearson correlation per key and side, guarded against constant columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.operators.distributions import SYNTH


def pair_corr(long: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of ``a`` and ``b`` over complete rows per key: ``real_n, real_rho, synth_n, synth_rho``.

    Rho is null if a side has under two rows or a constant column. ``corr`` itself divides by zero there.
    """
    complete = long.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    sides = []
    for side, here in (("real", ~F.col(SYNTH)), ("synth", F.col(SYNTH))):
        a, b = F.when(here, F.col("a")), F.when(here, F.col("b"))
        sides += [
            F.count(a).alias(f"{side}_n"),
            F.stddev_pop(a).alias(f"{side}_a"),
            F.stddev_pop(b).alias(f"{side}_b"),
            F.covar_pop(a, b).alias(f"{side}_cov"),
        ]
    moments = complete.groupBy(*keys).agg(*sides)

    def rho(side: str):
        varies = (F.col(f"{side}_n") > 1) & (F.col(f"{side}_a") != 0) & (F.col(f"{side}_b") != 0)
        spread = F.col(f"{side}_a") * F.col(f"{side}_b")
        return F.when(varies, F.try_divide(F.col(f"{side}_cov"), spread)).alias(f"{side}_rho")

    return moments.select(*keys, "real_n", rho("real"), "synth_n", rho("synth"))
