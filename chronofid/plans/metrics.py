"""A registry of scores that share one scan of a table.

A metric is a function from a ``Scan`` to ``(feature, score)`` rows, or to ``score`` alone for a score of the whole table. It is
registered under a family and a name, with a test whether it applies; a score of your own joins in by the same decorator:

    @metric("static", "RangeWidth", applies=lambda scan: bool(scan.roles.num_cols))
    def range_width(scan): ...

A ``Scan`` reads the table once. The columns that its roles name are written as Parquet to the shared folder; from there every metric
reads only what it needs. Row counts, counted values and other frames that several metrics start from are made once, whichever
family asks first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.operators.distributions import SYNTH, side_counts
from chronofid.operators.shape import FEATURE, VALUE, unpivot_labels, unpivot_numbers
from chronofid.plans.roles import TableRoles, named, union_all
from chronofid.session import checkpointed, shared_folder


class Metric(Protocol):
    """What the registry holds: a named score of a family."""

    family: str
    name: str

    def applies(self, scan: Scan) -> bool: ...

    def scores(self, scan: Scan) -> DataFrame: ...


@dataclass
class Scan:
    """One pair of tables on its way through many metrics. ``options`` are settings that single metrics look up."""

    source: DataFrame
    roles: TableRoles
    options: dict[str, Any] = field(default_factory=dict)
    _kept: dict = field(default_factory=dict, repr=False)

    def once(self, name: Any, make: Callable[[], Any]) -> Any:
        """The value of ``make()``, made for the first who asks for ``name``."""
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @cached_property
    def pair(self) -> DataFrame:
        """The columns that the roles name, read from the source this once."""
        roles = self.roles
        wanted = [SYNTH, roles.key, roles.time, roles.row, *roles.num_cols, *roles.cat_cols, *self.options.get("columns", [])]
        spark, path = self.source.sparkSession, shared_folder(self.source.sparkSession)
        self.source.select(*[F.col(f"`{c}`") for c in dict.fromkeys(wanted) if c in self.source.columns]).write.parquet(path)
        return spark.read.parquet(path)

    @cached_property
    def rows(self) -> int:
        return self.pair.count()

    def number_counts(self, keys: list[str] = ()) -> DataFrame:
        """``keys, feature, value, real_n, synth_n`` of the known numbers: rows collapse once for all scores that rest on values."""
        def make() -> DataFrame:
            long = unpivot_numbers(self.pair, [SYNTH, *keys], self.roles.num_cols)
            return checkpointed(side_counts(_known(long, keys), [*keys, FEATURE, VALUE]))

        return self.once(("numbers", *keys), make)

    def distinct_numbers(self, keys: list[str] = ()) -> int:
        """Rows of ``number_counts``."""
        return self.once(("distinct numbers", *keys), lambda: self.number_counts(keys).count())

    def label_counts(self, keys: list[str] = (), labelled: Callable[[DataFrame], DataFrame] = lambda df: df, name: str = "plain") -> DataFrame:
        """The same of the known categories, spelt by ``labelled`` (told apart by ``name``)."""
        def make() -> DataFrame:
            long = unpivot_labels(labelled(self.pair), [SYNTH, *keys], self.roles.cat_cols)
            return checkpointed(side_counts(_known(long, keys), [*keys, FEATURE, VALUE]))

        return self.once(("labels", name, *keys), make)


def _known(long: DataFrame, keys: list[str]) -> DataFrame:
    for c in [*keys, VALUE]:
        long = long.where(F.col(c).isNotNull())
    return long


@dataclass(frozen=True)
class _Registered:
    family: str
    name: str
    applies: Callable[[Scan], bool]
    scores: Callable[[Scan], DataFrame]
    column: str


_REGISTRY: dict[tuple[str, str], Metric] = {}


def metric(family: str, name: str, applies: Callable[[Scan], bool] = lambda scan: True, column: str = "score") -> Callable:
    """Register a function of a scan as the metric ``name`` of ``family``; a name that is there already is replaced."""
    def register(scores: Callable[[Scan], DataFrame]) -> Callable[[Scan], DataFrame]:
        _REGISTRY[family, name] = _Registered(family, name, applies, scores, column)
        return scores

    return register


def forget(family: str, name: str) -> None:
    """Take a metric out of the registry."""
    _REGISTRY.pop((family, name), None)


def registered(families: Iterable[str] | None = None) -> list[Metric]:
    """Metrics of the families in order of registration, of all if None."""
    wanted = None if families is None else set(families)
    return [m for m in _REGISTRY.values() if wanted is None or m.family in wanted]


def evaluate(scan: Scan, families: Iterable[str] | None = None) -> DataFrame:
    """``family, metric, feature, score`` of every registered metric that applies; ``feature`` is ``*`` for a whole table."""
    found = []
    for m in registered(families):
        if m.applies(scan):
            df = m.scores(scan)
            feature = F.col(FEATURE) if FEATURE in df.columns else "*"
            rows = named(df, m.name, getattr(m, "column", "score"), feature)
            found.append(rows.select(F.lit(m.family).alias("family"), "metric", "feature", "score"))
    if not found:
        return scan.source.sparkSession.createDataFrame([], "family string, metric string, feature string, score double")
    return union_all(found)
