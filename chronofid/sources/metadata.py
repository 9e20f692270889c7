"""Dataset metadata: declared columns, foreign keys and the roles derived from them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

from chronofid.operators.joins import Relationship
from chronofid.plans.roles import TableRoles

# The column kinds of the metadata format.
NUMERIC = {"numerical", "float", "integer"}
CATEGORICAL = {"categorical", "boolean"}
DATETIME = {"datetime"}
ID = {"id"}


@dataclass(frozen=True)
class TableInfo:
    name: str
    columns: dict[str, dict]
    primary_key: str | None = None
    traits: dict[str, str] = field(default_factory=dict)

    def of_kind(self, kinds: set[str]) -> list[str]:
        return [c for c, info in self.columns.items() if info.get("sdtype") in kinds]

    def schema(self) -> T.StructType:
        """Reading schema: times stay text until parsed by their format."""
        fields = []
        for c, info in self.columns.items():
            kind = info.get("sdtype")
            whole = str(info.get("computer_representation", "")).startswith("Int")
            if kind in NUMERIC:
                dtype: T.DataType = T.LongType() if whole else T.DoubleType()
            elif kind in ID and info.get("regex_format") is None:
                dtype = T.LongType()
            else:
                dtype = T.StringType()
            fields.append(T.StructField(c, dtype, True, {"sdtype": kind}))
        return T.StructType(fields)


@dataclass(frozen=True)
class DatasetInfo:
    name: str
    tables: dict[str, TableInfo]
    relationships: list[Relationship]

    def children(self) -> list[str]:
        found = [r.child for r in self.relationships if r.child in self.tables]
        return list(dict.fromkeys(found)) or list(self.tables)

    def roles(self, table: str, row: str = "row_ix") -> TableRoles:
        """Key from the foreign key, else the primary key, else the first id; time from traits or type."""
        info = self.tables[table]
        keys = [r.child_key for r in self.relationships if r.child == table]
        keys += [k for k in (info.primary_key, *info.of_kind(ID)) if k]
        stated = _stated(info.traits, "time_col")
        times = [stated] if stated in info.columns else info.of_kind(DATETIME)
        if not keys or not times:
            raise ValueError(f"table {table} has no key or no time column")
        return TableRoles(
            key=keys[0],
            time=times[0],
            row=row,
            num_cols=[c for c in info.of_kind(NUMERIC) if c not in (keys[0], times[0])],
            cat_cols=[c for c in info.of_kind(CATEGORICAL) if c not in (keys[0], times[0])],
            periodicity=_stated(info.traits, "periodicity"),
            representation=_stated(info.traits, "time_representation"),
            independence=_stated(info.traits, "trajectory_independence") or "independent",
        )

    def cross_sectional(self, table: str) -> bool:
        """Comparing rows of one timestamp needs calendar time and trajectories that depend on each other."""
        traits = self.tables[table].traits
        dependent = _stated(traits, "trajectory_independence") == "dependent"
        return dependent and _stated(traits, "time_representation") == "absolute"


def _stated(traits: dict[str, str], name: str) -> str | None:
    value = traits.get(name)
    return None if value in (None, "None", "") else value


def dataset(name: str, metadata: dict, traits: dict | None = None) -> DatasetInfo:
    """Build from the metadata dictionary and an optional traits dictionary."""
    per_table = (traits or {}).get("tables", {})
    tables = {
        t: TableInfo(t, spec.get("columns", {}), spec.get("primary_key"), per_table.get(t, {}))
        for t, spec in metadata.get("tables", {}).items()
    }
    rels = [
        Relationship(r["parent_table_name"], r["child_table_name"], r["parent_primary_key"], r["child_foreign_key"])
        for r in metadata.get("relationships", [])
    ]
    return DatasetInfo(name, tables, rels)


def load_dataset(name: str, metadata_path: str, traits_path: str | None = None) -> DatasetInfo:
    with open(metadata_path, encoding="utf-8") as handle:
        metadata = json.load(handle)
    traits = None
    if traits_path is not None:
        with open(traits_path, encoding="utf-8") as handle:
            traits = json.load(handle)
    return dataset(name, metadata, traits)
