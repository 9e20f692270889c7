"""Repair: shipped outputs of generators where available, and hand-made edge cases.

Set REPAIR_GOLDENS to a folder with ``real/<dataset>/metadata.json`` and table files, and
``synthetic/<dataset>/<model>/`` holding raw and repaired table files, to run the golden cases.
"""

import datetime as dt
import os
from pathlib import Path

import pandas as pd
import pytest

from chronofid.plans.repair import RepairRules, repair, report, sequence_report
from chronofid.sources.metadata import load_dataset
from chronofid.sources.tables import read_table

GOLDENS = os.environ.get("REPAIR_GOLDENS", "")
# File-name endings of repaired tables, with the fill used and whether only categories were filled.
ENDINGS = {
    "_postprocessed": ("sparse", False),
    "_postprocessed_prev_fill": ("prev_fill", False),
    "_cat_postprocessed_id_fill": ("id_fill", True),
    "_cat_postprocessed_prev_fill": ("prev_fill", True),
    "_cat_postprocessed_interp_fill": ("interp_fill", True),
}


def golden_cases():
    root = Path(GOLDENS)
    if not GOLDENS or not root.exists():
        return [pytest.param(None, None, None, None, marks=pytest.mark.skip(reason="REPAIR_GOLDENS not set"))]
    cases = []
    for meta in sorted(root.glob("real/*/metadata.json")):
        name = meta.parent.name
        for table in load_dataset(name, str(meta)).children():
            for folder in sorted((root / "synthetic" / name).glob("*/")):
                for ending in ENDINGS:
                    made = folder / f"{table}{ending}.csv"
                    if made.exists() and (folder / f"{table}.csv").exists() and (meta.parent / f"{table}.csv").exists():
                        cases.append(pytest.param(meta, table, folder, ending, id=f"{folder.name}{ending}"))
    return cases


def comparable(df, cols, nums):
    df = df[cols].copy()
    for c in cols:
        if c in nums:
            df[c] = df[c].astype(float).round(3)
    df = df.astype(object).where(df.notna(), None)
    return sorted(str([str(v) for v in row]) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize(("meta", "table", "folder", "ending"), golden_cases())
def test_matches_shipped_output(spark, meta, table, folder, ending):
    info = load_dataset(meta.parent.name, str(meta))
    roles = info.roles(table)
    method, only_cats = ENDINGS[ending]
    schema = info.tables[table].schema()
    real = read_table(spark, str(meta.parent / f"{table}.csv"), schema)
    synth = read_table(spark, str(folder / f"{table}.csv"), schema)
    rules = RepairRules(
        key=roles.key, time=roles.time, dedup="full_row", num_cols=roles.num_cols, cat_cols=roles.cat_cols
    )
    out = repair(synth, real, rules, method)
    got = out.withColumn(roles.time, out[roles.time].cast("date").cast("string")).toPandas()
    want = pd.read_csv(folder / f"{table}{ending}.csv")
    want[roles.time] = pd.to_datetime(want[roles.time]).dt.strftime("%Y-%m-%d")
    cols = [roles.key, roles.time, *([] if only_cats else roles.num_cols), *roles.cat_cols, "_is_imputed"]
    assert comparable(got, cols, roles.num_cols) == comparable(want, cols, roles.num_cols)
    row = report(synth, out, real, rules).first()
    assert (row["total_rows_after"], row["imputed_rows"]) == (len(want), int(want["_is_imputed"].sum()))


def small(spark, data, schema="k long, t long, x double, c string, row_ix long"):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], schema)


def test_numeric_fills(spark):
    rules = RepairRules(key="k", time="t", time_kind="integer", time_action="none", grid_kind="integer", num_cols=["x"], cat_cols=["c"])
    real = small(spark, [(1, 0, 0.0, "a"), (1, 9, 0.0, "a")])
    synth = small(spark, [(1, 0, None, "b"), (1, 1, 2.0, "a"), (1, 4, 8.0, "b"), (2, 3, None, None), (1, 5, 9.0, None)])

    def run(method):
        out = repair(synth, real, rules, method).orderBy("k", "t").collect()
        return [(r["t"], r["x"], r["c"], r["_is_imputed"]) for r in out if r["k"] == 1], [r for r in out if r["k"] == 2]

    interp, lone = run("interp_fill")
    assert [r[1] for r in interp] == [2.0, 2.0, 4.0, 6.0, 8.0, 9.0]
    assert [r[2] for r in interp] == ["b", "a", "a", "a", "b", "b"]
    assert [r[3] for r in interp] == [False, False, True, True, False, False]
    # A key without gaps keeps its nulls.
    assert lone[0]["x"] is None and lone[0]["c"] is None
    mean, _ = run("id_fill")
    assert mean[2][1] == pytest.approx(19 / 3) and mean[2][2] == "b" and mean[0][1] is None
    prev, _ = run("prev_fill")
    assert [r[1] for r in prev] == [None, 2.0, 2.0, 2.0, 8.0, 9.0] and prev[5][2] == "b"


def test_snap_prefers_the_earlier_point_and_keeps_the_first_row(spark):
    rules = RepairRules(key="k", time="t", time_kind="numeric", regular=False, num_cols=["x"])
    real = small(spark, [(1, 0, 0.0, "a"), (1, 10, 0.0, "a"), (1, 20, 0.0, "a")])
    synth = small(spark, [(1, 16, 1.0, "z"), (1, 15, 2.0, "y"), (1, 99, 3.0, "w"), (1, 5, 4.0, "v")])
    got = {(r["t"], r["x"]) for r in repair(synth, real, rules).collect()}
    assert got == {(10.0, 2.0), (20.0, 1.0), (0.0, 4.0)}


def test_month_grid_starts_at_the_first_month_start(spark):
    schema = "k long, t date, x double, c string, row_ix long"
    day = dt.date
    real = small(spark, [(1, day(2020, 1, 15), 0.0, "a"), (1, day(2020, 4, 20), 0.0, "a")], schema)
    synth = small(spark, [(1, day(2020, 1, 20), 1.0, "a"), (1, day(2020, 3, 1), 2.0, "a")], schema)
    rules = RepairRules(key="k", time="t", time_action="none", grid_kind="date_range", grid_freq="MS", num_cols=["x"])
    got = [(r["t"], r["_is_imputed"]) for r in repair(synth, real, rules).orderBy("t").collect()]
    assert got == [(day(2020, 2, 1), True), (day(2020, 3, 1), False), (day(2020, 4, 1), True)]


def test_sequence_report(spark):
    df = small(spark, [(1, 1, 0.0, ""), (1, 2, 0.0, ""), (1, 5, 0.0, ""), (2, 1, 0.0, ""), (3, 0, 0.0, "")])
    row = sequence_report(df, "k", "t").first()
    assert (row["keys_total"], row["keys_with_gaps"], row["missing_total"], row["avg_missing"]) == (3, 1, 2, 2.0)
