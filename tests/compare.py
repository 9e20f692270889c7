"""Compare a Spark result with DuckDB's, order-insensitively."""

import duckdb
import pandas as pd

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "null"
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "tolist") and not isinstance(v, (int, float)):
            v = v.tolist()
        if isinstance(v, list):
            return str([cell(x) for x in v])
        if isinstance(v, (pd.Timestamp,)) or hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, (int, float)):
            return repr(float(v) + 0.0)
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def differences(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(duck_df.columns)}"
    a, b = canonical(spark_df), canonical(duck_df)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None
