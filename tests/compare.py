"""Compare Spark results with DuckDB results, ignoring row and column order."""

import duckdb
import pandas as pd

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(data_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    return connection


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in frame.columns}


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    found = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} / {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} / {len(want)}"]
    if len(got) and kinds(normal(got)) != kinds(normal(want)):
        found.append(f"types {dict(got.dtypes)} / {dict(want.dtypes)}")
    a, b = normal(got), normal(want)
    for c in a.columns:
        left, right = a[c].astype(object), b[c].astype(object)
        unequal = ~((left == right) | (left.isna() & right.isna()))
        if unequal.any():
            at = unequal.idxmax()
            found.append(f"{c}: {int(unequal.sum())} differ, first {left[at]!r} / {right[at]!r}")
    return found
