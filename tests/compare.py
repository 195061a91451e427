"""Side-by-side comparison of a Spark result with its SQL counterpart."""

from __future__ import annotations

import duckdb
import pandas as pd

from loomline.plans.tables import TABLE_NAMES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.apply(lambda c: c.map(lambda v: "" if v is None or v != v else (repr(float(v)) if isinstance(v, float) else str(v))))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for c in got.columns:
        if got[c].dtype.kind != want[c].dtype.kind:
            return f"dtype of {c}: {got[c].dtype} != {want[c].dtype}"
    a, b = canonical(got), canonical(want)
    if a.equals(b):
        return None
    bad = (a != b).any(axis=1)
    return f"{int(bad.sum())} of {len(a)} rows differ\n{a[bad].head(4)}\n{b[bad].head(4)}"
