"""Comparison of a frame with DuckDB."""

from __future__ import annotations

import os


def plain(value):
    """A value as text that is alike in both engines."""
    import numpy as np
    import pandas as pd

    if value is None or value is pd.NA or isinstance(value, float) and value != value:
        return "null"
    if isinstance(value, (list, tuple, np.ndarray)):
        return str([plain(x) for x in value])
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (float, np.floating)):
        return str(int(value)) if float(value).is_integer() else f"{float(value):.10g}"
    return str(value)


def same_rows(frame, sql: str, sf_dir: str) -> None:
    """The frame has the rows that DuckDB gives for the SQL over the same tables."""
    import duckdb

    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in cursor.fetchall())
    got = sorted(tuple(plain(row[c]) for c in sorted(names)) for row in frame.collect())
    assert got == want
