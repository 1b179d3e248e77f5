"""Rows of two frames as sorted text, for comparing Spark's results with DuckDB's."""

import pandas as pd


def _text(x):
    if isinstance(x, float) and x == int(x if x == x and abs(x) != float("inf") else 0):
        return str(int(x))
    return "null" if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else f"{x:.9g}" if isinstance(x, float) else str(x)


def same_rows(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(_text, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
