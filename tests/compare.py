"""Row sets of Spark and DuckDB in one comparable form."""

import pandas as pd


def value(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return round(float(x), 9)
    return str(x)


def rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return sorted((tuple(value(x) for x in row) for row in frame[columns].itertuples(index=False, name=None)), key=repr)
