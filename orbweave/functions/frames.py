"""Pandas frames that go back to Spark."""

from __future__ import annotations

import pandas as pd


def frame(columns: dict) -> pd.DataFrame:
    """A frame whose strings are plain objects (Arrow-backed ones may come in chunks, which Spark doesn't take)."""
    df = pd.DataFrame(columns)
    return df.astype({c: object for c, t in df.dtypes.items() if pd.api.types.is_string_dtype(t)})
