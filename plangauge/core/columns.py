"""Small helpers for column lists."""

from __future__ import annotations

from pyspark.sql import DataFrame


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but for those named (case does not matter), quoted for select()."""
    gone = {n.lower() for n in names}
    return [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in gone]
