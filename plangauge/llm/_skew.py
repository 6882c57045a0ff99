"""Joins of rows with one row for each of their keys, where a key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, parts: int = 1000) -> DataFrame:
    """rows joined with groups (a stored table: one row for each key, `size` being how many of the rows have it).

    Keys that hold more than one part in `parts` of all rows are fewer than `parts`, so they are broadcast and their rows stay where
    they are; no other key brings more than that part into one task.
    """
    total, largest = groups.agg(F.sum(size), F.max(size)).first()
    if not total or largest * parts <= total:
        return rows.join(groups, key)
    hot = F.col(size) * parts > total
    known = F.broadcast(groups.where(hot))
    return rows.join(known, key).unionByName(rows.join(F.broadcast(groups.where(hot).select(key)), key, "left_anti").join(groups.where(~hot), key))
