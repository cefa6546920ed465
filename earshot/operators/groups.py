"""Joins of grouped tables, in which a null key is a group like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, by: list[str] | tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on ``by`` with nulls equal; the columns of ``by`` come from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in by})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in by))
    return left.join(renamed, same, how).drop(*(f"_right_{k}" for k in by))
