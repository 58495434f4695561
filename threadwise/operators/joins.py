"""Joins by key columns that may hold NULL."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which NULL keys meet NULL keys; the key columns are those of the left side."""
    renamed = right.withColumnsRenamed({key: f"__right_{key}" for key in keys})
    same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"__right_{key}")) for key in keys])
    return left.join(renamed, same, how).drop(*[f"__right_{key}" for key in keys])
