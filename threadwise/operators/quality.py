"""Constraint checks that a row store would declare."""

from pyspark.sql import DataFrame, functions as F

from threadwise.schemas import COMMENTS_NOT_NULL


def orphan_rows(df: DataFrame, foreign_key: str, parents: DataFrame, key: str, row_id: str) -> DataFrame:
    """Rows whose non-NULL foreign key has no parent row."""
    keys = parents.select(F.col(key).alias(foreign_key)).distinct()
    referring = df.filter(F.col(foreign_key).isNotNull()).select(row_id, foreign_key)
    return referring.join(keys, foreign_key, "left_anti").select(row_id, foreign_key)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def null_violations(df: DataFrame, columns: list[str] = COMMENTS_NOT_NULL) -> DataFrame:
    """NULLs per column that must not hold any."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "nulls")
