"""Constraints as queries: each gives the rows that break one. The front end raises if there is any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(df: DataFrame, col: str) -> DataFrame:
    """NOT NULL: the rows without a value."""
    return df.where(F.col(col).isNull())


def too_long(df: DataFrame, col: str, size: int) -> DataFrame:
    """VARCHAR(n), CHAR(n): the rows of more than n bytes; trailing blanks are padding."""
    return df.where(F.octet_length(F.rtrim(col)) > size)


def outside(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """ENUM: the rows whose value is none of the type's."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(values))


def orphans(df: DataFrame, col: str, parent: DataFrame, key: str) -> DataFrame:
    """FOREIGN KEY: the rows whose value is in no row of the parent."""
    return df.where(F.col(col).isNotNull()).join(parent.select(F.col(key).alias("__tsr_fk")), F.col(col) == F.col("__tsr_fk"), "left_anti")


def repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """PRIMARY KEY, UNIQUE: the keys of several rows, with their number. Keys with a null repeat nothing."""
    held = df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    return held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def taken(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """PRIMARY KEY, UNIQUE: the keys of new rows that old rows have."""
    return old.select(*keys).join(new.select(*keys), keys, "left_semi")
