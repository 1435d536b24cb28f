"""Guards and helpers for tables whose columns are known by name only."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df itself; KeyError names the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def first_present(df: DataFrame, names: Sequence[str]) -> str:
    """The first of several names that df has."""
    for name in names:
        if name in df.columns:
            return name
    raise KeyError(f"none of the columns {', '.join(names)}")


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """df itself; ValueError if a key occurs twice. One aggregation, stopped at the first such key."""
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"key {key} is not unique")
    return df


def suffix_duplicates(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Make a key unique: the second and later rows of a value get -1, -2, ... after it, in the given order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn(key, F.when(n > 0, F.concat_ws("-", F.col(key).cast("string"), n.cast("string"))).otherwise(F.col(key).cast("string")))


def numeric_order(name: str | Column) -> list[Column]:
    """Sort keys for ids in text form: numbers first, by value, then text."""
    c = (F.col(name) if isinstance(name, str) else name).cast("string")
    number = c.rlike("^[0-9]+$")
    return [(~number).asc(), F.when(number, c.cast("decimal(38,0)")).asc(), c.asc()]


def in_order(values: Iterable[str], c: Column) -> Column:
    """The place of a column's value among values, from 0; null if it is not there."""
    return F.nullif(F.array_position(F.lit(list(values)), c), F.lit(0)) - 1
