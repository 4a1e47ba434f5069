"""Ordering, limits, deduplication and set operations."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.functions.distributed import top_per_key
from cardlens.functions.scalars import day, percent


def order_limit(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """Distributed top-n: each partition keeps n rows before the merge."""
    return df.orderBy(*order).limit(n)


def head_per_group(df: DataFrame, key: str, order: Sequence[Column | str], n: int = 100) -> DataFrame:
    return top_per_key(df, [key], [F.col(o) if isinstance(o, str) else o for o in order], n, "_r").drop("_r")


def dedup_keep_first(df: DataFrame, subset: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in the stated order; rows are cut to one per key before the shuffle too."""
    return top_per_key(df, list(subset), [F.col(o) if isinstance(o, str) else o for o in order], 1, "_r").drop("_r")


def full_row_duplicates(df: DataFrame) -> DataFrame:
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def key_duplicates(df: DataFrame, key: str) -> DataFrame:
    groups = df.groupBy(key).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.sum("_n").alias("total"), F.count("*").alias("distinct_keys"), (F.sum("_n") - F.count("*")).alias("duplicates"),
        percent(F.sum("_n") - F.count("*"), F.sum("_n")).alias("duplicate_pct"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def distinct_values(df: DataFrame, dim: str) -> DataFrame:
    return df.select(dim).where(F.col(dim).isNotNull()).distinct().orderBy(dim)


def threshold_split(df: DataFrame, cut, date_col: str = "transaction_date") -> tuple[DataFrame, DataFrame]:
    """Rows before the cut day, and rows from it on."""
    return df.where(F.col(date_col) < day(cut)), df.where(F.col(date_col) >= day(cut))
