"""Outputs: append, overwrite, window replacement, checked publication, monthly layout, CSV export, extents."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.session import checkpoint_dir, shuffles_dropped


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once below the shared checkpoint folder and read from there: for frames that several jobs read.

    Columns are encoded and packed closely, so it takes a fraction of the room of a persisted frame and none of the memory.
    The shuffles behind it are dropped.
    """
    path = scratch(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_window(df: DataFrame, path: str, key: str = "window_end") -> None:
    """Replace only the windows present in the frame, so a rerun gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def publish(df: DataFrame, live: str, checks: Sequence[Column]) -> DataFrame:
    """Write a staged table, check its summary row, then swap names; the old table is kept as ``<live>_backup``.

    Each check is an aggregate condition that must hold. Returns the summary of the new table.
    """
    spark = df.sparkSession
    staged, backup = f"{live}_staged", f"{live}_backup"
    df.write.mode("overwrite").saveAsTable(staged)
    new = spark.table(staged)
    passed = new.agg(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(checks)]).first()
    failed = [i for i, ok in enumerate(passed) if not ok]
    if failed:
        raise ValueError(f"checks {failed} failed for {live}; the live table is unchanged")
    older = f"{live}_older"
    replaced = spark.catalog.tableExists(live)
    if replaced:
        spark.sql(f"DROP TABLE IF EXISTS {older}")
        if spark.catalog.tableExists(backup):
            spark.sql(f"ALTER TABLE {backup} RENAME TO {older}")
        spark.sql(f"ALTER TABLE {live} RENAME TO {backup}")
    try:
        spark.sql(f"ALTER TABLE {staged} RENAME TO {live}")
    except Exception:
        if replaced:  # put everything back as it was
            spark.sql(f"ALTER TABLE {backup} RENAME TO {live}")
            if spark.catalog.tableExists(older):
                spark.sql(f"ALTER TABLE {older} RENAME TO {backup}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {older}")
    return table_extent(spark.table(live))


def write_by_month(df: DataFrame, path: str, date_col: str = "transaction_date", order: Sequence[str] = ("hpan", "transaction_id")) -> None:
    """Partition by month, sorted by day and key inside. Rows are split by ranges of (month, day, key), so a heavy month or
    card is spread over several tasks and files whose statistics do not overlap."""
    keys = ["month", date_col, *order]
    (df.withColumn("month", F.date_format(date_col, "yyyyMM")).repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.mode("overwrite").partitionBy("month").parquet(path))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def head_n(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def sample_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """A repeatable sample: the n smallest hashes of the key (distributed top-n)."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def table_extent(df: DataFrame, date_col: str = "transaction_date") -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.min(date_col).alias("first_day"), F.max(date_col).alias("last_day"),
                  F.datediff(F.max(date_col), F.min(date_col)).alias("day_span"))
