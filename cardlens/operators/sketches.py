"""Distinct counts as state: sketches per day and key that merge over any period.

Exact distinct counts cannot be added up, so each period reads all its rows again. A sketch of fixed size per (day, key,
column) can: days are folded into weeks, months or any range, and keys into coarser keys, without the rows. Counts, sums and
extremes are kept beside it and stay exact.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SKETCH_BITS = 14  # 2^14 registers, of four to eight bits each


def relative_error(bits: int = SKETCH_BITS) -> float:
    """Standard error of one sketch, in its published worst case."""
    return 1.04 / math.sqrt(1 << bits)


def daily_states(df: DataFrame, keys: Sequence[str], columns: Sequence[str], amount: str = "amount", day: str = "transaction_date",
                 bits: int = SKETCH_BITS) -> DataFrame:
    """One row per day and key: ``transactions``, ``volume``, ``largest`` and a sketch ``<column>_sketch`` of each column.

    One pass; a row of state is combined before the shuffle. NULL values are not counted, NULL keys are keys.
    """
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(bits)).alias(f"{c}_sketch") for c in columns]
    return df.groupBy(day, *keys).agg(F.count("*").alias("transactions"), F.sum(amount).alias("volume"), F.max(amount).alias("largest"), *sketches)


def _in_period(day: str, date_from, date_to) -> Column:
    inside = F.lit(True)
    if date_from is not None:
        inside = inside & (F.col(day) >= F.lit(date_from).cast("date"))
    if date_to is not None:
        inside = inside & (F.col(day) <= F.lit(date_to).cast("date"))
    return inside


def merge_states(states: DataFrame, keys: Sequence[str], date_from=None, date_to=None, day: str = "transaction_date") -> DataFrame:
    """States of a period, both ends included, by the same or fewer keys; what comes out can be merged again."""
    sketches = [c for c in states.columns if c.endswith("_sketch")]
    return states.where(_in_period(day, date_from, date_to)).groupBy(*keys).agg(
        F.sum("transactions").alias("transactions"), F.sum("volume").alias("volume"), F.max("largest").alias("largest"),
        *[F.hll_union_agg(c).alias(c) for c in sketches])


def rolling_states(states: DataFrame, keys: Sequence[str], days: int, day: str = "transaction_date") -> DataFrame:
    """For each day with rows the merged state of the trailing ``days``: every state is added to the days it belongs to."""
    spread = states.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn("_day", F.date_add(day, F.col("_to")))
    present = states.select(F.col(day).alias("_day")).distinct()
    merged = merge_states(spread.join(present, "_day", "left_semi").drop(day), [*keys, "_day"], day="_day")
    return merged.withColumnRenamed("_day", day)


def estimates(states: DataFrame) -> DataFrame:
    """Sketches replaced by their counts: ``unique_<column>``."""
    return states.select(*[F.hll_sketch_estimate(c).alias(f"unique_{c.removesuffix('_sketch')}") if c.endswith("_sketch") else F.col(c) for c in states.columns])


def exact_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], day: str | None = None, days: int = 1) -> DataFrame:
    """Exact ``unique_<column>`` per key, of all columns from one table of (key, column, value), so that a row is not expanded
    for each aggregate and equal values are combined before the shuffle.

    With ``day`` one row per key and day with rows, counting the trailing ``days``. Rows are not copied to the days they count
    in: a value counts from each of its days until its next one or the end of the span, whichever comes first, so each of its
    days adds one and takes one away again, and the counts are running sums over the days.
    """
    held = [*keys, *([day] if day else [])]
    text = df.select(*held, *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(columns)])
    values = text.unpivot(held, [f"_c{i}" for i in range(len(columns))], "_column", "_value").groupBy(*held, "_column", "_value").agg(F.lit(1).alias("_one"))
    if day is None:
        return values.groupBy(*keys).agg(*[F.count(F.when(F.col("_column") == f"_c{i}", F.col("_value"))).alias(f"unique_{c}") for i, c in enumerate(columns)])
    over = F.date_add(day, days)
    after = F.least(F.lead(day).over(W.partitionBy(*keys, "_column", "_value").orderBy(day)), over)  # least passes over NULL
    counted = F.col("_value").isNotNull().cast("int")
    step = lambda at, n, has_rows: F.struct(at.alias(day), n.alias("_n"), F.lit(has_rows).alias("_rows"))
    ends = values.where(F.col(day).isNotNull()).withColumn("_after", after).select(
        *keys, "_column", F.inline(F.array(step(F.col(day), counted, True), step(F.col("_after"), -counted, False))))
    steps = ends.groupBy(*keys, day).agg(F.max("_rows").alias("_rows"), *[
        F.coalesce(F.sum(F.when(F.col("_column") == f"_c{i}", F.col("_n"))), F.lit(0)).alias(f"_s{i}") for i in range(len(columns))])
    line = W.partitionBy(*keys).orderBy(day)  # days with their sums, not rows
    return steps.select(*held, "_rows", *[F.sum(f"_s{i}").over(line).alias(f"unique_{c}") for i, c in enumerate(columns)]).where("_rows").drop("_rows")
