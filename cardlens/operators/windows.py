"""Window operators over cards and daily series.

Card windows are built from pieces of bounded size (see functions.distributed); windows over a series
``(series_key, ds, y)`` hold one row per calendar day and are bounded by the length of the calendar.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.functions.distributed import (SLICE_ROWS, cut_rows, heaviest_value, join_null_safe, own_rows, percentiles,
                                            time_slices, top_per_key, with_scalars)
from cardlens.functions.scalars import percent, ratio


def _seconds(c: str) -> Column:
    return F.unix_timestamp(c)


def running_count(df: DataFrame, card: str = "card_masked", day: str = "transaction_date",
                  stamp: str = "transaction_time", name: str = "running_count") -> DataFrame:
    """Transactions of the card on that day up to and including the row's time.

    Rows are counted per second first, so a window holds at most the seconds of one day.
    """
    per_time = df.groupBy(card, day, stamp).agg(F.count("*").alias("_n"))
    so_far = W.partitionBy(card, day).orderBy(stamp).rowsBetween(W.unboundedPreceding, 0)
    counts = per_time.select(card, day, stamp, F.sum("_n").over(so_far).alias(name))
    return join_null_safe(df, counts, [card, day, stamp])


def velocity_count(df: DataFrame, card: str = "card_masked", stamp: str = "transaction_time", seconds: int = 3600,
                   name: str = "velocity_count") -> DataFrame:
    """Transactions of the card in the trailing span, both ends included.

    Counts per second are put into slices of the span's length and copied into the following slice, so each window
    holds at most two spans of seconds whatever the card. Rows without time have no count.
    """
    per_second = df.where(F.col(stamp).isNotNull()).groupBy(card, _seconds(stamp).alias("_s")).agg(F.count("*").alias("_n"))
    own = F.floor(F.col("_s") / seconds)
    sliced = per_second.withColumn("_own", own).withColumn("_slice", F.explode(F.array("_own", F.col("_own") + 1)))
    trailing = W.partitionBy(card, "_slice").orderBy("_s").rangeBetween(-seconds, 0)
    counts = (
        sliced.withColumn(name, F.sum("_n").over(trailing)).where(F.col("_slice") == F.col("_own"))
        .select(card, "_s", name)
    )
    return join_null_safe(df.withColumn("_s", _seconds(stamp)), counts, [card, "_s"], "left").drop("_s")


def cohort_first_date(df: DataFrame, key: str = "card_masked", date_col: str = "transaction_date") -> DataFrame:
    """First day of each member on every row: a combinable aggregate joined back, not a whole-partition window."""
    return join_null_safe(df, df.groupBy(key).agg(F.min(date_col).alias("first_date")), [key])


def top_mcc_per_card(df: DataFrame, card: str = "hpan") -> DataFrame:
    """Most used code of each card and its share over all codes of the card."""
    valid = df.where(F.col("mcc") > 0)
    top = heaviest_value(valid, [card], "mcc", "top_mcc").withColumnRenamed("top_mcc_count", "mcc_count")
    totals = valid.groupBy(card).agg(F.count("*").alias("_all"))
    return join_null_safe(top, totals, [card]).select(card, "top_mcc", "mcc_count",
                                         ratio(F.col("mcc_count"), F.col("_all")).alias("top_mcc_ratio"))


def sequence_features(df: DataFrame, card: str = "hpan", stamp: str = "transaction_time",
                      tie: str = "transaction_id", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Previous-row gap and ratio and mean of the last ten rows of the card, and the ordinal in the hour, which is counted on
    (card, day, hour). Rows without time come before all others of their card.

    Cards of at most ``slice_rows`` rows are whole in one task, so their rows move once for all windows. Larger cards, of
    which there are fewer than rows / ``slice_rows``, are looked for while the plan is built; their time is cut into slices.
    """
    counts = df.groupBy(card).agg(F.count("*").alias("_n"))
    heavy = [r[0] for r in counts.where(F.col("_n") > slice_rows).select(card).collect()]
    # The windows by card come first: what is clustered by card is clustered by (card, day, hour) too.
    whole = lambda rows: _in_hour(_in_order(rows, [card], stamp, tie), card, stamp, tie)
    if not heavy:
        return whole(df)
    large = F.coalesce(F.col(card).isin(*[h for h in heavy if h is not None]), F.lit(None in heavy))
    sliced, parts = time_slices(_in_hour(df.where(large), card, stamp, tie), card, stamp, [stamp, tie], 9, slice_rows)
    timed = own_rows(_in_order(sliced, parts, stamp, tie))
    return whole(df.where(~large)).unionByName(timed)


def _in_hour(df: DataFrame, card: str, stamp: str, tie: str) -> DataFrame:
    in_hour = W.partitionBy(card, "transaction_date", "hour_num").orderBy(stamp, tie)
    return df.withColumn("txn_hour_count", F.row_number().over(in_hour))


def _in_order(df: DataFrame, parts: Sequence[str], stamp: str, tie: str) -> DataFrame:
    """The columns that follow from the rows of each part in order."""
    by_time = W.partitionBy(*parts).orderBy(stamp, tie)
    last_ten = by_time.rowsBetween(-9, 0)
    amount = F.col("amount_uzs").cast("double")
    nonzero = lambda c: F.when(c == 0, 1.0).otherwise(c)
    mean_ten = ratio(F.sum("amount_uzs").over(last_ten), F.count("amount_uzs").over(last_ten))
    return df.withColumns({
        "_days": F.datediff("transaction_date", F.lag("transaction_date").over(by_time)),
        "prev_amount": F.lag("amount_uzs").over(by_time),
        "card_avg_amount": mean_ten,
    }).withColumns({
        "days_since_prev_txn": F.coalesce(F.col("_days"), F.lit(999)),
        "amount_change_ratio": F.coalesce(amount / nonzero(F.col("prev_amount").cast("double")), F.lit(1.0)),
        "amount_deviation": amount / nonzero(F.col("card_avg_amount")),
    }).drop("_days")


def _series(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy("ds")


def moving_average(series: DataFrame, rows: int = 7, keys: Sequence[str] = ("series_key",), name: str = "ma") -> DataFrame:
    return series.withColumn(name, F.avg("y").over(_series(keys).rowsBetween(-(rows - 1), 0)))


def centered_mean(series: DataFrame, rows: int = 7, keys: Sequence[str] = ("series_key",), name: str = "trend") -> DataFrame:
    """Centred mean, NULL where the frame is not complete, and the residual."""
    half = rows // 2
    frame = _series(keys).rowsBetween(-half, half)
    mean = F.when(F.count("y").over(frame) == 2 * half + 1, F.avg("y").over(frame))
    return series.withColumn(name, mean).withColumn("residual", F.col("y") - F.col(name))


def pct_change(series: DataFrame, value: str, mode: str = "previous", keys: Sequence[str] = (), order: str = "week",
               name: str | None = None) -> DataFrame:
    """Change in percent against the previous row, the median or the mean of a short series of periods."""
    whole = W.partitionBy(*keys)
    v = F.col(value).cast("double")
    base = {"previous": F.lag(v).over(whole.orderBy(order)), "median": F.median(v).over(whole),
            "mean": F.avg(v).over(whole)}[mode]
    change = percent(v - base, base)
    if mode != "previous":
        change = F.coalesce(change, F.lit(0.0))
    return series.withColumn(name or f"{value}_change", change)


def cumulative_share(df: DataFrame, group: str, item: str, volume: str, coverage: float = 0.9,
                     most: int = 50) -> DataFrame:
    """Items of each group in falling volume while their cumulative share stays within coverage: at least one, at most
    ``most``. Only the ``most`` largest items are ever ordered; the share is of the whole group."""
    totals = df.groupBy(group).agg(F.sum(volume).alias("_all"))
    best = top_per_key(df, [group], [F.col(volume).desc(), F.col(item)], most, "rank")
    so_far = W.partitionBy(group).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    shared = best.withColumn("_cum", F.sum(volume).over(so_far))
    shared = join_null_safe(shared, totals, [group])
    shared = shared.withColumn("cum_share", ratio(F.col("_cum"), F.col("_all")))
    return shared.where((F.col("cum_share") <= coverage) | (F.col("rank") == 1)).drop("_cum", "_all")


def quartile_score(df: DataFrame, value: str, name: str, mode: str = "value", tie: str = "hpan",
                   fit_on: DataFrame | None = None) -> DataFrame:
    """Quartile 1–4 by interpolated edges, right-closed.

    ``value`` cuts the values; repeated edges fall back to four equal widths. ``rank`` cuts first-come ranks over (value,
    tie): only the three rows at the edges are looked for, and each row is compared with them. ``fit_on`` is the same frame
    in a form that is cheap to read again.
    """
    if mode == "rank":
        cuts = cut_rows(df if fit_on is None else fit_on, [value, tie], lambda n: [1 + (n - 1) * i // 4 for i in (1, 2, 3)] + [max(n, 1)])
        row = F.struct(value, tie)
        alone = F.get(F.col("_cuts"), 0) == F.get(F.col("_cuts"), 3)
        below = [row <= F.get(F.col("_cuts"), i) for i in range(3)]
        score = F.when(alone, 2).when(below[0], 1).when(below[1], 2).when(below[2], 3).otherwise(4)
        return df.withColumn("_cuts", cuts.select(F.array(*cuts.columns)).scalar()).withColumn(name, score).drop("_cuts")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    found = percentiles(df, [], value, probs)
    e = [F.col("_edges")[f"e{i}"] for i in range(5)]
    v = F.col(value).cast("double")
    distinct = (e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3]) & (e[3] < e[4])
    step = (e[4] - e[0]) / 4
    by_value = F.when(v <= e[1], 1).when(v <= e[2], 2).when(v <= e[3], 3).otherwise(4)
    by_width = F.when(e[0] == e[4], 2).when(v <= e[0] + step, 1).when(v <= e[0] + step * 2, 2).when(
        v <= e[0] + step * 3, 3).otherwise(4)
    score = F.when(v.isNotNull(), F.when(distinct, by_value).otherwise(by_width))
    return with_scalars(df, "_edges", found.agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"e{i}") for i, p in enumerate(probs)])
    ).withColumn(name, score).drop("_edges")
