"""Anomalies, drift and descriptive statistics."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.functions.distributed import join_null_safe, percentiles, wide_percentiles, with_scalars
from cardlens.functions.scalars import is_missing, log_amount, newest_day, percent, ratio
from cardlens.operators.windows import running_count, velocity_count

ANOMALY_COLUMNS = ["transaction_id", "company_id", "card_masked", "amount", "merchant_name", "mcc_code", "transaction_time"]


def zscore_anomalies(df: DataFrame, sensitivity: float = 3.0, days: int = 30, as_of=None) -> DataFrame:
    """Rows of the anchor day whose amount lies too many deviations from the mean of the last days."""
    last = newest_day(df, as_of)
    recent = df.where(F.col("transaction_date").between(F.date_sub(last, days), last))
    amount = F.col("amount").cast("double")
    level = recent.agg(F.avg(amount).alias("mean"), F.stddev_pop(amount).alias("std"))
    rows = with_scalars(df.where(F.col("transaction_date") == last), "_l", level)
    scored = rows.withColumn("z_score", ratio(amount - F.col("_l.mean"), F.col("_l.std")))
    return scored.where(F.abs("z_score") > sensitivity).select(*ANOMALY_COLUMNS, F.lit("amount_anomaly").alias("anomaly_type"), "z_score")


def velocity_anomalies(df: DataFrame, threshold: int = 10, mode: str = "hour", seconds: int = 3600, as_of=None,
                       all_days: bool = False) -> DataFrame:
    """Rows whose card was used too often: within the trailing span, or since the start of the day (``running``)."""
    rows = df if all_days else df.where(F.col("transaction_date") == newest_day(df, as_of))
    counted = running_count(rows, name="_n") if mode == "running" else velocity_count(rows, seconds=seconds, name="_n")
    return counted.where(F.col("_n") > threshold).select(
        *ANOMALY_COLUMNS, F.lit("velocity_anomaly").alias("anomaly_type"), F.col("_n").cast("double").alias("z_score"))


def detect_anomalies(df: DataFrame, sensitivity: float = 3.0, threshold: int = 10, as_of=None, n: int | None = None) -> DataFrame:
    """Both kinds, strongest first; ``n`` asks for a top-n report."""
    both = zscore_anomalies(df, sensitivity, as_of=as_of).unionByName(velocity_anomalies(df, threshold, as_of=as_of))
    ranked = both.orderBy(F.col("z_score").desc(), "transaction_id", "anomaly_type")
    return ranked if n is None else ranked.limit(n)


def iqr_flags(series: DataFrame, k: float = 3.0, keys: Sequence[str] = ("series_key",)) -> DataFrame:
    """Series rows with fences and flag; quartiles are per series, whose length is the calendar's."""
    quart = series.groupBy(*keys).agg(F.percentile("y", 0.25).alias("q1"), F.percentile("y", 0.75).alias("q3"))
    fences = quart.select(*keys, (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("low"),
                          (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("high"))
    return join_null_safe(series, fences, keys).withColumn("is_anomaly", ((F.col("y") < F.col("low")) | (F.col("y") > F.col("high"))).cast("int"))


def iqr_anomalies(series: DataFrame, k: float = 3.0, keys: Sequence[str] = ("series_key",)) -> DataFrame:
    """Anomaly count, rate and dates of each series."""
    return iqr_flags(series, k, keys).groupBy(*keys).agg(
        F.count("*").alias("length"), F.sum("is_anomaly").alias("anomalies"),
        percent(F.sum("is_anomaly"), F.count("*")).alias("anomaly_rate"),
        F.array_sort(F.collect_list(F.when(F.col("is_anomaly") == 1, F.col("ds").cast("string")))).alias("anomaly_dates"))


def weekly_zscore(weeks: DataFrame, limit: float = 2.0) -> DataFrame:
    """Deviation of each week, the coefficients of variation and their risk levels; one row per week."""
    everyone = W.partitionBy()
    cv = lambda c: percent(F.stddev_samp(F.col(c).cast("double")).over(everyone), F.avg(F.col(c).cast("double")).over(everyone))
    risk = lambda c: F.when(c < 15, "low").when(c < 30, "medium").otherwise("high")
    v = F.col("volume").cast("double")
    z = ratio(v - F.avg(v).over(everyone), F.stddev_samp(v).over(everyone))
    return weeks.select("week", "volume", "transactions", z.alias("z_score"), cv("volume").alias("volume_cv"), cv("transactions").alias("transactions_cv")
                        ).withColumns({"is_anomaly": F.coalesce((F.abs("z_score") > limit).cast("int"), F.lit(0)),
                                       "volume_risk": risk(F.col("volume_cv")), "transactions_risk": risk(F.col("transactions_cv"))})


def _drift_status(c):
    return F.when(c < 0.1, "stable").when(c < 0.25, "moderate").otherwise("critical")


def psi_bins(baseline: DataFrame, current: DataFrame, col: str, bins: int = 10, open_ends: bool = False,
             floor: float = 0.001) -> DataFrame:
    """Proportions of both samples in the quantile bins of the baseline.

    Bins are right-closed, the first one includes its lower edge, repeated edges are dropped. Values outside the baseline
    range are left out, or put into the end bins with ``open_ends``. Proportions have a floor.
    """
    probs = [i / bins for i in range(bins + 1)]
    found = {row["value"] for row in percentiles(baseline, [], col, probs).collect()}  # bins + 1 numbers
    edges = sorted(found)
    n_bins = len(edges) - 1

    def counted(df: DataFrame, side: str) -> DataFrame:
        v = F.col(col).cast("double")
        below = sum((v > e).cast("int") for e in edges) if edges else F.lit(0)
        at = F.when(v == edges[0], 1).otherwise(below) if edges else F.lit(0)
        if open_ends:
            at = F.greatest(F.least(at, F.lit(n_bins)), F.lit(1))
        # Out-of-range bins are left out by the join with the grid: filtering rows first would compute each bin twice.
        return df.groupBy(at.alias("bin")).agg(F.count(col).alias(side))

    grid = baseline.sparkSession.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))
    wide = grid.join(counted(baseline, "n_base"), "bin", "left").join(counted(current, "n_cur"), "bin", "left").na.fill(0)
    everyone = W.partitionBy()
    share = lambda c: F.greatest(F.coalesce(ratio(F.col(c), F.sum(c).over(everyone)), F.lit(0.0)), F.lit(floor))
    return wide.withColumns({"base_share": share("n_base"), "cur_share": share("n_cur")}).withColumn(
        "psi", (F.col("cur_share") - F.col("base_share")) * F.log(F.col("cur_share") / F.col("base_share"))).orderBy("bin")


def psi(baseline: DataFrame, current: DataFrame, col: str, bins: int = 10, open_ends: bool = False) -> DataFrame:
    total = psi_bins(baseline, current, col, bins, open_ends).agg(F.round(F.sum("psi"), 6).alias("psi"))
    return total.withColumn("status", _drift_status(F.col("psi")))


def quantile_shift(current: DataFrame, previous: DataFrame, col: str = "amount_uzs") -> DataFrame:
    """Mean relative shift of the nine deciles of positive values."""
    deciles = [i / 10 for i in range(1, 10)]
    now = percentiles(current.where(F.col(col) > 0), [], col, deciles).withColumnRenamed("value", "now")
    then = percentiles(previous.where(F.col(col) > 0), [], col, deciles).withColumnRenamed("value", "then")
    shifts = now.join(then, "prob").where(F.col("then") > 0)
    out = shifts.agg(F.round(F.avg(F.abs(F.col("now") - F.col("then")) / F.col("then")), 6).alias("shift"))
    return out.withColumn("status", F.when(F.col("shift").isNull(), "no data").otherwise(_drift_status(F.col("shift"))))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs from one aggregation."""
    pairs = list(combinations_with_replacement(cols, 2))
    number = lambda c: F.col(c).cast("double")
    row = df.agg(*[F.corr(number(a), number(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("corr"))
               for i, p in enumerate(pairs) for a, b in {p, p[::-1]}]
    return row.select(F.inline(F.array(*entries)))


def numeric_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each column; columns are the groups of one quantile job."""
    long = df.select(*[F.col(c).cast("string").try_cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "v").where(
        F.col("v").isNotNull())
    base = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                      F.min("v").alias("min"), F.max("v").alias("max"))
    return base.join(wide_percentiles(long, ["column"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "column", "left")


def categorical_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    nulls = F.sum(F.when(is_missing("value"), F.col("n")).otherwise(0))
    return counts.groupBy("column").agg(F.count_if(~is_missing("value")).alias("distinct_values"), nulls.alias("nulls"),
                                        percent(nulls, F.sum("n")).alias("null_pct"))


def histogram(df: DataFrame, col: str, bins: int = 50, log: bool = False) -> DataFrame:
    """Counts in equal widths between the smallest and largest positive value; empty bins are left out."""
    positive = df.where(F.col(col) > 0)
    v = log_amount(col) if log else F.col(col).cast("double")
    rows = positive.select(v.alias("v"))
    framed = with_scalars(rows, "_r", rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col("v") - lo) * bins, hi - lo), F.lit(0.0))), F.lit(bins - 1)) + 1
    return framed.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin")


def volume_volatility(series: DataFrame) -> DataFrame:
    return series.agg(F.count("*").alias("days"), F.avg("y").alias("mean"), F.max("y").alias("max"), F.min("y").alias("min"),
                      percent(F.stddev_samp("y"), F.avg("y")).alias("volatility"))
