"""Time series on ``(series_key, ds, y)``: all series of a frame are forecast in one job.

A series has one row per day; whatever is ordered per series is bounded by the length of the calendar. ``keys`` may hold
more columns than the series key, which is how back-test folds ride along.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import erfc, exp, gamma, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cardlens.functions.distributed import join_null_safe, top_per_key
from cardlens.functions.scalars import percent, ratio
from cardlens.operators.joins import align_on_date
from cardlens.operators.stats import iqr_anomalies
from cardlens.operators.windows import centered_mean, cumulative_share

KEYS = ("series_key",)
OTHER = "__OTHER__"
BAND = 1.96


def fill_calendar(series: DataFrame, keys: Sequence[str] = KEYS, end: Column | None = None) -> DataFrame:
    """One row per day between the first and last day of each series; days without a row get 0."""
    span = series.groupBy(*keys).agg(F.min("ds").alias("_a"), F.max("ds").alias("_b"))
    last = F.col("_b") if end is None else end
    days = span.select(*keys, F.explode(F.sequence("_a", last)).alias("ds"))
    return join_null_safe(days, series, [*keys, "ds"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def _last_rows(series: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return top_per_key(series, list(keys), [F.col("ds").desc()], n, "_back")


def _steps(anchors: DataFrame, horizon: int) -> DataFrame:
    """Future days of each series after its last day ``_last``."""
    return anchors.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("ds", F.date_add("_last", F.col("step")))


def _band(df: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    return df.select(*keys, "ds", "yhat", (F.col("yhat") * low).alias("yhat_lower"), (F.col("yhat") * high).alias("yhat_upper"))


def ma7_forecast(series: DataFrame, horizon: int = 30, keys: Sequence[str] = KEYS) -> DataFrame:
    """The mean of the last seven rows, repeated."""
    level = _last_rows(series, keys, 7).groupBy(*keys).agg(F.avg("y").alias("yhat"), F.max("ds").alias("_last"))
    return _band(_steps(level, horizon), keys, 0.9, 1.1)


def seasonal_naive(series: DataFrame, horizon: int = 14, season: int = 7, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last season, repeated; the mean where a series is shorter than a season."""
    tail = _last_rows(series.where(F.col("y").isNotNull()), keys, season)
    pattern = tail.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg("y").alias("_mean"),
        F.transform(F.array_sort(F.collect_list(F.struct("ds", "y"))), lambda s: s["y"]).alias("_season"))
    ends = series.groupBy(*keys).agg(F.max("ds").alias("_last"))
    steps = _steps(join_null_safe(pattern, ends, keys), horizon)
    repeated = F.when(F.col("_n") < season, F.col("_mean")).otherwise(
        F.try_element_at("_season", F.pmod(F.col("step") - 1, F.lit(season)).cast("int") + 1))
    return _band(steps.withColumn("yhat", repeated), keys, 0.8, 1.2)


def trend_weekday_forecast(series: DataFrame, horizon: int = 30, keys: Sequence[str] = KEYS) -> DataFrame:
    """Linear trend times a weekday index with a 95 % band from the residuals; three small aggregates per series."""
    keys = list(keys)
    first = series.groupBy(*keys).agg(F.min("ds").alias("_first"), F.max("ds").alias("_last"))
    timed = join_null_safe(series, first, keys).withColumn("_t", F.datediff("ds", "_first").cast("double"))
    line = timed.groupBy(*keys).agg(F.coalesce(F.regr_slope("y", "_t"), F.lit(0.0)).alias("_slope"),
                                    F.coalesce(F.regr_intercept("y", "_t"), F.avg("y")).alias("_base"))
    trend = F.col("_base") + F.col("_slope") * F.col("_t")
    fitted = join_null_safe(timed, line, keys).withColumn("_trend", trend)
    index = fitted.groupBy(*keys, F.weekday("ds").alias("_dow")).agg(F.coalesce(F.avg(F.try_divide("y", "_trend")), F.lit(1.0)).alias("_index"))
    resid = join_null_safe(fitted.withColumn("_dow", F.weekday("ds")), index, [*keys, "_dow"]).groupBy(*keys).agg(
        F.coalesce(F.stddev_samp(F.col("y") - F.col("_trend") * F.col("_index")), F.lit(0.0)).alias("_sd"))
    future = _steps(join_null_safe(join_null_safe(first, line, keys), resid, keys), horizon).withColumns(
        {"_t": F.datediff("ds", "_first").cast("double"), "_dow": F.weekday("ds")})
    return join_null_safe(future, index, [*keys, "_dow"], "left").withColumn("yhat", trend * F.coalesce("_index", F.lit(1.0))).select(
        *keys, "ds", "yhat", (F.col("yhat") - BAND * F.col("_sd")).alias("yhat_lower"), (F.col("yhat") + BAND * F.col("_sd")).alias("yhat_upper"))


def ensemble(forecasts: Sequence[DataFrame], weights: Sequence[float] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weighted mean per series and day of the models that have a value there."""
    weights = weights or [1.0 / len(forecasts)] * len(forecasts)
    every = reduce(DataFrame.unionByName, [f.select(*keys, "ds", "yhat", "yhat_lower", "yhat_upper", F.lit(float(w)).alias("_w"))
                                           for f, w in zip(forecasts, weights)])
    mean = lambda c: (F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c)
    return every.groupBy(*keys, "ds").agg(*[mean(c) for c in ("yhat", "yhat_lower", "yhat_upper")])


def _error_measures(inside: Column) -> list[Column]:
    """Count, errors and band coverage of rows with ``y`` and ``yhat``."""
    gap, size = F.abs(F.col("y") - F.col("yhat")), (F.abs("y") + F.abs("yhat")) / 2
    return [F.count("*").alias("n"), (F.avg(F.try_divide(gap, F.abs("y"))) * 100).alias("mape"), (F.avg(F.try_divide(gap, size)) * 100).alias("smape"),
            F.avg(gap).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), percent(F.count_if(inside), F.count("*")).alias("coverage")]


def forecast_metrics(forecast: DataFrame, holdout: DataFrame, train: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Percentage, symmetric, scaled, absolute and squared errors and band coverage per series."""
    keys = list(keys)
    both = align_on_date(holdout, forecast, keys).where(F.col("y").isNotNull() & F.col("yhat").isNotNull())
    errors = both.groupBy(*keys).agg(*_error_measures(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper"))))
    step = F.abs(F.col("y") - F.lag("y").over(W.partitionBy(*keys).orderBy("ds")))
    naive = train.where(F.col("y").isNotNull()).withColumn("_d", step).groupBy(*keys).agg(F.avg("_d").alias("_naive"))
    return join_null_safe(errors, naive, keys, "left").withColumn("mase", F.try_divide("mae", "_naive")).drop("_naive")


def _fold_ends(series: DataFrame, n_splits: int, test_size: int, min_train: int, keys: Sequence[str]) -> DataFrame:
    """Each row with its number, its count of values and ``_folds``: what prefix sums say at the last training row of each fold.

    The regression line, the mean step and the last day of every fold are read from running sums at one row, so a series is
    sorted once, whatever the number of folds.
    """
    whole = W.partitionBy(*keys)
    upto = whole.orderBy("ds").rowsBetween(W.unboundedPreceding, 0)
    before = whole.orderBy("ds").rowsBetween(W.unboundedPreceding, -1)
    has = F.col("y").isNotNull()
    timed = series.select(*keys, "ds", "y").withColumns({
        "_rn": F.row_number().over(whole.orderBy("ds")), "_len": F.count("*").over(whole), "_t": F.datediff("ds", F.min("ds").over(whole)).cast("double"),
        "_step": F.abs(F.col("y") - F.last("y", ignorenulls=True).over(before))})
    moments = timed.withColumns({
        "_n": F.count("y").over(upto), "_st": F.sum(F.when(has, F.col("_t"))).over(upto), "_sy": F.sum("y").over(upto),
        "_stt": F.sum(F.when(has, F.col("_t") * F.col("_t"))).over(upto), "_sty": F.sum(F.col("_t") * F.col("y")).over(upto),
        "_naive": F.avg("_step").over(upto)})
    spread = F.col("_n") * F.col("_stt") - F.col("_st") * F.col("_st")
    slope = F.coalesce(F.try_divide(F.col("_n") * F.col("_sty") - F.col("_st") * F.col("_sy"), spread), F.lit(0.0))
    split = F.try_divide(F.col("_len") - F.col("_rn"), F.lit(test_size))
    ends = (split == F.floor(split)) & split.between(1, n_splits) & (F.col("_rn") >= min_train)
    level = F.try_divide(F.col("_sy") - slope * F.col("_st"), F.col("_n"))
    fold = F.when(ends, F.struct(split.cast("int").alias("split"), F.col("_rn").alias("start"), F.col("_n").alias("n"), F.col("ds").alias("last"),
                                 slope.alias("slope"), level.alias("base"), F.col("_naive").alias("naive")))
    return moments.withColumn("_fold", fold).withColumn("_folds", F.collect_list("_fold").over(whole)).select(*keys, "ds", "y", "_rn", "_n", "_t", "_folds")


def rolling_origin(series: DataFrame, n_splits: int = 3, test_size: int = 14, min_train: int = 30, keys: Sequence[str] = KEYS, season: int = 7) -> DataFrame:
    """Back-test of both models: one row per series, split and model; n_splits does not change the plan.

    Lines and steps of the folds come from prefix sums. The weekday index is a mean of ratios to the fold's own line, which no
    difference of prefixes gives, so rows are paired with their folds inside the tasks that sorted them and only sums per fold
    and weekday leave: the series is shuffled once. Residual spreads follow from the same sums.
    """
    keys = list(keys)
    fold_keys = [*keys, "split"]
    rows = _fold_ends(series, n_splits, test_size, min_train, keys).withColumn("_f", F.explode("_folds"))
    y, trend = F.col("y"), F.col("_f.base") + F.col("_f.slope") * F.col("_t")
    train = (F.col("_rn") <= F.col("_f.start")) & y.isNotNull()
    test = (F.col("_rn") > F.col("_f.start")) & (F.col("_rn") <= F.col("_f.start") + test_size)
    both = train & trend.isNotNull()
    part = lambda test, c: F.sum(F.when(test, c))
    listed = lambda test, *c: F.collect_list(F.when(test, F.struct(*c)))
    weekday = rows.groupBy(*keys, F.col("_f.split").alias("split"), F.weekday("ds").alias("_dow")).agg(
        F.first("_f").alias("_f"), F.coalesce(F.avg(F.when(train, F.try_divide(y, trend))), F.lit(1.0)).alias("_index"),
        F.count_if(both).alias("_m"), part(both, y).alias("_y"), part(both, trend).alias("_tr"), part(both, y * y).alias("_yy"),
        part(both, y * trend).alias("_ytr"), part(both, trend * trend).alias("_trtr"),
        listed(train & (F.col("_n") > F.col("_f.n") - season), "ds", "y").alias("_tail"), listed(test & y.isNotNull(), "ds", "y", "_t").alias("_test"))
    index = F.col("_index")
    resid, square = F.col("_y") - index * F.col("_tr"), F.col("_yy") - 2 * index * F.col("_ytr") + index * index * F.col("_trtr")
    folds = weekday.groupBy(*fold_keys).agg(
        F.first("_f").alias("_f"), F.map_from_entries(F.collect_list(F.struct("_dow", "_index"))).alias("_by_day"),
        F.sum("_m").alias("_m"), F.sum(resid).alias("_r"), F.sum(square).alias("_rr"),
        F.transform(F.array_sort(F.flatten(F.collect_list("_tail"))), lambda s: s["y"]).alias("_season"), F.flatten(F.collect_list("_test")).alias("_test"))
    spread = F.try_divide(F.greatest(F.col("_rr") - F.col("_r") * F.try_divide(F.col("_r"), F.col("_m")), F.lit(0.0)), F.col("_m") - 1)
    mean = F.aggregate("_season", F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size("_season"), F.lit(0))
    days = folds.withColumns({"_sd": F.coalesce(F.sqrt(spread), F.lit(0.0)), "_mean": mean}).withColumn("_d", F.explode("_test"))
    step = F.datediff("_d.ds", "_f.last")
    repeated = F.when(F.size("_season") < season, F.col("_mean")).otherwise(F.try_element_at("_season", F.pmod(step - 1, F.lit(season)).cast("int") + 1))
    line = (F.col("_f.base") + F.col("_f.slope") * F.col("_d._t")) * F.coalesce(F.try_element_at("_by_day", F.weekday("_d.ds")), F.lit(1.0))
    made = lambda name, yhat, low, high: F.struct(F.lit(name).alias("model"), yhat.alias("yhat"), low.alias("low"), high.alias("high"))
    forecasts = days.where(step.between(1, test_size)).select(*fold_keys, F.col("_d.y").alias("y"), F.col("_f.naive").alias("_naive"), F.explode(F.array(
        made("seasonal_naive", repeated, repeated * 0.8, repeated * 1.2),
        made("trend_weekday", line, line - BAND * F.col("_sd"), line + BAND * F.col("_sd")))).alias("_p")).select("*", "_p.*").where("yhat IS NOT NULL")
    errors = forecasts.groupBy(*fold_keys, "model").agg(*_error_measures(F.col("y").between(F.col("low"), F.col("high"))), F.first("_naive").alias("_naive"))
    return errors.withColumn("mase", F.try_divide("mae", "_naive")).drop("_naive")


def backtest_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("model").agg(*[x for c in ("mape", "smape", "mase", "mae", "rmse", "coverage") for x in
                                          (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])


def decompose(series: DataFrame, period: int = 7, keys: Sequence[str] = KEYS) -> DataFrame:
    """Classical decomposition: centred mean, mean deviation of each weekday, rest."""
    keys = list(keys)
    trended = centered_mean(series, period, keys).withColumns({"_off": F.col("residual"), "_dow": F.weekday("ds")}).drop("residual")
    season = trended.groupBy(*keys, "_dow").agg(F.avg("_off").alias("seasonal"))
    return join_null_safe(trended, season, [*keys, "_dow"]).select(*keys, "ds", "y", "trend", "seasonal", (F.col("_off") - F.col("seasonal")).alias("residual"))


def strengths(parts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One minus the share of the residual's variance in component plus residual."""
    strength = lambda c: 1 - F.try_divide(F.var_pop("residual"), F.var_pop(F.col(c) + F.col("residual")))
    return parts.where(F.col("residual").isNotNull()).groupBy(*keys).agg(
        strength("trend").alias("trend_strength"), strength("seasonal").alias("seasonal_strength"))


@F.pandas_udf(DoubleType())
def _odd_tail(q: pd.Series, df: pd.Series) -> pd.Series:
    """Chi-square tail for odd degrees of freedom, by its finite sum."""
    def tail(x: float, d: int) -> float:
        h = x / 2
        return erfc(sqrt(h)) + sum(exp(-h) * h ** (i + 0.5) / gamma(i + 1.5) for i in range((d - 1) // 2))

    return pd.Series([tail(float(x), int(d)) for x, d in zip(q, df)], index=q.index)


def chi2_tail(q: Column, degrees: int) -> Column:
    """Probability above q; a finite sum for even degrees, native."""
    if degrees % 2:
        return _odd_tail(q, F.lit(degrees))
    h, term, total = q / 2, F.lit(1.0), F.lit(1.0)
    for i in range(1, degrees // 2):
        term = term * h / i
        total = total + term
    return F.exp(-h) * total


def ljung_box(series: DataFrame, lags: int = 10, value: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """Autocorrelation test per series: statistic, probability and flag below 0.05."""
    keys = list(keys)
    whole = W.partitionBy(*keys)
    centred = series.where(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(whole))
    in_order = whole.orderBy("ds")
    lagged = centred.select(*keys, "_c", *[F.lag("_c", k).over(in_order).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = lagged.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_s0"),
                                     *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)])
    n = F.col("n").cast("double")
    terms = [F.coalesce(F.try_divide(F.pow(F.try_divide(F.col(f"_s{k}"), F.col("_s0")), 2), n - k), F.lit(0.0)) for k in range(1, lags + 1)]
    stat = n * (n + 2) * reduce(lambda a, b: a + b, terms)
    tested = sums.select(*keys, "n", stat.alias("statistic"))
    return tested.withColumn("p_value", chi2_tail(F.col("statistic"), lags)).withColumn("autocorrelated", (F.col("p_value") < 0.05).cast("int"))


def diagnose_series(series: DataFrame, keys: Sequence[str] = KEYS, k: float = 3.0, places: int | None = None) -> DataFrame:
    """Length, gaps, level, spread, strengths and anomalies of each series. With ``places``, the decimals that the values have,
    the mean comes from an exact sum, which no order of rows can change."""
    mean = F.avg("y") if places is None else F.sum(F.col("y").cast(f"decimal(30,{places})")).cast("double") / F.nullif(F.count("y"), F.lit(0))
    base = series.groupBy(*keys).agg(F.count("*").alias("length"), F.count_if(F.col("y").isNull()).alias("missing"), mean.alias("mean"),
                                     F.stddev_samp("y").alias("std"), F.try_divide(F.stddev_samp("y"), F.avg("y")).alias("cv"))
    odd = iqr_anomalies(series, k, keys).select(*keys, "anomaly_rate", "anomaly_dates")
    return join_null_safe(join_null_safe(base, strengths(decompose(series, keys=keys), keys), keys, "left"), odd, keys, "left")


# ---- hierarchy -------------------------------------------------------------------------------------------------

def select_series(daily: DataFrame, coverage: float = 0.9, max_merchants: int = 50, max_mcc: int = 20) -> DataFrame:
    """Leaves (mcc, merchant_key, ds, y): the largest codes, in each the merchants within coverage, and the rest as one.

    All other codes together are one code of their own, so the leaves sum up to the whole history. Codes become text; a
    missing one is the empty text.
    """
    daily = daily.withColumn("mcc", F.coalesce(F.col("mcc").cast("string"), F.lit("")))
    top = daily.groupBy("mcc").agg(F.sum("y").alias("_v")).orderBy(F.col("_v").desc(), "mcc").limit(max_mcc).select("mcc", F.lit(True).alias("_top"))
    kept = daily.join(F.broadcast(top), "mcc", "left").withColumn("mcc", F.when(F.col("_top"), F.col("mcc")).otherwise(OTHER))
    totals = kept.where("_top").groupBy("mcc", "merchant_key").agg(F.sum("y").alias("v"))
    chosen = cumulative_share(totals, "mcc", "merchant_key", "v", coverage, max_merchants).select("mcc", "merchant_key", F.lit(True).alias("_own"))
    marked = join_null_safe(kept, chosen, ["mcc", "merchant_key"], "left")
    selected = marked.where(F.col("_own")).select("mcc", "merchant_key", "ds", "y")
    rest = marked.groupBy("mcc", "ds").agg(F.coalesce(F.sum(F.when(F.col("_own").isNull(), F.col("y"))), F.lit(0.0)).alias("y")).select(
        "mcc", F.lit(OTHER).alias("merchant_key"), "ds", F.greatest("y", F.lit(0.0)).alias("y"))
    return selected.unionByName(rest)


def hierarchical_forecast(leaves: DataFrame, horizon: int = 14, model: str = "ma7", common_calendar: bool = False) -> DataFrame:
    """Leaf forecasts and their sums by code and in total, labelled by level.

    Each leaf continues after its own last day; ``common_calendar`` first fills all leaves with zeros up to one last day.
    """
    keys = ["mcc", "merchant_key"]
    if common_calendar:
        leaves = fill_calendar(leaves, keys, leaves.agg(F.max("ds")).scalar())
    made = ma7_forecast(leaves, horizon, keys) if model == "ma7" else trend_weekday_forecast(leaves, horizon, keys)
    leaf = made.select(F.lit("merchant").alias("level"), F.col("mcc").cast("string").alias("mcc"), "merchant_key", "ds", "yhat")
    code = leaf.groupBy("mcc", "ds").agg(F.sum("yhat").alias("yhat")).select(F.lit("mcc").alias("level"), "mcc", F.lit("").alias("merchant_key"), "ds", "yhat")
    total = code.groupBy("ds").agg(F.sum("yhat").alias("yhat")).select(F.lit("total").alias("level"), F.lit("").alias("mcc"), F.lit("").alias("merchant_key"), "ds", "yhat")
    return leaf.unionByName(code).unionByName(total)


def top_down(total_forecast: DataFrame, history: DataFrame, item: str = "mcc") -> DataFrame:
    """A total forecast spread over items by their share of the history.

    The forecast has one row per future day; its rows ride on each item as one small array, so no join is needed.
    """
    shares = history.groupBy(item).agg(F.sum("y").alias("_v"))
    whole = shares.agg(F.sum("_v")).scalar()
    days = total_forecast.agg(F.collect_list(F.struct("ds", "yhat"))).scalar()
    spread = shares.select(item, ratio(F.col("_v"), whole).alias("share"), F.explode(days).alias("_d"))
    return spread.select(item, "_d.ds", (F.col("_d.yhat") * F.col("share")).alias("yhat"), "share")
