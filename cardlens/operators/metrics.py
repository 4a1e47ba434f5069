"""Metric queries: daily, minute, fraud, company, merchant, cohort, period and share reports."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.functions.distributed import heaviest_value, join_null_safe, percentiles, top_values, wide_percentiles, with_scalars
from cardlens.functions.scalars import (anchored_filter, day, filter_transactions, hour_expr, is_missing, mean_of,
                                        percent, ratio, sum_if, truncate_time)


def _fraud() -> Column:
    return F.col("is_fraud") == 1


def _distinct(name: str, approx: bool) -> Column:
    return F.approx_count_distinct(name) if approx else F.countDistinct(name)


def _grouped_with_median(df: DataFrame, keys: Sequence[str], amount: str, median: str, approx: bool, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates and the median of each group, a sketch when ``approx``, else exact."""
    if approx:
        return df.groupBy(*keys).agg(*aggregates, F.percentile_approx(F.col(amount).cast("double"), 0.5).alias(median))
    medians = wide_percentiles(df, keys, amount, {median: 0.5})
    return join_null_safe(df.groupBy(*keys).agg(*aggregates), medians, keys, "left")


def daily_metrics(df: DataFrame, company: str | None = None, date_from=None, date_to=None,
                  approx: bool = False) -> DataFrame:
    """Per day and company: volumes, exact median, distinct cards and merchants, fraud share, five top codes."""
    df = filter_transactions(df, company=company, date_from=date_from, date_to=date_to)
    keys = ["transaction_date", "company_id"]
    base = _grouped_with_median(df, keys, "amount", "median_amount", approx, [
        F.count("*").alias("transaction_count"),
        F.sum("amount").alias("total_volume"),
        mean_of("amount").alias("avg_amount"),
        _distinct("card_masked", approx).alias("unique_cards"),
        _distinct("merchant_id", approx).alias("unique_merchants"),
        F.count_if(_fraud()).alias("fraud_count"),
        sum_if(_fraud(), "amount").alias("fraud_volume"),
        percent(F.count_if(_fraud()), F.count("*")).alias("fraud_rate"),
        F.max("amount").alias("max_transaction"),
        F.min("amount").alias("min_transaction"),
    ])
    return (
        join_null_safe(base, top_values(df, keys, "mcc_code", 5, "top_mcc_codes"), keys, "left")
        .orderBy(F.col("transaction_date").desc(), "company_id")
    )


def minute_metrics(df: DataFrame, window_minutes: int = 5, company: str | None = None, now=None) -> DataFrame:
    """Per minute over the last minutes before ``now`` (default: the newest time of the frame)."""
    df = filter_transactions(df, company=company)
    last = df.agg(F.max("transaction_time")).scalar() if now is None else now
    recent = df.where(F.col("transaction_time") >= last - F.expr(f"INTERVAL {int(window_minutes)} MINUTES"))
    return recent.groupBy(F.date_trunc("minute", "transaction_time").alias("minute")).agg(
        F.count("*").alias("transactions_per_minute"),
        F.sum("amount").alias("volume_per_minute"),
        mean_of("amount").alias("avg_amount"),
        F.countDistinct("card_masked").alias("unique_cards"),
        F.count_if(_fraud()).alias("fraud_count"),
        F.max("amount").alias("max_amount"),
    ).orderBy(F.col("minute").desc())


def fraud_summary(df: DataFrame, date_from=None, date_to=None) -> DataFrame:
    df = filter_transactions(df, date_from=date_from, date_to=date_to)
    return df.agg(
        F.count("*").alias("total_transactions"),
        F.count_if(_fraud()).alias("fraud_transactions"),
        percent(F.count_if(_fraud()), F.count("*")).alias("fraud_rate"),
        sum_if(_fraud(), "amount").alias("fraud_volume"),
        mean_of(F.when(_fraud(), F.col("amount"))).alias("avg_fraud_amount"),
        mean_of(F.when(~_fraud(), F.col("amount"))).alias("avg_normal_amount"),
    )


def fraud_by_mcc(df: DataFrame, top: int = 10, date_from=None, date_to=None) -> DataFrame:
    df = filter_transactions(df, date_from=date_from, date_to=date_to)
    return (
        df.groupBy("mcc_code", "mcc_description").agg(
            F.count("*").alias("total_count"), F.count_if(_fraud()).alias("fraud_count"),
            percent(F.count_if(_fraud()), F.count("*")).alias("fraud_rate"))
        .where("fraud_count > 0").orderBy(F.col("fraud_rate").desc(), "mcc_code", "mcc_description").limit(top)
    )


def fraud_by_hour(df: DataFrame, date_from=None, date_to=None) -> DataFrame:
    df = filter_transactions(df, date_from=date_from, date_to=date_to)
    return df.groupBy(F.hour("transaction_time").alias("hour")).agg(
        F.count_if(_fraud()).alias("fraud_count"), F.count("*").alias("total_count"),
        percent(F.count_if(_fraud()), F.count("*")).alias("fraud_rate")).orderBy("hour")


def decline_rate_by_hour(df: DataFrame, accepted: Sequence[str] = ("", "00", "0")) -> DataFrame:
    declined = ~F.coalesce(F.col("respcode"), F.lit("")).isin(*accepted)
    return df.groupBy(hour_expr(df).alias("hour")).agg(
        F.count("*").alias("total"), F.count_if(declined).alias("declined"),
        percent(F.count_if(declined), F.count("*")).alias("decline_rate")).orderBy("hour")


def company_comparison(df: DataFrame, days: int = 30, as_of=None, approx: bool = False) -> DataFrame:
    df = anchored_filter(df, days, as_of)
    base = _grouped_with_median(df, ["company_id"], "amount", "median_transaction", approx, [
        F.count("*").alias("total_transactions"), F.sum("amount").alias("total_volume"),
        mean_of("amount").alias("avg_transaction"),
        _distinct("card_masked", approx).alias("unique_cards"),
        _distinct("merchant_id", approx).alias("unique_merchants"),
        percent(F.count_if(_fraud()), F.count("*")).alias("fraud_rate"),
        F.max("amount").alias("max_transaction")])
    top = heaviest_value(df, ["company_id"], "mcc_code", "top_mcc").drop("top_mcc_count")
    return join_null_safe(base, top, ["company_id"], "left").orderBy(F.col("total_volume").desc(), "company_id")


def company_radar(comparison: DataFrame) -> DataFrame:
    """Measures as percent of the best company; the frame has one row per company, so one window holds it."""
    everyone = W.partitionBy()
    scaled = lambda c: percent(F.col(c), F.max(c).over(everyone))
    return comparison.select(
        "company_id", scaled("total_transactions").alias("transactions"), scaled("total_volume").alias("volume"),
        scaled("unique_cards").alias("cards"), scaled("unique_merchants").alias("merchants"),
        (100 - F.col("fraud_rate")).alias("security"))


def merchant_analysis(df: DataFrame, top_n: int = 20, company: str | None = None) -> DataFrame:
    """The merchants with the largest volume; code and category are the most frequent ones."""
    df = filter_transactions(df, company=company)
    keys = ["merchant_name", "merchant_id"]
    best = df.groupBy(*keys).agg(
        F.count("*").alias("transaction_count"), F.sum("amount").alias("total_volume"),
        mean_of("amount").alias("avg_amount"), F.countDistinct("card_masked").alias("unique_customers"),
        F.countDistinct("transaction_date").alias("active_days"), F.count_if(_fraud()).alias("fraud_count"),
    ).orderBy(F.col("total_volume").desc(), "merchant_id").limit(top_n)
    theirs = join_null_safe(df, best.select(*keys), keys)
    code = heaviest_value(theirs, keys, "mcc_code", "mcc_code_top").select(*keys, F.col("mcc_code_top").alias("mcc_code"))
    kind = heaviest_value(theirs, keys, "mcc_description", "category").drop("category_count")
    return join_null_safe(join_null_safe(best, code, keys, "left"), kind, keys, "left").orderBy(F.col("total_volume").desc(), "merchant_id")


def cohort_analysis(df: DataFrame, field: str = "card_masked", metric: str = "amount") -> DataFrame:
    """(first month, active month): members, sum and mean. Rows are summed per member and month before the window."""
    monthly = df.groupBy(field, truncate_time("transaction_date", "month").alias("transaction_month")).agg(
        F.sum(metric).alias("_sum"), F.count(metric).alias("_n"))
    first = F.min("transaction_month").over(W.partitionBy(field))
    return monthly.withColumn("cohort_month", first).groupBy("cohort_month", "transaction_month").agg(
        F.count("*").alias("cohort_size"), F.sum("_sum").alias(f"total_{metric}"),
        ratio(F.sum("_sum"), F.sum("_n")).alias(f"avg_{metric}")).orderBy("cohort_month", "transaction_month")


def general_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    return df.agg(
        F.count("*").alias("transactions"), F.sum("amount_uzs").alias("volume"), F.min("amount_uzs").alias("min_amount"),
        F.max("amount_uzs").alias("max_amount"), mean_of("amount_uzs").alias("avg_amount"),
        _distinct("hpan", approx).alias("cards"), _distinct("pinfl", approx).alias("clients"),
        _distinct("merchant_name", approx).alias("merchants"))


def top_by(df: DataFrame, dim: str, n: int = 10, measure: str = "volume") -> DataFrame:
    """Largest values of a dimension with count, volume, mean, cards and share of all rows and volume."""
    groups = df.where(~is_missing(dim)).groupBy(dim).agg(
        F.count("*").alias("transactions"), F.sum("amount_uzs").alias("volume"),
        mean_of("amount_uzs").alias("avg_amount"), F.countDistinct("hpan").alias("cards"))
    whole = F.col("_whole")
    best = groups.orderBy(F.col(measure).desc(), dim).limit(n)
    return (
        with_scalars(best, "_whole", groups.agg(F.sum("transactions").alias("n"), F.sum("volume").alias("v")))
        .withColumns({"share_transactions": percent(F.col("transactions"), whole["n"]),
                      "share_volume": percent(F.col("volume"), whole["v"])})
        .drop("_whole").orderBy(F.col(measure).desc(), dim)
    )


def share_of_total(groups: DataFrame, measure: str, name: str = "share") -> DataFrame:
    """Percent of the grand total, through a scalar subquery rather than a one-task window."""
    total = groups.agg(F.sum(measure)).scalar()
    return groups.withColumn(name, percent(F.col(measure), total))


def _split(df: DataFrame, key: Column, name: str) -> DataFrame:
    groups = df.groupBy(key.alias(name)).agg(
        F.count("*").alias("transactions"), F.sum("amount_uzs").alias("volume"), mean_of("amount_uzs").alias("avg_amount"))
    return share_of_total(groups, "transactions").orderBy(name)


def p2p_split(df: DataFrame) -> DataFrame:
    is_p2p = F.lower(F.col("p2p_flag").cast("string")).isin("1", "true")
    return _split(df, F.when(is_p2p, "P2P").otherwise("Purchase"), "kind")


def gender_split(df: DataFrame, codes: Sequence[str] = ("М", "Ж", "M", "F", "Male", "Female")) -> DataFrame:
    return _split(df.where(F.col("gender").isin(*codes)), F.col("gender"), "gender")


def hour_profile(df: DataFrame) -> DataFrame:
    """At most 24 valid hours, each with its count relative to the busiest hour."""
    hours = df.groupBy(hour_expr(df).alias("hour")).agg(
        F.count("*").alias("transactions"), F.sum("amount_uzs").alias("volume"), mean_of("amount_uzs").alias("avg_amount"))
    hours = hours.where(F.col("hour").between(0, 23))
    return hours.withColumn(
        "bar_share", percent(F.col("transactions"), F.max("transactions").over(W.partitionBy()))).orderBy("hour")


def monthly_activity(df: DataFrame) -> DataFrame:
    return df.groupBy(truncate_time("transaction_date", "yyyymm").alias("month")).agg(
        F.count("*").alias("transactions"), F.sum("amount_uzs").alias("volume")).orderBy("month")


def p2p_share_by_hour(df: DataFrame) -> DataFrame:
    p2p = F.count_if(F.col("p2p_flag") == 1)
    return df.groupBy(hour_expr(df).alias("hour")).agg(
        F.count("*").alias("transactions"), p2p.alias("p2p_transactions"),
        percent(p2p, F.count("*")).alias("p2p_share")).orderBy("hour")


def daily_series(df: DataFrame, metric: str = "volume") -> DataFrame:
    value = {"volume": F.sum("amount_uzs"), "transactions": F.count("*"),
             "unique_cards": F.countDistinct("hpan") if "hpan" in df.columns else F.lit(None)}[metric]
    return df.groupBy(F.col("transaction_date").alias("ds")).agg(value.cast("double").alias("y")).orderBy("ds")


def weekly_trends(df: DataFrame, date_from=None, date_to=None) -> DataFrame:
    df = filter_transactions(df, date_from=date_from, date_to=date_to)
    return df.groupBy(truncate_time("transaction_date", "week").alias("week")).agg(
        F.sum("amount_uzs").alias("volume"), F.count("*").alias("transactions"), mean_of("amount_uzs").alias("avg_check"),
        F.countDistinct("hpan").alias("unique_cards"),
        percent(F.count_if(F.col("p2p_flag") == 1), F.count("*")).alias("p2p_share")).orderBy("week")


def daily_mcc_rollup(df: DataFrame) -> DataFrame:
    """Sum and count per day and code; the mean is derived from them, so partial rollups can be merged."""
    groups = df.groupBy("transaction_date", "mcc").agg(
        F.sum("amount_uzs").alias("total_amount"), F.count("*").alias("transaction_count"))
    return groups.withColumn("avg_amount", ratio(F.col("total_amount"), F.col("transaction_count")))


def amount_quantiles(df: DataFrame, probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9),
                     amount: str = "amount_uzs") -> DataFrame:
    return percentiles(df, [], amount, probs).orderBy("prob")


def _periods(start, end) -> tuple[Column, Column, Column]:
    first, last = day(start), day(end)
    return first, last, F.date_sub(first, F.datediff(last, first) + 1)


def period_kpi(df: DataFrame, start, end) -> DataFrame:
    """The period and the equally long one before it, in one pass: current, previous and change in percent."""
    first, last, before = _periods(start, end)
    current = F.col("transaction_date") >= first
    p2p = F.col("p2p_flag") == 1
    rows = df.where(F.col("transaction_date").between(before, last))
    share = lambda test: F.round(percent(F.count_if(test & p2p), F.count_if(test)), 2)
    totals = rows.agg(
        sum_if(current, "amount_uzs").cast("double").alias("vc"), sum_if(~current, "amount_uzs").cast("double").alias("vp"),
        F.count_if(current).cast("double").alias("nc"), F.count_if(~current).cast("double").alias("np"),
        F.coalesce(share(current), F.lit(0.0)).alias("pc"), F.coalesce(share(~current), F.lit(0.0)).alias("pp"))
    long = totals.selectExpr("stack(3, 'volume', vc, vp, 'transactions', nc, np, 'p2p_share', pc, pp) "
                             "AS (metric, current, previous)")
    return long.withColumn("change_pct", percent(F.col("current") - F.col("previous"), F.col("previous")))


def period_volume_compare(df: DataFrame, baseline: tuple, current: tuple) -> DataFrame:
    """Daily volume of two periods, labelled."""
    d = F.col("transaction_date")
    in_current, in_base = d.between(*map(day, current)), d.between(*map(day, baseline))
    label = F.when(in_current, "Current").when(in_base, "Baseline")
    return df.where(in_current | in_base).groupBy("transaction_date", label.alias("period")).agg(
        F.sum("amount_uzs").alias("volume")).orderBy("transaction_date")


def segment_summary(cards: DataFrame, segment: str = "customer_segment") -> DataFrame:
    groups = cards.groupBy(segment).agg(
        F.count("*").alias("clients"), F.round(F.avg("txn_amount_30d"), 2).alias("avg_amount"),
        F.round(F.avg("txn_count_30d"), 4).alias("avg_transactions"),
        F.round(F.avg("days_since_last_txn"), 4).alias("avg_recency"), F.round(F.avg("p2p_ratio_30d"), 4).alias("avg_p2p"))
    return share_of_total(groups, "clients").orderBy(F.col("clients").desc(), segment)


def cluster_summary(cards: DataFrame, cluster: str = "kmeans_cluster") -> DataFrame:
    return cards.groupBy(cluster).agg(
        F.count("*").alias("clients"), F.round(F.avg("p2p_ratio_30d"), 4).alias("avg_p2p"),
        F.round(F.avg("avg_txn_amount_30d"), 2).alias("avg_amount")).orderBy(cluster)


def rf_heatmap(scored: DataFrame) -> DataFrame:
    """Recency digit by frequency digit counts from the score code."""
    levels = ["1", "2", "3", "4"]
    digits = scored.select(F.substring("rfm_score", 1, 1).alias("R"), F.substring("rfm_score", 2, 1).alias("F"))
    return digits.groupBy("R").pivot("F", levels).count().na.fill(0).select(
        "R", *[F.col(x).alias(f"F{x}") for x in levels]).orderBy("R")


def top_n_plus_other(df: DataFrame, dim: str = "mcc", n: int = 9, other: str = "OTHER") -> DataFrame:
    """The n largest groups by volume and one row for all others; all groups stay in the sums."""
    groups = df.groupBy(F.col(dim).cast("string").alias(dim)).agg(F.sum("amount_uzs").alias("volume"))
    best = groups.orderBy(F.col("volume").desc(), dim).limit(n)
    named = best.select(F.col(dim).alias("_named"))
    rest = groups.join(named, F.col(dim).eqNullSafe(F.col("_named")), "left_anti").groupBy(F.lit(other).alias(dim)).agg(F.sum("volume").alias("volume"))
    return share_of_total(best.unionByName(rest), "volume").orderBy(F.col("volume").desc(), dim)


def rank_top(df: DataFrame, dim: str, n: int) -> DataFrame:
    """Position by volume for the n largest groups: the limit runs as a distributed top-n before the window."""
    best = df.groupBy(dim).agg(F.sum("amount_uzs").alias("volume")).orderBy(F.col("volume").desc(), dim).limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("volume").desc(), dim)))


def mcc_repair_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows_total"), F.count_if(F.col("mcc") == 0).alias("rows_mcc_zero"),
        F.count_if(F.col("mcc") > 0).alias("rows_mcc_gt0"), F.countDistinct("mcc").alias("uniq_mcc"),
        F.min("mcc").alias("mcc_min"), F.max("mcc").alias("mcc_max"))


def p2p_bank_flows(df: DataFrame) -> DataFrame:
    return df.where(F.col("p2p_flag") == 1).groupBy("sender_bank", "receiver_bank").agg(
        F.count("*").alias("transfers"), F.sum("amount_uzs").alias("volume")).orderBy(F.col("volume").desc(), "sender_bank",
                                                                                     "receiver_bank")


def union_reports(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack small result frames in long form: (section, key, metric, value)."""
    def melt(section: str, frame: DataFrame) -> DataFrame:
        texts = [n for n, k in frame.dtypes if k in ("string", "date", "timestamp")]
        numbers = [n for n in frame.columns if n not in texts]
        key = F.concat_ws("|", *[F.col(t).cast("string") for t in texts]) if texts else F.lit("")
        return frame.select(key.alias("key"), *[F.col(n).cast("double").alias(n) for n in numbers]).unpivot(
            ["key"], numbers, "metric", "value").select(F.lit(section).alias("section"), "key", "metric", "value")

    return reduce(DataFrame.unionByName, [melt(s, f) for s, f in parts.items()])
