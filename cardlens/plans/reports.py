"""Reports as data: long frames made of the component results; rendering is left to the reader of the small frame."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.functions.distributed import with_scalars
from cardlens.functions.scalars import day, is_missing, percent
from cardlens.operators import metrics as m
from cardlens.operators import quality as q
from cardlens.operators import stats as st
from cardlens.operators.windows import pct_change
from cardlens.sources.writers import stored


def _long(df: DataFrame, section: str, key: Column, metric: str, current: Column, previous: Column | None = None, change: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), F.lit(metric).alias("metric"), current.cast("double").alias("current"),
                     (none if previous is None else previous.cast("double")).alias("previous"), (none if change is None else change.cast("double")).alias("change"))


def weekly_report(df: DataFrame, end, days: int = 7, top: int = 20) -> DataFrame:
    """(section, key, metric, current, previous, change): key figures, top codes with their share among the top, top
    merchants, hours, fill rates and the shift of the amount distribution against the period before."""
    last = day(end)
    first = F.date_sub(last, days - 1)
    before = F.date_sub(first, days)
    now = df.where(F.col("transaction_date").between(first, last))
    prior = df.where(F.col("transaction_date").between(before, F.date_sub(first, 1)))
    kpi = m.period_kpi(df, first, last)
    parts = [kpi.select(F.lit("kpi").alias("section"), F.lit("").alias("key"), "metric", "current", "previous", F.col("change_pct").alias("change"))]

    def largest(dim: str, valid: Column) -> DataFrame:
        return now.where(valid).groupBy(dim).agg(F.sum("amount_uzs").cast("double").alias("volume")).orderBy(F.col("volume").desc(), dim).limit(top)

    codes = largest("mcc", F.col("mcc") > 0)
    shared = with_scalars(codes, "_all", codes.agg(F.sum("volume").alias("v")))
    parts.append(_long(codes, "top_mcc", F.col("mcc"), "volume", F.col("volume")))
    parts.append(_long(shared, "top_mcc", F.col("mcc"), "share_of_top", F.round(percent(F.col("volume"), F.col("_all.v")), 4)))
    parts.append(_long(largest("merchant_name", ~is_missing("merchant_name")), "top_merchant", F.col("merchant_name"), "volume", F.col("volume")))
    hours = now.where(F.col("hour_num").between(0, 23)).groupBy("hour_num").agg(F.sum("amount_uzs").alias("v"))
    parts.append(_long(hours, "hour", F.col("hour_num"), "volume", F.col("v")))
    parts.append(_long(q.fill_rates(now), "fill_rate", F.col("field"), "fill_rate", F.col("fill_rate")))
    shift = st.quantile_shift(now, prior)
    parts.append(_long(shift, "drift", F.col("status"), "quantile_shift", F.col("shift")))
    return reduce(DataFrame.unionByName, parts)


def dq_report(raw: DataFrame, typed: DataFrame, as_of=None, large: float = 1_000_000, repeats: int = 10) -> DataFrame:
    """Schema rules and missing rates of the text rows and business checks of the typed rows: (part, name, detail, count, share)."""
    none = F.lit(None).cast("double")
    rules = q.schema_rules(raw, as_of=as_of).select(F.lit("rule").alias("part"), F.col("column").alias("name"), F.col("rule").alias("detail"),
                                                    F.col("violations").cast("bigint").alias("count"), none.alias("share"))
    checks = q.business_checks(typed, as_of, large, repeats).select(F.lit("check").alias("part"), F.col("check").alias("name"), F.col("issue").cast("string").alias("detail"),
                                                                    F.col("violations").cast("bigint").alias("count"), none.alias("share"))
    nulls = q.null_rates(raw).select(F.lit("missing").alias("part"), F.col("column").alias("name"), F.lit("").alias("detail"),
                                     F.col("nulls").cast("bigint").alias("count"), F.col("null_rate").alias("share"))
    return rules.unionByName(checks).unionByName(nulls)


def analysis_report(df: DataFrame, top: int = 10) -> DataFrame:
    """Ten sections in long form: totals, transfers, codes, banks, regions, merchants, hours, gender, responses, fill rates.

    The rows are written once, so that each section reads its own columns and no section joins them again. Codes alone are read
    from the frame itself: Spark takes an element looked up by a missing place for one that cannot be NULL, and a written one
    would no longer be missing.
    """
    codes = m.top_by(df, "mcc", top)
    df = stored(df, "rows")
    return m.union_reports({
        "general": m.general_stats(df), "p2p": m.p2p_split(df), "mcc": codes.withColumn("mcc", F.col("mcc").cast("string")),
        "bank": m.top_by(df, "emitent_bank", top), "region": m.top_by(df, "emitent_region", top), "merchant": m.top_by(df, "merchant_name", top),
        "hour": m.hour_profile(df).withColumn("hour", F.col("hour").cast("string")), "gender": m.gender_split(df),
        "response": m.top_by(df, "respcode", top), "fill": q.fill_rates(df)})


def trend_report(df: DataFrame, weeks: int = 4, as_of=None) -> DataFrame:
    """The last weeks with their change against the week before."""
    last = df.agg(F.max("transaction_date")).scalar() if as_of is None else day(as_of)
    recent = df.where(F.col("transaction_date") >= F.date_sub(last, 7 * weeks))
    trends = m.weekly_trends(recent).orderBy(F.col("week").desc()).limit(weeks)
    changed = pct_change(pct_change(trends, "volume", name="volume_change"), "transactions", name="tx_change")
    return changed.select("week", "volume", "transactions", "avg_check", "volume_change", "tx_change").orderBy(F.col("week").desc())
