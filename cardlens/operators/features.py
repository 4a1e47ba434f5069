"""Per-card features, card–merchant graph features and the model's feature frame."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.functions.distributed import SLICE_ROWS, heaviest_value, join_null_safe
from cardlens.functions.scalars import (calendar_flags, is_missing, is_night, is_weekend, mean_of, merchant_key, newest_day,
                                        ratio, sum_if)
from cardlens.operators.joins import CARD_FEATURES, CARD_GRAPH, MERCHANT_GRAPH, txn_left_merchant_risk
from cardlens.operators.windows import sequence_features
from cardlens.session import cut_lineage
from cardlens.sources.bucketed import heavy_keys, join_stored, key_text, store_facts, store_features
from cardlens.sources.model import CAPITAL_REGION, RISKY_MCC

BASE_FEATURES = ["amount_uzs", "hour_num", "p2p_flag", "days_since_prev_txn", "amount_change_ratio", "amount_deviation",
                 "txn_hour_count", "is_risky_mcc", "is_weekend", "is_night", "is_capital"]
ALL_FEATURES = (BASE_FEATURES + CARD_FEATURES + [f"card_{c}" for c in CARD_GRAPH]
                + [f"merch_{c}" for c in MERCHANT_GRAPH])
BASIC_FEATURES = BASE_FEATURES + ["mcc"]


def card_features(df: DataFrame, as_of=None, days: Sequence[int] = (7, 30, 90), min_txns: int = 5, approx: bool = False) -> DataFrame:
    """Activity of each card up to the anchor day in one aggregation.

    ``days`` are the three horizons; column names keep the labels 7d, 30d and 90d. A horizon of N days reaches back to
    ``anchor - N``, both ends included. ``approx`` estimates the distinct counts, which spares the row expansion that
    several exact ones need.
    """
    distinct = F.approx_count_distinct if approx else F.countDistinct
    last = F.col("_last")
    since = lambda n: F.col("transaction_date") >= F.date_sub(last, n)
    rows = df.withColumn("_last", newest_day(df, as_of)).where(
        ~is_missing("hpan") & F.col("transaction_date").between(F.date_sub(last, days[2]), last))
    spans = {"7d": since(days[0]), "30d": since(days[1]), "90d": since(days[2])}
    p2p_30 = (F.col("p2p_flag") == 1) & spans["30d"]
    inside = lambda test, c: distinct(F.when(test, F.col(c)))
    aggregates: list[Column] = []
    for label, test in spans.items():
        aggregates += [F.count_if(test).alias(f"txn_count_{label}"), sum_if(test, "amount_uzs").alias(f"txn_amount_{label}"),
                       F.coalesce(mean_of(F.when(test, F.col("amount_uzs"))), F.lit(0.0)).alias(f"avg_txn_amount_{label}")]
    per_day = ratio(F.count("*"), distinct(F.col("transaction_date")))
    aggregates += [
        F.count_if(p2p_30).alias("p2p_count_30d"), sum_if(p2p_30, "amount_uzs").alias("p2p_amount_30d"),
        inside(spans["7d"], "mcc").alias("unique_mcc_7d"), inside(spans["30d"], "mcc").alias("unique_mcc_30d"),
        inside(spans["30d"], "merchant_name").alias("unique_merchants_30d"),
        ratio(F.sum("hour_num"), F.count("hour_num")).alias("avg_hour"),
        ratio(F.count_if(is_weekend()), F.count("*")).alias("weekend_ratio"),
        ratio(F.count_if(is_night()), F.count("*")).alias("night_txn_ratio"),
        per_day.alias("avg_daily_txn_count"), F.max("transaction_date").alias("_newest"),
        F.count("*").alias("total_txn_count"), F.max("_last").alias("calculation_date"),
    ]
    grouped = rows.groupBy("hpan").agg(*aggregates).where(F.col("total_txn_count") >= min_txns)
    at_least_one = F.greatest(F.col("txn_count_30d"), F.lit(1))
    return grouped.withColumns({
        "days_since_last_txn": F.datediff("calculation_date", F.col("_newest")),
        "p2p_ratio_30d": ratio(F.col("p2p_count_30d"), at_least_one),
        "max_daily_txn_count": F.bround("avg_daily_txn_count", 0).cast("bigint"),
    }).drop("_newest")


def card_extremes(df: DataFrame, accepted: Sequence[str] = ("", "0", "00"), home: str | None = None) -> DataFrame:
    """True daily maxima, failed, reversed and foreign counts and the main merchant of each card."""
    failed = F.count_if(~F.coalesce(F.col("respcode"), F.lit("")).isin(*accepted))
    foreign = F.count_if(F.col("address_country") != home) if home and "address_country" in df.columns else F.lit(0)
    daily = df.groupBy("hpan", "transaction_date").agg(
        F.count("*").alias("n"), F.sum("amount_uzs").alias("amount"), failed.alias("failed"),
        F.count_if(F.col("reversal_flag") == 1).alias("reversed"), foreign.cast("bigint").alias("foreign"))
    cards = daily.groupBy("hpan").agg(
        F.max("n").alias("max_daily_txn_count"), F.max("amount").alias("max_daily_amount"),
        F.sum("failed").alias("failed_txn_count"), F.sum("reversed").alias("reversal_count"),
        F.sum("foreign").alias("international_txn_count"), F.sum("n").alias("_n"))
    main = heaviest_value(df, ["hpan"], "merchant_name", "top_merchant")
    return join_null_safe(cards, main, ["hpan"], "left").withColumn(
        "top_merchant_ratio", ratio(F.col("top_merchant_count"), F.col("_n"))).drop("_n", "top_merchant_count")


def card_feature_report(features: DataFrame) -> DataFrame:
    names = ["txn_count_30d", "txn_amount_30d", "avg_txn_amount_30d", "p2p_ratio_30d", "unique_mcc_30d",
             "days_since_last_txn"]
    return features.agg(F.count("*").alias("cards"), *[F.round(F.avg(n), 4).alias(f"avg_{n}") for n in names])


def graph_edges(df: DataFrame, window_days: int = 90, as_of=None) -> DataFrame:
    """One row per (card, merchant) in the window of N calendar days.

    All graph features are built from these edges, so heavy cards and merchants are pre-summed before any other shuffle
    and degrees are plain counts.
    """
    end = F.col("window_end")
    rows = df.withColumn("window_end", newest_day(df, as_of)).where(
        F.col("transaction_date").between(F.date_sub(end, window_days - 1), end))
    return rows.groupBy("hpan", merchant_key(df).alias("merchant_key"), "window_end").agg(
        F.count("*").alias("n"), F.sum("fraud_proxy").alias("fraud"), F.sum("amount_uzs").alias("amount"),
        F.count("amount_uzs").alias("n_amount"), F.max("amount_uzs").alias("max_amount"),
    ).withColumn("window_start", F.date_sub(end, window_days - 1))


def merchant_graph_features(edges: DataFrame) -> DataFrame:
    return edges.groupBy("merchant_key", "window_start", "window_end").agg(
        F.count("*").alias("degree_cards_90d"), F.sum("n").alias("txn_count_90d"),
        ratio(F.sum("fraud"), F.sum("n")).alias("fraud_ratio_90d"))


def card_graph_features(edges: DataFrame, merchants: DataFrame) -> DataFrame:
    """Degree and amounts of each card, and how many of its merchants saw fraud.

    The default counts distinct risky merchants; the ``_txn`` pair counts transactions at them, so its ratio can pass 1.
    """
    risky = F.col("merchant_risk") > 0
    risky_n = F.coalesce(F.sum(F.when(risky, F.col("n"))), F.lit(0))
    return txn_left_merchant_risk(edges, merchants).groupBy("hpan", "window_start", "window_end").agg(
        F.count("*").alias("degree_merchants_90d"), F.sum("n").alias("txn_count_90d"),
        ratio(F.sum("amount"), F.sum("n_amount")).alias("avg_amount_90d"), F.max("max_amount").alias("max_amount_90d"),
        F.count_if(risky).alias("neighbor_fraud_merchants_90d"),
        ratio(F.count_if(risky), F.count("*")).alias("neighbor_fraud_ratio_90d"),
        risky_n.alias("neighbor_fraud_txn_90d"), ratio(risky_n, F.count("*")).alias("neighbor_fraud_txn_ratio_90d"))


def latest_window(df: DataFrame, key: str = "window_end") -> DataFrame:
    return df.where(F.col(key) == df.agg(F.max(key)).scalar())


def _finish(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    present = set(df.columns)
    value = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in present else F.lit(0.0)
    return df.select(*keep, *[value(n).alias(n) for n in names])


def fraud_features(txn: DataFrame, cards: DataFrame | None = None, card_graph: DataFrame | None = None,
                   merchant_graph: DataFrame | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The model's 27 numeric columns with id, day and label; whatever is missing is 0.

    Windows and joins by card use one key, a text that is never NULL, so transactions move once for all of them.
    """
    keyed = lambda df, columns: df.select(key_text("hpan").alias("_card"), *columns)
    df = calendar_flags(sequence_features(txn.withColumn("_card", key_text("hpan")), "_card", slice_rows=slice_rows), RISKY_MCC, CAPITAL_REGION)
    if cards is not None:
        df = df.join(keyed(cards, CARD_FEATURES), "_card", "left")
    if card_graph is not None and merchant_graph is not None:
        df = df.join(keyed(card_graph, [F.col(c).alias(f"card_{c}") for c in CARD_GRAPH]), "_card", "left")
        merchants = merchant_graph.select("merchant_key", *[F.col(c).alias(f"merch_{c}") for c in MERCHANT_GRAPH])
        df = df if "merchant_key" in df.columns else df.withColumn("merchant_key", merchant_key(df))
        df = join_null_safe(df, merchants, ["merchant_key"], "left")
    return _finish(df, ALL_FEATURES, ["transaction_id", "hpan", "transaction_date", "fraud_proxy"])


def store_fraud_tables(txn: DataFrame, cards: DataFrame, card_graph: DataFrame, tables: Sequence[str], buckets: int = 200,
                       paths: Sequence[str | None] = (None, None, None), slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions with their sequence columns, card features and card graph as tables bucketed by card.

    Written once per refresh and joined as often as models need them; all three share buckets and heavy cards.
    """
    facts = calendar_flags(sequence_features(txn, slice_rows=slice_rows), RISKY_MCC, CAPITAL_REGION)
    heavy = cut_lineage(heavy_keys(txn, "hpan", buckets))  # fewer rows than buckets, read for each table
    graph = card_graph.select("hpan", *[F.col(c).alias(f"card_{c}") for c in CARD_GRAPH])
    return (store_facts(facts.withColumn("merchant_key", merchant_key(facts)), tables[0], "hpan", ["transaction_id"], heavy, buckets, paths[0]),
            store_features(cards.select("hpan", *CARD_FEATURES), tables[1], "hpan", heavy, buckets, paths[1]),
            store_features(graph, tables[2], "hpan", heavy, buckets, paths[2]))


def fraud_features_stored(facts: DataFrame, cards: DataFrame, card_graph: DataFrame, merchant_graph: DataFrame) -> DataFrame:
    """``fraud_features`` from the stored tables: cards meet without an exchange, only merchants need one."""
    merchants = merchant_graph.select("merchant_key", *[F.col(c).alias(f"merch_{c}") for c in MERCHANT_GRAPH])
    by_card = join_stored(join_stored(facts, cards, "hpan"), card_graph, "hpan")
    kept = ["transaction_id", "hpan", "transaction_date", "fraud_proxy"]
    return _finish(join_null_safe(by_card, merchants, ["merchant_key"], "left"), ALL_FEATURES, kept)


def fraud_features_basic(txn: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The 12-column vector of the model comparison."""
    df = calendar_flags(sequence_features(txn, slice_rows=slice_rows), RISKY_MCC, CAPITAL_REGION)
    return _finish(df, BASIC_FEATURES, ["transaction_id", "hpan", "transaction_date", "fraud_proxy"])
