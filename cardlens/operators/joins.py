"""Joins of transactions with segments, features, maps and one-row aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.functions.distributed import heaviest_value, join_null_safe, with_scalars
from cardlens.functions.scalars import clean_mcc, is_missing, merchant_key

CARD_GRAPH = ["degree_merchants_90d", "txn_count_90d", "avg_amount_90d", "max_amount_90d",
              "neighbor_fraud_merchants_90d", "neighbor_fraud_ratio_90d"]
MERCHANT_GRAPH = ["degree_cards_90d", "txn_count_90d", "fraud_ratio_90d"]
CARD_FEATURES = ["txn_count_30d", "avg_txn_amount_30d", "p2p_ratio_30d", "unique_mcc_30d", "unique_merchants_30d",
                 "weekend_ratio", "night_txn_ratio"]


def join_segments_features(segments: DataFrame, features: DataFrame) -> DataFrame:
    return segments.join(features, "hpan")


def segments_left_features(segments: DataFrame, features: DataFrame) -> DataFrame:
    return segments.join(features, "hpan", "left")


def _zero(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names})


def attach_graph_features(txn: DataFrame, card_graph: DataFrame, merchant_graph: DataFrame) -> DataFrame:
    """Card and merchant graph columns on each transaction, prefixed; absent ones are 0."""
    cards = card_graph.select("hpan", *[F.col(c).alias(f"card_{c}") for c in CARD_GRAPH])
    merchants = merchant_graph.select("merchant_key", *[F.col(c).alias(f"merch_{c}") for c in MERCHANT_GRAPH])
    keyed = txn if "merchant_key" in txn.columns else txn.withColumn("merchant_key", merchant_key(txn))
    joined = join_null_safe(join_null_safe(keyed, cards, ["hpan"], "left"), merchants, ["merchant_key"], "left")
    return _zero(joined, [f"card_{c}" for c in CARD_GRAPH] + [f"merch_{c}" for c in MERCHANT_GRAPH])


def join_card_features(txn: DataFrame, features: DataFrame) -> DataFrame:
    return _zero(join_null_safe(txn, features.select("hpan", *CARD_FEATURES), ["hpan"], "left"), CARD_FEATURES)


def txn_left_merchant_risk(edges: DataFrame, merchant_graph: DataFrame) -> DataFrame:
    """Risk of the merchant on each (card, merchant) edge; unknown merchants count as 0."""
    risk = merchant_graph.select("merchant_key", F.col("fraud_ratio_90d").alias("merchant_risk"))
    return _zero(join_null_safe(edges, risk, ["merchant_key"], "left"), ["merchant_risk"])


def mcc_map(baseline: DataFrame, key: str) -> DataFrame:
    """Dominant valid code of each merchant key in a trusted table."""
    coded = baseline.select(key, clean_mcc("mcc").alias("mapped_mcc")).where(~is_missing(key) & (F.col("mapped_mcc") > 0))
    return heaviest_value(coded, [key], "mapped_mcc", "mapped").select(key, F.col("mapped").alias(f"mcc_by_{key}"))


def apply_mcc_map(df: DataFrame, by_id: DataFrame, by_name: DataFrame | None = None) -> DataFrame:
    """Code from the merchant id map, else from the name map, else the row's own."""
    joined = df.join(by_id, "merchant", "left")
    choices = [F.col("mcc_by_merchant")]
    if by_name is not None:
        joined = joined.join(by_name, "merchant_name", "left")
        choices.append(F.col("mcc_by_merchant_name"))
    fixed = F.coalesce(*choices, clean_mcc("mcc"))
    return joined.withColumn("mcc", fixed).drop("mcc_by_merchant", "mcc_by_merchant_name")


def cross_scalars(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One-row aggregates of the frame on each row, as scalar subqueries."""
    one = with_scalars(df, "_one", df.agg(*[c.alias(n) for n, c in aggregates.items()]))
    return one.withColumns({n: F.col("_one")[n] for n in aggregates}).drop("_one")


def align_on_date(holdout: DataFrame, forecast: DataFrame, keys=("series_key",)) -> DataFrame:
    """Observed and forecast values of the same series and day; a NULL key is a series too."""
    return join_null_safe(holdout.select(*keys, "ds", "y"), forecast, [*keys, "ds"])


def total_minus_selected(total: DataFrame, selected: DataFrame) -> DataFrame:
    """What the selected series leave of the total per day, never below 0."""
    covered = selected.groupBy("ds").agg(F.sum("y").alias("_covered"))
    rest = F.greatest(F.col("y") - F.coalesce(F.col("_covered"), F.lit(0.0)), F.lit(0.0))
    return total.join(covered, "ds", "left").select("ds", rest.alias("y"))
