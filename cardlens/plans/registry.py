"""Registry of queries with the SQL text each must agree with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}

# Whole-number sums that the other engine widens beyond 64 bits; they are brought back to bigint.
WIDE_SUMS = {
    "card_extremes": ["failed_txn_count", "reversal_count"], "merchant_graph_features": ["txn_count_90d"],
    "card_graph_features": ["txn_count_90d", "neighbor_fraud_txn_90d"], "roc_points": ["tp", "fp"], "ev_curve": ["tp", "fp"],
    "ev_threshold": ["tp", "fp"], "profile_table": ["total", "nulls"], "data_patterns": ["n"], "iqr_anomalies": ["anomalies"],
    "tfidf_vocabulary": ["total"],
}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; its result is made engine-neutral so that two engines can be compared."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = lambda spark, sf_dir: portable(plan(spark, sf_dir))
        if sql is not None:
            narrow = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in WIDE_SUMS.get(name, []))
            SQL[name] = f"SELECT * REPLACE ({narrow}) FROM ({sql})" if narrow else sql
        return plan

    return register


def portable(df: DataFrame) -> DataFrame:
    """Dates and times as text, whole numbers as bigint, other numbers as double, arrays as joined text."""

    def plain(field: T.StructField):
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DateType):
            return c.cast("string").alias(field.name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("bigint").alias(field.name)
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            return c.cast("double").alias(field.name)
        if isinstance(kind, T.ArrayType):
            return F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(field.name)
        return c

    return df.select(*[plain(f) for f in df.schema.fields])


# The canonical frame in SQL, as the start of a WITH list.
TXN = """WITH txn AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE)) AS transaction_id,
    l_orderkey || '-' || l_linenumber AS transaction_code,
    CAST(o_custkey AS VARCHAR) AS hpan, CAST(o_custkey AS VARCHAR) AS card_masked, CAST(o_custkey AS VARCHAR) AS pinfl,
    r_name AS company_id, c_mktsegment AS emitent_bank, n_name AS emitent_region, p_brand AS acquirer_bank,
    l_suppkey AS merchant, CAST(l_suppkey AS VARCHAR) AS merchant_id, s_name AS merchant_name,
    ([4111,4121,5251,5311,5411,5541,5661,5691,5732,5812,5813,5814,5912,5942,5999,6011,6012,7230,8062,8211])[p_size % 20 + 1] AS mcc,
    CAST(([4111,4121,5251,5311,5411,5541,5661,5691,5732,5812,5813,5814,5912,5942,5999,6011,6012,7230,8062,8211])[p_size % 20 + 1] AS VARCHAR) AS mcc_code,
    p_type AS mcc_description, p_type AS merchant_type,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_uzs,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS reqamt,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS conamt,
    CAST(l_shipdate AS DATE) AS transaction_date,
    date_diff('day', DATE '1900-01-01', CAST(l_shipdate AS DATE)) AS rday,
    (l_orderkey * 7 + l_linenumber * 5 + l_partkey) % 24 AS hour_num,
    (l_orderkey * 13 + l_suppkey) % 60 AS minute_num,
    date_trunc('day', l_shipdate) + to_hours(CAST((l_orderkey * 7 + l_linenumber * 5 + l_partkey) % 24 AS BIGINT))
      + to_minutes(CAST((l_orderkey * 13 + l_suppkey) % 60 AS BIGINT)) AS transaction_time,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS p2p_flag,
    CASE WHEN l_returnflag = 'R' THEN 'card2card' ELSE '' END AS p2p_type,
    CASE WHEN l_returnflag = 'R' THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS sender_hpan,
    CASE WHEN l_returnflag = 'R' THEN CAST(l_suppkey AS VARCHAR) ELSE '' END AS receiver_hpan,
    CASE WHEN l_returnflag = 'R' THEN c_mktsegment ELSE '' END AS sender_bank,
    CASE WHEN l_returnflag = 'R' THEN p_brand ELSE '' END AS receiver_bank,
    CASE WHEN l_linestatus = 'F' THEN '00' ELSE '05' END AS respcode,
    CASE WHEN l_tax >= 0.08 THEN 1 ELSE 0 END AS reversal_flag,
    CASE WHEN o_custkey % 2 = 0 THEN 'М' ELSE 'Ж' END AS gender,
    18 + o_custkey % 60 AS age,
    CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 1 ELSE 0 END AS is_fraud,
    CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 1 ELSE 0 END AS fraud_proxy,
    l_orderkey * 7 + l_linenumber * 3 + l_partkey AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
), edge AS (SELECT max(transaction_date) AS d FROM txn)
"""

# The canonical frame with missing cards, companies and codes, to follow TXN in the WITH list.
MISSING = {"card_masked": 7, "company_id": 5, "mcc": 3, "mcc_code": 3}
NULLED = TXN + ", nul AS (SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN merchant % {m} = 0 THEN NULL ELSE {c} END AS {c}" for c, m in MISSING.items()) + ") FROM txn)"


def on_nulled(name: str) -> str:
    """The SQL of a registered query over the frame with missing keys."""
    return NULLED + SQL[name].removeprefix(TXN).replace("FROM txn", "FROM nul").replace(
        "t JOIN top USING (transaction_date, company_id)", "t JOIN top ON t.transaction_date = top.transaction_date AND t.company_id IS NOT DISTINCT FROM top.company_id")


def with_missing(df: DataFrame) -> DataFrame:
    """The frame (with ``merchant``) with the same keys missing as in ``NULLED``."""
    return df.withColumns({c: F.when(F.col("merchant") % m != 0, F.col(c)) for c, m in MISSING.items() if c in df.columns})


# The dirty variant, to follow TXN in the WITH list.
DIRTY = TXN + """, dirty AS (
  SELECT transaction_id, transaction_code, hpan, pinfl, emitent_bank, CAST(merchant AS VARCHAR) AS merchant,
    CASE WHEN k % 17 = 0 THEN '' ELSE merchant_name END AS merchant_name,
    CASE WHEN k % 23 = 0 THEN '' WHEN k % 19 = 0 THEN mcc || '.0' ELSE CAST(mcc AS VARCHAR) END AS mcc,
    CASE WHEN k % 47 = 0 THEN replace(CAST(amount_uzs AS VARCHAR), '.', ',') WHEN k % 41 = 0 THEN 'n/a'
         WHEN k % 31 = 0 THEN '-' || amount_uzs ELSE CAST(amount_uzs AS VARCHAR) END AS amount_uzs,
    CAST(reqamt AS VARCHAR) AS reqamt, CAST(conamt AS VARCHAR) AS conamt,
    CASE WHEN k % 53 = 0 THEN strftime(transaction_date, '%d.%m.%Y') ELSE CAST(transaction_date AS VARCHAR) END AS transaction_date,
    CAST(rday AS VARCHAR) AS rday,
    CASE WHEN k % 29 = 0 THEN '27' ELSE CAST(hour_num AS VARCHAR) END AS hour_num,
    CASE WHEN k % 59 = 0 THEN '1' WHEN k % 37 = 0 THEN CASE WHEN p2p_flag = 1 THEN 'True' ELSE 'False' END
         ELSE CAST(p2p_flag AS VARCHAR) END AS p2p_flag,
    CASE WHEN k % 59 = 0 THEN '' ELSE p2p_type END AS p2p_type, sender_hpan, receiver_bank,
    CASE WHEN k % 43 = 0 THEN '' ELSE respcode END AS respcode, gender, CAST(age AS VARCHAR) AS age,
    CAST(fraud_proxy AS VARCHAR) AS fraud_proxy
  FROM txn
)
"""
