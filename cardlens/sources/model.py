"""The canonical ``transactions`` frame over the test tables, and its text-only dirty variant.

Every column names the tables it needs, so a query joins in only the tables its columns come from:
a daily count reads ``lineitem`` alone, a per-company one walks orders → customer → nation → region.
No join carries a broadcast hint; Spark decides from file sizes and run-time statistics.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# Merchant category codes used for the test data.
MCC_CODES = [4111, 4121, 5251, 5311, 5411, 5541, 5661, 5691, 5732, 5812, 5813, 5814, 5912, 5942, 5999, 6011,
             6012, 7230, 8062, 8211]
RISKY_MCC = [6010, 6011, 6012, 7995]
CAPITAL_REGION = "NATION_0"

# table → (the column on the fact side, the table's own key, the table that must be joined before it)
_LINKS = {
    "orders": ("l_orderkey", "o_orderkey", None),
    "customer": ("o_custkey", "c_custkey", "orders"),
    "nation": ("c_nationkey", "n_nationkey", "customer"),
    "region": ("n_regionkey", "r_regionkey", "nation"),
    "supplier": ("l_suppkey", "s_suppkey", None),
    "part": ("l_partkey", "p_partkey", None),
}

_text = lambda name: F.col(name).cast("string")
_is_p2p = lambda: F.col("l_returnflag") == "R"
_amount = lambda: F.col("l_extendedprice").cast("decimal(18,2)")
_day = lambda: F.col("l_shipdate").cast("date")
_hour = lambda: ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5 + F.col("l_partkey")) % 24).cast("int")
_minute = lambda: ((F.col("l_orderkey") * 13 + F.col("l_suppkey")) % 60).cast("int")
_mcc = lambda: F.element_at(F.array(*[F.lit(m) for m in MCC_CODES]), F.col("p_size") % 20 + 1)
_fraud = lambda: F.when(_is_p2p() & (F.col("l_discount") >= 0.09), 1).otherwise(0)


def _if_p2p(name: str) -> Callable[[], Column]:
    return lambda: F.when(_is_p2p(), _text(name)).otherwise("")


def _txn_id() -> Column:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber"), _text("l_partkey"), _text("l_suppkey"),
                       cents.cast("string"), _day().cast("string"))


COLUMNS: dict[str, tuple[str, Callable[[], Column]]] = {
    "transaction_id": ("", _txn_id),
    "transaction_code": ("", lambda: F.concat(_text("l_orderkey"), F.lit("-"), _text("l_linenumber"))),
    "hpan": ("orders", lambda: _text("o_custkey")),
    "card_masked": ("orders", lambda: _text("o_custkey")),
    "pinfl": ("orders", lambda: _text("o_custkey")),
    "company_id": ("region", lambda: F.col("r_name")),
    "emitent_bank": ("customer", lambda: F.col("c_mktsegment")),
    "emitent_region": ("nation", lambda: F.col("n_name")),
    "acquirer_bank": ("part", lambda: F.col("p_brand")),
    "merchant": ("", lambda: F.col("l_suppkey")),
    "merchant_id": ("", lambda: _text("l_suppkey")),
    "merchant_name": ("supplier", lambda: F.col("s_name")),
    "mcc": ("part", _mcc),
    "mcc_code": ("part", lambda: _mcc().cast("string")),
    "mcc_description": ("part", lambda: F.col("p_type")),
    "merchant_type": ("part", lambda: F.col("p_type")),
    "amount": ("", _amount),
    "amount_uzs": ("", _amount),
    "reqamt": ("", _amount),
    "conamt": ("", lambda: F.round(_amount() * (1 - F.col("l_discount").cast("decimal(4,2)")), 2).cast("decimal(18,2)")),
    "transaction_date": ("", _day),
    "rday": ("", lambda: F.datediff(_day(), F.lit("1900-01-01").cast("date"))),
    "hour_num": ("", _hour),
    "minute_num": ("", _minute),
    "transaction_time": ("", lambda: F.timestamp_seconds(
        F.unix_timestamp(_day().cast("timestamp")) + _hour() * 3600 + _minute() * 60)),
    "p2p_flag": ("", lambda: F.when(_is_p2p(), 1).otherwise(0)),
    "p2p_type": ("", lambda: F.when(_is_p2p(), "card2card").otherwise("")),
    "sender_hpan": ("orders", _if_p2p("o_custkey")),
    "receiver_hpan": ("", _if_p2p("l_suppkey")),
    "sender_bank": ("customer", _if_p2p("c_mktsegment")),
    "receiver_bank": ("part", _if_p2p("p_brand")),
    "respcode": ("", lambda: F.when(F.col("l_linestatus") == "F", "00").otherwise("05")),
    "reversal_flag": ("", lambda: F.when(F.col("l_tax") >= 0.08, 1).otherwise(0)),
    "gender": ("orders", lambda: F.when(F.col("o_custkey") % 2 == 0, "М").otherwise("Ж")),
    "age": ("orders", lambda: (18 + F.col("o_custkey") % 60).cast("int")),
    "is_fraud": ("", _fraud),
    "fraud_proxy": ("", _fraud),
}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the files once, later reads need no look at the footers."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _joined(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    needed: list[str] = []

    def need(name: str) -> None:
        before = _LINKS[name][2]
        if before and before not in needed:
            need(before)
        if name not in needed:
            needed.append(name)

    for name in names:
        if COLUMNS[name][0]:
            need(COLUMNS[name][0])
    meet = lambda left, t: left.join(table(spark, sf_dir, t), F.col(_LINKS[t][0]) == F.col(_LINKS[t][1]))
    # What hangs on orders is joined to orders, so that the fact table, the largest one, moves once for the whole chain.
    chain = [t for t in needed if _LINKS[t][2]]
    fact = reduce(meet, [t for t in needed if t != "orders" and t not in chain], table(spark, sf_dir, "lineitem"))
    if "orders" not in needed:
        return fact
    orders = reduce(meet, chain, table(spark, sf_dir, "orders"))
    return fact.join(orders, F.col(_LINKS["orders"][0]) == F.col(_LINKS["orders"][1]))


def transactions(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The canonical frame with the named columns (all of them when none is named)."""
    chosen = list(names) or list(COLUMNS)
    return _joined(spark, sf_dir, chosen).select(*[COLUMNS[n][1]().alias(n) for n in chosen])


def last_day(spark: SparkSession, sf_dir: str) -> Column:
    """max(transaction_date) as a scalar subquery that scans one column of the fact table."""
    return transactions(spark, sf_dir, "transaction_date").agg(F.max("transaction_date")).scalar()


DIRTY_COLUMNS = ["transaction_id", "transaction_code", "hpan", "pinfl", "emitent_bank", "merchant", "merchant_name",
                 "mcc", "amount_uzs", "reqamt", "conamt", "transaction_date", "rday", "hour_num", "p2p_flag",
                 "p2p_type", "sender_hpan", "receiver_bank", "respcode", "gender", "age", "fraud_proxy"]


def transactions_dirty(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Text-only variant with planted faults; later faults win over earlier ones."""
    chosen = list(names) or DIRTY_COLUMNS
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")
    clean = {n: COLUMNS[n][1]().cast("string") for n in chosen}
    every = lambda m: k % m == 0
    faults: dict[str, Callable[[Column], Column]] = {
        "merchant_name": lambda c: F.when(every(17), "").otherwise(c),
        "mcc": lambda c: F.when(every(23), "").when(every(19), F.concat(c, F.lit(".0"))).otherwise(c),
        "hour_num": lambda c: F.when(every(29), "27").otherwise(c),
        "amount_uzs": lambda c: (F.when(every(47), F.translate(c, ".", ",")).when(every(41), "n/a")
                                 .when(every(31), F.concat(F.lit("-"), c)).otherwise(c)),
        "p2p_flag": lambda c: (F.when(every(59), "1")
                               .when(every(37), F.when(_is_p2p(), "True").otherwise("False")).otherwise(c)),
        "respcode": lambda c: F.when(every(43), "").otherwise(c),
        "transaction_date": lambda c: F.when(every(53), F.date_format(_day(), "dd.MM.yyyy")).otherwise(c),
        "p2p_type": lambda c: F.when(every(59), "").otherwise(c),
    }
    source = _joined(spark, sf_dir, chosen)
    return source.select(*[(faults[n](clean[n]) if n in faults else clean[n]).alias(n) for n in chosen])
