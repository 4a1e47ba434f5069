"""From text columns to typed ones: schema conformance, type recommendation, day-number base."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.functions.scalars import (DAY_BASES, bool_to_flag, clean_mcc, day_number_to_date, is_missing, parse_date_multi,
                                        to_int, to_money)

# Columns whose type does not follow from their values.
TYPE_BY_NAME = {"transaction_code": "String", "pinfl": "String", "terminal_id": "String", "ip": "String",
                "login": "String", "expire_date": "String", "issue_date": "String", "hpan": "String",
                "pinfl_flag": "Nullable(Float32)", "oked": "Nullable(Float32)", "respcode": "Nullable(Float32)"}
UNSIGNED = [("UInt8", 2 ** 8), ("UInt16", 2 ** 16), ("UInt32", 2 ** 32)]
SIGNED = [("Int8", 2 ** 7), ("Int16", 2 ** 15), ("Int32", 2 ** 31)]


def conform_to_schema(df: DataFrame, schema: Mapping[str, str], defaults: Mapping[str, object] | None = None,
                      unsigned: Sequence[str] = ()) -> DataFrame:
    """The schema's columns in its order: absent ones added, casts safe, defaults filled, unsigned ones not below 0."""
    defaults, cols = defaults or {}, []
    for name, kind in schema.items():
        c = F.col(f"`{name}`").try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if name in defaults:
            c = F.coalesce(c, F.lit(defaults[name]).cast(kind))
        cols.append((F.greatest(c, F.lit(0).cast(kind)) if name in unsigned else c).alias(name))
    return df.select(*cols)


def recommend_types(df: DataFrame, overrides: Mapping[str, str] = TYPE_BY_NAME, numeric_share: float = 0.9) -> DataFrame:
    """The narrowest type of each text column, from one aggregation over all columns."""
    def number(name: str):
        return F.trim(F.col(f"`{name}`").cast("string")).try_cast("double")

    stats = []
    for i, name in enumerate(df.columns):
        n = number(name)
        stats += [F.count_if(~is_missing(F.col(f"`{name}`"))).alias(f"filled_{i}"), F.count_if(is_missing(F.col(f"`{name}`"))).alias(f"missing_{i}"),
                  F.count(n).alias(f"parsed_{i}"), F.count_if(n != F.floor(n)).alias(f"fraction_{i}"),
                  F.min(n).alias(f"low_{i}"), F.max(n).alias(f"high_{i}")]
    row = df.agg(*stats)
    entries = [F.struct(F.lit(name).alias("column"), *[F.col(f"{s}_{i}").alias(s) for s in
                                                       ("filled", "missing", "parsed", "fraction", "low", "high")])
               for i, name in enumerate(df.columns)]
    long = row.select(F.inline(F.array(*entries)))
    low, high = F.col("low"), F.col("high")
    unsigned, signed = F.when(high < UNSIGNED[0][1], UNSIGNED[0][0]), F.when((low >= -SIGNED[0][1]) & (high < SIGNED[0][1]), SIGNED[0][0])
    for label, bound in UNSIGNED[1:]:
        unsigned = unsigned.when(high < bound, label)
    for label, bound in SIGNED[1:]:
        signed = signed.when((low >= -bound) & (high < bound), label)
    numeric = (F.col("parsed") > F.col("filled") * numeric_share) & (F.col("parsed") > 0)
    whole = F.when(low >= 0, unsigned.otherwise("UInt64")).otherwise(signed.otherwise("Int64"))
    base = F.when(F.col("fraction") > 0, "Float64").otherwise(whole)
    found = F.when(numeric, F.when(F.col("missing") > 0, F.concat(F.lit("Nullable("), base, F.lit(")"))).otherwise(base)).otherwise("String")
    fixed = F.lit(None).cast("string")
    if overrides:
        fixed = F.try_element_at(F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]), F.col("column"))
    return long.select("column", "filled", "missing", "parsed", F.coalesce(fixed, found).alias("type"))


def infer_day_base(df: DataFrame, column: str = "rday", bases: Sequence[str] = tuple(DAY_BASES), first_year: int = 2015,
                   last_year: int = 2030) -> DataFrame:
    """First and last day under each candidate base; the plausible ones (years in range) come first."""
    edges = df.agg(F.min(F.col(column).try_cast("int")).alias("low"), F.max(F.col(column).try_cast("int")).alias("high"))
    entries = [F.struct(F.lit(b).alias("base"), day_number_to_date("low", b).alias("first_day"), day_number_to_date("high", b).alias("last_day"))
               for b in bases]
    days = edges.select(F.inline(F.array(*entries)))
    fits = (F.year("first_day") >= first_year) & (F.year("last_day") <= last_year)
    return days.withColumn("plausible", fits.cast("int")).orderBy(F.col("plausible").desc(), "base")


def typed_transactions(raw: DataFrame) -> DataFrame:
    """The text-only frame with parsed money, code, hour, day and flags; whatever fails to parse is NULL (code: 0)."""
    known = {
        "amount_uzs": to_money("amount_uzs"), "reqamt": to_money("reqamt"), "conamt": to_money("conamt"),
        "mcc": clean_mcc("mcc"), "hour_num": to_int("hour_num", None), "p2p_flag": bool_to_flag("p2p_flag"),
        "transaction_date": parse_date_multi("transaction_date", None), "rday": to_int("rday", None),
        "age": to_int("age", None), "fraud_proxy": to_int("fraud_proxy", 0),
    }
    return raw.withColumns({name: expr for name, expr in known.items() if name in raw.columns})
