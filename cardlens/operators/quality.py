"""Data quality: profiles, rules as data, scores, repairs and diagnoses."""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.functions.distributed import top_per_key, wide_percentiles, with_scalars
from cardlens.functions.scalars import (day, filter_transactions, hash_card, hash_impute, hash_number, is_missing,
                                        parse_date_multi, percent, ratio, region_ip_fill)
from cardlens.operators.setops import dedup_keep_first, head_per_group

# Fixed values.
CRITICAL_COLUMNS = ["hpan", "transaction_code", "amount_uzs", "emitent_bank"]
VALID_MCC = [5411, 5999, 5812, 6011, 5541, 5912, 5814, 5311, 5732, 5045, 5942, 5947, 5122, 5813, 5921]
GENDERS = ["М", "Ж", "M", "F"]
IP_PATTERN = r"^(\d{1,3}\.){3}\d{1,3}$"
SKETCH_ERROR = 0.02
LEAST_AMOUNT, LARGEST_AMOUNT = 100, 1_000_000_000
NUMERIC_KINDS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _number(name: str) -> Column:
    return F.trim(F.col(f"`{name}`").cast("string")).try_cast("double")


# ---- profiles --------------------------------------------------------------------------------------------------

def _value_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n): all columns in one pass and one shuffle, with equal values summed before it."""
    names = list(columns or df.columns)
    text = df.select(*[F.col(f"`{n}`").cast("string").alias(f"c{i}") for i, n in enumerate(names)])
    counted = text.unpivot([], text.columns, "at", "value").groupBy("at", "value").agg(F.count("*").alias("n"))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.substring("at", 2, 10).cast("int"))
    return counted.select(name.alias("column"), "value", "n")


def _blank() -> Column:
    return F.col("value").isNull() | (F.col("value") == "")


def _least_values(df: DataFrame, k: int) -> DataFrame:
    """(column, value): the k smallest filled values of each column. A task keeps k values a column and passes only those on."""
    names = df.columns
    text = df.select(*[F.col(f"`{n}`").cast("string").alias(f"c{i}") for i, n in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        least: list[list[str]] = [[] for _ in names]
        for batch in batches:
            for i in range(len(names)):
                held = least[i]
                values = pc.unique(batch.column(i))
                if len(held) == k:
                    values = values.filter(pc.less(values, pa.scalar(held[-1], values.type)))
                fresh = values.filter(pc.greater(values, pa.scalar("", values.type)))
                if len(fresh):
                    order = pc.select_k_unstable(pa.table({"v": fresh}), min(k, len(fresh)), [("v", "ascending")])
                    least[i] = sorted({*held, *fresh.take(order).to_pylist()}, key=lambda v: v.encode())[:k]
        rows = [(name, v) for name, held in zip(names, least) for v in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(2)], names=["column", "value"])

    parts = text.mapInArrow(run, "column string, value string").distinct()
    return top_per_key(parts, ["column"], [F.col("value")], k, "_r").drop("_r")


def _column_states(df: DataFrame) -> DataFrame:
    """One row per column with type, counts, extremes, mean, smallest filled value and a distinct sketch: one aggregation of
    bounded state, no value is shuffled."""
    entries, aggregates = [], [F.count("*").alias("t")]
    for i, (name, kind) in enumerate(df.dtypes):
        c = F.col(f"`{name}`")
        text = c.cast("string")
        filled = text.isNotNull() & (text != "")
        number = kind.startswith(NUMERIC_KINDS)
        v = c.cast("double") if number else F.lit(None).cast("double")
        total = F.sum(c).cast("double") if number else F.lit(None).cast("double")
        aggregates += [F.count_if(~F.coalesce(filled, F.lit(False))).alias(f"n{i}"), F.approx_count_distinct(text, SKETCH_ERROR).alias(f"d{i}"),
                       F.min(F.when(filled, text)).alias(f"e{i}")]
        if number:
            aggregates += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"), F.round(F.try_divide(total, F.count(c)), 4).alias(f"a{i}")]
        at = lambda x: F.col(f"{x}{i}") if number else F.lit(None).cast("double")  # noqa: B023, E731
        entries.append(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type"), F.col("t").alias("total"), F.col(f"n{i}").alias("nulls"),
                                F.col(f"d{i}").alias("distinct_values"), at("l").alias("min_value"), at("h").alias("max_value"), at("a").alias("avg_value"),
                                F.col(f"e{i}").alias("example")))
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def _with_exact_distinct(states: DataFrame, df: DataFrame, deal_by: str | None) -> DataFrame:
    """The sketches replaced by exact counts: every different value of every column is shuffled."""
    dealt = df if deal_by is None else df.repartition(F.col(f"`{deal_by}`"))
    exact = _value_table(dealt).select("column", "value").groupBy("column").agg(F.count("value").alias("distinct_values"))
    return states.drop("distinct_values").join(exact, "column", "left").na.fill(0, ["distinct_values"])


def profile_table(df: DataFrame, k: int = 5, exact: bool = True, deal_by: str | None = None) -> DataFrame:
    """Per column: type, rows, missing, missing share, distinct values, the k smallest examples, numeric extremes and mean.

    Two passes with bounded state. Distinct values are counted exactly by a third pass, which shuffles them, or estimated
    within ``SKETCH_ERROR``. ``deal_by`` names a column with many values by which rows are dealt before they are taken
    apart, for tables whose files give few tasks.
    """
    states = _column_states(df)
    if exact:
        states = _with_exact_distinct(states, df, deal_by)
    shown = _least_values(df, k).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    return states.drop("example").withColumn("null_rate", ratio(F.col("nulls"), F.col("total"))).join(shown, "column", "left").select(
        "column", "type", "total", "nulls", "distinct_values", "min_value", "max_value", "avg_value", "null_rate", "examples").orderBy("column")


def null_rates(df: DataFrame) -> DataFrame:
    """Missing values of all columns from one aggregation without a shuffle of rows."""
    row = df.agg(F.count("*").alias("_t"), *[F.count_if(is_missing(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(df.columns)])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.col("_t").alias("total")) for i, c in enumerate(df.columns)]
    long = row.select(F.inline(F.array(*entries)))
    return long.withColumn("null_rate", ratio(F.col("nulls"), F.col("total"))).orderBy(F.col("null_rate").desc(), "column")


def data_dictionary(df: DataFrame, exact: bool = True, deal_by: str | None = None) -> DataFrame:
    """Column, smallest value as repeatable example, missing, missing share and distinct values (see ``profile_table``)."""
    states = _column_states(df)
    if exact:
        states = _with_exact_distinct(states, df, deal_by)
    return states.select("column", "example", "nulls", ratio(F.col("nulls"), F.col("total")).alias("null_rate"), "distinct_values").orderBy(
        F.col("null_rate").desc(), "column")


# ---- rules -----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """kind: type, not_null, range, at_least, isin, max_length, not_future or unique."""

    column: str
    kind: str
    args: tuple = field(default=())

    def label(self) -> str:
        return f"{self.kind}({', '.join(map(str, self.args))})" if self.args else self.kind

    def violated(self, as_of: Column) -> Column:
        c, n = F.col(f"`{self.column}`"), _number(self.column)
        if self.kind == "type":
            test = ~is_missing(c) & c.cast("string").try_cast(self.args[0]).isNull()
        elif self.kind == "not_null":
            test = is_missing(c)
        elif self.kind == "range":
            test = ~n.between(*self.args)
        elif self.kind == "at_least":
            test = n < self.args[0]
        elif self.kind == "isin":
            test = ~is_missing(c) & ~c.cast("string").isin(*[str(a) for a in self.args])
        elif self.kind == "max_length":
            test = F.length(c) > self.args[0]
        elif self.kind == "not_future":
            test = parse_date_multi(c, None) > F.date_add(as_of, 1)
        else:
            raise ValueError(f"unknown rule {self.kind}")
        return F.coalesce(test, F.lit(False))


TRANSACTION_RULES = [
    Rule("rday", "type", ("bigint",)), Rule("rday", "range", (0, 500000)), Rule("transaction_date", "not_future"),
    Rule("amount_uzs", "type", ("double",)), Rule("amount_uzs", "at_least", (0,)), Rule("mcc", "type", ("double",)),
    Rule("mcc", "range", (0, 9999)), Rule("merchant", "at_least", (0,)), Rule("p2p_flag", "isin", (0, 1)),
    Rule("respcode", "max_length", (8,)), Rule("hour_num", "range", (0, 23)), Rule("hpan", "not_null"),
    Rule("transaction_code", "not_null"), Rule("transaction_code", "unique"), Rule("emitent_bank", "not_null"),
    Rule("gender", "isin", ("М", "Ж")),
]


def schema_rules(df: DataFrame, rules: Sequence[Rule] = tuple(TRANSACTION_RULES), as_of=None) -> DataFrame:
    """Violations and the smallest violating value of each rule whose column exists.

    All row rules share one aggregation; a uniqueness rule counts keys. Rule names are data, so adding one adds a column.
    """
    today = F.current_date() if as_of is None else day(as_of)
    known = [r for r in rules if r.column in df.columns]
    plain = [r for r in known if r.kind != "unique"]
    parts = []
    if plain:
        bad = [(r, r.violated(today)) for r in plain]
        row = df.agg(*[F.count_if(b).alias(f"n{i}") for i, (_, b) in enumerate(bad)],
                     *[F.min(F.when(b, F.col(f"`{r.column}`").cast("string"))).alias(f"s{i}") for i, (r, b) in enumerate(bad)])
        entries = [F.struct(F.lit(r.column).alias("column"), F.lit(r.label()).alias("rule"), F.col(f"n{i}").alias("violations"),
                            F.col(f"s{i}").alias("sample")) for i, (r, _) in enumerate(bad)]
        parts.append(row.select(F.inline(F.array(*entries))))
    for r in known:
        if r.kind == "unique":
            keys = df.groupBy(r.column).agg(F.count("*").alias("_n"))
            parts.append(keys.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"),
                                  F.min(F.when(F.col("_n") > 1, F.col(r.column).cast("string"))).alias("sample")).select(
                F.lit(r.column).alias("column"), F.lit("unique").alias("rule"), "violations", "sample"))
    return reduce(DataFrame.unionByName, parts)


def rule_failures(df: DataFrame, rule: Rule, n: int = 20, as_of=None) -> DataFrame:
    """The first n failing rows of one rule."""
    return df.where(rule.violated(F.current_date() if as_of is None else day(as_of))).limit(n)


def business_checks(df: DataFrame, as_of=None, large: float = 1_000_000, repeats: int = 10) -> DataFrame:
    """Eight business rules on the typed frame: (check, violations, issue)."""
    today = F.current_date() if as_of is None else day(as_of)
    amount, hour, mcc = F.col("amount_uzs"), F.col("hour_num"), F.col("mcc")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    counted = {
        "negative_amount": amount < 0,
        "hour_out_of_range": ~F.coalesce(hour.between(0, 23), F.lit(False)),
        "mcc_and_merchant_empty": (F.coalesce(mcc, F.lit(0)) == 0) & blank("merchant_name"),
        "p2p_without_type": (F.coalesce(F.col("p2p_flag"), F.lit(0)) == 1) & blank("p2p_type"),
        "respcode_too_long": F.length("respcode") > 8,
        "future_date": F.col("transaction_date") > today,
        "date_before_2000": F.col("transaction_date") < F.lit("2000-01-01").cast("date"),
        "mcc_out_of_range": mcc.isNotNull() & ~((mcc > 0) & (mcc < 10000)),
    }
    row = df.agg(F.count("mcc").alias("_mcc"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in counted.items()])
    issue = {n: F.col(n) > 0 for n in counted}
    issue["mcc_out_of_range"] = F.col("mcc_out_of_range") * 20 > F.col("_mcc")
    entries = [F.struct(F.lit(n).alias("check"), F.col(n).alias("violations"), F.coalesce(issue[n], F.lit(False)).cast("int").alias("issue")) for n in counted]
    repeated = df.where(amount > large).groupBy("amount_uzs").agg(F.count("*").alias("_n")).where(F.col("_n") > repeats).agg(
        F.count("*").alias("violations")).select(F.lit("large_amount_repeated").alias("check"), "violations",
                                                 (F.col("violations") > 0).cast("int").alias("issue"))
    return row.select(F.inline(F.array(*entries))).unionByName(repeated)


# ---- scores ----------------------------------------------------------------------------------------------------

def _with_fences(df: DataFrame, number: Column) -> DataFrame:
    """Row number as ``_a`` and the 3×IQR fences as ``_fence``."""
    numbered = df.withColumn("_a", number)
    q = wide_percentiles(numbered, [], "_a", {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return with_scalars(numbered, "_fence", q.select((F.col("q1") - spread * 3).alias("low"), (F.col("q3") + spread * 3).alias("high")))


def _outlier() -> Column:
    return F.coalesce((F.col("_a") < F.col("_fence.low")) | (F.col("_a") > F.col("_fence.high")), F.lit(False))


def _mean_of_test(test: Column) -> Column:
    return ratio(F.count_if(F.coalesce(test, F.lit(False))), F.count("*"))


def _duplicates(df: DataFrame, key: str) -> Column:
    return df.groupBy(key).agg(F.count("*").alias("_n")).agg(F.sum(F.col("_n") - 1)).scalar()


def _five_dim_row(df: DataFrame) -> DataFrame:
    """All figures of the five dimensions in one row; figures whose columns are absent are NULL."""
    have = set(df.columns)
    null = F.lit(None).cast("double")
    amounts = null
    if {"reqamt", "conamt", "amount_uzs"} <= have:
        asked, paid = F.coalesce(_number("reqamt"), F.lit(0.0)), F.coalesce(_number("amount_uzs"), F.lit(0.0))
        amounts = _mean_of_test((paid <= asked * 1.1) | (asked == 0))
    order = null
    if {"issue_date", "expire_date"} <= have:
        order = _mean_of_test(parse_date_multi("expire_date", None) > parse_date_multi("issue_date", None))
    valid = lambda c, lo, hi: _mean_of_test(_number(c).between(lo, hi)) if c in have else null
    fenced = _with_fences(df, _number("amount_uzs"))
    return fenced.agg(
        F.count("*").alias("total"),
        *[F.count_if(is_missing(c)).alias(f"missing_{c}") for c in CRITICAL_COLUMNS if c in have],
        order.alias("dates_order"), amounts.alias("amounts"), valid("mcc", 0, 9999).alias("mcc_range"),
        valid("age", 18, 100).alias("age_range"), valid("hour_num", 0, 23).alias("hour_range"),
        F.count("_a").alias("n_amount"), F.count_if(_outlier()).alias("outliers"),
        F.count_if(F.coalesce(F.col("_a") < 0, F.lit(False))).alias("negatives"),
    ).withColumn("duplicates", _duplicates(df, "transaction_code") if "transaction_code" in have else F.lit(0))


def five_dim_checks(df: DataFrame) -> DataFrame:
    """(dimension, check, value, success) for completeness, consistency, uniqueness, validity and accuracy."""
    row = _five_dim_row(df)
    share = lambda c: F.round(percent(F.col(c), F.col("total")), 2)
    out = [("completeness", c, share(f"missing_{c}"), share(f"missing_{c}") < 5) for c in CRITICAL_COLUMNS if f"missing_{c}" in row.columns]
    out += [("consistency", c, F.col(c), F.col(c) > 0.95) for c in ("dates_order", "amounts")]
    out += [("uniqueness", "transaction_code", share("duplicates"), F.col("duplicates") == 0)]
    out += [("validity", c, F.col(c), F.col(c) > 0.95) for c in ("mcc_range", "age_range", "hour_range")]
    out += [("accuracy", "outliers", F.round(percent(F.col("outliers"), F.col("n_amount")), 2), F.col("outliers") == 0),
            ("accuracy", "negative_amounts", share("negatives"), F.col("negatives") == 0)]
    entries = [F.struct(F.lit(d).alias("dimension"), F.lit(n).alias("check"), v.cast("double").alias("value"), s.cast("int").alias("success"))
               for d, n, v, s in out]
    return row.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())


def _mean(parts: Sequence[Column]) -> Column:
    """Mean of the parts that are not NULL."""
    filled = F.array_compact(F.array(*parts))
    return ratio(F.aggregate(filled, F.lit(0.0), lambda a, x: a + x), F.size(filled))


def quality_score(df: DataFrame) -> DataFrame:
    """Five scores, their mean and the grade."""
    row = _five_dim_row(df)
    share = lambda c, of="total": F.round(percent(F.col(c), F.col(of)), 2)
    complete = _mean([F.greatest(F.lit(0.0), 100 - share(f"missing_{c}")) for c in CRITICAL_COLUMNS if f"missing_{c}" in row.columns])
    passed = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col(c) > 0.95, 100.0).otherwise(0.0))
    consistent = F.coalesce(_mean([passed("dates_order"), F.col("amounts") * 100]), F.lit(0.0))
    unique = F.greatest(F.lit(0.0), 100 - share("duplicates"))
    valid = F.coalesce(_mean([passed("mcc_range"), F.col("age_range") * 100, F.col("hour_range") * 100]), F.lit(0.0))
    accurate = 100 - F.least(F.coalesce(share("outliers", "n_amount"), F.lit(0.0)) * 2, F.lit(30.0)) - share("negatives") * 5
    scores = {"completeness_score": complete, "consistency_score": consistent, "uniqueness_score": unique,
              "validity_score": valid, "accuracy_score": accurate}
    scored = row.select(*[v.alias(n) for n, v in scores.items()])
    overall = reduce(lambda a, b: a + b, [F.col(n) for n in scores]) / 5
    grade = (F.when(overall >= 95, "A+ (Excellent)").when(overall >= 90, "A (Very Good)").when(overall >= 80, "B (Good)")
             .when(overall >= 70, "C (Acceptable)").when(overall >= 60, "D (Poor)").otherwise("F (Critical)"))
    return scored.select(*[F.round(n, 2).alias(n) for n in scores], F.round(overall, 2).alias("overall_score"), grade.alias("grade"))


def quality_score_strict(df: DataFrame, fraud: str = "fraud_proxy") -> DataFrame:
    """The repair job's variant of the five scores: plain shares, no rounding of parts, no penalty factors."""
    have = set(df.columns)
    filled = lambda c: 100 - percent(F.count_if(is_missing(c)), F.count("*"))
    of = lambda test, base: percent(F.count_if(F.coalesce(base & test, F.lit(False))), F.count_if(F.coalesce(base, F.lit(False))))
    inside = lambda c, lo, hi: _mean_of_test(_number(c).between(lo, hi)) * 100
    complete = [filled(c) for c in CRITICAL_COLUMNS if c in have]
    consistent = []
    if {"p2p_flag", "sender_hpan"} <= have:
        consistent.append(of(~is_missing("sender_hpan"), _number("p2p_flag") == 1))
    if {fraud, "respcode"} <= have:
        consistent.append(of(F.col("respcode") != "00", _number(fraud) == 1))
    valid = [inside(c, lo, hi) for c, lo, hi in (("mcc", 0, 9999), ("hour_num", 0, 23)) if c in have]
    fenced = _with_fences(df, _number("amount_uzs"))
    scored = fenced.agg(
        _mean(complete).alias("completeness"), _mean(consistent).alias("consistency") if consistent else F.lit(95.0).alias("consistency"),
        _mean(valid).alias("validity") if valid else F.lit(95.0).alias("validity"),
        F.greatest(F.lit(0.0), 100 - F.coalesce(percent(F.count_if(_outlier()), F.count("_a")), F.lit(5.0))).alias("accuracy"),
        F.count("*").alias("_t"))
    scored = scored.withColumns({"uniqueness": 100 - percent(_duplicates(df, "transaction_code"), F.col("_t")),
                                 "consistency": F.coalesce("consistency", F.lit(95.0))}).drop("_t")
    names = ["completeness", "uniqueness", "consistency", "validity", "accuracy"]
    overall = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / 5
    return scored.select(*[F.round(n, 4).alias(n) for n in names], F.round(overall, 4).alias("overall"))


# ---- repairs ---------------------------------------------------------------------------------------------------

def _present(df: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({n: c for n, c in changes.items() if n in df.columns})


def fix_consistency(df: DataFrame, fraud: str = "fraud_proxy") -> DataFrame:
    """Transfer fields only on transfers, no accepted fraud, positive amounts, expiry after issue."""
    keep_p2p = lambda c: F.when(F.col("p2p_flag") == 0, "").otherwise(F.col(c))
    changes = {c: keep_p2p(c) for c in ("sender_hpan", "p2p_type", "receiver_bank") if c in df.columns}
    if "respcode" in df.columns and fraud in df.columns:
        changes["respcode"] = F.when((F.col(fraud) == 1) & (F.col("respcode") == "00"), "05").otherwise(F.col("respcode"))
    if "amount_uzs" in df.columns:
        changes["amount_uzs"] = F.abs("amount_uzs")
    if {"issue_date", "expire_date"} <= set(df.columns):
        late = F.col("expire_date") <= F.col("issue_date")
        changes["expire_date"] = F.when(late, F.date_add("issue_date", 365 * 3)).otherwise(F.col("expire_date"))
    return _present(df, changes)


def fill_respcode(df: DataFrame, fraud: str = "fraud_proxy", large: float = 10_000_000) -> DataFrame:
    """Missing response codes: 61 for very large amounts, else 05 for fraud, else 00."""
    filled = F.when(F.col("amount_uzs") > large, "61").when(F.col(fraud) == 1, "05").otherwise("00")
    return df.withColumn("respcode", F.when(is_missing("respcode"), filled).otherwise(F.col("respcode")))


def fix_formats(df: DataFrame, key: str = "transaction_id", region: str = "emitent_region") -> DataFrame:
    """Invalid address, card, code, hour, age and gender replaced by repeatable choices from the allowed sets."""
    bad = lambda c, lo, hi: ~F.coalesce(F.col(c).between(lo, hi), F.lit(False))
    have = set(df.columns)
    changes: dict[str, Column] = {}
    if "ip" in have:
        wrong = ~F.coalesce(F.col("ip").rlike(IP_PATTERN), F.lit(False))
        changes["ip"] = region_ip_fill("ip", region if region in have else F.lit(""), key, wrong)
    if "hpan" in have:
        source = F.when(is_missing("hpan"), F.col(key)).otherwise(F.col("hpan"))
        changes["hpan"] = F.when(F.coalesce(F.length("hpan") == 16, F.lit(False)), F.col("hpan")).otherwise(hash_card(source))
    if "mcc" in have:
        changes["mcc"] = hash_impute("mcc", VALID_MCC, key, bad("mcc", 0, 9999))
    if "hour_num" in have:
        changes["hour_num"] = F.when(bad("hour_num", 0, 23), hash_number(key, "h") % 24).otherwise(F.col("hour_num"))
    if "age" in have:
        changes["age"] = F.when(bad("age", 18, 100), 18 + hash_number(key, "g") % 47).otherwise(F.col("age"))
    if "gender" in have:
        changes["gender"] = hash_impute("gender", ["М", "Ж"], key, ~F.coalesce(F.col("gender").isin(*GENDERS), F.lit(False)))
    return df.withColumns(changes)


def clip_outliers(df: DataFrame, amount: str = "amount_uzs") -> DataFrame:
    """Absolute limits first, then the 3×IQR fences of the limited amounts; values are clipped, never redrawn."""
    def between(c: Column, low: Column, high: Column) -> Column:
        return F.when(c.isNotNull(), F.greatest(F.least(c, high), low))

    value = F.col(amount).cast("double")
    limited = df.withColumn(amount, between(value, F.lit(float(LEAST_AMOUNT)), F.lit(float(LARGEST_AMOUNT))))
    fenced = _with_fences(limited, F.col(amount))
    return fenced.withColumn(amount, between(F.col(amount), F.col("_fence.low"), F.col("_fence.high"))).drop("_a", "_fence")


def improve(df: DataFrame, order: Sequence[str] = ("transaction_date", "transaction_id"), per_card: int | None = None) -> DataFrame:
    """All repairs in order, then one row per transaction code and, where ``per_card`` is asked for, the first rows of each
    card."""
    fixed = clip_outliers(fix_formats(fix_consistency(fill_respcode(df))))
    unique = dedup_keep_first(fixed, ["transaction_code"], list(order))
    return unique if per_card is None else head_per_group(unique, "hpan", list(order), per_card)


def improvement_scores(before: DataFrame, after: DataFrame) -> DataFrame:
    return quality_score_strict(before).withColumn("stage", F.lit("before")).unionByName(
        quality_score_strict(after).withColumn("stage", F.lit("after")))


# ---- diagnoses -------------------------------------------------------------------------------------------------

def field_diagnosis(raw: DataFrame, fields: Sequence[str] = ("mcc", "rday", "amount_uzs")) -> DataFrame:
    """Empty, zero, non-numeric and positive values of text fields."""
    aggs, entries = [], []
    for f in fields:
        n, empty = _number(f), is_missing(f)
        aggs += [F.count_if(empty).alias(f"{f}_e"), F.count_if(F.coalesce(n == 0, F.lit(False))).alias(f"{f}_z"),
                 F.count_if(~empty & n.isNull()).alias(f"{f}_x"), F.count_if(F.coalesce(n > 0, F.lit(False))).alias(f"{f}_v")]
        entries.append(F.struct(F.lit(f).alias("field"), F.col(f"{f}_e").alias("empty"), F.col(f"{f}_z").alias("zero"),
                                F.col(f"{f}_x").alias("non_numeric"), F.col(f"{f}_v").alias("valid")))
    return raw.agg(*aggs).select(F.inline(F.array(*entries)))


def fill_rates(df: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Filled share of amount, code and merchant in the period; 0 counts as empty for numbers."""
    rows = filter_transactions(df, date_from=date_from, date_to=date_to)
    empty = {"amount_uzs": F.coalesce(F.col("amount_uzs"), F.lit(0)) == 0, "mcc": F.coalesce(F.col("mcc"), F.lit(0)) == 0,
             "merchant_name": is_missing("merchant_name")}
    row = rows.agg(F.count("*").alias("_t"), *[F.count_if(t).alias(n) for n, t in empty.items()])
    entries = [F.struct(F.lit(n).alias("field"), (F.col("_t") - F.col(n)).alias("filled"), F.col("_t").alias("total")) for n in empty]
    long = row.select(F.inline(F.array(*entries)))
    return long.withColumn("fill_rate", F.coalesce(percent(F.col("filled"), F.col("total")), F.lit(100.0)))


def data_patterns(df: DataFrame, hours: int = 3, codes: int = 5) -> DataFrame:
    """Peak hours, transfer share and most frequent codes as (pattern, value, n)."""
    def top(column: str, n: int, name: str) -> DataFrame:
        counts = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(n)
        return counts.select(F.lit(name).alias("pattern"), F.col(column).cast("string").alias("value"), "n")

    p2p = df.agg(F.round(percent(F.count_if(F.col("p2p_flag") == 1), F.count("*")), 2).cast("string").alias("value"),
                 F.count_if(F.col("p2p_flag") == 1).alias("n")).select(F.lit("p2p_ratio").alias("pattern"), "value", "n")
    return top("hour_num", hours, "peak_hour").unionByName(p2p).unionByName(top("mcc", codes, "top_mcc"))


def entity_density(df: DataFrame, entities: Sequence[str] = ("hpan", "pinfl", "merchant_name"), exact: bool = True) -> DataFrame:
    """Distinct entities and rows per entity, from one value table, or from sketches in one pass."""
    if not exact:
        states = _column_states(df.select(*entities))
        filled = F.col("total") - F.col("nulls")
        return states.where(filled > 0).select(F.col("column").alias("entity"), "distinct_values", filled.alias("transactions"),
                                               ratio(filled, F.col("distinct_values")).alias("avg_per_entity"))
    values = _value_table(df, entities).where(~_blank())
    return values.groupBy(F.col("column").alias("entity")).agg(
        F.count("*").alias("distinct_values"), F.sum("n").alias("transactions"),
        ratio(F.sum("n"), F.count("*")).alias("avg_per_entity"))


def invalid_dates(df: DataFrame, columns: Sequence[str], fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Filled values that do not parse in the format."""
    row = df.agg(*[F.count_if(~is_missing(c) & F.try_to_date(F.col(c), fmt).isNull()).alias(c) for c in columns],
                 *[F.count_if(is_missing(c)).alias(f"{c}_m") for c in columns])
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("invalid"), F.col(f"{c}_m").alias("missing")) for c in columns]
    return row.select(F.inline(F.array(*entries)))


def schema_compare(tables: Mapping[str, DataFrame], fields: Sequence[str]) -> DataFrame:
    """Type, rows and filled values of the key fields in each table."""
    def one(name: str, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        here = [f for f in fields if f in kinds]
        row = df.agg(F.count("*").alias("_t"), *[F.count_if(~is_missing(f)).alias(f) for f in here])
        entries = [F.struct(F.lit(f).alias("field"), F.lit(kinds.get(f, "absent")).alias("type"), F.col("_t").alias("total"),
                            (F.col(f) if f in here else F.lit(0)).cast("bigint").alias("filled")) for f in fields]
        return row.select(F.lit(name).alias("table_name"), F.inline(F.array(*entries)))

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])
