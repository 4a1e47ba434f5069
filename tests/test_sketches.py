"""Mergeable states and bounded profiles against plain counts."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cardlens.operators import quality, sketches


def rows(n=30_000):
    r = random.Random(6)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in (0, 1, 2, 5, 9, 30)]
    return [(r.choice(days), r.choice(["a", "a", "b", None]), f"c{r.randrange(9000)}", r.choice([None, *range(40)]), float(r.randrange(500))) for _ in range(n)]


SCHEMA = "transaction_date date, company string, card string, shop int, amount double"


def test_states_merge_over_days_and_keys(spark):
    data = rows()
    states = sketches.daily_states(spark.createDataFrame(data, SCHEMA).repartition(7), ["company"], ["card", "shop"])
    for begin, end in ((None, None), (dt.date(2024, 1, 2), dt.date(2024, 1, 10)), (dt.date(2024, 1, 30), None)):
        inside = [x for x in data if (begin is None or x[0] >= begin) and (end is None or x[0] <= end)]
        for keys in (["company"], []):
            got = sketches.estimates(sketches.merge_states(sketches.merge_states(states, ["company"], begin, end) if begin is None and end is None else states, keys,
                                                           *((begin, end) if begin or end else ()))).collect()
            for g in got:
                own = [x for x in inside if not keys or x[1] == g.company]
                assert (g.transactions, g.volume, g.largest) == (len(own), sum(x[4] for x in own), max(x[4] for x in own))
                for name, i in (("card", 2), ("shop", 3)):
                    exact = len({x[i] for x in own} - {None})
                    assert abs(g[f"unique_{name}"] - exact) <= 5 * sketches.relative_error() * exact + 1
            assert sum(g.transactions for g in got) == len(inside)


def test_error_of_the_sketches(spark):
    """Over many keys the mean error is that of one sketch, and few are beyond twice of it."""
    df = spark.range(400_000).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(40)).alias("g"))
    states = sketches.daily_states(df.select(F.lit(dt.date(2024, 1, 1)).alias("transaction_date"), "g", "k", F.lit(1).alias("amount")), ["g"], ["k"], bits=10)
    exact = {x.g: x.unique_k for x in sketches.exact_counts(df, ["g"], ["k"]).collect()}
    errors = [abs(x.unique_k / exact[x.g] - 1) for x in sketches.estimates(states).collect()]
    limit = sketches.relative_error(10)
    assert len(errors) == 40 and sum(errors) / 40 < limit and sum(e > 2 * limit for e in errors) <= 4


def test_rolling_and_exact(spark):
    data = rows(3000)
    df = spark.createDataFrame(data, SCHEMA)
    for x in sketches.estimates(sketches.rolling_states(sketches.daily_states(df, [], ["card"]), [], 5)).collect():
        own = [y for y in data if dt.timedelta(0) <= x.transaction_date - y[0] < dt.timedelta(days=5)]
        assert x.transactions == len(own) and abs(x.unique_card - len({y[2] for y in own})) <= 30
    exact = {x.company: (x.unique_card, x.unique_shop) for x in sketches.exact_counts(df, ["company"], ["card", "shop"]).collect()}
    assert exact == {c: (len({y[2] for y in data if y[1] == c}), len({y[3] for y in data if y[1] == c} - {None})) for c in ("a", "b", None)}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_profile_with_bounded_state(spark, k):
    data = [(r.choice([None, "", "é", "Z", "b", "aa"]), r.choice([None, 5, -3, 7]), None, x) for r in [random.Random(1)] for x in [float(i % 11) for i in range(300)]]
    df = spark.createDataFrame(data, "`a.b` string, n int, none string, x double").repartition(5)
    for exact in (True, False):
        got = {x["column"]: x for x in quality.profile_table(df, k, exact=exact, deal_by="x" if exact else None).collect()}
        for i, name in enumerate(("a.b", "n", "none", "x")):
            values = [str(y[i]) for y in data if y[i] is not None]
            filled = sorted({v for v in values if v != ""}, key=str.encode)
            row = got[name]
            assert (row["total"], row["nulls"]) == (300, 300 - sum(v != "" for v in values))
            assert row["distinct_values"] == len(set(values)) and (row["examples"] or []) == filled[:k]
        assert (got["n"]["min_value"], got["n"]["max_value"]) == (-3.0, 7.0) and got["a.b"]["avg_value"] is None
    assert quality.profile_table(df.limit(0), k).count() == 4


def test_sketched_profile_shuffles_no_values(spark):
    df = spark.range(50_000).select(F.col("id").cast("string").alias("v"), F.col("id").alias("n"))
    out = quality.profile_table(df, 3, exact=False)
    out.collect()
    metrics = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in metrics and "unpivot" not in metrics.lower()


def test_trailing_counts_are_exact(spark):
    """Values that come again within and after the span, NULL values, NULL days and days with none but NULL values."""
    data = [*rows(2000), (dt.date(2024, 3, 1), "a", None, None, 1.0), (None, "a", "c1", 1, 1.0)]
    df = spark.createDataFrame(data, SCHEMA)
    for keys, days in (([], 1), ([], 4), (["company"], 3), (["company"], 40)):
        found = sketches.exact_counts(df, keys, ["card", "shop"], day="transaction_date", days=days)
        got = {(x.transaction_date, *[x[k] for k in keys]): (x.unique_card, x.unique_shop) for x in found.collect()}
        want = {}
        for key in {(x[0], *([x[1]] if keys else [])) for x in data if x[0]}:
            own = [x for x in data if x[0] and dt.timedelta(0) <= key[0] - x[0] < dt.timedelta(days) and (not keys or x[1] == key[1])]
            want[key] = (len({x[2] for x in own} - {None}), len({x[3] for x in own} - {None}))
        assert got == want


def test_trailing_counts_copy_no_rows(spark):
    """Rows are not spread over the days of the span: what is shuffled does not depend on it."""
    df = spark.createDataFrame(rows(500), SCHEMA)
    def largest(days):
        plan = sketches.exact_counts(df, [], ["card"], day="transaction_date", days=days)
        plan.collect()
        return plan._jdf.queryExecution().executedPlan().toString().count("Generate")
    assert largest(3) == largest(300) and "sequence" not in sketches.exact_counts(df, [], ["card"], day="transaction_date", days=300)._jdf.queryExecution().optimizedPlan().toString()
