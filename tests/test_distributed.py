"""Ranking helpers against brute force, and hot keys against the plain windows."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlens.functions import distributed as ds
from cardlens.operators.windows import quartile_score, running_count, sequence_features, velocity_count


def _values(n, seed):
    rng = random.Random(seed)
    pool = [0.0, -3.5, 1e9, 2.25, 2.26] + [round(rng.uniform(-50, 5000), 2) for _ in range(200)]
    return [rng.choice(pool) for _ in range(n)]


def test_percentiles_match_numpy(spark):
    data = {"a": _values(701, 1), "b": _values(40, 2), "c": [7.5]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.prob): r.value for r in ds.percentiles(df, ["k"], "v", probs).collect()}
    assert len(got) == len(data) * len(probs)
    for k, vs in data.items():
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(vs, p))


def test_percentiles_ignore_null_values_and_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", None), ("x", 5.0)], "k string, v double")
    assert {r.k: r.value for r in ds.percentiles(df, ["k"], "v", [0.5]).collect()} == {None: 2.0, "x": 5.0}


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e9])
def test_value_bins_split_any_magnitude(spark, scale):
    rng = random.Random(8)
    values = [rng.random() * scale for _ in range(20000)] + [-rng.random() * scale for _ in range(200)] + [0.0, 5e-324, 1.7e308]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("bin", ds.value_bin(F.col("v")))
    ordered = [r.bin for r in df.orderBy("v").collect()]
    assert ordered == sorted(ordered)
    sizes = [r["count"] for r in df.groupBy("bin").count().collect()]
    assert max(sizes) < 20 * sum(sizes) / len(sizes)


def test_running_totals_and_rank(spark):
    scores = sorted({round(random.Random(3).random() + i / 7, 3) for i in range(300)}, reverse=True)
    df = spark.createDataFrame([(s, i % 5 + 1) for i, s in enumerate(scores)], "s double, n long")
    rows = ds.running_totals(df, [], "s", {"t": "n"}, descending=True).orderBy(F.desc("s")).collect()
    assert [r.t for r in rows] == list(np.cumsum([i % 5 + 1 for i in range(len(scores))]))
    ranked = ds.global_rank(df, [F.col("s")]).orderBy("s").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(scores) + 1)) and {r["total"] for r in ranked} == {len(scores)}


def _skewed(spark, n=900):
    """One card holds a third of all rows; times repeat, some rows share a second."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        card = "hot" if i % 3 == 0 else f"c{rng.randrange(40)}"
        when = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 72))
        rows.append((f"t{i:05d}", card, when.date(), when, when.hour, round(rng.choice([0.0, 0.0, rng.uniform(1, 900)]), 2)))
    return spark.createDataFrame(rows, "transaction_id string, hpan string, transaction_date date, transaction_time timestamp, hour_num int, a double").withColumn(
        "amount_uzs", F.col("a").cast("decimal(18,2)")).drop("a")


def test_hot_card_windows_equal_plain_windows(spark):
    df = _skewed(spark)
    names = ["transaction_id", "days_since_prev_txn", "prev_amount", "card_avg_amount", "amount_change_ratio", "amount_deviation", "txn_hour_count"]
    plain = sequence_features(df).select(*names).orderBy("transaction_id").collect()
    sliced = sequence_features(df, slice_rows=10).select(*names).orderBy("transaction_id").collect()
    assert len(plain) == 900 and plain == sliced


def test_counts_in_trailing_hour_and_day(spark):
    df = _skewed(spark)
    rows = df.select("transaction_id", "hpan", "transaction_time").collect()
    hour = {r.transaction_id: r.velocity_count for r in velocity_count(df, "hpan").collect()}
    day = {r.transaction_id: r.running_count for r in running_count(df, "hpan").collect()}
    for r in rows:
        mine = [x.transaction_time for x in rows if x.hpan == r.hpan and x.transaction_time <= r.transaction_time]
        assert hour[r.transaction_id] == sum(r.transaction_time - t <= dt.timedelta(hours=1) for t in mine)
        assert day[r.transaction_id] == sum(t.date() == r.transaction_time.date() for t in mine)


def test_top_values_and_heaviest_break_ties_by_value(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("a", 2), ("a", 3), ("b", 9)], "k string, v int")
    assert {r.k: list(r.t) for r in ds.top_values(df, ["k"], "v", 2, "t").collect()} == {"a": [1, 2], "b": [9]}
    assert {r.k: (r.h, r.h_count) for r in ds.heaviest_value(df, ["k"], "v", "h").collect()} == {"a": (1, 2), "b": (9, 1)}


def test_quartiles_fall_back_to_equal_widths_when_edges_repeat(spark):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate([1.0] * 8 + [2.0, 9.0])], "hpan string, v double")
    assert [r.s for r in quartile_score(df, "v", "s").orderBy(F.col("hpan").cast("int")).collect()] == [1] * 9 + [4]
    same = spark.createDataFrame([("a", 5.0), ("b", 5.0)], "hpan string, v double")
    assert {r.s for r in quartile_score(same, "v", "s").collect()} == {2}


def test_window_group_limit_runs_before_the_shuffle(spark):
    plan = ds.top_per_key(_skewed(spark), ["hpan"], [F.col("transaction_time")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def _odd_cards(spark):
    """300 rows of one card among others: hours unlike the times, missing times, a NULL card with many rows."""
    rng = random.Random(9)
    rows = []
    for i in range(900):
        card = ["hot", None, f"c{rng.randrange(9)}"][i % 3]
        when = None if rng.random() < 0.2 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 90))
        day = when.date() if when else dt.date(2024, 1, 1 + rng.randrange(3))
        rows.append((f"t{i:05d}", card, day, when, rng.randrange(24), float(rng.randrange(0, 900))))
    return spark.createDataFrame(rows, "transaction_id string, hpan string, transaction_date date, transaction_time timestamp, hour_num int, amount_uzs double")


def test_slices_do_not_change_results(spark):
    df = _odd_cards(spark)
    whole = sequence_features(df).orderBy("transaction_id").collect()
    assert len(whole) == 900
    for size in (7, 40):
        cut = sequence_features(df, slice_rows=size).select(*whole[0].asDict()).orderBy("transaction_id").collect()
        assert [tuple(r)[:7] for r in cut] == [tuple(r)[:7] for r in whole]
        for a, b in zip(cut, whole):
            assert tuple(a)[7:] == pytest.approx(tuple(b)[7:])
    rows = {r.transaction_id: r for r in whole}
    order = lambda r: (r.transaction_time is not None, r.transaction_time or dt.datetime.min, r.transaction_id)
    for card in ("hot", None, "c3"):
        mine = sorted((r for r in whole if r.hpan == card), key=order)
        for i, r in enumerate(mine):
            last = mine[max(0, i - 9):i + 1]
            assert rows[r.transaction_id].prev_amount == (mine[i - 1].amount_uzs if i else None)
            assert rows[r.transaction_id].card_avg_amount == pytest.approx(sum(x.amount_uzs for x in last) / len(last))
            same = [x for x in mine if (x.transaction_date, x.hour_num) == (r.transaction_date, r.hour_num)]
            assert rows[r.transaction_id].txn_hour_count == same.index(r) + 1


def test_rows_without_card_stay(spark):
    df = _odd_cards(spark)
    assert running_count(df, "hpan").count() == velocity_count(df, "hpan").count() == 900
    assert velocity_count(df, "hpan").where("transaction_time is null and velocity_count is not null").count() == 0
