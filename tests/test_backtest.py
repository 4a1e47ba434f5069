"""Back-test from prefix sums against one forecast per fold, on series with gaps, NULL values and a NULL key."""
import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.operators import forecast as fc

NAMES = ["n", "mape", "smape", "mae", "rmse", "coverage", "mase"]


def series(spark):
    r = random.Random(3)
    start = "2024-01-01"
    rows = []
    for key, days, gap, empty in (("a", 120, 0.0, 0.0), ("b", 90, 0.2, 0.1), (None, 70, 0.1, 0.0), ("short", 20, 0.0, 0.0), ("null", 60, 0.0, 1.0), ("flat", 60, 0.0, 0.0)):
        for i in range(days):
            if r.random() >= gap:
                y = 10.0 if key == "flat" else None if r.random() < empty else 100 + i + 20 * (i % 7) + r.uniform(-9, 9)
                rows.append((key, i, y))
    return spark.createDataFrame(rows, "series_key string, i int, y double").select("series_key", F.date_add(F.lit(start).cast("date"), F.col("i")).alias("ds"), "y")


def fold_by_fold(df, n_splits, test_size, min_train) -> DataFrame:
    """Each series and fold cut by hand and given to the public models."""
    made = []
    by_key: dict = {}
    for row in df.orderBy("series_key", "ds").collect():
        by_key.setdefault(row.series_key, []).append((row.ds, row.y))
    train, test = [], []
    for key, rows in by_key.items():
        for k in range(1, n_splits + 1):
            stop = len(rows) - (k - 1) * test_size
            if stop - test_size >= min_train:
                train += [(key, k, *x) for x in rows[:stop - test_size]]
                test += [(key, k, *x) for x in rows[stop - test_size:stop]]
    spark, schema, keys = df.sparkSession, "series_key string, split int, ds date, y double", ["series_key", "split"]
    train, test = spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)
    for name, f in (("seasonal_naive", fc.seasonal_naive(train, test_size, keys=keys)), ("trend_weekday", fc.trend_weekday_forecast(train, test_size, keys))):
        made.append(fc.forecast_metrics(f, test, train, keys).withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, made)


@pytest.mark.parametrize("n_splits,test_size,min_train", [(3, 14, 30), (5, 9, 3)])
def test_equals_fold_by_fold(spark, n_splits, test_size, min_train):
    df = series(spark)
    keyed = lambda found: {(x.series_key, x.split, x.model): x for x in found.collect()}
    got, want = keyed(fc.rolling_origin(df, n_splits, test_size, min_train)), keyed(fold_by_fold(df, n_splits, test_size, min_train))
    assert set(got) == set(want) and any(k[0] is None for k in got)
    for key, row in want.items():
        if key[0] == "flat" and key[2] == "trend_weekday":  # the band has no width: rounding decides what lies inside
            continue
        for name in NAMES:
            expected = row[name] if row[name] is None else pytest.approx(row[name], rel=1e-6, abs=1e-9)
            assert got[key][name] == expected, (key, name)


def test_plan_does_not_grow_with_folds(spark):
    def exchanges(n):
        return fc.rolling_origin(series(spark), n)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(2) == exchanges(40) == 1


def test_empty(spark):
    assert fc.rolling_origin(series(spark).where("false")).count() == 0
