"""Order statistics by selection against sorted lists."""
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlens.functions import distributed as ds
from cardlens.operators import windows
from cardlens.operators.segments import rfm_scores


def test_bits_are_those_of_the_double(spark):
    r = random.Random(2)
    values = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), *[2.0**e for e in range(-1074, 1024, 7)]]
    values += [math.nextafter(2.0**e, s) for e in range(-300, 300, 11) for s in (0, math.inf)] + [r.uniform(-1, 1) * 10.0 ** r.randint(-300, 300) for _ in range(3000)]
    values += [-v for v in values]
    want = {v: (lambda b: b if b >= 0 else -(b & ((1 << 63) - 1)))(struct.unpack("<q", struct.pack("<d", v))[0]) for v in values}
    got = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", ds.ordered_bits(F.col("v"))).collect()
    assert all(x.b == want[x.v] for x in got)
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(ds.ordered_bits(F.col("v"))).first()[0]
    assert nan > max(want.values())


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_dense_values(spark, keys):
    n = 1_000_000
    df = spark.range(n).select((F.col("id") % 2).alias("k"), (1000 + F.pmod(F.col("id") * 7_919, F.lit(n)) / n).alias("v"))
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    for k in range(2 if keys else 1):
        values = [1000 + i * 7_919 % n / n for i in range(n) if not keys or i % 2 == k]
        got = {r.prob: r.value for r in ds.percentiles(df, keys, "v", probs).collect() if not keys or r.k == k}
        assert got == pytest.approx({p: float(np.quantile(values, p)) for p in probs}, abs=1e-12)


@pytest.mark.parametrize("small,splits", [(1, 2), (7, 5), (200_000, 64)])
def test_cut_rows(spark, small, splits):
    r = random.Random(4)
    rows = [(r.choice([None, 1, 1, 1, 2, 5, 9]), f"t{r.randint(0, 40):02d}") for _ in range(120)]
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = [1, 17, 60, 119, 120]
    got = ds.cut_rows(spark.createDataFrame(rows, "v int, t string"), ["v", "t"], lambda n: want, small, splits).first()
    assert [tuple(c) for c in got] == [order[i - 1] for i in want]
    empty = ds.cut_rows(spark.createDataFrame([], "v int, t string"), ["v"], lambda n: [1, 2]).first()
    assert list(empty) == [None, None]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 101])
def test_quartiles_of_ranks(spark, n):
    r = random.Random(n)
    rows = [(f"c{i:03d}", r.choice([1, 1, 1, 2, 3])) for i in range(n)]
    got = windows.quartile_score(spark.createDataFrame(rows, "hpan string, v int"), "v", "q", mode="rank").collect()
    ordered = {c: i for i, (_, c) in enumerate(sorted((v, c) for c, v in rows), 1)}
    edge = lambda q: 1 + (n - 1) * q
    assert {x.hpan: x.q for x in got} == {c: 2 if n == 1 else 1 if i <= edge(.25) else 2 if i <= edge(.5) else 3 if i <= edge(.75) else 4 for c, i in ordered.items()}


def test_scores_write_no_frame(spark, monkeypatch):
    def refuse(df):
        raise AssertionError("the frame was written")

    monkeypatch.setattr(ds, "cut_lineage", refuse)
    cards = spark.range(500).select(F.col("id").cast("string").alias("hpan"), (F.col("id") % 17).alias("txn_count_30d"), (F.col("id") % 91).alias("txn_amount_30d"),
                                    (F.col("id") % 40).alias("days_since_last_txn"))
    scored = rfm_scores(cards)
    assert scored.count() == 470 and not spark.sparkContext._jsc.getPersistentRDDs()
