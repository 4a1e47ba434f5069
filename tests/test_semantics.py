"""Micro-frames for edge rows, brute-force checks of algorithms and invariants."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cardlens.functions import scalars as sc
from cardlens.operators import forecast as fc
from cardlens.operators import fraud as fr
from cardlens.operators import quality as q
from cardlens.operators import segments as sg
from cardlens.operators import stats as st
from cardlens.operators import text as tx
from cardlens.sources import readers, typing, writers


def _one(df, *names):
    row = df.first()
    return tuple(row[n] for n in names)


def test_scalar_parsing(spark):
    df = spark.createDataFrame([("2024-01-05", "5411.0", "12,50"), ("05.01.2024", "abc", "x"), ("20240105", "", " 7 "), ("05/01/2024", None, None), ("junk", "99", "1")],
                               "d string, m string, a string")
    out = df.select(sc.parse_date_multi("d").alias("d"), sc.clean_mcc("m").alias("m"), sc.to_float("a").alias("a"), sc.to_int("m").alias("i")).collect()
    assert [r.d for r in out] == [dt.date(2024, 1, 5)] * 4 + [dt.date(1970, 1, 1)]
    assert [r.m for r in out] == [5411, 0, 0, 0, 99] and [r.i for r in out] == [5411, 0, 0, 0, 99]
    assert [r.a for r in out] == [12.5, 0.0, 7.0, 0.0, 1.0]


def test_luhn_and_day_base(spark):
    df = spark.createDataFrame([("4539578763621486",), ("4539578763621487",), ("",), ("79927398713",), (None,)], "c string")
    assert [r.v for r in df.select(sc.luhn_valid("c").alias("v")).collect()] == [True, False, False, True, False]
    day = spark.range(1).select(F.lit(45658).alias("n")).select(sc.day_number_to_date("n").alias("d"), sc.day_number_to_date("n", "1899-12-30").alias("e"))
    assert _one(day, "d", "e") == (dt.date(2025, 1, 3), dt.date(2025, 1, 1))
    found = typing.infer_day_base(spark.createDataFrame([("45658",), ("45700",)], "rday string"))
    assert [r.base for r in found.collect() if r.plausible] == ["1899-12-30", "1900-01-01"]


def test_whole_nan_is_missing_but_names_keep_it(spark):
    path = writers.scratch(spark, "nan")
    spark.createDataFrame([("Nanette", "nan"), (" NaN ", "1")], "a string, b string").coalesce(1).write.option("header", True).csv(path)
    assert sorted(tuple(r) for r in readers.read_csv_raw(spark, path).collect()) == [("", "1"), ("Nanette", "")]


def test_safe_select_guards(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert readers.safe_select(spark, "select * from five", 3).count() == 3
    assert readers.safe_select(spark, "select 'drop; table' as t from five limit 4").count() == 4
    for bad in ("drop table five", "select 1; select 2", "with x as (select 1) insert into five select * from x", "delete from five"):
        with pytest.raises(ValueError):
            readers.safe_select(spark, bad)


def test_publish_keeps_live_table_when_a_check_fails(spark):
    name = "published_check"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{writers.scratch(spark, name)}'")
    good = spark.createDataFrame([(dt.date(2024, 1, 1), 1)], "transaction_date date, mcc int")
    writers.publish(good, f"{name}.live", [F.count("*") == 1])
    with pytest.raises(ValueError):
        writers.publish(good.union(good), f"{name}.live", [F.count("*") == 1])
    assert spark.table(f"{name}.live").count() == 1
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_segments_lowest_edges(spark):
    rows = [("a", 0, 0, 10.0), ("b", 3, 20, 20.0), ("c", 40, 6, 30.0), ("d", 200, 60, 40.0)]
    cards = spark.createDataFrame(rows, "hpan string, days_since_last_txn int, txn_count_30d int, txn_amount_30d double")
    ours = {r.hpan: (r.recency_score, r.frequency_score) for r in sg.behaviour_segments(cards).collect()}
    assert ours == {"a": ("Active", "Low"), "b": ("Active", "High"), "c": ("Sleeping", "Medium"), "d": ("Lost", "VeryHigh")}
    strict = {r.hpan: r for r in sg.behaviour_segments(cards, strict_reference=True).collect()}
    assert strict["a"].recency_score is None and strict["a"].frequency_score is None and strict["a"].customer_segment == "Lost"


def test_psi_of_equal_samples_is_zero_and_open_ends_count(spark):
    base = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    assert _one(st.psi(base, base, "v"), "psi", "status") == (0.0, "stable")
    shifted = base.select((F.col("v") + 1000).alias("v"))
    assert {r.n_cur for r in st.psi_bins(base, shifted, "v").collect()} == {0}
    assert st.psi_bins(base, shifted, "v", open_ends=True).orderBy(F.desc("bin")).first().n_cur == 100


def _scored(spark, n=400):
    rng = random.Random(8)
    rows = [(str(i), round(rng.choice([rng.random(), 0.25, 0.5]), 3), int(rng.random() < 0.3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "transaction_id string, score double, fraud_proxy int")


def test_metrics_by_brute_force(spark):
    rows, df = _scored(spark)
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    wins = sum((p > m) + 0.5 * (p == m) for p in pos for m in neg)
    got = fr.classification_metrics(df).first()
    assert got.roc_auc == pytest.approx(wins / len(pos) / len(neg))
    tp, fp = sum(p >= 0.5 for p in pos), sum(m >= 0.5 for m in neg)
    assert got.precision == pytest.approx(tp / (tp + fp)) and got.recall == pytest.approx(tp / len(pos))
    cells = fr.confusion_matrix(df).first()
    assert (cells.tp, cells.fp) == (tp, fp) and cells.tp + cells.fp + cells.tn + cells.fn == len(rows)
    curve = fr.ev_curve(df).orderBy("i").collect()
    for r in curve:
        assert (r.tp, r.fp) == (sum(p >= r.threshold for p in pos), sum(m >= r.threshold for m in neg))
    best = fr.ev_threshold(df).first()
    assert best.ev == max(r.ev for r in curve) and best.threshold == next(r.threshold for r in curve if r.ev == best.ev)


def test_isotonic_is_monotone_and_not_worse(spark):
    _, df = _scored(spark)
    out = fr.calibrate_isotonic(df)
    values = [r.calibrated for r in out.orderBy("score").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(values, values[1:]))
    assert fr.brier(out, "calibrated").first()[0] <= fr.brier(out).first()[0]


def test_chi_square_tail(spark):
    known = {1: (3.841459, 0.05), 2: (5.991465, 0.05), 5: (11.070498, 0.05), 10: (18.307038, 0.05), 7: (1.0, 0.994829)}
    for degrees, (x, p) in known.items():
        got = spark.range(1).select(fc.chi2_tail(F.lit(x), degrees).alias("p")).first().p
        assert got == pytest.approx(p, abs=1e-5)


def _series(spark, n, key="s", start=dt.date(2024, 1, 1), f=lambda i: float(i)):
    return spark.createDataFrame([(key, start + dt.timedelta(days=i), f(i)) for i in range(n)], "series_key string, ds date, y double")


def test_forecast_edges(spark):
    short = fc.seasonal_naive(_series(spark, 3), 4).orderBy("ds").collect()
    assert [r.yhat for r in short] == [1.0] * 4 and short[0].ds == dt.date(2024, 1, 4)
    week = fc.seasonal_naive(_series(spark, 10), 9).orderBy("ds").collect()
    assert [r.yhat for r in week] == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 3.0, 4.0]
    line = fc.trend_weekday_forecast(_series(spark, 70, f=lambda i: 100.0 + 2 * i), 5).orderBy("ds").collect()
    assert [r.yhat for r in line] == pytest.approx([100.0 + 2 * i for i in range(70, 75)])
    perfect = fc.forecast_metrics(_series(spark, 5).withColumns({"yhat": F.col("y"), "yhat_lower": F.col("y"), "yhat_upper": F.col("y")}).drop("y"),
                                  _series(spark, 5), _series(spark, 5)).first()
    assert (perfect.mape, perfect.rmse, perfect.mase, perfect.coverage) == (0.0, 0.0, 0.0, 100.0)
    flat = fc.ljung_box(_series(spark, 30, f=lambda i: 4.0)).first()
    assert flat.statistic == 0.0 and flat.autocorrelated == 0


def test_hierarchy_adds_up(spark):
    rng = random.Random(2)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), m, f"k{k}", rng.uniform(1, 9) * (k + 1)) for i in range(20) for m in (1, 2) for k in range(6)]
    leaves = fc.select_series(spark.createDataFrame(rows, "ds date, mcc int, merchant_key string, y double"), 0.6, 3)
    assert leaves.agg(F.sum("y")).first()[0] == pytest.approx(sum(r[3] for r in rows))
    sums = {r.level: r.s for r in fc.hierarchical_forecast(leaves, 5).groupBy("level").agg(F.sum("yhat").alias("s")).collect()}
    assert sums["merchant"] == pytest.approx(sums["mcc"]) == pytest.approx(sums["total"])


def test_table_chunks_hold_the_text(spark):
    """Without the repeated lines the chunks are the text; only a single line passes the size; a tenth of the lines repeats."""
    rng = random.Random(4)
    texts = {i: "\n".join("".join(rng.choices("abc", k=rng.randrange(0, 60))) for _ in range(rng.randrange(1, 200))) for i in range(12)}
    frame = spark.createDataFrame([(i, "table", t) for i, t in texts.items()], "doc_id int, type string, content string")
    got = {}
    for r in tx.chunk_documents(frame, 300, 10).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r.text.split("\n"))
    for i, chunks in got.items():
        lines = list(chunks[0])
        for before, chunk in zip(chunks, chunks[1:]):
            repeat = len(before) // 10
            assert chunk[:repeat] == before[len(before) - repeat:]
            assert sum(map(len, before)) + len(chunk[repeat]) > 300  # a chunk ends only where the next line does not fit
            lines += chunk[repeat:]
        assert "\n".join(lines) == texts[i]
        assert all(sum(map(len, c)) <= 300 or len(c) == 1 for c in chunks)


def test_query_expansion(spark):
    asked = spark.createDataFrame([("Card risk вчера",), ("nothing here",), ("отчет 5 мая, карта card",)], "text string")
    out = [r.expanded for r in tx.expand_query(asked).collect()]
    assert out[0] == "Card risk вчера карта карточка hpan риск угроза проблема дата период время"
    assert out[1] == "nothing here" and out[2] == "отчет 5 мая, карта card карточка hpan дата период время"


def test_repairs_are_idempotent(spark):
    rows = [("1", "c1", "5", 20000000.0, 1, "", "", "05", 7, 30, "Ж", 1), ("2", "c2", "12345", -50.0, 0, "s", "card2card", "", 99, 5, "?", 0), ("3", None, None, None, 1, "", "", "", None, None, None, 1)]
    df = spark.createDataFrame(rows, "transaction_id string, hpan string, m string, amount_uzs double, p2p_flag int, sender_hpan string, p2p_type string, respcode string, "
                               "hour_num long, age long, gender string, fraud_proxy int").withColumn("mcc", F.col("m").cast("int")).drop("m")
    once = q.fix_formats(q.fix_consistency(q.fill_respcode(df)))
    twice = q.fix_formats(q.fix_consistency(q.fill_respcode(once)))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    fixed = {r.transaction_id: r for r in once.collect()}
    assert fixed["2"].amount_uzs == 50.0 and fixed["2"].sender_hpan == "" and 0 <= fixed["2"].hour_num <= 23 and fixed["3"].respcode == "05"
    assert all(len(r.hpan) == 16 and 0 <= r.mcc <= 9999 and 18 <= r.age <= 100 and r.gender in q.GENDERS for r in fixed.values())


def test_clip_keeps_missing_amounts(spark):
    df = spark.createDataFrame([(1.0,), (None,), (500.0,), (510.0,), (520.0,), (1e12,)], "amount_uzs double")
    out = [r.amount_uzs for r in q.clip_outliers(df).collect()]
    assert out == [440.0, None, 500.0, 510.0, 520.0, 580.0]  # quartiles 500 and 520, fences three spreads away


def test_division_by_zero_gives_null(spark):
    assert spark.range(1).select(sc.percent(F.lit(1), F.lit(0)).alias("x")).first().x is None


def test_stand_in_cards_pass_the_check_and_do_not_meet(spark):
    keys = [str(i) for i in range(3000)] + ["007", "7a", None, "x-1", "123456789012"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", sc.hash_card("k").alias("c")).withColumn("ok", sc.luhn_valid("c")).collect()
    assert all(len(r.c) == 16 and r.ok for r in rows if r.k is not None)
    assert len({r.c for r in rows}) == len(rows)


def test_split_keeps_rare_labels(spark):
    df = spark.createDataFrame([(f"t{i}", 1 if i < 3 else 0 if i < 1000 else None) for i in range(1100)], "transaction_id string, fraud_proxy int")
    train, hold = fr.stratified_split(df)
    counts = {r.fraud_proxy: r["count"] for r in hold.groupBy("fraud_proxy").count().collect()}
    assert counts == {1: 1, 0: 199, None: 20}
    assert train.count() + hold.count() == 1100 and train.join(hold, "transaction_id").count() == 0


def test_dates_are_read_whole(spark):
    texts = ["2024-01-05", "2024-01-05junk", "05.01.2024 10:30", "2024-01-05T07:00:00", "20240105", "2024-01-05 x"]
    days = spark.createDataFrame([(t,) for t in texts], "t string").select(sc.parse_date_multi("t").cast("string").alias("d")).collect()
    assert [r.d for r in days] == ["2024-01-05", "1970-01-01", "2024-01-05", "2024-01-05", "2024-01-05", "1970-01-01"]


def test_leaves_sum_up_to_the_whole_history(spark):
    rows = [(dt.date(2024, 1, 1 + day), code, f"m{m}", 1.0) for day in range(8) for code in [None, *range(30)] for m in range(3)]
    leaves = fc.select_series(spark.createDataFrame(rows, "ds date, mcc int, merchant_key string, y double"), 0.9, 2, 20)
    assert leaves.agg(F.sum("y")).first()[0] == len(rows)
    assert leaves.select("mcc").distinct().count() == 21
    made = {r.level: r.yhat for r in fc.hierarchical_forecast(leaves, 1).groupBy("level").agg(F.sum("yhat").alias("yhat")).collect()}
    assert made["total"] == pytest.approx(len(rows) / 8) == pytest.approx(made["merchant"])
