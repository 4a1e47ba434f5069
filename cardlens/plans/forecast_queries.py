"""Time-series queries: one series per merchant category over the daily volume."""
from pyspark.sql import functions as F

from cardlens.operators import forecast as fc
from cardlens.operators import joins as j
from cardlens.operators import metrics as m
from cardlens.plans.features_queries import SERIES, mcc_series
from cardlens.plans.registry import TXN, query
from cardlens.sources.model import transactions

DAY = "CAST(ds AS VARCHAR) AS ds"
NUMBERED = SERIES + """, num AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds) AS rn, row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) AS back,
    count(*) OVER (PARTITION BY series_key) AS len, max(ds) OVER (PARTITION BY series_key) AS last FROM s)
"""


def _rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


BANDS = ("yhat", "yhat_lower", "yhat_upper")


@query("fill_calendar", SERIES + """, sp AS (SELECT series_key, min(ds) AS a, max(ds) AS b FROM s GROUP BY 1),
dd AS (SELECT series_key, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS ds FROM sp)
SELECT dd.series_key, CAST(dd.ds AS VARCHAR) AS ds, coalesce(y, 0) AS y FROM dd LEFT JOIN s ON s.series_key = dd.series_key AND s.ds = dd.ds""")
def _(spark, d):
    return fc.fill_calendar(mcc_series(spark, d))


@query("ma7_forecast", NUMBERED + """, lv AS (SELECT series_key, last, avg(y) AS v FROM num WHERE back <= 7 GROUP BY ALL)
SELECT series_key, CAST(last + CAST(i AS INT) AS VARCHAR) AS ds, round(v, 4) AS yhat, round(v * 0.9, 4) AS yhat_lower, round(v * 1.1, 4) AS yhat_upper FROM lv, range(1, 31) r(i)""")
def _(spark, d):
    return _rounded(fc.ma7_forecast(mcc_series(spark, d), 30), *BANDS)


@query("seasonal_naive", NUMBERED + """SELECT series_key, CAST(last + CAST(i AS INT) AS VARCHAR) AS ds, round(y, 4) AS yhat, round(y * 0.8, 4) AS yhat_lower, round(y * 1.2, 4) AS yhat_upper
FROM num, range(1, 15) r(i) WHERE back <= 7 AND (i - 1) % 7 = 7 - back""")
def _(spark, d):
    return _rounded(fc.seasonal_naive(mcc_series(spark, d), 14), *BANDS)


TREND = """, tm AS (SELECT *, CAST(ds - min(ds) OVER (PARTITION BY {k}) AS DOUBLE) AS t, min(ds) OVER (PARTITION BY {k}) AS first FROM {source}),
ln AS (SELECT {k}, regr_slope(y, t) AS sl, regr_intercept(y, t) AS b, any_value(first) AS first, max(ds) AS last FROM tm GROUP BY {k}),
ft AS (SELECT tm.*, b + sl * t AS trend, isodow(ds) AS dow FROM tm JOIN ln USING ({k})),
ix AS (SELECT {k}, dow, avg(y / trend) AS ix FROM ft GROUP BY {k}, dow),
sd AS (SELECT {k}, stddev_samp(y - trend * ix) AS sd FROM ft JOIN ix USING ({k}, dow) GROUP BY {k}),
fu AS (SELECT {k}, last + CAST(i AS INT) AS ds, b + sl * CAST(last + CAST(i AS INT) - first AS DOUBLE) AS trend, isodow(last + CAST(i AS INT)) AS dow, sd FROM ln JOIN sd USING ({k}), range(1, {h}) r(i)),
tw AS (SELECT {k}, ds, trend * coalesce(ix, 1) AS yhat, trend * coalesce(ix, 1) - 1.96 * sd AS yhat_lower, trend * coalesce(ix, 1) + 1.96 * sd AS yhat_upper FROM fu LEFT JOIN ix USING ({k}, dow))
"""


@query("trend_weekday_forecast", SERIES + TREND.format(k="series_key", source="s", h=31)
       + "SELECT series_key, CAST(ds AS VARCHAR) AS ds, round(yhat, 2) AS yhat, round(yhat_lower, 2) AS yhat_lower, round(yhat_upper, 2) AS yhat_upper FROM tw")
def _(spark, d):
    return _rounded(fc.trend_weekday_forecast(mcc_series(spark, d), 30), *BANDS, digits=2)


@query("ensemble", NUMBERED + TREND.format(k="series_key", source="s", h=15) + """, lv AS (SELECT series_key, last, avg(y) AS v FROM num WHERE back <= 7 GROUP BY ALL),
ma AS (SELECT series_key, last + CAST(i AS INT) AS ds, v AS yhat, v * 0.9 AS yhat_lower, v * 1.1 AS yhat_upper FROM lv, range(1, 15) r(i))
SELECT series_key, CAST(ds AS VARCHAR) AS ds, round(ma.yhat * 0.25 + tw.yhat * 0.75, 2) AS yhat, round(ma.yhat_lower * 0.25 + tw.yhat_lower * 0.75, 2) AS yhat_lower,
  round(ma.yhat_upper * 0.25 + tw.yhat_upper * 0.75, 2) AS yhat_upper FROM ma JOIN tw USING (series_key, ds)""")
def _(spark, d):
    s = mcc_series(spark, d)
    return _rounded(fc.ensemble([fc.ma7_forecast(s, 14), fc.trend_weekday_forecast(s, 14)], [0.25, 0.75]), *BANDS, digits=2)


def _metric_sql(k: str, forecast: str, test: str, train: str, extra: str = "", rounded: bool = True) -> str:
    r = (lambda e, n: f"round({e}, {n})") if rounded else (lambda e, n: e)
    return f"""SELECT {k}, {extra} count(*) AS n, {r("avg(abs(y - yhat) / nullif(abs(y), 0)) * 100", 4)} AS mape,
  {r("avg(abs(y - yhat) / nullif((abs(y) + abs(yhat)) / 2, 0)) * 100", 4)} AS smape, {r("avg(abs(y - yhat))", 4)} AS mae, {r("sqrt(avg((y - yhat) ** 2))", 4)} AS rmse,
  CAST(count(*) FILTER (y BETWEEN yhat_lower AND yhat_upper) AS DOUBLE) / count(*) * 100 AS coverage, {r("avg(abs(y - yhat)) / any_value(nv)", 6)} AS mase
FROM {test} JOIN {forecast} USING ({k}, ds) JOIN (SELECT {k}, avg(dd) AS nv FROM (SELECT {k}, abs(y - lag(y) OVER (PARTITION BY {k} ORDER BY ds)) AS dd FROM {train}) GROUP BY {k}) USING ({k}) GROUP BY {k}"""


METRICS = ("mape", "smape", "mae", "rmse")


@query("forecast_metrics", NUMBERED + """, tr AS (SELECT series_key, ds, y FROM num WHERE back > 14), te AS (SELECT series_key, ds, y FROM num WHERE back <= 14),
lv AS (SELECT series_key, max(ds) OVER (PARTITION BY series_key) AS last, avg(y) OVER (PARTITION BY series_key) AS v FROM num WHERE back BETWEEN 15 AND 21),
ma AS (SELECT DISTINCT series_key, last + CAST(i AS INT) AS ds, v AS yhat, v * 0.9 AS yhat_lower, v * 1.1 AS yhat_upper FROM lv, range(1, 31) r(i))
""" + _metric_sql("series_key", "ma", "te", "tr"))
def _(spark, d):
    series = mcc_series(spark, d)
    from pyspark.sql import Window as W

    back = series.withColumn("back", F.row_number().over(W.partitionBy("series_key").orderBy(F.col("ds").desc())))
    train, test = back.where("back > 14").drop("back"), back.where("back <= 14").drop("back")
    out = fc.forecast_metrics(fc.ma7_forecast(train, 30), test, train)
    return _rounded(_rounded(out, *METRICS), "mase", digits=6)


@query("align_on_date", NUMBERED + """, lv AS (SELECT DISTINCT series_key, max(ds) OVER (PARTITION BY series_key) AS last, avg(y) OVER (PARTITION BY series_key) AS v FROM num WHERE back BETWEEN 15 AND 21)
SELECT num.series_key, CAST(num.ds AS VARCHAR) AS ds, y, round(v, 4) AS yhat FROM num JOIN lv ON num.series_key = lv.series_key AND num.ds - lv.last BETWEEN 1 AND 30 AND back <= 14""")
def _(spark, d):
    from pyspark.sql import Window as W

    back = mcc_series(spark, d).withColumn("back", F.row_number().over(W.partitionBy("series_key").orderBy(F.col("ds").desc())))
    forecast = fc.ma7_forecast(back.where("back > 14").drop("back"), 30)
    return _rounded(j.align_on_date(back.where("back <= 14"), forecast).select("series_key", "ds", "y", "yhat"), "yhat")


@query("align_on_date_null_key", NUMBERED + """, k AS (SELECT nullif(series_key, 5411) AS series_key, ds, y, back FROM num), lv AS (SELECT DISTINCT series_key, max(ds) OVER (PARTITION BY series_key) AS last, avg(y) OVER (PARTITION BY series_key) AS v FROM k WHERE back BETWEEN 15 AND 21)
SELECT k.series_key, CAST(k.ds AS VARCHAR) AS ds, y, round(v, 4) AS yhat FROM k JOIN lv ON k.series_key IS NOT DISTINCT FROM lv.series_key AND k.ds - lv.last BETWEEN 1 AND 30 AND back <= 14""")
def _(spark, d):
    from pyspark.sql import Window as W

    series = mcc_series(spark, d).withColumn("series_key", F.expr("nullif(series_key, 5411)"))
    back = series.withColumn("back", F.row_number().over(W.partitionBy("series_key").orderBy(F.col("ds").desc())))
    forecast = fc.ma7_forecast(back.where("back > 14").drop("back"), 30)
    return _rounded(j.align_on_date(back.where("back <= 14"), forecast).select("series_key", "ds", "y", "yhat"), "yhat")


FOLDS = NUMBERED + """, fo AS (SELECT num.series_key, num.series_key || '-' || k AS fold, k AS split, ds, y, rn, len - k * 14 AS start, len - (k - 1) * 14 AS stop FROM num, range(1, 4) r(k) WHERE len - k * 14 >= 30),
tr AS (SELECT fold, ds, y FROM fo WHERE rn <= start), te AS (SELECT fold, ds, y FROM fo WHERE rn > start AND rn <= stop),
tb AS (SELECT fold, ds, y, row_number() OVER (PARTITION BY fold ORDER BY ds DESC) AS back, max(ds) OVER (PARTITION BY fold) AS last FROM tr),
sn AS (SELECT fold, last + CAST(i AS INT) AS ds, y AS yhat, y * 0.8 AS yhat_lower, y * 1.2 AS yhat_upper FROM tb, range(1, 15) r(i) WHERE back <= 7 AND (i - 1) % 7 = 7 - back)
""" + TREND.format(k="fold", source="tr", h=15)


def _rolling_sql(rounded: bool) -> str:
    both = [_metric_sql("fold", f, "te", "tr", f"'{name}' AS model,", rounded) for f, name in (("sn", "seasonal_naive"), ("tw", "trend_weekday"))]
    return FOLDS + ", ro AS (" + " UNION ALL ".join(both) + ")\n"


def _rolled(spark, d):
    return fc.rolling_origin(mcc_series(spark, d))


@query("rolling_origin", _rolling_sql(True) + "SELECT * FROM ro")
def _(spark, d):
    out = _rolled(spark, d).withColumn("fold", F.concat_ws("-", F.col("series_key").cast("string"), "split")).drop("series_key", "split")
    return _rounded(_rounded(out, *METRICS), "mase", digits=6)


@query("backtest_summary", _rolling_sql(False) + "SELECT model, " + ", ".join(
    f"round(avg({c}), 3) AS {c}_mean, round(stddev_samp({c}), 3) AS {c}_std" for c in ("mape", "smape", "mase", "mae", "rmse", "coverage")) + " FROM ro GROUP BY 1")
def _(spark, d):
    out = fc.backtest_summary(_rolled(spark, d))
    return _rounded(out, *[c for c in out.columns if c != "model"], digits=3)


DECOMPOSED = SERIES + """, cm AS (SELECT *, CASE WHEN count(*) OVER f = 7 THEN avg(y) OVER f END AS trend, isodow(ds) AS dow FROM s
  WINDOW f AS (PARTITION BY series_key ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
se AS (SELECT series_key, dow, avg(y - trend) AS seasonal FROM cm GROUP BY ALL),
dc AS (SELECT series_key, ds, y, trend, seasonal, y - trend - seasonal AS residual FROM cm JOIN se USING (series_key, dow)),
st AS (SELECT series_key, 1 - var_pop(residual) / var_pop(trend + residual) AS trend_strength, 1 - var_pop(residual) / var_pop(seasonal + residual) AS seasonal_strength
  FROM dc WHERE residual IS NOT NULL GROUP BY 1)
"""


@query("decompose", DECOMPOSED + f"SELECT series_key, {DAY}, y, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(residual, 3) AS residual FROM dc")
def _(spark, d):
    return _rounded(fc.decompose(mcc_series(spark, d)), "trend", "seasonal", "residual", digits=3)


@query("series_strengths", DECOMPOSED + "SELECT series_key, round(trend_strength, 6) AS trend_strength, round(seasonal_strength, 6) AS seasonal_strength FROM st")
def _(spark, d):
    return _rounded(fc.strengths(fc.decompose(mcc_series(spark, d))), "trend_strength", "seasonal_strength", digits=6)


def _ljung(lags: int) -> str:
    ks = range(1, lags + 1)
    return SERIES + f""", ce AS (SELECT series_key, ds, y - avg(y) OVER (PARTITION BY series_key) AS c FROM s),
lg AS (SELECT series_key, c, {', '.join(f'lag(c, {k}) OVER w AS l{k}' for k in ks)} FROM ce WINDOW w AS (PARTITION BY series_key ORDER BY ds)),
sm AS (SELECT series_key, count(*) AS n, sum(c * c) AS s0, {', '.join(f'sum(c * l{k}) AS s{k}' for k in ks)} FROM lg GROUP BY 1),
q AS (SELECT series_key, n, CAST(n AS DOUBLE) * (n + 2) * ({' + '.join(f'(s{k} / s0) ** 2 / (n - {k})' for k in ks)}) AS q FROM sm)
"""


@query("ljung_box", _ljung(10) + """SELECT series_key, n, round(q, 4) AS statistic, round(exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24), 6) AS p_value,
  CASE WHEN exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24) < 0.05 THEN 1 ELSE 0 END AS autocorrelated FROM q""")
def _(spark, d):
    return _rounded(_rounded(fc.ljung_box(mcc_series(spark, d), 10), "statistic"), "p_value", digits=6)


@query("ljung_box_odd", _ljung(7) + """, pv AS (SELECT *, CASE WHEN q > 300 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 600), lambda i: exp((3.5 + i) * ln(q / 2) - q / 2 - lgamma(4.5 + i)))) END AS p FROM q)
SELECT series_key, n, round(q, 4) AS statistic, round(greatest(p, 0), 6) AS p_value, CASE WHEN p < 0.05 THEN 1 ELSE 0 END AS autocorrelated FROM pv""")
def _(spark, d):
    return _rounded(_rounded(fc.ljung_box(mcc_series(spark, d), 7), "statistic"), "p_value", digits=6)


@query("diagnose_series", DECOMPOSED + """, iq AS (SELECT series_key, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM s GROUP BY 1),
an AS (SELECT s.series_key, CAST(count(*) FILTER (y < q1 - (q3 - q1) OR y > q3 + (q3 - q1)) AS DOUBLE) / count(*) * 100 AS anomaly_rate,
    coalesce(string_agg(CAST(ds AS VARCHAR), ',' ORDER BY ds) FILTER (y < q1 - (q3 - q1) OR y > q3 + (q3 - q1)), '') AS anomaly_dates FROM s JOIN iq USING (series_key) GROUP BY 1)
SELECT s.series_key, count(*) AS length, 0 AS missing, round(CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / count(*), 3) AS mean, round(stddev_samp(y), 3) AS std, round(stddev_samp(y) / avg(y), 6) AS cv,
  round(any_value(trend_strength), 6) AS trend_strength, round(any_value(seasonal_strength), 6) AS seasonal_strength, any_value(anomaly_rate) AS anomaly_rate,
  any_value(anomaly_dates) AS anomaly_dates FROM s JOIN st USING (series_key) JOIN an USING (series_key) GROUP BY s.series_key""")
def _(spark, d):
    out = fc.diagnose_series(mcc_series(spark, d), k=1.0, places=2)
    return _rounded(_rounded(out, "mean", "std", digits=3), "cv", "trend_strength", "seasonal_strength", digits=6)


LEAVES = TXN + """, da AS (SELECT transaction_date AS ds, mcc, merchant_id AS merchant_key, CAST(sum(amount) AS DOUBLE) AS y FROM txn GROUP BY ALL),
tp AS (SELECT mcc FROM da GROUP BY mcc ORDER BY sum(y) DESC, mcc LIMIT 5), kp AS (SELECT ds, CASE WHEN mcc IN (SELECT mcc FROM tp) THEN CAST(mcc AS VARCHAR) ELSE '__OTHER__' END AS mcc, merchant_key, y FROM da),
tt AS (SELECT mcc, merchant_key, sum(y) AS v, row_number() OVER (PARTITION BY mcc ORDER BY sum(y) DESC, merchant_key) AS r FROM kp WHERE mcc <> '__OTHER__' GROUP BY mcc, merchant_key),
cs AS (SELECT *, sum(v) OVER (PARTITION BY mcc ORDER BY r) / sum(v) OVER (PARTITION BY mcc) AS sh FROM tt),
ch AS (SELECT mcc, merchant_key FROM cs WHERE (sh <= 0.3 OR r = 1) AND r <= 12),
se AS (SELECT kp.mcc, kp.merchant_key, ds, y FROM kp JOIN ch USING (mcc, merchant_key)),
ot AS (SELECT a.mcc, '__OTHER__' AS merchant_key, a.ds, greatest(a.y - coalesce(c, 0), 0) AS y FROM (SELECT mcc, ds, sum(y) AS y FROM kp GROUP BY ALL) a
  LEFT JOIN (SELECT mcc, ds, sum(y) AS c FROM se GROUP BY ALL) b ON a.mcc = b.mcc AND a.ds = b.ds),
lf AS (SELECT * FROM se UNION ALL SELECT * FROM ot)
"""


def _leaves(spark, d):
    daily = transactions(spark, d, "transaction_date", "mcc", "merchant_id", "amount_uzs").groupBy(
        F.col("transaction_date").alias("ds"), "mcc", F.col("merchant_id").alias("merchant_key")).agg(F.sum("amount_uzs").cast("double").alias("y"))
    return fc.select_series(daily, 0.3, 12, 5)


@query("select_series", LEAVES + f"SELECT mcc, merchant_key, {DAY}, round(y, 3) AS y FROM lf")
def _(spark, d):
    return _rounded(_leaves(spark, d), "y", digits=3)


@query("hierarchical_forecast", LEAVES + """, nb AS (SELECT *, row_number() OVER (PARTITION BY mcc, merchant_key ORDER BY ds DESC) AS back, max(ds) OVER (PARTITION BY mcc, merchant_key) AS last FROM lf),
f AS (SELECT CAST(mcc AS VARCHAR) AS mcc, merchant_key, last + CAST(i AS INT) AS ds, v AS yhat FROM (SELECT mcc, merchant_key, last, avg(y) AS v FROM nb WHERE back <= 7 GROUP BY ALL), range(1, 8) r(i)),
u AS (SELECT 'merchant' AS level, * FROM f UNION ALL SELECT 'mcc', mcc, '', ds, sum(yhat) FROM f GROUP BY mcc, ds UNION ALL SELECT 'total', '', '', ds, sum(yhat) FROM f GROUP BY ds)
SELECT level, mcc, merchant_key, CAST(ds AS VARCHAR) AS ds, round(yhat, 3) AS yhat FROM u""")
def _(spark, d):
    return _rounded(fc.hierarchical_forecast(_leaves(spark, d), 7), "yhat", digits=3)


@query("top_down", SERIES + """, tot AS (SELECT ds, sum(y) AS y, row_number() OVER (ORDER BY ds DESC) AS back FROM s GROUP BY ds), lv AS (SELECT avg(y) AS v, max(ds) AS last FROM tot WHERE back <= 7),
sh AS (SELECT series_key AS mcc, sum(y) / (SELECT sum(y) FROM s) AS share FROM s GROUP BY 1)
SELECT mcc, CAST(last + CAST(i AS INT) AS VARCHAR) AS ds, round(v * share, 3) AS yhat, round(share, 8) AS share FROM lv, sh, range(1, 11) r(i)""")
def _(spark, d):
    series = mcc_series(spark, d)
    total = m.daily_series(transactions(spark, d, "transaction_date", "amount_uzs")).withColumn("series_key", F.lit("total"))
    out = fc.top_down(fc.ma7_forecast(total, 10), series.withColumnRenamed("series_key", "mcc"))
    return _rounded(_rounded(out, "yhat", digits=3), "share", digits=8)
