"""Windows, set operations, joins, card and graph features, segments."""
import uuid

from pyspark.sql import functions as F

from cardlens.operators import features as f
from cardlens.operators import joins as j
from cardlens.operators import metrics as m
from cardlens.operators import segments as s
from cardlens.operators import setops as k
from cardlens.operators import windows as w
from cardlens.plans.registry import DIRTY, SQL, TXN, on_nulled, query, with_missing
from cardlens.sources.model import last_day, transactions, transactions_dirty
from cardlens.sources.writers import scratch, stored

CARD_COLUMNS = ["hpan", "transaction_date", "amount_uzs", "p2p_flag", "mcc", "merchant_name", "hour_num"]
HORIZONS = (30, 90, 365)
TIME = "strftime(transaction_time, '%Y-%m-%d %H:%M:%S')"


def _feat(days: tuple) -> str:
    parts = []
    for label, n in zip(("7d", "30d", "90d"), days):
        on = f"transaction_date >= d - {n}"
        parts.append(f"""count(*) FILTER ({on}) AS txn_count_{label},
    coalesce(CAST(sum(amount) FILTER ({on}) AS DOUBLE), 0) AS txn_amount_{label},
    CASE WHEN count(*) FILTER ({on}) = 0 THEN 0 ELSE CAST(sum(amount) FILTER ({on}) AS DOUBLE) / count(*) FILTER ({on}) END
      AS avg_txn_amount_{label}""")
    p2p = f"p2p_flag = 1 AND transaction_date >= d - {days[1]}"
    return f""", feat AS (SELECT hpan, any_value(CAST(d AS VARCHAR)) AS calculation_date, {', '.join(parts)},
    count(*) FILTER ({p2p}) AS p2p_count_30d, coalesce(CAST(sum(amount) FILTER ({p2p}) AS DOUBLE), 0) AS p2p_amount_30d,
    count(DISTINCT mcc) FILTER (transaction_date >= d - {days[0]}) AS unique_mcc_7d,
    count(DISTINCT mcc) FILTER (transaction_date >= d - {days[1]}) AS unique_mcc_30d,
    count(DISTINCT merchant_name) FILTER (transaction_date >= d - {days[1]}) AS unique_merchants_30d,
    CAST(sum(hour_num) AS DOUBLE) / count(*) AS avg_hour,
    CAST(count(*) FILTER (isodow(transaction_date) >= 6) AS DOUBLE) / count(*) AS weekend_ratio,
    CAST(count(*) FILTER (hour_num >= 22 OR hour_num <= 6) AS DOUBLE) / count(*) AS night_txn_ratio,
    CAST(count(*) AS DOUBLE) / count(DISTINCT transaction_date) AS avg_daily_txn_count, count(*) AS total_txn_count,
    any_value(d) - max(transaction_date) AS days_since_last_txn,
    CAST(count(*) FILTER ({p2p}) AS DOUBLE) / greatest(count(*) FILTER (transaction_date >= d - {days[1]}), 1) AS p2p_ratio_30d,
    CAST(round_even(CAST(count(*) AS DOUBLE) / count(DISTINCT transaction_date), 0) AS BIGINT) AS max_daily_txn_count
  FROM txn, edge WHERE transaction_date BETWEEN d - {days[2]} AND d GROUP BY hpan HAVING count(*) >= 5)
"""


FEAT = TXN + _feat(HORIZONS)
RFM = FEAT + """, act AS (SELECT *, row_number() OVER (ORDER BY txn_count_30d, hpan) AS fr,
    row_number() OVER (ORDER BY txn_amount_30d, hpan) AS mr FROM feat WHERE txn_count_30d > 0),
n AS (SELECT count(*) AS n, quantile_cont(CAST(days_since_last_txn AS DOUBLE), 0.25) AS q1,
    quantile_cont(CAST(days_since_last_txn AS DOUBLE), 0.5) AS q2, quantile_cont(CAST(days_since_last_txn AS DOUBLE), 0.75) AS q3 FROM act),
sc AS (SELECT act.*, CASE WHEN days_since_last_txn <= q1 THEN 4 WHEN days_since_last_txn <= q2 THEN 3
    WHEN days_since_last_txn <= q3 THEN 2 ELSE 1 END AS R_score,
    CASE WHEN fr <= 1 + (n - 1) * 0.25 THEN 1 WHEN fr <= 1 + (n - 1) * 0.5 THEN 2 WHEN fr <= 1 + (n - 1) * 0.75 THEN 3 ELSE 4 END AS F_score,
    CASE WHEN mr <= 1 + (n - 1) * 0.25 THEN 1 WHEN mr <= 1 + (n - 1) * 0.5 THEN 2 WHEN mr <= 1 + (n - 1) * 0.75 THEN 3 ELSE 4 END AS M_score
  FROM act, n),
rfm AS (SELECT hpan, R_score, F_score, M_score, CAST(R_score AS VARCHAR) || F_score || M_score AS rfm_score,
    CASE WHEN R_score >= 3 AND F_score >= 3 AND M_score >= 3 THEN 'Champions' WHEN R_score >= 3 AND F_score >= 2 AND M_score >= 2 THEN 'Loyal'
    WHEN R_score >= 3 THEN 'Potential' WHEN R_score >= 2 AND F_score >= 3 THEN 'At Risk' WHEN R_score >= 2 THEN 'Hibernating'
    ELSE 'Lost' END AS rfm_segment FROM sc)
"""
BEHAVIOUR = FEAT + """, q AS (SELECT quantile_cont(txn_amount_30d, 0.25) AS q1, quantile_cont(txn_amount_30d, 0.5) AS q2,
    quantile_cont(txn_amount_30d, 0.75) AS q3 FROM feat),
b AS (SELECT feat.*, CASE WHEN days_since_last_txn <= 7 THEN 'Active' WHEN days_since_last_txn <= 30 THEN 'Regular'
    WHEN days_since_last_txn <= 90 THEN 'Sleeping' ELSE 'Lost' END AS recency_score,
    CASE WHEN txn_count_30d <= 5 THEN 'Low' WHEN txn_count_30d <= 15 THEN 'Medium' WHEN txn_count_30d <= 50 THEN 'High' ELSE 'VeryHigh' END AS frequency_score,
    CASE WHEN txn_amount_30d <= q1 THEN 'Low' WHEN txn_amount_30d <= q2 THEN 'Medium' WHEN txn_amount_30d <= q3 THEN 'High' ELSE 'Premium' END AS monetary_score
  FROM feat, q),
seg AS (SELECT *, CASE WHEN recency_score = 'Active' AND monetary_score IN ('High', 'Premium') THEN 'Champions'
    WHEN recency_score = 'Active' AND frequency_score IN ('High', 'VeryHigh') THEN 'Loyal'
    WHEN recency_score = 'Regular' THEN 'Potential' WHEN recency_score = 'Sleeping' THEN 'At Risk' ELSE 'Lost' END AS customer_segment FROM b)
"""
EDGES = TXN + """, win AS (SELECT txn.*, d - 364 AS window_start, d AS window_end FROM txn, edge WHERE transaction_date BETWEEN d - 364 AND d),
e AS (SELECT hpan, merchant_id AS merchant_key, window_start, window_end, count(*) AS n, sum(fraud_proxy) AS fraud, sum(amount) AS amount,
    max(amount) AS max_amount FROM win GROUP BY ALL),
mg AS (SELECT merchant_key, window_start, window_end, count(*) AS degree_cards_90d, sum(n) AS txn_count_90d,
    CAST(sum(fraud) AS DOUBLE) / sum(n) AS fraud_ratio_90d FROM e GROUP BY ALL),
cg AS (SELECT hpan, e.window_start, e.window_end, count(*) AS degree_merchants_90d, sum(n) AS txn_count_90d,
    CAST(sum(amount) AS DOUBLE) / sum(n) AS avg_amount_90d, CAST(max(max_amount) AS DOUBLE) AS max_amount_90d,
    count(*) FILTER (fraud_ratio_90d > 0) AS neighbor_fraud_merchants_90d,
    CAST(count(*) FILTER (fraud_ratio_90d > 0) AS DOUBLE) / count(*) AS neighbor_fraud_ratio_90d,
    coalesce(sum(n) FILTER (fraud_ratio_90d > 0), 0) AS neighbor_fraud_txn_90d,
    CAST(coalesce(sum(n) FILTER (fraud_ratio_90d > 0), 0) AS DOUBLE) / count(*) AS neighbor_fraud_txn_ratio_90d
  FROM e JOIN mg USING (merchant_key) GROUP BY ALL)
"""
SEQUENCE = """, lagged AS (SELECT *, lag(transaction_date) OVER t AS prev_day, lag(amount) OVER t AS prev_amount,
    CAST(sum(amount) OVER (PARTITION BY hpan ORDER BY transaction_time, transaction_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS DOUBLE)
    / count(*) OVER (PARTITION BY hpan ORDER BY transaction_time, transaction_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean_ten,
    row_number() OVER (PARTITION BY hpan, transaction_date, hour_num ORDER BY transaction_time, transaction_id) AS txn_hour_count
  FROM txn WINDOW t AS (PARTITION BY hpan ORDER BY transaction_time, transaction_id)),
base AS (SELECT *, coalesce(transaction_date - prev_day, 999) AS days_since_prev_txn,
    coalesce(CAST(amount AS DOUBLE) / CASE WHEN prev_amount = 0 THEN 1 ELSE CAST(prev_amount AS DOUBLE) END, 1) AS amount_change_ratio,
    CAST(amount AS DOUBLE) / CASE WHEN mean_ten = 0 THEN 1 ELSE mean_ten END AS amount_deviation,
    CASE WHEN mcc IN (6010, 6011, 6012, 7995) THEN 1 ELSE 0 END AS is_risky_mcc,
    CASE WHEN isodow(transaction_date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN hour_num >= 22 OR hour_num <= 6 THEN 1 ELSE 0 END AS is_night,
    CASE WHEN emitent_region = 'NATION_0' THEN 1 ELSE 0 END AS is_capital FROM lagged)
"""
BASE_COLUMNS = ("transaction_id, hpan, CAST(transaction_date AS VARCHAR) AS transaction_date, fraud_proxy, "
                + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in f.BASE_FEATURES))


def cards(spark, d):
    return f.card_features(transactions(spark, d, *CARD_COLUMNS), as_of=last_day(spark, d), days=HORIZONS)


def edges(spark, d):
    return f.graph_edges(transactions(spark, d, "hpan", "merchant", "transaction_date", "fraud_proxy", "amount_uzs"), 365,
                         as_of=last_day(spark, d))


# ---- windows ---------------------------------------------------------------------------------------------------

@query("running_count", TXN + """
SELECT transaction_id, count(*) OVER (PARTITION BY card_masked, transaction_date ORDER BY transaction_time) AS running_count FROM txn""")
def _(spark, d):
    return w.running_count(transactions(spark, d, "transaction_id", "card_masked", "transaction_date", "transaction_time")
                           ).select("transaction_id", "running_count")


@query("running_count_null_card", on_nulled("running_count"))
def _(spark, d):
    names = ["transaction_id", "card_masked", "transaction_date", "transaction_time", "merchant"]
    return w.running_count(with_missing(transactions(spark, d, *names))).select("transaction_id", "running_count")


@query("velocity_count", TXN + """
SELECT transaction_id, count(*) OVER (PARTITION BY card_masked ORDER BY transaction_time
  RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS velocity_count FROM txn""")
def _(spark, d):
    return w.velocity_count(transactions(spark, d, "transaction_id", "card_masked", "transaction_time")
                            ).select("transaction_id", "velocity_count")


@query("velocity_count_week", TXN + """
SELECT transaction_id, count(*) OVER (PARTITION BY card_masked ORDER BY transaction_time
  RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS velocity_count FROM txn""")
def _(spark, d):
    return w.velocity_count(transactions(spark, d, "transaction_id", "card_masked", "transaction_time"), seconds=7 * 86400
                            ).select("transaction_id", "velocity_count")


@query("cohort_first_date", TXN + """
SELECT transaction_id, CAST(min(transaction_date) OVER (PARTITION BY card_masked) AS VARCHAR) AS first_date FROM txn""")
def _(spark, d):
    return w.cohort_first_date(transactions(spark, d, "transaction_id", "card_masked", "transaction_date")
                               ).select("transaction_id", "first_date")


@query("top_mcc_per_card", TXN + """, c AS (SELECT hpan, mcc, count(*) AS n,
    row_number() OVER (PARTITION BY hpan ORDER BY count(*) DESC, mcc) AS r FROM txn WHERE mcc > 0 GROUP BY hpan, mcc)
SELECT hpan, max(mcc) FILTER (r = 1) AS top_mcc, max(n) FILTER (r = 1) AS mcc_count,
  CAST(max(n) FILTER (r = 1) AS DOUBLE) / sum(n) AS top_mcc_ratio FROM c GROUP BY hpan""")
def _(spark, d):
    return w.top_mcc_per_card(transactions(spark, d, "hpan", "mcc"))


@query("sequence_features", TXN + SEQUENCE + """
SELECT transaction_id, days_since_prev_txn, CAST(prev_amount AS DOUBLE) AS prev_amount, amount_change_ratio,
  mean_ten AS card_avg_amount, amount_deviation, txn_hour_count FROM base""")
def _(spark, d):
    df = transactions(spark, d, "transaction_id", "hpan", "transaction_date", "transaction_time", "hour_num", "amount_uzs")
    return w.sequence_features(df).select("transaction_id", "days_since_prev_txn", "prev_amount", "amount_change_ratio",
                                          "card_avg_amount", "amount_deviation", "txn_hour_count")


SERIES = TXN + ", s AS (SELECT mcc AS series_key, transaction_date AS ds, CAST(sum(amount) AS DOUBLE) AS y FROM txn GROUP BY ALL)"


def mcc_series(spark, d):
    return transactions(spark, d, "mcc", "transaction_date", "amount_uzs").groupBy(
        F.col("mcc").alias("series_key"), F.col("transaction_date").alias("ds")).agg(F.sum("amount_uzs").cast("double").alias("y"))


@query("moving_average", SERIES + """
SELECT series_key, CAST(ds AS VARCHAR) AS ds, y, round(avg(y) OVER (PARTITION BY series_key ORDER BY ds
  ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS ma FROM s""")
def _(spark, d):
    return w.moving_average(mcc_series(spark, d)).withColumn("ma", F.round("ma", 4))


@query("centered_mean", SERIES + """, c AS (SELECT *, CASE WHEN count(*) OVER f = 7 THEN avg(y) OVER f END AS m FROM s
  WINDOW f AS (PARTITION BY series_key ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT series_key, CAST(ds AS VARCHAR) AS ds, y, round(m, 4) AS trend, round(y - m, 4) AS residual FROM c""")
def _(spark, d):
    return w.centered_mean(mcc_series(spark, d)).withColumns({"trend": F.round("trend", 4), "residual": F.round("residual", 4)})


@query("pct_change", TXN + """, wk AS (SELECT CAST(date_trunc('week', transaction_date) AS DATE) AS week,
    CAST(sum(amount) AS DOUBLE) AS volume FROM txn GROUP BY 1)
SELECT CAST(week AS VARCHAR) AS week, volume,
  round((volume - lag(volume) OVER (ORDER BY week)) / lag(volume) OVER (ORDER BY week) * 100, 4) AS vs_previous,
  round((volume - (SELECT median(volume) FROM wk)) / (SELECT median(volume) FROM wk) * 100, 4) AS vs_median,
  round((volume - (SELECT avg(volume) FROM wk)) / (SELECT avg(volume) FROM wk) * 100, 4) AS vs_mean FROM wk""")
def _(spark, d):
    weeks = transactions(spark, d, "transaction_date", "amount_uzs").groupBy(
        F.date_trunc("week", "transaction_date").cast("date").alias("week")).agg(F.sum("amount_uzs").cast("double").alias("volume"))
    for mode in ("previous", "median", "mean"):
        weeks = w.pct_change(weeks, "volume", mode, name=f"vs_{mode}").withColumn(f"vs_{mode}", F.round(f"vs_{mode}", 4))
    return weeks


@query("cumulative_share", TXN + """, g AS (SELECT mcc, merchant_name, sum(amount) AS v FROM txn GROUP BY ALL),
c AS (SELECT *, row_number() OVER o AS rank, CAST(sum(v) OVER (o ROWS UNBOUNDED PRECEDING) AS DOUBLE)
    / CAST(sum(v) OVER (PARTITION BY mcc) AS DOUBLE) AS cum_share FROM g WINDOW o AS (PARTITION BY mcc ORDER BY v DESC, merchant_name))
SELECT mcc, merchant_name, CAST(v AS DOUBLE) AS v, rank, cum_share FROM c WHERE (cum_share <= 0.5 OR rank = 1) AND rank <= 30""")
def _(spark, d):
    groups = transactions(spark, d, "mcc", "merchant_name", "amount_uzs").groupBy("mcc", "merchant_name").agg(F.sum("amount_uzs").alias("v"))
    return w.cumulative_share(groups, "mcc", "merchant_name", "v", 0.5, 30)


def _card_totals(spark, d):
    return transactions(spark, d, "hpan", "amount_uzs").groupBy("hpan").agg(
        F.sum("amount_uzs").alias("total"), F.count("*").alias("n"))


@query("quartile_score_value", TXN + """, c AS (SELECT hpan, CAST(sum(amount) AS DOUBLE) AS total FROM txn GROUP BY 1),
q AS (SELECT quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.5) AS b, quantile_cont(total, 0.75) AS c FROM c)
SELECT hpan, CASE WHEN total <= q.a THEN 1 WHEN total <= q.b THEN 2 WHEN total <= q.c THEN 3 ELSE 4 END AS score FROM c, q""")
def _(spark, d):
    return w.quartile_score(_card_totals(spark, d), "total", "score").select("hpan", "score")


@query("quartile_score_rank", TXN + """, c AS (SELECT hpan, count(*) AS k FROM txn GROUP BY 1),
r AS (SELECT hpan, row_number() OVER (ORDER BY k, hpan) AS r, count(*) OVER () AS n FROM c)
SELECT hpan, CASE WHEN r <= 1 + (n - 1) * 0.25 THEN 1 WHEN r <= 1 + (n - 1) * 0.5 THEN 2 WHEN r <= 1 + (n - 1) * 0.75 THEN 3 ELSE 4 END AS score
FROM r""")
def _(spark, d):
    return w.quartile_score(_card_totals(spark, d), "n", "score", mode="rank").select("hpan", "score")


# ---- ordering and sets -----------------------------------------------------------------------------------------

@query("order_limit", TXN + "SELECT transaction_id, CAST(amount AS DOUBLE) AS amount FROM txn ORDER BY txn.amount DESC, transaction_id LIMIT 50")
def _(spark, d):
    return k.order_limit(transactions(spark, d, "transaction_id", "amount"), [F.col("amount").desc(), "transaction_id"], 50)


@query("head_per_group", TXN + """SELECT hpan, transaction_id FROM txn
QUALIFY row_number() OVER (PARTITION BY hpan ORDER BY transaction_time, transaction_id) <= 10""")
def _(spark, d):
    return k.head_per_group(transactions(spark, d, "hpan", "transaction_id", "transaction_time"), "hpan",
                            ["transaction_time", "transaction_id"], 10).select("hpan", "transaction_id")


@query("dedup_keep_first", TXN + """SELECT transaction_code, transaction_id FROM txn
QUALIFY row_number() OVER (PARTITION BY transaction_code ORDER BY transaction_time, transaction_id) = 1""")
def _(spark, d):
    return k.dedup_keep_first(transactions(spark, d, "transaction_code", "transaction_id", "transaction_time"),
                              ["transaction_code"], ["transaction_time", "transaction_id"]).select("transaction_code", "transaction_id")


@query("full_row_duplicates", TXN + """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
  SELECT hpan, mcc, hour_num, p2p_flag, count(*) AS n FROM txn GROUP BY ALL)""")
def _(spark, d):
    return k.full_row_duplicates(transactions(spark, d, "hpan", "mcc", "hour_num", "p2p_flag"))


@query("key_duplicates", TXN + """SELECT count(*) AS total, count(DISTINCT transaction_code) AS distinct_keys,
  count(*) - count(DISTINCT transaction_code) AS duplicates,
  CAST(count(*) - count(DISTINCT transaction_code) AS DOUBLE) / count(*) * 100 AS duplicate_pct FROM txn""")
def _(spark, d):
    return k.key_duplicates(transactions(spark, d, "transaction_code"), "transaction_code")


@query("union_all", TXN + """SELECT transaction_id, 'risky' AS kind FROM txn WHERE mcc IN (6011, 6012)
UNION ALL SELECT transaction_id, 'large' FROM txn WHERE amount > 90000""")
def _(spark, d):
    df = transactions(spark, d, "transaction_id", "mcc", "amount")
    return k.union_all([df.where(F.col("mcc").isin(6011, 6012)).select("transaction_id", F.lit("risky").alias("kind")),
                        df.where("amount > 90000").select("transaction_id", F.lit("large").alias("kind"))])


@query("distinct_values", TXN + "SELECT DISTINCT emitent_region FROM txn")
def _(spark, d):
    return k.distinct_values(transactions(spark, d, "emitent_region"), "emitent_region")


@query("threshold_split", TXN + """SELECT CASE WHEN transaction_date < d - 200 THEN 'train' ELSE 'holdout' END AS part, count(*) AS n,
  CAST(min(transaction_date) AS VARCHAR) AS first_day, CAST(max(transaction_date) AS VARCHAR) AS last_day FROM txn, edge GROUP BY 1""")
def _(spark, d):
    train, hold = k.threshold_split(transactions(spark, d, "transaction_date"), F.date_sub(last_day(spark, d), 200))
    both = k.union_all([train.withColumn("part", F.lit("train")), hold.withColumn("part", F.lit("holdout"))])
    return both.groupBy("part").agg(F.count("*").alias("n"), F.min("transaction_date").alias("first_day"),
                                    F.max("transaction_date").alias("last_day"))


# ---- features --------------------------------------------------------------------------------------------------

@query("card_features", FEAT + "SELECT * FROM feat")
def _(spark, d):
    return cards(spark, d)


@query("card_features_default_days", TXN + _feat((7, 30, 90)) + "SELECT * FROM feat")
def _(spark, d):
    return f.card_features(transactions(spark, d, *CARD_COLUMNS), as_of=last_day(spark, d))


@query("card_extremes", TXN + """, dl AS (SELECT hpan, transaction_date, count(*) AS n, sum(amount) AS a,
    count(*) FILTER (respcode NOT IN ('', '0', '00')) AS f, count(*) FILTER (reversal_flag = 1) AS r FROM txn GROUP BY ALL),
tm AS (SELECT hpan, merchant_name, n FROM (SELECT hpan, merchant_name, count(*) AS n,
    row_number() OVER (PARTITION BY hpan ORDER BY count(*) DESC, merchant_name) AS r FROM txn GROUP BY hpan, merchant_name) WHERE r = 1)
SELECT dl.hpan, max(dl.n) AS max_daily_txn_count, CAST(max(a) AS DOUBLE) AS max_daily_amount, sum(f) AS failed_txn_count,
  sum(r) AS reversal_count, 0 AS international_txn_count, any_value(merchant_name) AS top_merchant,
  CAST(any_value(tm.n) AS DOUBLE) / sum(dl.n) AS top_merchant_ratio FROM dl JOIN tm USING (hpan) GROUP BY dl.hpan""")
def _(spark, d):
    return f.card_extremes(transactions(spark, d, "hpan", "transaction_date", "amount_uzs", "respcode", "reversal_flag", "merchant_name"))


@query("card_feature_report", FEAT + """SELECT count(*) AS cards, round(avg(txn_count_30d), 4) AS avg_txn_count_30d,
  round(avg(txn_amount_30d), 4) AS avg_txn_amount_30d, round(avg(avg_txn_amount_30d), 4) AS avg_avg_txn_amount_30d,
  round(avg(p2p_ratio_30d), 4) AS avg_p2p_ratio_30d, round(avg(unique_mcc_30d), 4) AS avg_unique_mcc_30d,
  round(avg(days_since_last_txn), 4) AS avg_days_since_last_txn FROM feat""")
def _(spark, d):
    return f.card_feature_report(cards(spark, d))


@query("merchant_graph_features", EDGES + "SELECT * REPLACE (CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end) FROM mg")
def _(spark, d):
    return f.merchant_graph_features(edges(spark, d))


@query("card_graph_features", EDGES + "SELECT * REPLACE (CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end) FROM cg")
def _(spark, d):
    e = edges(spark, d)
    return f.card_graph_features(e, f.merchant_graph_features(e))


@query("latest_window", EDGES + """, mo AS (SELECT merchant_id, CAST(date_trunc('month', transaction_date) AS DATE) AS window_end, count(*) AS n FROM txn GROUP BY ALL)
SELECT merchant_id, CAST(window_end AS VARCHAR) AS window_end, n FROM mo WHERE window_end = (SELECT max(window_end) FROM mo)""")
def _(spark, d):
    monthly = transactions(spark, d, "merchant_id", "transaction_date").groupBy(
        "merchant_id", F.date_trunc("month", "transaction_date").cast("date").alias("window_end")).agg(F.count("*").alias("n"))
    return f.latest_window(monthly)


@query("txn_left_merchant_risk", EDGES + """SELECT hpan, merchant_key, n, coalesce(CASE WHEN degree_cards_90d > 3 THEN fraud_ratio_90d END, 0) AS merchant_risk
FROM e JOIN mg USING (merchant_key)""")
def _(spark, d):
    e = edges(spark, d)
    known = f.merchant_graph_features(e).where("degree_cards_90d > 3")
    return j.txn_left_merchant_risk(e, known).select("hpan", "merchant_key", "n", "merchant_risk")


FEATURE_SOURCE = ["transaction_id", "hpan", "merchant", "merchant_name", "mcc", "transaction_date", "transaction_time", "hour_num",
                  "amount_uzs", "p2p_flag", "emitent_region", "fraud_proxy"]


def feature_source(spark, d):
    """The transactions of the model features, joined once: the look for heavy cards and the windows read the written rows."""
    return stored(transactions(spark, d, *FEATURE_SOURCE), "transactions")


def model_features(spark, d):
    e = edges(spark, d)
    # Written one after the other: the shuffles of one are gone when the next begins, and their sizes are known to the joins.
    merchants = stored(f.merchant_graph_features(e), "merchants")
    graph = stored(f.card_graph_features(e, merchants), "card_graph")
    return f.fraud_features(feature_source(spark, d), stored(cards(spark, d), "cards"), graph, merchants)


@query("fraud_features", EDGES + _feat(HORIZONS) + SEQUENCE + f"""
SELECT {BASE_COLUMNS.replace('hpan,', 'base.hpan,').replace('CAST(amount_uzs', 'CAST(base.amount_uzs')},
  {', '.join(f'coalesce(CAST(feat.{c} AS DOUBLE), 0) AS {c}' for c in f.CARD_FEATURES)},
  {', '.join(f'coalesce(CAST(cg.{c} AS DOUBLE), 0) AS card_{c}' for c in f.CARD_GRAPH)},
  {', '.join(f'coalesce(CAST(mg.{c} AS DOUBLE), 0) AS merch_{c}' for c in f.MERCHANT_GRAPH)}
FROM base LEFT JOIN feat USING (hpan) LEFT JOIN cg USING (hpan) LEFT JOIN mg ON base.merchant_id = mg.merchant_key""")
def _(spark, d):
    return model_features(spark, d)


@query("fraud_features_stored", SQL["fraud_features"])
def _(spark, d):
    """The same rows from tables bucketed by card."""
    e = edges(spark, d)
    merchants = stored(f.merchant_graph_features(e), "merchants")
    run = uuid.uuid4().hex[:12]
    names = [f"{n}_{run}" for n in ("facts", "card_features", "card_graph")]
    tables = f.store_fraud_tables(feature_source(spark, d), cards(spark, d), f.card_graph_features(e, merchants), names, 16,
                                  [scratch(spark, n) for n in names])
    return f.fraud_features_stored(*tables, merchants)


@query("fraud_features_basic", TXN + SEQUENCE + f"SELECT {BASE_COLUMNS}, CAST(mcc AS DOUBLE) AS mcc FROM base")
def _(spark, d):
    return f.fraud_features_basic(transactions(spark, d, *FEATURE_SOURCE))


# ---- joins -----------------------------------------------------------------------------------------------------

def _segments(spark, d):
    return s.behaviour_segments(cards(spark, d)).select("hpan", "customer_segment")


@query("join_segments_features", BEHAVIOUR + """SELECT customer_segment, count(*) AS clients,
  round(avg(txn_count_30d), 4) AS avg_txn FROM seg GROUP BY 1""")
def _(spark, d):
    return j.join_segments_features(_segments(spark, d), cards(spark, d)).groupBy("customer_segment").agg(
        F.count("*").alias("clients"), F.round(F.avg("txn_count_30d"), 4).alias("avg_txn"))


@query("segments_left_features", BEHAVIOUR + """SELECT hpan, customer_segment, CASE WHEN txn_count_30d > 2 THEN txn_count_30d END AS txn_count_30d FROM seg""")
def _(spark, d):
    return j.segments_left_features(_segments(spark, d), cards(spark, d).where("txn_count_30d > 2").select("hpan", "txn_count_30d"))


@query("attach_graph_features", EDGES + f"""SELECT transaction_id,
  {', '.join(f'coalesce(CAST(cg.{c} AS DOUBLE), 0) AS card_{c}' for c in f.CARD_GRAPH)},
  {', '.join(f'coalesce(CAST(mg.{c} AS DOUBLE), 0) AS merch_{c}' for c in f.MERCHANT_GRAPH)}
FROM txn LEFT JOIN cg USING (hpan) LEFT JOIN mg ON txn.merchant_id = mg.merchant_key""")
def _(spark, d):
    e = edges(spark, d)
    merchants = f.merchant_graph_features(e)
    return j.attach_graph_features(transactions(spark, d, "transaction_id", "hpan", "merchant"),
                                   f.card_graph_features(e, merchants), merchants).drop("hpan", "merchant", "merchant_key")


@query("attach_graph_features_null_card", EDGES + """, n AS (SELECT *, CASE WHEN CAST(hpan AS BIGINT) % 10 <> 0 THEN hpan END AS card FROM txn),
g AS (SELECT CASE WHEN CAST(hpan AS BIGINT) % 10 <> 0 THEN hpan END AS card, sum(txn_count_90d) AS txn_count_90d, max(max_amount_90d) AS max_amount_90d FROM cg GROUP BY 1)
SELECT transaction_id, coalesce(CAST(g.txn_count_90d AS DOUBLE), 0) AS card_txn_count_90d, coalesce(CAST(g.max_amount_90d AS DOUBLE), 0) AS card_max_amount_90d
FROM n LEFT JOIN g ON n.card IS NOT DISTINCT FROM g.card""")
def _(spark, d):
    e = edges(spark, d)
    merchants = f.merchant_graph_features(e)
    card = F.when(F.col("hpan").cast("bigint") % 10 != 0, F.col("hpan"))
    graph = f.card_graph_features(e, merchants).groupBy(card.alias("hpan")).agg(
        F.sum("txn_count_90d").alias("txn_count_90d"), F.max("max_amount_90d").alias("max_amount_90d"),
        *[F.lit(0.0).alias(c) for c in f.CARD_GRAPH if c not in ("txn_count_90d", "max_amount_90d")])
    txn = transactions(spark, d, "transaction_id", "hpan", "merchant").withColumn("hpan", card)
    return j.attach_graph_features(txn, graph, merchants).select("transaction_id", "card_txn_count_90d", "card_max_amount_90d")


@query("join_card_features", FEAT + f"""SELECT transaction_id,
  {', '.join(f'coalesce(CAST(feat.{c} AS DOUBLE), 0) AS {c}' for c in f.CARD_FEATURES)} FROM txn LEFT JOIN feat USING (hpan)""")
def _(spark, d):
    return j.join_card_features(transactions(spark, d, "transaction_id", "hpan"), cards(spark, d)).drop("hpan")


MAPS = DIRTY + """, m1 AS (SELECT merchant, mcc FROM (SELECT CAST(merchant AS VARCHAR) AS merchant, mcc,
    row_number() OVER (PARTITION BY merchant ORDER BY count(*) DESC, mcc) AS r FROM txn WHERE amount >= 104000 GROUP BY merchant, mcc) WHERE r = 1),
m2 AS (SELECT merchant_name, mcc FROM (SELECT merchant_name, mcc, row_number() OVER (PARTITION BY merchant_name ORDER BY count(*) DESC, mcc) AS r
    FROM txn GROUP BY merchant_name, mcc) WHERE r = 1),
fixed AS (SELECT transaction_id, coalesce(m1.mcc, m2.mcc, TRY_CAST(nullif(regexp_extract(dirty.mcc, '(\\d+)', 1), '') AS INT), 0) AS mcc
  FROM dirty LEFT JOIN m1 ON dirty.merchant = m1.merchant LEFT JOIN m2 ON dirty.merchant_name = m2.merchant_name)
"""


def _repaired(spark, d):
    # Codes by id are known from the very large payments only, so most merchants fall back to the code of their name.
    trusted = transactions(spark, d, "merchant_id", "merchant_name", "mcc", "amount_uzs").withColumnRenamed("merchant_id", "merchant")
    by_id = j.mcc_map(trusted.where("amount_uzs >= 104000"), "merchant")
    by_name = j.mcc_map(trusted, "merchant_name")
    return j.apply_mcc_map(transactions_dirty(spark, d, "transaction_id", "merchant", "merchant_name", "mcc"), by_id, by_name)


@query("apply_mcc_map", MAPS + "SELECT * FROM fixed")
def _(spark, d):
    return _repaired(spark, d).select("transaction_id", "mcc")


@query("mcc_repair_summary", MAPS + """SELECT count(*) AS rows_total, count(*) FILTER (mcc = 0) AS rows_mcc_zero,
  count(*) FILTER (mcc > 0) AS rows_mcc_gt0, count(DISTINCT mcc) AS uniq_mcc, min(mcc) AS mcc_min, max(mcc) AS mcc_max FROM fixed""")
def _(spark, d):
    return m.mcc_repair_summary(_repaired(spark, d))


@query("cross_scalars", TXN + """SELECT transaction_id, CAST(amount AS DOUBLE) / (SELECT CAST(max(amount) AS DOUBLE) FROM txn) AS of_max,
  hour_num - (SELECT min(hour_num) FROM txn) AS over_min FROM txn""")
def _(spark, d):
    df = j.cross_scalars(transactions(spark, d, "transaction_id", "amount", "hour_num"), top=F.max("amount"), low=F.min("hour_num"))
    return df.select("transaction_id", (F.col("amount").cast("double") / F.col("top").cast("double")).alias("of_max"),
                     (F.col("hour_num") - F.col("low")).alias("over_min"))


@query("total_minus_selected", TXN + """, t AS (SELECT transaction_date AS ds, CAST(sum(amount) AS DOUBLE) AS y,
    coalesce(CAST(sum(amount) FILTER (mcc = 5411) AS DOUBLE), 0) AS c FROM txn GROUP BY 1)
SELECT CAST(ds AS VARCHAR) AS ds, round(greatest(y - c, 0), 4) AS y FROM t""")
def _(spark, d):
    df = transactions(spark, d, "transaction_date", "amount_uzs", "mcc")
    rest = j.total_minus_selected(m.daily_series(df), m.daily_series(df.where("mcc = 5411")))
    return rest.withColumn("y", F.round("y", 4))


# ---- segments --------------------------------------------------------------------------------------------------

@query("rfm_scores", RFM + "SELECT * FROM rfm")
def _(spark, d):
    return s.rfm_scores(cards(spark, d)).select("hpan", "R_score", "F_score", "M_score", "rfm_score", "rfm_segment")


@query("rf_heatmap", RFM + """SELECT rfm_score[1] AS R, count(*) FILTER (rfm_score[2] = '1') AS F1, count(*) FILTER (rfm_score[2] = '2') AS F2,
  count(*) FILTER (rfm_score[2] = '3') AS F3, count(*) FILTER (rfm_score[2] = '4') AS F4 FROM rfm GROUP BY 1""")
def _(spark, d):
    return m.rf_heatmap(s.rfm_scores(cards(spark, d)))


@query("behaviour_segments", BEHAVIOUR + """SELECT hpan, recency_score, frequency_score, monetary_score, customer_segment,
  frequency_score AS activity_level FROM seg""")
def _(spark, d):
    return s.behaviour_segments(cards(spark, d)).select("hpan", "recency_score", "frequency_score", "monetary_score",
                                                        "customer_segment", "activity_level")


@query("segment_summary", BEHAVIOUR + """SELECT customer_segment, count(*) AS clients, round(avg(txn_amount_30d), 2) AS avg_amount,
  round(avg(txn_count_30d), 4) AS avg_transactions, round(avg(days_since_last_txn), 4) AS avg_recency,
  round(avg(p2p_ratio_30d), 4) AS avg_p2p, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM seg) * 100 AS share FROM seg GROUP BY 1""")
def _(spark, d):
    return m.segment_summary(s.behaviour_segments(cards(spark, d)))


@query("kmeans_segments")
def _(spark, d):
    return s.kmeans_segments(cards(spark, d)).select("hpan", "kmeans_cluster")


@query("cluster_summary")
def _(spark, d):
    return m.cluster_summary(s.kmeans_segments(cards(spark, d)))


@query("choose_k")
def _(spark, d):
    return s.choose_k(cards(spark, d), 2, 4)
