"""Metric queries on the canonical frame."""
from pyspark.sql import functions as F

from cardlens.functions.distributed import heaviest_value, top_values
from cardlens.operators import metrics as m
from cardlens.operators import sketches as sk
from cardlens.plans.registry import TXN, on_nulled, query, with_missing
from cardlens.sources.model import last_day, transactions

AMOUNTS = "CAST(sum(amount) AS DOUBLE)"
MEAN = "CAST(sum(amount) AS DOUBLE) / count(amount)"
FRAUD_RATE = "CAST(count(*) FILTER (is_fraud = 1) AS DOUBLE) / count(*) * 100"
LONG_AGO, LATE = "1999-01-01", "1999-12-31"


@query("daily_metrics", TXN + f""", top AS (
  SELECT transaction_date, company_id, string_agg(mcc_code, ',' ORDER BY n DESC, mcc_code) AS codes FROM (
    SELECT transaction_date, company_id, mcc_code, count(*) AS n,
      row_number() OVER (PARTITION BY transaction_date, company_id ORDER BY count(*) DESC, mcc_code) AS r
    FROM txn GROUP BY transaction_date, company_id, mcc_code) WHERE r <= 5 GROUP BY transaction_date, company_id)
SELECT CAST(t.transaction_date AS VARCHAR) AS transaction_date, t.company_id, count(*) AS transaction_count,
  {AMOUNTS} AS total_volume, {MEAN} AS avg_amount, quantile_cont(CAST(amount AS DOUBLE), 0.5) AS median_amount,
  count(DISTINCT card_masked) AS unique_cards, count(DISTINCT merchant_id) AS unique_merchants,
  count(*) FILTER (is_fraud = 1) AS fraud_count, coalesce(CAST(sum(amount) FILTER (is_fraud = 1) AS DOUBLE), 0) AS fraud_volume,
  {FRAUD_RATE} AS fraud_rate, any_value(codes) AS top_mcc_codes,
  CAST(max(amount) AS DOUBLE) AS max_transaction, CAST(min(amount) AS DOUBLE) AS min_transaction
FROM txn t JOIN top USING (transaction_date, company_id) GROUP BY ALL""")
def _(spark, d):
    return m.daily_metrics(transactions(spark, d, "transaction_date", "company_id", "amount", "card_masked", "merchant_id",
                                        "is_fraud", "mcc_code"))


@query("daily_metrics_filtered", TXN + f""", sel AS (
  SELECT * FROM txn WHERE company_id = 'ASIA' AND transaction_date BETWEEN DATE '{LONG_AGO}' AND DATE '{LATE}'),
top AS (
  SELECT transaction_date, string_agg(mcc_code, ',' ORDER BY n DESC, mcc_code) AS codes FROM (
    SELECT transaction_date, mcc_code, count(*) AS n,
      row_number() OVER (PARTITION BY transaction_date ORDER BY count(*) DESC, mcc_code) AS r
    FROM sel GROUP BY transaction_date, mcc_code) WHERE r <= 5 GROUP BY transaction_date)
SELECT CAST(t.transaction_date AS VARCHAR) AS transaction_date, t.company_id, count(*) AS transaction_count,
  {AMOUNTS} AS total_volume, {MEAN} AS avg_amount, quantile_cont(CAST(amount AS DOUBLE), 0.5) AS median_amount,
  count(DISTINCT card_masked) AS unique_cards, count(DISTINCT merchant_id) AS unique_merchants,
  count(*) FILTER (is_fraud = 1) AS fraud_count, coalesce(CAST(sum(amount) FILTER (is_fraud = 1) AS DOUBLE), 0) AS fraud_volume,
  {FRAUD_RATE} AS fraud_rate, any_value(codes) AS top_mcc_codes,
  CAST(max(amount) AS DOUBLE) AS max_transaction, CAST(min(amount) AS DOUBLE) AS min_transaction
FROM sel t JOIN top USING (transaction_date) GROUP BY ALL""")
def _(spark, d):
    return m.daily_metrics(transactions(spark, d, "transaction_date", "company_id", "amount", "card_masked", "merchant_id",
                                        "is_fraud", "mcc_code"), company="ASIA", date_from=LONG_AGO, date_to=LATE)


@query("minute_metrics", TXN + f"""
SELECT strftime(date_trunc('minute', transaction_time), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS transactions_per_minute,
  {AMOUNTS} AS volume_per_minute, {MEAN} AS avg_amount, count(DISTINCT card_masked) AS unique_cards,
  count(*) FILTER (is_fraud = 1) AS fraud_count, CAST(max(amount) AS DOUBLE) AS max_amount
FROM txn WHERE transaction_time >= (SELECT max(transaction_time) FROM txn) - INTERVAL 10080 MINUTE GROUP BY 1""")
def _(spark, d):
    now = transactions(spark, d, "transaction_time").agg(F.max("transaction_time")).scalar()
    return m.minute_metrics(transactions(spark, d, "transaction_time", "amount", "card_masked", "is_fraud"), 10080, now=now)


@query("fraud_summary", TXN + f"""
SELECT count(*) AS total_transactions, count(*) FILTER (is_fraud = 1) AS fraud_transactions, {FRAUD_RATE} AS fraud_rate,
  CAST(sum(amount) FILTER (is_fraud = 1) AS DOUBLE) AS fraud_volume,
  CAST(sum(amount) FILTER (is_fraud = 1) AS DOUBLE) / count(*) FILTER (is_fraud = 1) AS avg_fraud_amount,
  CAST(sum(amount) FILTER (is_fraud = 0) AS DOUBLE) / count(*) FILTER (is_fraud = 0) AS avg_normal_amount
FROM txn WHERE transaction_date BETWEEN DATE '{LONG_AGO}' AND DATE '{LATE}'""")
def _(spark, d):
    return m.fraud_summary(transactions(spark, d, "transaction_date", "amount", "is_fraud"), LONG_AGO, LATE)


@query("fraud_by_mcc", TXN + f"""
SELECT mcc_code, mcc_description, count(*) AS total_count, count(*) FILTER (is_fraud = 1) AS fraud_count, {FRAUD_RATE} AS fraud_rate
FROM txn GROUP BY ALL HAVING count(*) FILTER (is_fraud = 1) > 0 ORDER BY fraud_rate DESC, mcc_code, mcc_description LIMIT 10""")
def _(spark, d):
    return m.fraud_by_mcc(transactions(spark, d, "transaction_date", "mcc_code", "mcc_description", "is_fraud"))


@query("fraud_by_hour", TXN + f"""
SELECT hour(transaction_time) AS hour, count(*) FILTER (is_fraud = 1) AS fraud_count, count(*) AS total_count,
  {FRAUD_RATE} AS fraud_rate FROM txn GROUP BY 1""")
def _(spark, d):
    return m.fraud_by_hour(transactions(spark, d, "transaction_time", "is_fraud"))


@query("decline_rate_by_hour", TXN + """
SELECT hour_num AS hour, count(*) AS total, count(*) FILTER (respcode NOT IN ('', '00', '0')) AS declined,
  CAST(count(*) FILTER (respcode NOT IN ('', '00', '0')) AS DOUBLE) / count(*) * 100 AS decline_rate FROM txn GROUP BY 1""")
def _(spark, d):
    return m.decline_rate_by_hour(transactions(spark, d, "hour_num", "respcode"))


COMPANY = f""", recent AS (SELECT txn.* FROM txn, edge WHERE transaction_date BETWEEN d - 30 AND d),
top AS (SELECT company_id, mcc_code AS top_mcc FROM (
  SELECT company_id, mcc_code, row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, mcc_code) AS r
  FROM recent GROUP BY company_id, mcc_code) WHERE r = 1),
cmp AS (SELECT company_id, count(*) AS total_transactions, {AMOUNTS} AS total_volume, {MEAN} AS avg_transaction,
  quantile_cont(CAST(amount AS DOUBLE), 0.5) AS median_transaction, count(DISTINCT card_masked) AS unique_cards,
  count(DISTINCT merchant_id) AS unique_merchants, {FRAUD_RATE} AS fraud_rate, any_value(top_mcc) AS top_mcc,
  CAST(max(amount) AS DOUBLE) AS max_transaction FROM recent JOIN top USING (company_id) GROUP BY company_id)
"""


def _comparison(spark, d):
    return m.company_comparison(transactions(spark, d, "transaction_date", "company_id", "amount", "card_masked",
                                             "merchant_id", "is_fraud", "mcc_code"), 30, as_of=last_day(spark, d))


@query("company_comparison", TXN + COMPANY + "SELECT * FROM cmp")
def _(spark, d):
    return _comparison(spark, d)


@query("company_radar", TXN + COMPANY + """
SELECT company_id, CAST(total_transactions AS DOUBLE) / max(total_transactions) OVER () * 100 AS transactions,
  total_volume / max(total_volume) OVER () * 100 AS volume,
  CAST(unique_cards AS DOUBLE) / max(unique_cards) OVER () * 100 AS cards,
  CAST(unique_merchants AS DOUBLE) / max(unique_merchants) OVER () * 100 AS merchants, 100 - fraud_rate AS security FROM cmp""")
def _(spark, d):
    return m.company_radar(_comparison(spark, d))


@query("merchant_analysis", TXN + f""", code AS (SELECT merchant_id, mcc_code AS top_code FROM (
  SELECT merchant_id, mcc_code, row_number() OVER (PARTITION BY merchant_id ORDER BY count(*) DESC, mcc_code) AS r
  FROM txn GROUP BY merchant_id, mcc_code) WHERE r = 1),
kind AS (SELECT merchant_id, mcc_description AS top_kind FROM (
  SELECT merchant_id, mcc_description, row_number() OVER (PARTITION BY merchant_id ORDER BY count(*) DESC, mcc_description) AS r
  FROM txn GROUP BY merchant_id, mcc_description) WHERE r = 1)
SELECT merchant_name, merchant_id, count(*) AS transaction_count, {AMOUNTS} AS total_volume, {MEAN} AS avg_amount,
  count(DISTINCT card_masked) AS unique_customers, count(DISTINCT transaction_date) AS active_days,
  count(*) FILTER (is_fraud = 1) AS fraud_count, any_value(top_code) AS mcc_code, any_value(top_kind) AS category
FROM txn JOIN code USING (merchant_id) JOIN kind USING (merchant_id)
GROUP BY merchant_name, merchant_id ORDER BY sum(amount) DESC, merchant_id LIMIT 20""")
def _(spark, d):
    return m.merchant_analysis(transactions(spark, d, "merchant_name", "merchant_id", "amount", "card_masked",
                                            "transaction_date", "is_fraud", "mcc_code", "mcc_description"))


@query("cohort_analysis", TXN + f""", firsts AS (SELECT *, min(transaction_date) OVER (PARTITION BY card_masked) AS first FROM txn)
SELECT CAST(CAST(date_trunc('month', first) AS DATE) AS VARCHAR) AS cohort_month,
  CAST(CAST(date_trunc('month', transaction_date) AS DATE) AS VARCHAR) AS transaction_month,
  count(DISTINCT card_masked) AS cohort_size, {AMOUNTS} AS total_amount, {MEAN} AS avg_amount FROM firsts GROUP BY 1, 2""")
def _(spark, d):
    return m.cohort_analysis(transactions(spark, d, "card_masked", "transaction_date", "amount"))


@query("general_stats", TXN + f"""
SELECT count(*) AS transactions, {AMOUNTS} AS volume, CAST(min(amount) AS DOUBLE) AS min_amount,
  CAST(max(amount) AS DOUBLE) AS max_amount, {MEAN} AS avg_amount, count(DISTINCT hpan) AS cards,
  count(DISTINCT pinfl) AS clients, count(DISTINCT merchant_name) AS merchants FROM txn""")
def _(spark, d):
    return m.general_stats(transactions(spark, d, "amount_uzs", "hpan", "pinfl", "merchant_name"))


def _top(dim: str, n: int, measure: str = "volume") -> str:
    return TXN + f""", g AS (SELECT {dim}, count(*) AS transactions, {AMOUNTS} AS volume, {MEAN} AS avg_amount,
  count(DISTINCT hpan) AS cards, sum(amount) AS exact FROM txn WHERE {dim} IS NOT NULL AND CAST({dim} AS VARCHAR) <> '' GROUP BY {dim}),
s AS (SELECT sum(transactions) AS n, CAST(sum(exact) AS DOUBLE) AS v FROM g)
SELECT {dim}, transactions, volume, avg_amount, cards, CAST(transactions AS DOUBLE) / n * 100 AS share_transactions,
  volume / v * 100 AS share_volume FROM g, s ORDER BY {measure} DESC, {dim} LIMIT {n}"""


for _dim, _n, _measure in [("mcc", 10, "volume"), ("emitent_bank", 10, "volume"), ("emitent_region", 10, "transactions"),
                           ("merchant_name", 15, "volume"), ("hpan", 20, "volume"), ("respcode", 10, "transactions")]:
    @query(f"top_by_{_dim}", _top(_dim, _n, _measure))
    def _(spark, d, dim=_dim, n=_n, measure=_measure):
        return m.top_by(transactions(spark, d, *dict.fromkeys([dim, "amount_uzs", "hpan"])), dim, n, measure)


def _split_sql(key: str, name: str, where: str = "true") -> str:
    return TXN + f""", g AS (SELECT {key} AS {name}, count(*) AS transactions, {AMOUNTS} AS volume, {MEAN} AS avg_amount
  FROM txn WHERE {where} GROUP BY 1)
SELECT *, CAST(transactions AS DOUBLE) / sum(transactions) OVER () * 100 AS share FROM g"""


@query("p2p_split", _split_sql("CASE WHEN p2p_flag = 1 THEN 'P2P' ELSE 'Purchase' END", "kind"))
def _(spark, d):
    return m.p2p_split(transactions(spark, d, "p2p_flag", "amount_uzs"))


@query("gender_split", _split_sql("gender", "gender", "gender IN ('М', 'Ж')"))
def _(spark, d):
    return m.gender_split(transactions(spark, d, "gender", "amount_uzs"))


@query("hour_profile", TXN + f""", g AS (SELECT hour_num AS hour, count(*) AS transactions, {AMOUNTS} AS volume, {MEAN} AS avg_amount
  FROM txn GROUP BY 1) SELECT *, CAST(transactions AS DOUBLE) / max(transactions) OVER () * 100 AS bar_share FROM g""")
def _(spark, d):
    return m.hour_profile(transactions(spark, d, "hour_num", "amount_uzs"))


@query("monthly_activity", TXN + f"""
SELECT strftime(transaction_date, '%Y%m') AS month, count(*) AS transactions, {AMOUNTS} AS volume FROM txn GROUP BY 1""")
def _(spark, d):
    return m.monthly_activity(transactions(spark, d, "transaction_date", "amount_uzs"))


@query("p2p_share_by_hour", TXN + """
SELECT hour_num AS hour, count(*) AS transactions, count(*) FILTER (p2p_flag = 1) AS p2p_transactions,
  CAST(count(*) FILTER (p2p_flag = 1) AS DOUBLE) / count(*) * 100 AS p2p_share FROM txn GROUP BY 1""")
def _(spark, d):
    return m.p2p_share_by_hour(transactions(spark, d, "hour_num", "p2p_flag"))


for _metric, _expr in [("volume", AMOUNTS), ("transactions", "CAST(count(*) AS DOUBLE)"),
                       ("unique_cards", "CAST(count(DISTINCT hpan) AS DOUBLE)")]:
    @query(f"daily_series_{_metric}", TXN + f"SELECT CAST(transaction_date AS VARCHAR) AS ds, {_expr} AS y FROM txn GROUP BY transaction_date")
    def _(spark, d, metric=_metric):
        need = {"volume": ["amount_uzs"], "transactions": [], "unique_cards": ["hpan"]}[metric]
        return m.daily_series(transactions(spark, d, "transaction_date", *need), metric)


@query("weekly_trends", TXN + f"""
SELECT CAST(CAST(date_trunc('week', transaction_date) AS DATE) AS VARCHAR) AS week, {AMOUNTS} AS volume, count(*) AS transactions,
  {MEAN} AS avg_check, count(DISTINCT hpan) AS unique_cards,
  CAST(count(*) FILTER (p2p_flag = 1) AS DOUBLE) / count(*) * 100 AS p2p_share FROM txn GROUP BY 1""")
def _(spark, d):
    return m.weekly_trends(transactions(spark, d, "transaction_date", "amount_uzs", "hpan", "p2p_flag"))


@query("daily_mcc_rollup", TXN + f"""
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, mcc, {AMOUNTS} AS total_amount, count(*) AS transaction_count,
  {MEAN} AS avg_amount FROM txn GROUP BY ALL""")
def _(spark, d):
    return m.daily_mcc_rollup(transactions(spark, d, "transaction_date", "mcc", "amount_uzs"))


@query("amount_quantiles", TXN + """
SELECT CAST(p AS DOUBLE) AS prob, round(v, 4) AS value FROM (
  SELECT unnest([0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9]) AS p,
    unnest(quantile_cont(CAST(amount AS DOUBLE), [0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9])) AS v FROM txn)""")
def _(spark, d):
    probs = [0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9]
    return m.amount_quantiles(transactions(spark, d, "amount_uzs"), probs).withColumn("value", F.round("value", 4))


@query("period_kpi", TXN + f""", p AS (
  SELECT CASE WHEN transaction_date >= DATE '{LONG_AGO}' THEN 'c' ELSE 'p' END AS w, {AMOUNTS} AS v,
    CAST(count(*) AS DOUBLE) AS n, round(CAST(count(*) FILTER (p2p_flag = 1) AS DOUBLE) / count(*) * 100, 2) AS s
  FROM txn WHERE transaction_date BETWEEN DATE '1998-01-01' AND DATE '{LATE}' GROUP BY 1),
r AS (SELECT 'volume' AS metric, c.v AS current, q.v AS previous FROM p c, p q WHERE c.w = 'c' AND q.w = 'p'
  UNION ALL SELECT 'transactions', c.n, q.n FROM p c, p q WHERE c.w = 'c' AND q.w = 'p'
  UNION ALL SELECT 'p2p_share', c.s, q.s FROM p c, p q WHERE c.w = 'c' AND q.w = 'p')
SELECT *, (current - previous) / previous * 100 AS change_pct FROM r""")
def _(spark, d):
    return m.period_kpi(transactions(spark, d, "transaction_date", "amount_uzs", "p2p_flag"), LONG_AGO, LATE)


@query("period_volume_compare", TXN + f"""
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date,
  CASE WHEN transaction_date >= DATE '{LONG_AGO}' THEN 'Current' ELSE 'Baseline' END AS period, {AMOUNTS} AS volume
FROM txn WHERE transaction_date BETWEEN DATE '1998-01-01' AND DATE '{LATE}' GROUP BY ALL""")
def _(spark, d):
    return m.period_volume_compare(transactions(spark, d, "transaction_date", "amount_uzs"), ("1998-01-01", "1998-12-31"),
                                   (LONG_AGO, LATE))


@query("top_k_values", TXN + """, c AS (SELECT emitent_bank, mcc, count(*) AS n,
  row_number() OVER (PARTITION BY emitent_bank ORDER BY count(*) DESC, mcc) AS r FROM txn GROUP BY emitent_bank, mcc)
SELECT emitent_bank, string_agg(CAST(mcc AS VARCHAR), ',' ORDER BY r) AS top_mcc FROM c WHERE r <= 3 GROUP BY 1""")
def _(spark, d):
    return top_values(transactions(spark, d, "emitent_bank", "mcc"), ["emitent_bank"], "mcc", 3, "top_mcc")


@query("top_n_plus_other", TXN + f""", g AS (SELECT CAST(mcc AS VARCHAR) AS mcc, sum(amount) AS v,
  row_number() OVER (ORDER BY sum(amount) DESC, CAST(mcc AS VARCHAR)) AS r FROM txn GROUP BY 1),
o AS (SELECT CASE WHEN r <= 9 THEN mcc ELSE 'OTHER' END AS mcc, CAST(sum(v) AS DOUBLE) AS volume FROM g GROUP BY 1)
SELECT mcc, volume, volume / (SELECT CAST(sum(v) AS DOUBLE) FROM g) * 100 AS share FROM o""")
def _(spark, d):
    return m.top_n_plus_other(transactions(spark, d, "mcc", "amount_uzs"))


@query("heavy_value_per_key", TXN + """
SELECT merchant, mcc AS heavy_mcc, n AS heavy_mcc_count FROM (SELECT merchant, mcc, count(*) AS n,
  row_number() OVER (PARTITION BY merchant ORDER BY count(*) DESC, mcc) AS r FROM txn WHERE mcc > 0 GROUP BY merchant, mcc) WHERE r = 1""")
def _(spark, d):
    return heaviest_value(transactions(spark, d, "merchant", "mcc").where("mcc > 0"), ["merchant"], "mcc", "heavy_mcc")


@query("p2p_bank_flows", TXN + f"""
SELECT sender_bank, receiver_bank, count(*) AS transfers, {AMOUNTS} AS volume FROM txn WHERE p2p_flag = 1 GROUP BY ALL""")
def _(spark, d):
    return m.p2p_bank_flows(transactions(spark, d, "p2p_flag", "sender_bank", "receiver_bank", "amount_uzs"))


@query("share_of_total", TXN + f""", g AS (SELECT acquirer_bank, sum(amount) AS v FROM txn GROUP BY 1)
SELECT acquirer_bank, CAST(v AS DOUBLE) AS volume, CAST(v AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) * 100 AS share FROM g""")
def _(spark, d):
    groups = transactions(spark, d, "acquirer_bank", "amount_uzs").groupBy("acquirer_bank").agg(F.sum("amount_uzs").alias("volume"))
    return m.share_of_total(groups, "volume")


@query("rank_top", TXN + f"""
SELECT merchant_name, {AMOUNTS} AS volume, row_number() OVER (ORDER BY sum(amount) DESC, merchant_name) AS rank
FROM txn GROUP BY merchant_name ORDER BY rank LIMIT 25""")
def _(spark, d):
    return m.rank_top(transactions(spark, d, "merchant_name", "amount_uzs"), "merchant_name", 25)


# ---- missing keys ----------------------------------------------------------------------------------------------

@query("daily_metrics_null_company", on_nulled("daily_metrics").replace("ORDER BY count(*) DESC, mcc_code)", "ORDER BY count(*) DESC, mcc_code NULLS FIRST)")
       .replace("any_value(codes) AS", "coalesce(any_value(codes), '') AS"))
def _(spark, d):
    return m.daily_metrics(with_missing(transactions(spark, d, "transaction_date", "company_id", "amount", "card_masked", "merchant_id",
                                                     "is_fraud", "mcc_code", "merchant")))


@query("top_n_plus_other_null", on_nulled("top_n_plus_other").replace("ORDER BY sum(amount) DESC, CAST(mcc AS VARCHAR))", "ORDER BY sum(amount) DESC, CAST(mcc AS VARCHAR) NULLS FIRST)"))
def _(spark, d):
    return m.top_n_plus_other(with_missing(transactions(spark, d, "mcc", "amount_uzs", "merchant")))


SKETCHED = ["card_masked", "merchant_id"]


def _near(states, exact, keys):
    """Estimates beside exact counts: whether each is within five standard errors, and the exact values."""
    wide = sk.estimates(states).join(exact.select(*keys, *[F.col(f"unique_{c}").alias(f"_{c}") for c in SKETCHED]), keys)
    limit = 5 * sk.relative_error()
    return wide.withColumns({f"{c}_near": F.abs(F.col(f"unique_{c}") - F.col(f"_{c}")) <= F.greatest(F.lit(1.0), limit * F.col(f"_{c}")) for c in SKETCHED})


@query("sketch_states_merged", TXN + f"""SELECT company_id, count(*) AS transactions, {AMOUNTS} AS volume, CAST(max(amount) AS DOUBLE) AS largest,
  count(DISTINCT card_masked) AS cards, count(DISTINCT merchant_id) AS merchants, true AS card_masked_near, true AS merchant_id_near
FROM txn WHERE transaction_date BETWEEN DATE '{LONG_AGO}' - 1000 AND DATE '{LATE}' GROUP BY 1""")
def _(spark, d):
    df = transactions(spark, d, "transaction_date", "company_id", "card_masked", "merchant_id", "amount")
    begin = F.date_sub(F.lit(LONG_AGO).cast("date"), 1000)
    states = sk.daily_states(df, ["company_id"], SKETCHED)
    inside = df.where(F.col("transaction_date").between(begin, F.lit(LATE).cast("date")))
    merged = sk.merge_states(states.where(F.col("transaction_date") >= begin), ["company_id"], date_to=LATE)
    near = _near(merged, sk.exact_counts(inside, ["company_id"], SKETCHED), ["company_id"])
    return near.select("company_id", "transactions", "volume", "largest", F.col("_card_masked").alias("cards"), F.col("_merchant_id").alias("merchants"),
                       "card_masked_near", "merchant_id_near")


@query("sketch_states_rolling", TXN + f""", dd AS (SELECT DISTINCT transaction_date AS d FROM txn)
SELECT CAST(d AS VARCHAR) AS transaction_date, count(*) AS transactions, {AMOUNTS} AS volume, count(DISTINCT card_masked) AS cards, true AS card_masked_near
FROM dd JOIN txn ON transaction_date BETWEEN d - 6 AND d GROUP BY d""")
def _(spark, d):
    df = transactions(spark, d, "transaction_date", "card_masked", "merchant_id", "amount")
    rolled = sk.rolling_states(sk.daily_states(df, [], SKETCHED), [], 7)
    exact = sk.exact_counts(df, [], SKETCHED, day="transaction_date", days=7)
    return _near(rolled, exact, ["transaction_date"]).select("transaction_date", "transactions", "volume", F.col("_card_masked").alias("cards"), "card_masked_near")
