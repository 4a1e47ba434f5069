"""Report queries, checked against unions of the component SQL."""
from pyspark.sql import functions as F

from cardlens.operators import quality as q
from cardlens.plans import reports as r
from cardlens.plans.metrics_queries import _split_sql, _top
from cardlens.plans.quality_queries import BUSINESS, BUSINESS_NAMES, RULES_SQL, typed
from cardlens.plans.registry import DIRTY, SQL, TXN, query
from cardlens.sources.model import last_day, transactions, transactions_dirty

REPORT_NAMES = ["transaction_date", "amount_uzs", "p2p_flag", "mcc", "merchant_name", "hour_num"]
DECILES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


@query("weekly_report", TXN + f""", p AS (SELECT txn.*, CASE WHEN transaction_date > d - 365 THEN 'c' ELSE 'p' END AS w FROM txn, edge WHERE transaction_date > d - 730),
k AS (SELECT w, CAST(sum(amount) AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS n, round(CAST(sum(p2p_flag) AS DOUBLE) / count(*) * 100, 2) AS s FROM p GROUP BY w),
kk AS (SELECT a.v AS vc, b.v AS vp, a.n AS nc, b.n AS np, a.s AS sc, b.s AS sp FROM k a, k b WHERE a.w = 'c' AND b.w = 'p'),
ki AS (SELECT 'volume' AS metric, vc AS current, vp AS previous FROM kk UNION ALL SELECT 'transactions', nc, np FROM kk UNION ALL SELECT 'p2p_share', sc, sp FROM kk),
now AS (SELECT * FROM p WHERE w = 'c'),
mc AS (SELECT mcc, CAST(sum(amount) AS DOUBLE) AS v FROM now WHERE mcc > 0 GROUP BY 1 ORDER BY v DESC, mcc LIMIT 20),
me AS (SELECT merchant_name, CAST(sum(amount) AS DOUBLE) AS v FROM now GROUP BY 1 ORDER BY v DESC, merchant_name LIMIT 20),
qa AS (SELECT unnest(range(1, 10)) AS i, unnest(quantile_cont(CAST(amount AS DOUBLE), {DECILES})) AS x FROM now),
qb AS (SELECT unnest(range(1, 10)) AS i, unnest(quantile_cont(CAST(amount AS DOUBLE), {DECILES})) AS y FROM p WHERE w = 'p'),
sh AS (SELECT round(avg(abs(x - y) / y), 6) AS s FROM qa JOIN qb USING (i))
SELECT 'kpi' AS section, '' AS key, metric, current, previous, (current - previous) / previous * 100 AS change FROM ki
UNION ALL SELECT 'top_mcc', CAST(mcc AS VARCHAR), 'volume', v, NULL, NULL FROM mc
UNION ALL SELECT 'top_mcc', CAST(mcc AS VARCHAR), 'share_of_top', round(v / (SELECT sum(v) FROM mc) * 100, 4), NULL, NULL FROM mc
UNION ALL SELECT 'top_merchant', merchant_name, 'volume', v, NULL, NULL FROM me
UNION ALL SELECT 'hour', CAST(hour_num AS VARCHAR), 'volume', CAST(sum(amount) AS DOUBLE), NULL, NULL FROM now GROUP BY hour_num
UNION ALL SELECT 'fill_rate', f, 'fill_rate', 100, NULL, NULL FROM (SELECT unnest(['amount_uzs', 'mcc', 'merchant_name']) AS f)
UNION ALL SELECT 'drift', CASE WHEN s < 0.1 THEN 'stable' WHEN s < 0.25 THEN 'moderate' ELSE 'critical' END, 'quantile_shift', s, NULL, NULL FROM sh""")
def _(spark, d):
    return r.weekly_report(transactions(spark, d, *REPORT_NAMES), last_day(spark, d), 365)


DQ_NAMES = list(dict.fromkeys(rule.column for rule in q.TRANSACTION_RULES))


@query("dq_report", BUSINESS + ", rl AS (" + RULES_SQL.removeprefix(DIRTY) + """)
SELECT 'rule' AS part, "column" AS name, rule AS detail, violations AS count, NULL AS share FROM rl
UNION ALL SELECT 'check', "check", CAST(issue AS VARCHAR), violations, NULL FROM bc
""" + "".join(f" UNION ALL SELECT 'missing', '{c}', '', count(*) FILTER ({c} = ''), CAST(count(*) FILTER ({c} = '') AS DOUBLE) / count(*) FROM dirty" for c in DQ_NAMES))
def _(spark, d):
    return r.dq_report(transactions_dirty(spark, d, *DQ_NAMES), typed(spark, d, *BUSINESS_NAMES), "2000-06-01", 50000, 1)


def _melted(section: str, sql: str, key: str, metrics: list[str]) -> str:
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in metrics)
    return (f"SELECT '{section}' AS section, key, metric, value FROM (UNPIVOT (SELECT {key} AS key, {casts} FROM ({sql})) ON {', '.join(metrics)} "
            "INTO NAME metric VALUE value)")


TOP = ["transactions", "volume", "avg_amount", "cards", "share_transactions", "share_volume"]
SPLIT = ["transactions", "volume", "avg_amount", "share"]


@query("analysis_report", " UNION ALL ".join([
    _melted("general", SQL["general_stats"], "''", ["transactions", "volume", "min_amount", "max_amount", "avg_amount", "cards", "clients", "merchants"]),
    _melted("p2p", SQL["p2p_split"], "kind", SPLIT), _melted("mcc", _top("mcc", 10), "CAST(mcc AS VARCHAR)", TOP), _melted("bank", _top("emitent_bank", 10), "emitent_bank", TOP),
    _melted("region", _top("emitent_region", 10), "emitent_region", TOP), _melted("merchant", _top("merchant_name", 10), "merchant_name", TOP),
    _melted("hour", SQL["hour_profile"], "CAST(hour AS VARCHAR)", ["transactions", "volume", "avg_amount", "bar_share"]), _melted("gender", SQL["gender_split"], "gender", SPLIT),
    _melted("response", _top("respcode", 10), "respcode", TOP),
    _melted("fill", TXN + "SELECT unnest(['amount_uzs', 'mcc', 'merchant_name']) AS field, count(*) AS filled, count(*) AS total, 100 AS fill_rate FROM txn", "field", ["filled", "total", "fill_rate"])]))
def _(spark, d):
    return r.analysis_report(transactions(spark, d, "transaction_date", "amount_uzs", "hpan", "pinfl", "merchant_name", "p2p_flag", "gender", "hour_num", "mcc", "emitent_bank",
                                          "emitent_region", "respcode"))


@query("trend_report", TXN + """, w AS (SELECT CAST(date_trunc('week', transaction_date) AS DATE) AS week, CAST(sum(amount) AS DOUBLE) AS volume, count(*) AS transactions,
    CAST(sum(amount) AS DOUBLE) / count(*) AS avg_check FROM txn, edge WHERE transaction_date >= d - 140 GROUP BY 1 ORDER BY week DESC LIMIT 20)
SELECT CAST(week AS VARCHAR) AS week, volume, transactions, avg_check, (volume - lag(volume) OVER o) / lag(volume) OVER o * 100 AS volume_change,
  CAST(transactions - lag(transactions) OVER o AS DOUBLE) / lag(transactions) OVER o * 100 AS tx_change FROM w WINDOW o AS (ORDER BY week)""")
def _(spark, d):
    return r.trend_report(transactions(spark, d, "transaction_date", "amount_uzs", "hpan", "p2p_flag"), 20, last_day(spark, d))
