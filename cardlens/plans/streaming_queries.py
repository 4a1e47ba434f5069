"""Streaming jobs run to the end of their input, checked against the same rows in batch."""
from pyspark.sql import functions as F

from cardlens.plans.registry import DIRTY, TXN, query
from cardlens.sources import writers
from cardlens.sources.model import table, transactions, transactions_dirty
from cardlens.streaming import jobs

CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def event_stream(spark, d):
    """The events table as a stream of card payments."""
    raw = jobs.file_stream(spark, d, table(spark, d, "events").schema, "events.parquet")
    return raw.select(F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").alias("card"), F.col("value").alias("amount"),
                      F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_fraud"))


@query("stream_minute_metrics", f"""SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS transactions_per_minute, round(sum(value), 4) AS volume_per_minute,
  round(sum(value) / count(*), 4) AS avg_amount, count(*) FILTER (event_type = 'error') AS fraud_count, max(value) AS max_amount
FROM events GROUP BY date_trunc('minute', ts) HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {CLOSED}""")
def _(spark, d):
    path = writers.scratch(spark, "minutes")
    jobs.run_to_end(jobs.minute_metrics_stream(event_stream(spark, d)), path, writers.scratch(spark, "progress"))
    out = spark.read.parquet(path).drop("unique_cards")
    return out.withColumns({c: F.round(c, 4) for c in ("volume_per_minute", "avg_amount")})


@query("stream_velocity_alerts", f"""WITH e AS (SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM events),
w AS (SELECT user_id, b - CAST(i AS INT) * INTERVAL 5 MINUTE AS s FROM e, range(0, 12) r(i))
SELECT user_id AS card, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n
FROM w GROUP BY user_id, s HAVING count(*) > 1 AND s + INTERVAL 1 HOUR <= {CLOSED}""")
def _(spark, d):
    path = writers.scratch(spark, "alerts")
    jobs.run_to_end(jobs.velocity_alerts_stream(event_stream(spark, d), 1), path, writers.scratch(spark, "progress"), keyed_state=True)
    return spark.read.parquet(path)


@query("stream_trailing_velocity", f"""WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT user_id AS card, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS event_time, n AS events, CAST(k AS BIGINT) AS velocity_count
FROM w WHERE k > 1 AND (s // 60 + 1) * 60 < (SELECT epoch(c) FROM (SELECT {CLOSED} AS c))""")
def _(spark, d):
    path = writers.scratch(spark, "trailing")
    jobs.run_to_end(jobs.trailing_velocity_stream(event_stream(spark, d), 1), path, writers.scratch(spark, "progress"), keyed_state=True)
    return spark.read.parquet(path)


@query("stream_daily_rollup", TXN + """SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, mcc, CAST(sum(amount) AS DOUBLE) AS total_amount, count(*) AS transaction_count,
  CAST(sum(amount) AS DOUBLE) / count(*) AS avg_amount FROM txn GROUP BY ALL""")
def _(spark, d):
    source, path = writers.scratch(spark, "landed"), writers.scratch(spark, "rollup")
    landed = transactions(spark, d, "transaction_time", "mcc", "amount").withColumnRenamed("transaction_time", "event_time")
    landed.repartition(4, "mcc").write.parquet(source)
    stream = jobs.file_stream(spark, source, landed.schema, files_per_batch=2)
    jobs.daily_rollup_stream(stream, path, writers.scratch(spark, "progress"))
    return jobs.daily_rollup(spark, path)


@query("stream_ingest", DIRTY + """SELECT coalesce(TRY_CAST(regexp_extract(mcc, '(\\d+)', 1) AS INT), 0) AS mcc, count(*) AS n,
  CAST(sum(TRY_CAST(replace(amount_uzs, ',', '.') AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM dirty GROUP BY 1""")
def _(spark, d):
    source, path = writers.scratch(spark, "arriving"), writers.scratch(spark, "typed")
    raw = transactions_dirty(spark, d, "transaction_id", "mcc", "amount_uzs")
    writers.append(raw, source)
    writers.append(raw, source)
    jobs.run_to_end(jobs.ingest_stream(jobs.file_stream(spark, source, raw.schema)), path, writers.scratch(spark, "progress"))
    return spark.read.parquet(path).groupBy("mcc").agg(F.count("*").alias("n"), F.sum("amount_uzs").alias("volume"))
