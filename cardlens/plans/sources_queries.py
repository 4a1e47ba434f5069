"""Reading, writing, typing and scalar expressions."""
import uuid

from pyspark.sql import functions as F

from cardlens.functions import scalars as sc
from cardlens.plans.registry import DIRTY, TXN, query
from cardlens.sources import readers, typing, writers
from cardlens.sources.model import CAPITAL_REGION, RISKY_MCC, last_day, table, transactions, transactions_dirty

BY_MCC = TXN + "SELECT mcc, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM txn GROUP BY mcc"


def _by_mcc(df):
    return df.groupBy(F.col("mcc").cast("bigint").alias("mcc")).agg(
        F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("total"))


@query("read_csv_inferred", BY_MCC)
def _(spark, d):
    path = writers.scratch(spark, "typed")
    writers.export_csv(transactions(spark, d, "transaction_id", "mcc", "amount"), path)
    return _by_mcc(readers.read_csv_inferred(spark, path))


RAW = ["transaction_id", "merchant_name", "mcc", "amount_uzs", "respcode", "gender"]
RAW_SQL = DIRTY + """SELECT gender, count(*) AS n, count(*) FILTER (merchant_name = '') AS no_name, count(*) FILTER (mcc = '') AS no_mcc,
  count(*) FILTER (respcode = '') AS no_code, count(*) FILTER (amount_uzs = 'n/a') AS no_amount FROM dirty GROUP BY gender"""


def _raw_counts(df):
    empty = lambda c, v="": F.count_if(F.col(c) == v)
    return df.groupBy("gender").agg(F.count("*").alias("n"), empty("merchant_name").alias("no_name"), empty("mcc").alias("no_mcc"),
                                    empty("respcode").alias("no_code"), empty("amount_uzs", "n/a").alias("no_amount"))


@query("read_csv_raw", RAW_SQL)
def _(spark, d):
    path = writers.scratch(spark, "raw")
    writers.export_csv(transactions_dirty(spark, d, *RAW), path)
    return _raw_counts(readers.read_csv_raw(spark, path, columns=RAW))


@query("read_csv_tolerant", RAW_SQL)
def _(spark, d):
    path = writers.scratch(spark, "semicolon")
    cyrillic = transactions_dirty(spark, d, *RAW).withColumn("gender", readers.to_cp1251(F.col("gender")))
    cyrillic.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return _raw_counts(readers.read_csv_tolerant(spark, path))


@query("read_parquet", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return readers.read_parquet(spark, f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("read_dir", "SELECT 'lineitem.parquet' AS file, count(*) AS n FROM lineitem")
def _(spark, d):
    return readers.rows_per_file(readers.read_dir(spark, d, "lineitem*.parquet"))


@query("resolve_aliases", "SELECT CAST(o_custkey AS VARCHAR) AS hpan, o_totalprice AS amount_uzs, '' AS p2p_type, o_orderkey AS rday FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("card"), F.col("o_totalprice").alias("total"),
                                              F.col("o_orderkey").alias("relative_day"))
    return readers.resolve_aliases(orders, {"hpan": ["hpan", "card", "pan"], "amount_uzs": ["amount_uzs", "amount", "sum", "total"],
                                            "p2p_type": ["p2p_type"], "rday": ["rday", "relative_day"]}, {"amount_uzs": 0.0, "rday": 0})


@query("conform_to_schema", DIRTY + """SELECT transaction_id, coalesce(CASE WHEN mcc NOT LIKE '%.%' THEN TRY_CAST(mcc AS INT) END, 0) AS mcc,
  greatest(coalesce(TRY_CAST(amount_uzs AS DOUBLE), 0), 0) AS amount_uzs, 860 AS currency, TRY_CAST(hour_num AS BIGINT) AS hour_num, merchant_name FROM dirty""")
def _(spark, d):
    raw = transactions_dirty(spark, d, "transaction_id", "mcc", "amount_uzs", "hour_num", "merchant_name")
    return typing.conform_to_schema(raw, {"transaction_id": "string", "mcc": "int", "amount_uzs": "double", "currency": "int",
                                          "hour_num": "bigint", "merchant_name": "string"},
                                    {"mcc": 0, "amount_uzs": 0, "currency": 860}, unsigned=["amount_uzs"])


def _recommended(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) FILTER ({c} <> '') AS filled, count(*) FILTER ({c} = '') AS missing,
  count(TRY_CAST({c} AS DOUBLE)) AS parsed FROM dirty"""


@query("recommend_types", DIRTY + ", r AS (" + " UNION ALL ".join(
    _recommended(c) for c in ["transaction_id", "hpan", "merchant_name", "mcc", "amount_uzs", "rday", "hour_num", "respcode", "age"]) + """)
SELECT *, CASE "column" WHEN 'hpan' THEN 'String' WHEN 'respcode' THEN 'Nullable(Float32)' WHEN 'mcc' THEN 'Nullable(UInt16)'
  WHEN 'amount_uzs' THEN 'Float64' WHEN 'rday' THEN 'UInt16' WHEN 'hour_num' THEN 'UInt8' WHEN 'age' THEN 'UInt8' ELSE 'String' END AS type FROM r""")
def _(spark, d):
    return typing.recommend_types(transactions_dirty(spark, d, "transaction_id", "hpan", "merchant_name", "mcc", "amount_uzs", "rday",
                                                     "hour_num", "respcode", "age"))


@query("infer_day_base", TXN + """, e AS (SELECT min(rday) AS lo, max(rday) AS hi FROM txn),
b AS (SELECT unnest(['1899-12-30', '1900-01-01', '1970-01-01', '2000-01-01']) AS base),
r AS (SELECT base, CAST(base AS DATE) + CAST(lo AS INT) AS f, CAST(base AS DATE) + CAST(hi AS INT) AS l FROM b, e)
SELECT base, CAST(f AS VARCHAR) AS first_day, CAST(l AS VARCHAR) AS last_day,
  CASE WHEN year(f) >= 1990 AND year(l) <= 2002 THEN 1 ELSE 0 END AS plausible FROM r""")
def _(spark, d):
    return typing.infer_day_base(transactions(spark, d, "rday"), first_year=1990, last_year=2002)


@query("append", TXN + "SELECT p2p_flag, count(*) AS n FROM txn GROUP BY 1")
def _(spark, d):
    path = writers.scratch(spark, "appended")
    df = transactions(spark, d, "transaction_id", "p2p_flag")
    writers.append(df.where("p2p_flag = 1"), path)
    writers.append(df.where("p2p_flag = 0"), path)
    return spark.read.parquet(path).groupBy("p2p_flag").agg(F.count("*").alias("n"))


@query("overwrite", TXN + "SELECT transaction_id FROM txn WHERE p2p_flag = 0")
def _(spark, d):
    path = writers.scratch(spark, "replaced")
    df = transactions(spark, d, "transaction_id", "p2p_flag")
    writers.overwrite(df.where("p2p_flag = 1").select("transaction_id"), path)
    writers.overwrite(df.where("p2p_flag = 0").select("transaction_id"), path)
    return spark.read.parquet(path)


@query("replace_window", TXN + """, g AS (SELECT year(transaction_date) AS window_end, merchant, count(*) AS n FROM txn GROUP BY 1, 2)
SELECT window_end, merchant, CASE WHEN window_end = 1999 THEN -n ELSE n END AS n FROM g""")
def _(spark, d):
    path = writers.scratch(spark, "windows")
    yearly = transactions(spark, d, "transaction_date", "merchant").groupBy(F.year("transaction_date").alias("window_end"), "merchant").agg(F.count("*").alias("n"))
    writers.replace_window(yearly, path)
    again = yearly.where("window_end = 1999").withColumn("n", -F.col("n"))
    writers.replace_window(again, path)
    writers.replace_window(again, path)
    return spark.read.parquet(path)


@query("publish", TXN + """SELECT count(*) AS row_count, CAST(min(transaction_date) AS VARCHAR) AS first_day,
  CAST(max(transaction_date) AS VARCHAR) AS last_day, max(transaction_date) - min(transaction_date) AS day_span FROM txn WHERE mcc > 5500""")
def _(spark, d):
    name = f"published_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{writers.scratch(spark, name)}'")
    df = transactions(spark, d, "transaction_date", "mcc", "amount_uzs")
    writers.publish(df, f"{name}.live", [F.count("*") > 0])
    return writers.publish(df.where("mcc > 5500"), f"{name}.live", [F.count("*") > 0, F.min("mcc") > 0])


@query("write_by_month", TXN + "SELECT strftime(transaction_date, '%Y%m') AS month, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS volume FROM txn GROUP BY 1")
def _(spark, d):
    path = writers.scratch(spark, "monthly")
    writers.write_by_month(transactions(spark, d, "transaction_id", "transaction_date", "hpan", "amount_uzs"), path)
    months = spark.read.parquet(path)
    return months.groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.sum("amount_uzs").alias("volume"))


@query("export_csv", BY_MCC)
def _(spark, d):
    path = writers.scratch(spark, "export")
    writers.export_csv(transactions(spark, d, "mcc", "amount"), path)
    return _by_mcc(readers.read_csv_raw(spark, path, columns=["mcc", "amount"]))


@query("sample_rows", TXN + "SELECT transaction_id, hpan FROM txn ORDER BY md5(transaction_id), transaction_id LIMIT 200")
def _(spark, d):
    return writers.sample_rows(transactions(spark, d, "transaction_id", "hpan"), 200, "transaction_id")


@query("table_extent", TXN + """SELECT count(*) AS row_count, CAST(min(transaction_date) AS VARCHAR) AS first_day,
  CAST(max(transaction_date) AS VARCHAR) AS last_day, max(transaction_date) - min(transaction_date) AS day_span FROM txn""")
def _(spark, d):
    return writers.table_extent(transactions(spark, d, "transaction_date"))


@query("safe_select", TXN + "SELECT emitent_region, count(*) AS n FROM txn WHERE p2p_flag = 1 GROUP BY 1")
def _(spark, d):
    view = f"txn_{uuid.uuid4().hex[:12]}"
    transactions(spark, d, "emitent_region", "p2p_flag").createOrReplaceTempView(view)
    return readers.safe_select(spark, f"SELECT emitent_region, count(*) AS n FROM {view} WHERE p2p_flag = 1 GROUP BY emitent_region;")


# ---- scalars ---------------------------------------------------------------------------------------------------

@query("parse_date", DIRTY + "SELECT transaction_id, CAST(CAST(TRY_STRPTIME(transaction_date, '%d.%m.%Y') AS DATE) AS VARCHAR) AS day FROM dirty")
def _(spark, d):
    return transactions_dirty(spark, d, "transaction_id", "transaction_date").select("transaction_id", sc.parse_date("transaction_date").alias("day"))


@query("parse_date_multi", TXN + "SELECT transaction_id, CAST(CASE WHEN transaction_id LIKE '1%' THEN DATE '1970-01-01' ELSE transaction_date END AS VARCHAR) AS day FROM txn")
def _(spark, d):
    raw = transactions_dirty(spark, d, "transaction_id", "transaction_date")
    broken = F.when(F.col("transaction_id").startswith("1"), "unknown").otherwise(F.col("transaction_date"))
    return raw.select("transaction_id", sc.parse_date_multi(broken).alias("day"))


@query("to_int_to_float", DIRTY + """SELECT transaction_id, coalesce(TRY_CAST(TRY_CAST(mcc AS DOUBLE) AS BIGINT), 0) AS mcc,
  coalesce(TRY_CAST(replace(amount_uzs, ',', '.') AS DOUBLE), 0) AS amount FROM dirty""")
def _(spark, d):
    return transactions_dirty(spark, d, "transaction_id", "mcc", "amount_uzs").select(
        "transaction_id", sc.to_int("mcc").alias("mcc"), sc.to_float("amount_uzs").alias("amount"))


@query("cast_or_default", DIRTY + "SELECT transaction_id, coalesce(TRY_CAST(amount_uzs AS DOUBLE), -1) AS amount_uzs, coalesce(TRY_CAST(p2p_flag AS DOUBLE), 0) AS p2p_flag FROM dirty")
def _(spark, d):
    return sc.cast_or_default(transactions_dirty(spark, d, "transaction_id", "amount_uzs", "p2p_flag"),
                              {"amount_uzs": ("double", -1), "p2p_flag": ("double", 0)})


@query("cast_or_null", DIRTY + "SELECT transaction_id, TRY_CAST(amount_uzs AS DOUBLE) AS amount_uzs, TRY_CAST(p2p_flag AS DOUBLE) AS p2p_flag FROM dirty")
def _(spark, d):
    return sc.cast_or_null(transactions_dirty(spark, d, "transaction_id", "amount_uzs", "p2p_flag"), {"amount_uzs": "double", "p2p_flag": "double"})


@query("impute_median_unknown", DIRTY + """, t AS (SELECT transaction_id, TRY_CAST(amount_uzs AS DOUBLE) AS a, nullif(merchant_name, '') AS m FROM dirty)
SELECT transaction_id, round(coalesce(a, (SELECT quantile_cont(a, 0.5) FROM t)), 4) AS amount, coalesce(m, 'Unknown') AS merchant_name FROM t""")
def _(spark, d):
    df = transactions_dirty(spark, d, "transaction_id", "amount_uzs", "merchant_name").select(
        "transaction_id", F.col("amount_uzs").try_cast("double").alias("amount"), F.nullif("merchant_name", F.lit("")).alias("merchant_name"))
    return sc.impute_median_unknown(df, ["amount"], ["merchant_name"]).withColumn("amount", F.round("amount", 4))


@query("fill_constants", DIRTY + "SELECT transaction_id, CASE WHEN merchant_name = '' THEN 'none' ELSE merchant_name END AS merchant_name, CASE WHEN respcode = '' THEN '96' ELSE respcode END AS respcode FROM dirty")
def _(spark, d):
    return sc.fill_constants(transactions_dirty(spark, d, "transaction_id", "merchant_name", "respcode"), {"merchant_name": "none", "respcode": "96"})


@query("normalize_strings", TXN + "SELECT transaction_id, CASE WHEN hour_num = 3 THEN '' ELSE upper(merchant_name) END AS merchant_name, emitent_region FROM txn")
def _(spark, d):
    df = transactions(spark, d, "transaction_id", "merchant_name", "emitent_region", "hour_num").withColumns({
        "merchant_name": F.when(F.col("hour_num") == 3, " NaN ").otherwise(F.concat(F.lit("  "), "merchant_name")),
        "emitent_region": F.concat("emitent_region", F.lit(" "))})
    return sc.normalize_strings(df, upper=["merchant_name"], trim=["emitent_region"]).drop("hour_num")


@query("day_number_to_date", TXN + "SELECT transaction_id, CAST(transaction_date AS VARCHAR) AS day FROM txn")
def _(spark, d):
    return transactions(spark, d, "transaction_id", "rday").select("transaction_id", sc.day_number_to_date("rday").alias("day"))


@query("epoch_weekend_flag", TXN + "SELECT transaction_id, CASE WHEN isodow(transaction_time) >= 6 THEN 1 ELSE 0 END AS weekend FROM txn")
def _(spark, d):
    return transactions(spark, d, "transaction_id", "transaction_time").select(
        "transaction_id", sc.epoch_weekend_flag(F.unix_timestamp("transaction_time")).alias("weekend"))


@query("clean_mcc", DIRTY + "SELECT transaction_id, coalesce(TRY_CAST(regexp_extract(mcc, '(\\d+)', 1) AS INT), 0) AS mcc FROM dirty")
def _(spark, d):
    return transactions_dirty(spark, d, "transaction_id", "mcc").select("transaction_id", sc.clean_mcc("mcc").alias("mcc"))


@query("bool_to_flag", DIRTY + "SELECT transaction_id, CASE WHEN lower(p2p_flag) IN ('1', 'true', 'yes') THEN 1 ELSE 0 END AS flag FROM dirty")
def _(spark, d):
    return transactions_dirty(spark, d, "transaction_id", "p2p_flag").select("transaction_id", sc.bool_to_flag("p2p_flag").alias("flag"))


@query("hour_expr", TXN + "SELECT transaction_id, hour_num AS hour FROM txn")
def _(spark, d):
    df = transactions(spark, d, "transaction_id", "hour_num", "transaction_time").withColumn(
        "hour_num", F.when(F.col("hour_num") > 11, "late").otherwise(F.col("hour_num").cast("string")))
    return df.select("transaction_id", sc.hour_expr(df).alias("hour"))


@query("merchant_key", DIRTY + "SELECT transaction_id, CASE WHEN mcc = '' THEN lower(merchant_name) ELSE merchant END AS merchant_key FROM dirty")
def _(spark, d):
    df = transactions_dirty(spark, d, "transaction_id", "merchant", "merchant_name", "mcc").withColumn(
        "merchant", F.when(F.col("mcc") == "", "").otherwise(F.col("merchant")))
    return df.select("transaction_id", sc.merchant_key(df).alias("merchant_key"))


@query("mcc_label", TXN + """, lab AS (SELECT mcc, min(mcc_description) AS label FROM txn WHERE mcc < 5600 GROUP BY mcc)
SELECT transaction_id, coalesce(label, 'MCC ' || txn.mcc) AS mcc_label FROM txn LEFT JOIN lab ON txn.mcc = lab.mcc""")
def _(spark, d):
    labels = transactions(spark, d, "mcc", "mcc_description").where("mcc < 5600").groupBy("mcc").agg(F.min("mcc_description").alias("label"))
    return sc.mcc_label(transactions(spark, d, "transaction_id", "mcc"), labels).select("transaction_id", "mcc_label")


@query("truncate_time", TXN + """SELECT transaction_id, strftime(date_trunc('minute', transaction_time), '%Y-%m-%d %H:%M:%S') AS minute,
  strftime(date_trunc('hour', transaction_time), '%Y-%m-%d %H:%M:%S') AS hour, CAST(CAST(date_trunc('week', transaction_date) AS DATE) AS VARCHAR) AS week,
  CAST(CAST(date_trunc('month', transaction_date) AS DATE) AS VARCHAR) AS month, strftime(transaction_date, '%Y%m') AS yyyymm FROM txn""")
def _(spark, d):
    df = transactions(spark, d, "transaction_id", "transaction_time", "transaction_date")
    return df.select("transaction_id", *[sc.truncate_time("transaction_time", u).alias(u) for u in ("minute", "hour")],
                     *[sc.truncate_time("transaction_date", u).alias(u) for u in ("week", "month", "yyyymm")])


@query("day_diff", TXN + "SELECT transaction_id, d - transaction_date AS age_days, CAST(transaction_date + 30 AS VARCHAR) AS due FROM txn, edge")
def _(spark, d):
    return transactions(spark, d, "transaction_id", "transaction_date").select(
        "transaction_id", sc.day_diff(last_day(spark, d), "transaction_date").alias("age_days"), sc.add_days("transaction_date", 30).alias("due"))


@query("log_amount", TXN + "SELECT transaction_id, round(log10(CAST(amount AS DOUBLE) + 1), 6) AS log_amount FROM txn")
def _(spark, d):
    return transactions(spark, d, "transaction_id", "amount").select("transaction_id", F.round(sc.log_amount("amount"), 6).alias("log_amount"))


@query("calendar_flags", TXN + """SELECT transaction_id, CASE WHEN isodow(transaction_date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour_num >= 22 OR hour_num <= 6 THEN 1 ELSE 0 END AS is_night, CASE WHEN emitent_region = 'NATION_0' THEN 1 ELSE 0 END AS is_capital,
  CASE WHEN mcc IN (6010, 6011, 6012, 7995) THEN 1 ELSE 0 END AS is_risky_mcc FROM txn""")
def _(spark, d):
    df = transactions(spark, d, "transaction_id", "transaction_date", "hour_num", "emitent_region", "mcc")
    return sc.calendar_flags(df, RISKY_MCC, CAPITAL_REGION).select("transaction_id", "is_weekend", "is_night", "is_capital", "is_risky_mcc")


@query("anchored_filter", TXN + "SELECT transaction_id FROM txn, edge WHERE transaction_date BETWEEN d - 400 AND d")
def _(spark, d):
    return sc.anchored_filter(transactions(spark, d, "transaction_id", "transaction_date"), 400, last_day(spark, d)).select("transaction_id")


@query("filter_transactions", TXN + """SELECT transaction_id FROM txn WHERE emitent_bank IN ('BUILDING', 'MACHINERY') AND mcc NOT IN (6011, 6012)
  AND p2p_flag = 0 AND company_id = 'EUROPE' AND transaction_date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' AND merchant_name <> ''""")
def _(spark, d):
    df = transactions(spark, d, "transaction_id", "emitent_bank", "mcc", "p2p_flag", "company_id", "transaction_date", "merchant_name")
    return sc.filter_transactions(df, banks=["BUILDING", "MACHINERY"], not_mccs=[6011, 6012], p2p=False, company="EUROPE",
                                  date_from="1997-01-01", date_to="2000-12-31", not_empty=["merchant_name"]).select("transaction_id")


@query("split_rfm_code", TXN + "SELECT DISTINCT mcc_code, mcc_code[1] AS R, mcc_code[2] AS F FROM txn")
def _(spark, d):
    codes = transactions(spark, d, "mcc_code").distinct()
    return codes.select("mcc_code", *sc.split_rfm_code("mcc_code"))


NUMBER = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"


@query("hash_impute", DIRTY + f"SELECT transaction_id, CASE WHEN merchant_name = '' THEN (['one', 'two', 'three'])[{NUMBER.format('transaction_id')} % 3 + 1] ELSE merchant_name END AS merchant_name FROM dirty")
def _(spark, d):
    return transactions_dirty(spark, d, "transaction_id", "merchant_name").select(
        "transaction_id", sc.hash_impute("merchant_name", ["one", "two", "three"], "transaction_id").alias("merchant_name"))


@query("luhn_valid", TXN + """, c AS (SELECT transaction_id, '8600' || lpad(CAST(merchant * 7919 + mcc * 31 + hour_num AS VARCHAR), 12, '0') AS card FROM txn),
digits AS (SELECT transaction_id, i, CAST(card[17 - i] AS INT) AS x FROM c, range(1, 17) r(i))
SELECT transaction_id, sum(CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN x * 2 - 9 ELSE x * 2 END) % 10 = 0 AS valid FROM digits GROUP BY 1""")
def _(spark, d):
    card = F.concat(F.lit("8600"), F.lpad((F.col("merchant") * 7919 + F.col("mcc") * 31 + F.col("hour_num")).cast("string"), 12, "0"))
    return transactions(spark, d, "transaction_id", "merchant", "mcc", "hour_num").select("transaction_id", sc.luhn_valid(card).alias("valid"))


@query("region_ip_fill", TXN + f"""SELECT transaction_id, CASE WHEN hour_num < 12 THEN '10.0.0.1' WHEN emitent_region = 'NATION_1' THEN
  '185.74.5.' || ({NUMBER.format("(transaction_id || 'b')")} % 254 + 1) ELSE '185.74.' || ({NUMBER.format("(transaction_id || 'a')")} % 254 + 1) || '.'
  || ({NUMBER.format("(transaction_id || 'b')")} % 254 + 1) END AS ip FROM txn""")
def _(spark, d):
    df = transactions(spark, d, "transaction_id", "hour_num", "emitent_region").withColumns({
        "ip": F.when(F.col("hour_num") < 12, "10.0.0.1").otherwise(""), "region": F.when(F.col("emitent_region") == "NATION_1", "Tashkent").otherwise("Elsewhere")})
    return df.select("transaction_id", sc.region_ip_fill("ip", "region", "transaction_id").alias("ip"))


@query("unique_txn_code", TXN + """SELECT transaction_id, 'TXN-' || strftime(transaction_time, '%Y%m%d%H%M%S') || '-' || right(hpan, 4) || '-' || substr(sha256(transaction_id), 1, 16) AS code FROM txn""")
def _(spark, d):
    return transactions(spark, d, "transaction_id", "transaction_time", "hpan").select(
        "transaction_id", sc.unique_txn_code("transaction_time", "hpan", "transaction_id").alias("code"))
