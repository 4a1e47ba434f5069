"""Fraud models and their evaluation. Metrics are checked on a score computed from the columns by a fixed formula."""
from pyspark.sql import functions as F

from cardlens.operators import features as f
from cardlens.operators import fraud as fr
from cardlens.plans.features_queries import FEATURE_SOURCE, HORIZONS, SEQUENCE, feature_source, model_features
from cardlens.plans.registry import TXN, query
from cardlens.sources.model import last_day, transactions
from cardlens.sources.writers import stored

SCORED = TXN + """, sc AS (SELECT transaction_id, transaction_date, fraud_proxy,
  round(p2p_flag * 0.45 + CASE WHEN mcc IN (6011, 6012) THEN 0.1 ELSE 0 END + (CAST(amount_uzs AS DOUBLE) / 400000), 4) AS score FROM txn),
pn AS (SELECT count(*) FILTER (fraud_proxy = 1) AS p, count(*) FILTER (fraud_proxy = 0) AS n FROM sc),
g AS (SELECT score AS threshold, count(*) FILTER (fraud_proxy = 1) AS pos, count(*) FILTER (fraud_proxy = 0) AS neg FROM sc GROUP BY 1),
cu AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp FROM g),
roc AS (SELECT cu.*, CAST(tp AS DOUBLE) / p AS tpr, CAST(fp AS DOUBLE) / n AS fpr, p AS positives, n AS negatives FROM cu, pn)
"""


def scored(spark, d):
    df = transactions(spark, d, "transaction_id", "transaction_date", "p2p_flag", "mcc", "amount_uzs", "fraud_proxy")
    value = F.col("p2p_flag") * 0.45 + F.when(F.col("mcc").isin(6011, 6012), 0.1).otherwise(0) + F.col("amount_uzs").cast("double") / 400000
    return df.select("transaction_id", "transaction_date", "fraud_proxy", F.round(value, 4).alias("score"))


@query("stratified_split", TXN + """, h AS (SELECT transaction_id, fraud_proxy, CAST('0x' || substr(md5(transaction_id || '42'), 1, 8) AS BIGINT) AS h FROM txn),
r AS (SELECT *, row_number() OVER (PARTITION BY fraud_proxy ORDER BY h % 10000, h, transaction_id) AS r, count(*) OVER (PARTITION BY fraud_proxy) AS n FROM h)
SELECT transaction_id, fraud_proxy, CASE WHEN r <= CASE WHEN n > 1 THEN greatest(1, floor(n * 0.2 + 0.5)) ELSE 0 END THEN 'holdout' ELSE 'train' END AS part FROM r""")
def _(spark, d):
    train, hold = fr.stratified_split(transactions(spark, d, "transaction_id", "fraud_proxy"))
    return train.withColumn("part", F.lit("train")).unionByName(hold.withColumn("part", F.lit("holdout")))


@query("temporal_split", TXN + """SELECT CASE WHEN transaction_date >= d - 30 THEN 'valid' ELSE 'train' END AS part, count(*) AS n, CAST(min(transaction_date) AS VARCHAR) AS first_day,
  CAST(max(transaction_date) AS VARCHAR) AS last_day FROM txn, edge WHERE transaction_date >= d - 150 GROUP BY 1""")
def _(spark, d):
    train, valid = fr.temporal_split(transactions(spark, d, "transaction_date"), as_of=last_day(spark, d))
    both = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.min("transaction_date").alias("first_day"), F.max("transaction_date").alias("last_day"))


SCALE = ["amount_uzs", "hour_num", "amount_change_ratio", "amount_deviation"]


@query("scale_features", TXN + SEQUENCE + "SELECT transaction_id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER (), 5) AS {c}" for c in SCALE) + " FROM base")
def _(spark, d):
    basic = f.fraud_features_basic(transactions(spark, d, *FEATURE_SOURCE)).select("transaction_id", *SCALE)
    return fr.scale_features(basic, SCALE).withColumns({c: F.round(c, 5) for c in SCALE})


@query("roc_points", SCORED + "SELECT * FROM roc")
def _(spark, d):
    return fr.roc_points(scored(spark, d))


@query("classification_metrics", SCORED + """, a AS (SELECT CAST(sum(neg * (tp * 2 - pos)) AS DOUBLE) / (CAST(max(positives) AS DOUBLE) * max(negatives) * 2) AS roc_auc,
    sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / max(positives) AS pr_auc, max(abs(tpr - fpr)) AS ks,
    CAST(sum(pos) FILTER (threshold >= 0.5) AS DOUBLE) / (sum(pos) FILTER (threshold >= 0.5) + sum(neg) FILTER (threshold >= 0.5)) AS precision,
    CAST(sum(pos) FILTER (threshold >= 0.5) AS DOUBLE) / max(positives) AS recall FROM roc)
SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(ks, 6) AS ks, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(precision * recall * 2 / (precision + recall), 6) AS f1 FROM a""")
def _(spark, d):
    return fr.classification_metrics(scored(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("roc_auc", "pr_auc", "ks", "precision", "recall", "f1")])


@query("confusion_matrix", SCORED + """, c AS (SELECT count(*) FILTER (score >= 0.5 AND fraud_proxy = 1) AS tp, count(*) FILTER (score >= 0.5 AND fraud_proxy = 0) AS fp,
    count(*) FILTER (score < 0.5 AND fraud_proxy = 0) AS tn, count(*) FILTER (score < 0.5 AND fraud_proxy = 1) AS fn FROM sc)
SELECT *, CAST(tp AS DOUBLE) / (tp + fn) AS tpr, CAST(fp AS DOUBLE) / (fp + tn) AS fpr, CAST(tn AS DOUBLE) / (tn + fp) AS tnr, CAST(fn AS DOUBLE) / (fn + tp) AS fnr FROM c""")
def _(spark, d):
    return fr.confusion_matrix(scored(spark, d))


@query("recall_at_fpr", SCORED + """, pts AS (SELECT threshold, tpr, fpr FROM roc UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0), tg AS (SELECT unnest([0.01, 0.02, 0.3]) AS t)
SELECT CAST(t AS DOUBLE) AS target_fpr, tpr AS recall, threshold FROM tg, pts QUALIFY row_number() OVER (PARTITION BY t ORDER BY abs(fpr - CAST(t AS DOUBLE)), threshold DESC) = 1""")
def _(spark, d):
    return fr.recall_at_fpr(scored(spark, d), (0.01, 0.02, 0.3))


@query("brier", SCORED + "SELECT round(avg((score - fraud_proxy) * (score - fraud_proxy)), 8) AS brier FROM sc")
def _(spark, d):
    return fr.brier(scored(spark, d)).select(F.round("brier", 8).alias("brier"))


EV = SCORED + """, gr AS (SELECT i, 0.01::DOUBLE + i * ((0.99::DOUBLE - 0.01::DOUBLE) / 199) AS threshold FROM range(0, 200) r(i)),
ev AS (SELECT i, gr.threshold, coalesce(sum(pos), 0) AS tp, coalesce(sum(neg), 0) AS fp FROM gr LEFT JOIN g ON g.threshold >= gr.threshold GROUP BY ALL)
"""


@query("ev_curve", EV + "SELECT i, round(threshold, 6) AS threshold, tp, fp, round(CAST(tp AS DOUBLE) - CAST(fp AS DOUBLE) * 0.15::DOUBLE, 4) AS ev FROM ev")
def _(spark, d):
    return fr.ev_curve(scored(spark, d)).withColumns({"threshold": F.round("threshold", 6), "ev": F.round("ev", 4)})


@query("ev_threshold", EV + "SELECT round(threshold, 6) AS threshold, tp, fp, round(CAST(tp AS DOUBLE) - CAST(fp AS DOUBLE) * 0.15::DOUBLE, 4) AS ev FROM ev ORDER BY tp - fp * 0.15 DESC, i LIMIT 1")
def _(spark, d):
    return fr.ev_threshold(scored(spark, d)).withColumns({"threshold": F.round("threshold", 6), "ev": F.round("ev", 4)})


@query("calibrate_isotonic")
def _(spark, d):
    return fr.calibrate_isotonic(scored(spark, d)).select("transaction_id", "score", "calibrated")


def basic(spark, d):
    """The features of the model comparison, written once: a fit reads them several times."""
    return stored(f.fraud_features_basic(feature_source(spark, d)), "features")


@query("train_fraud_model")
def _(spark, d):
    train, hold = fr.stratified_split(stored(model_features(spark, d), "features"))
    return fr.score(fr.train_fraud_model(train), hold).select("transaction_id", "fraud_proxy", "score")


@query("benchmark_models")
def _(spark, d):
    train, valid = fr.temporal_split(basic(spark, d), 1500, 365, as_of=last_day(spark, d))
    return fr.benchmark_models(train, valid, f.BASIC_FEATURES)


@query("tune_fraud_model")
def _(spark, d):
    return fr.tune(basic(spark, d), f.BASIC_FEATURES, kind="forest", space={"maxDepth": (2, 6), "minInstancesPerNode": (1, 40), "subsamplingRate": (0.5, 1.0)}, trials=3, trees=5)[1]


@query("feature_importance")
def _(spark, d):
    model = fr.train_fraud_model(basic(spark, d), f.BASIC_FEATURES, kind="forest", trees=5, depth=5)
    return fr.feature_importance(model, spark, f.BASIC_FEATURES)


@query("permutation_importance")
def _(spark, d):
    frame = basic(spark, d)
    model = fr.train_fraud_model(frame, f.BASIC_FEATURES, kind="forest", trees=5, depth=5)
    return fr.permutation_importance(model, frame, ["amount_uzs", "hour_num", "p2p_flag"])


@query("reason_codes")
def _(spark, d):
    frame = basic(spark, d)
    return fr.reason_codes(fr.train_fraud_model(frame, f.BASIC_FEATURES, kind="logistic"), frame, f.BASIC_FEATURES)


@query("tree_reason_codes")
def _(spark, d):
    """Reasons of the boosted trees' own scores on the held-out fifth."""
    train, hold = fr.stratified_split(stored(model_features(spark, d), "features"))
    return fr.tree_reason_codes(fr.train_fraud_model(train, trees=5, depth=4), hold, f.ALL_FEATURES)


@query("fraud_end_to_end")
def _(spark, d):
    return fr.fraud_end_to_end(transactions(spark, d, *FEATURE_SOURCE), 365, 1500, 365, as_of=last_day(spark, d), card_days=HORIZONS, trees=5, depth=4)
