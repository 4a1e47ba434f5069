"""Exact invariants of fitted models and clusters, where the model itself has no form in SQL: counts and facts as rows."""
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.functions.distributed import with_scalars
from cardlens.operators import features as f
from cardlens.operators import fraud as fr
from cardlens.operators import metrics as m
from cardlens.operators import segments as sg
from cardlens.plans.features_queries import FEATURE_SOURCE, HORIZONS, cards, model_features
from cardlens.plans.models_queries import SCORED, basic, scored
from cardlens.plans.registry import SQL, TXN, query
from cardlens.sources.model import last_day, transactions
from cardlens.sources.writers import stored

NAMES = f.BASIC_FEATURES
CARDS = f"(SELECT count(*) AS n FROM ({SQL['card_features']}))"


def _fits(c: str, low: float, high: float):
    return F.coalesce(F.col(c).between(low, high), F.lit(False))


@query("calibrate_isotonic_exact", SCORED + """, q AS (SELECT floor(round(score * 10000) / 100) / 100 AS s, CAST(sum(fraud_proxy) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS w FROM sc GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY s) AS i FROM q),
c AS (SELECT *, sum(y) OVER (ORDER BY i) AS cy, sum(w) OVER (ORDER BY i) AS cw FROM p),
ab AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cw - a.cw + a.w) AS v FROM c a JOIN c b ON a.i <= b.i),
mn AS (SELECT a, b AS i, min(v) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM ab)
SELECT s AS score, round(max(mn.v), 9) AS calibrated, CAST(any_value(w) AS BIGINT) AS n FROM mn JOIN p USING (i) GROUP BY s""")
def _(spark, d):
    """Pooling of adjacent violators against the largest of the smallest means, on scores cut to two digits."""
    coarse = scored(spark, d).withColumn("score", F.floor(F.round(F.col("score") * 10000) / 100) / 100)
    return fr.calibrate_isotonic(coarse).groupBy("score").agg(F.round(F.max("calibrated"), 9).alias("calibrated"), F.count("*").alias("n"))


@query("train_fraud_model_check", TXN + """, r AS (SELECT fraud_proxy, count(*) AS n FROM txn GROUP BY 1)
SELECT fraud_proxy, CAST(CASE WHEN n > 1 THEN greatest(1, floor(n * 0.2 + 0.5)) ELSE 0 END AS BIGINT) AS n, CAST(CASE WHEN n > 1 THEN greatest(1, floor(n * 0.2 + 0.5)) ELSE 0 END AS BIGINT) AS in_range, TRUE AS better FROM r""")
def _(spark, d):
    """Held-out rows per label, scores within 0 and 1, and a mean score that is higher for fraud."""
    split = fr.stratified_split(stored(model_features(spark, d), "features"))
    train, hold = (stored(part.select(*f.ALL_FEATURES, "fraud_proxy"), "split") for part in split)  # a fit reads its rows five times
    rows = stored(fr.score(fr.train_fraud_model(train, trees=5, depth=4), hold).select("fraud_proxy", "score"), "scores")
    means = rows.agg(F.avg(F.when(F.col("fraud_proxy") == 1, F.col("score"))).alias("one"), F.avg(F.when(F.col("fraud_proxy") == 0, F.col("score"))).alias("zero"))
    found = rows.groupBy("fraud_proxy").agg(F.count("*").alias("n"), F.count_if(_fits("score", 0, 1)).alias("in_range"))
    return with_scalars(found, "_m", means).select("fraud_proxy", "n", "in_range", (F.col("_m.one") > F.col("_m.zero")).alias("better"))


@query("benchmark_models_check", "SELECT unnest(['forest', 'gbt', 'logistic']) AS model, TRUE AS better_than_chance, TRUE AS in_range FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def _(spark, d):
    train, valid = fr.temporal_split(basic(spark, d), 1500, 365, as_of=last_day(spark, d))
    found = fr.benchmark_models(train, valid, NAMES, trees=5, depth=4)
    return found.select("model", (F.col("roc_auc") > 0.5).alias("better_than_chance"), (_fits("roc_auc", 0, 1) & _fits("pr_auc", 0, 1) & _fits("f1", 0, 1)).alias("in_range"))


@query("tune_fraud_model_check", "SELECT 3 AS trials, TRUE AS distinct_points, TRUE AS better_than_chance FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def _(spark, d):
    space = {"maxDepth": (2, 6), "minInstancesPerNode": (1, 40), "subsamplingRate": (0.5, 1.0)}
    found = fr.tune(basic(spark, d), NAMES, kind="forest", space=space, trials=3, trees=5)[1]
    return found.agg(F.count("*").alias("trials"), (F.count_distinct("params") == F.count("*")).alias("distinct_points"), (F.min("roc_auc") > 0.5).alias("better_than_chance"))


@query("halving_search_check", TXN + """, h AS (SELECT transaction_id, fraud_proxy, CAST('0x' || substr(md5(transaction_id || '42'), 1, 8) AS BIGINT) AS h,
  CAST('0x' || substr(md5(transaction_id || 'rung'), 1, 8) AS BIGINT) % 10000 AS g FROM txn),
r AS (SELECT *, row_number() OVER (PARTITION BY fraud_proxy ORDER BY h % 10000, h, transaction_id) AS r, count(*) OVER (PARTITION BY fraud_proxy) AS n FROM h),
t AS (SELECT g FROM r WHERE r > CASE WHEN n > 1 THEN greatest(1, floor(n * 0.2 + 0.5)) ELSE 0 END)
SELECT rung, trials, (SELECT count(*) FROM t WHERE g < share) AS rows, TRUE AS better_than_chance, TRUE AS best_goes_on
FROM (VALUES (0, 9, 1111), (1, 3, 3333), (2, 1, 10000)) v(rung, trials, share)""")
def _(spark, d):
    """Rungs with their rows; the settings of a rung must be the best of the one before."""
    frame = basic(spark, d)
    found = fr.halving_search(frame, NAMES, kind="forest", space={"maxDepth": (2, 6), "minInstancesPerNode": (1, 40), "subsamplingRate": (0.5, 1.0)}, trees=5)[1]
    ranked = found.withColumn("place", F.rank().over(W.partitionBy("rung").orderBy(F.col("roc_auc").desc())))
    before = ranked.select((F.col("rung") + 1).alias("rung"), "params", F.col("place").alias("was"))
    joined = ranked.join(before, ["rung", "params"], "left")
    kept = F.coalesce(F.max("was") <= F.count("*"), F.lit(True))
    return joined.groupBy("rung").agg(F.count("*").alias("trials"), F.max("rows").alias("rows"), (F.max("roc_auc") > 0.5).alias("better_than_chance"), kept.alias("best_goes_on"))


@query("feature_importance_check", f"SELECT {len(NAMES)} AS features, 1.0::DOUBLE AS total, TRUE AS ranked, TRUE AS uses_flag FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def _(spark, d):
    found = fr.feature_importance(fr.train_fraud_model(basic(spark, d), NAMES, kind="forest", trees=5, depth=5), spark, NAMES)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "importance"))), lambda s: s["importance"])
    return found.agg(F.count_distinct("feature").alias("features"), F.round(F.sum("importance"), 9).alias("total"),
                     (F.to_json(listed) == F.to_json(F.reverse(F.array_sort(listed)))).alias("ranked"),
                     (F.max(F.when(F.col("feature") == "p2p_flag", F.col("importance"))) > 0).alias("uses_flag"))


@query("permutation_importance_all", f"SELECT unnest({NAMES}) AS feature, TRUE AS in_range FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def _(spark, d):
    frame = basic(spark, d)
    model = fr.train_fraud_model(frame, NAMES, kind="forest", trees=5, depth=5)
    return fr.permutation_importance(model, frame, NAMES).select("feature", _fits("importance", -1, 1).alias("in_range"))


@query("reason_codes_check", TXN + "SELECT count(*) AS n, count(*) AS disjoint, count(*) AS bounded FROM txn")
def _(spark, d):
    """No factor both raises and lowers a row's score, and each list has at most three."""
    frame = basic(spark, d)
    found = fr.reason_codes(fr.train_fraud_model(frame, NAMES, kind="logistic"), frame, NAMES)
    up, down = (F.array_remove(F.split(c, ","), "") for c in ("raises", "lowers"))
    return found.agg(F.count("*").alias("n"), F.count_if(~F.arrays_overlap(up, down)).alias("disjoint"),
                     F.count_if((F.size(up) <= 3) & (F.size(down) <= 3)).alias("bounded"))


@query("tree_reason_codes_check", TXN + "SELECT transaction_id, fraud_proxy, TRUE AS adds_up FROM txn")
def _(spark, d):
    """On every row the base and the contributions are the margin of the boosted trees."""
    frame = stored(model_features(spark, d), "features")
    parts = fr.tree_contributions(fr.train_fraud_model(frame, trees=5, depth=4), frame, f.ALL_FEATURES, keep=("transaction_id", "fraud_proxy"))
    total = F.aggregate("contributions", F.col("base"), lambda a, c: a + c)
    return parts.select("transaction_id", "fraud_proxy", F.coalesce(F.abs(total - F.col("margin")) < 1e-9, F.lit(False)).alias("adds_up"))


@query("kmeans_segments_check", f"SELECT n AS cards, n AS nearest, TRUE AS within_k FROM {CARDS}")
def _(spark, d):
    """Every card has a cluster, and no centre is nearer to it than that of its own."""
    kept = cards(spark, d).persist()
    model = sg.fit_kmeans(kept)
    rows = model.transform(sg._inputs(kept, sg.CLUSTER_FEATURES))
    centres = [[float(x) for x in c] for c in model.stages[-1].clusterCenters()]
    place = F.col("_place")
    away = [sum((place[i] - x) * (place[i] - x) for i, x in enumerate(c)) for c in centres]
    far = rows.withColumn("_place", fr.vector_to_array("_scaled")).withColumn("_away", F.array(*away))
    own = F.get("_away", F.col("kmeans_cluster"))
    return far.agg(F.count("*").alias("cards"), F.count_if(own <= F.array_min("_away") + 1e-9).alias("nearest"),
                   F.coalesce(F.max("kmeans_cluster") < len(centres), F.lit(True)).alias("within_k"))


@query("cluster_summary_check", f"SELECT n AS clients, TRUE AS same_mean FROM {CARDS}")
def _(spark, d):
    """Clients of all clusters are the cards, and the clusters' means give the mean of all cards."""
    kept = cards(spark, d).persist()
    found = m.cluster_summary(sg.kmeans_segments(kept))
    sums = found.agg(F.sum("clients").alias("clients"), (F.sum(F.col("clients") * F.col("avg_amount")) / F.sum("clients")).alias("mean"))
    whole = kept.agg(F.avg("avg_txn_amount_30d").alias("mean"))
    return with_scalars(sums, "_w", whole).select("clients", F.coalesce(F.abs(F.col("mean") - F.col("_w.mean")) < 0.01, F.col("clients").isNull() | F.col("_w.mean").isNull()).alias("same_mean"))


@query("choose_k_check", "SELECT 3 AS tried, 2 AS least, 4 AS most, TRUE AS in_range FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def _(spark, d):
    found = sg.choose_k(cards(spark, d), 2, 4)
    return found.agg(F.count("*").alias("tried"), F.min("k").alias("least"), F.max("k").alias("most"), F.bool_and(_fits("silhouette", -1, 1)).alias("in_range"))


@query("fraud_end_to_end_check", "SELECT 1 AS n, TRUE AS better_than_chance, TRUE AS calibration_helps FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def _(spark, d):
    found = fr.fraud_end_to_end(transactions(spark, d, *FEATURE_SOURCE), 365, 1500, 365, as_of=last_day(spark, d), card_days=HORIZONS, trees=5, depth=4)
    return found.agg(F.count("*").alias("n"), F.bool_and(F.col("roc_auc") > 0.5).alias("better_than_chance"),
                     F.bool_and(F.col("brier_calibrated") <= F.col("brier_raw") + 1e-9).alias("calibration_helps"))
