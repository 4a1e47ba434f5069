"""Customer segmentation: recency–frequency–monetary scores, behaviour bins and k-means clusters."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.operators.windows import quartile_score

CLUSTER_FEATURES = ["txn_count_30d", "txn_amount_30d", "avg_txn_amount_30d", "p2p_ratio_30d", "unique_mcc_30d",
                    "weekend_ratio", "days_since_last_txn"]


def rfm_scores(cards: DataFrame) -> DataFrame:
    """R from values (low is good), F and M from first-come ranks; three-digit code and segment."""
    active = cards.where(F.col("txn_count_30d") > 0)
    slim = active.select("hpan", "txn_count_30d", "txn_amount_30d").persist()
    scored = quartile_score(active, "txn_count_30d", "F_score", mode="rank", fit_on=slim)
    scored = quartile_score(scored, "txn_amount_30d", "M_score", mode="rank", fit_on=slim)
    slim.unpersist()
    scored = quartile_score(scored, "days_since_last_txn", "_late")
    scored = scored.withColumn("R_score", 5 - F.col("_late")).drop("_late")
    r, f, m = F.col("R_score"), F.col("F_score"), F.col("M_score")
    segment = (
        F.when((r >= 3) & (f >= 3) & (m >= 3), "Champions").when((r >= 3) & (f >= 2) & (m >= 2), "Loyal")
        .when(r >= 3, "Potential").when((r >= 2) & (f >= 3), "At Risk").when(r >= 2, "Hibernating").otherwise("Lost"))
    return scored.withColumns({"rfm_score": F.concat(r.cast("string"), f.cast("string"), m.cast("string")),
                               "rfm_segment": segment})


def _bins(c: Column, edges: Sequence[float], labels: Sequence[str], with_lowest: bool) -> Column:
    low = c >= edges[0] if with_lowest else c > edges[0]
    out = F.when(low & (c <= edges[1]), labels[0])
    for upper, label in zip(edges[2:], labels[1:]):
        out = out.when((c > edges[labels.index(label)]) & (c <= upper), label)
    return out.when(c > edges[-1], labels[-1])


def behaviour_segments(cards: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Recency, frequency and monetary bins and the segment made of them.

    Bins include their lowest edge; ``strict_reference`` leaves it out, so that a value of 0 has no bin.
    """
    keep_low = not strict_reference
    binned = quartile_score(cards, "txn_amount_30d", "_m").withColumns({
        "recency_score": _bins(F.col("days_since_last_txn"), [0, 7, 30, 90], ["Active", "Regular", "Sleeping", "Lost"], keep_low),
        "frequency_score": _bins(F.col("txn_count_30d"), [0, 5, 15, 50], ["Low", "Medium", "High", "VeryHigh"], keep_low),
        "monetary_score": F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Premium")]), F.col("_m")),
    }).drop("_m")
    recency = F.coalesce("recency_score", F.lit(""))
    segment = (
        F.when((recency == "Active") & F.col("monetary_score").isin("High", "Premium"), "Champions")
        .when((recency == "Active") & F.col("frequency_score").isin("High", "VeryHigh"), "Loyal")
        .when(recency == "Regular", "Potential").when(recency == "Sleeping", "At Risk").otherwise("Lost"))
    return binned.withColumns({"customer_segment": segment, "activity_level": F.col("frequency_score")})


def _inputs(cards: DataFrame, features: Sequence[str]) -> DataFrame:
    return cards.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def fit_kmeans(cards: DataFrame, k: int = 5, features: Sequence[str] = CLUSTER_FEATURES, seed: int = 42) -> PipelineModel:
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
              KMeans(featuresCol="_scaled", predictionCol="kmeans_cluster", k=k, seed=seed)]
    return Pipeline(stages=stages).fit(_inputs(cards, features))


def kmeans_segments(cards: DataFrame, k: int = 5, features: Sequence[str] = CLUSTER_FEATURES, seed: int = 42) -> DataFrame:
    """Cards with their cluster; fits on the whole frame."""
    model = fit_kmeans(cards, k, features, seed)
    return model.transform(_inputs(cards, features)).drop("_raw", "_scaled")


def choose_k(cards: DataFrame, kmin: int = 2, kmax: int = 6, features: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    """Silhouette of each k, best first. The loop is over the few values of k, each fit is a Spark job."""
    kept = _inputs(cards, features).select(*features).persist()
    judge = ClusteringEvaluator(featuresCol="_scaled", predictionCol="kmeans_cluster")
    rows = [(k, float(judge.evaluate(fit_kmeans(kept, k, features).transform(kept)))) for k in range(kmin, kmax + 1)]
    kept.unpersist()
    return cards.sparkSession.createDataFrame(rows, "k int, silhouette double").orderBy(F.col("silhouette").desc(), "k")
