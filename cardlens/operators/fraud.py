"""Fraud models: splits, scaling, training, exact ranking metrics, calibration, thresholds and explanations."""
from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cardlens.functions.distributed import running_totals, with_scalars
from cardlens.functions.scalars import hash_number, newest_day, ratio
from cardlens.operators.features import ALL_FEATURES, card_features, card_graph_features, fraud_features, graph_edges, merchant_graph_features
from cardlens.operators.joins import cross_scalars
from cardlens.session import cut_lineage
from cardlens.sources.writers import stored

# The threshold grid of the expected-value search.
GRID_LOW, GRID_HIGH, GRID_POINTS = 0.01, 0.99, 200
LOGIT_BINS = 2000
SPLIT_BUCKETS = 10_000
TOGETHER = 3  # features whose permuted rows are moved at once


# ---- splits and scaling ----------------------------------------------------------------------------------------

def stratified_split(df: DataFrame, holdout: float = 0.2, seed: int = 42, key: str = "transaction_id", label: str = "fraud_proxy") -> tuple[DataFrame, DataFrame]:
    """Repeatable split in which each label gives its rounded share, at least one row where it has two.

    Rows are dealt to buckets by a hash of their key and counted by label and bucket. All buckets of a label but one lie on
    one side as a whole; only rows of that one are ranked, so nearly all rows stay where they are. A label is one entry of a
    list that comes to every row: labels are few. Rows may be re-read in any order.
    """
    number = hash_number(key, str(seed))
    bucket = F.coalesce(number % SPLIT_BUCKETS, F.lit(-1))
    counts = df.groupBy(label, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(W.partitionBy(label))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(label).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = F.when(total > 1, F.greatest(F.lit(1), F.floor(total * holdout + 0.5))).otherwise(0)
    cuts = counts.select(F.col(label).alias("label"), "_bucket", "_n", before.alias("_before"), wanted.alias("_wanted")).where(
        (F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_before") + F.col("_n")))
    listed = cuts.agg(F.collect_list(F.struct("label", F.col("_bucket").alias("bucket"), (F.col("_wanted") - F.col("_before")).alias("take"))))
    cut = F.get(F.filter("_cuts", lambda c: c["label"].eqNullSafe(F.col(label))), 0)
    side = F.coalesce(F.signum((bucket - F.col("_cut.bucket")).cast("double")), F.lit(1.0))
    sided = df.withColumns({"_hash": number, "_cuts": listed.scalar()}).withColumn("_cut", cut).withColumn("_side", side)
    place = F.row_number().over(W.partitionBy(label).orderBy("_hash", key))
    between = sided.where("_side = 0").withColumn("_place", place)
    part = lambda whole, cut_open: sided.where(whole).select(*df.columns).unionByName(between.where(cut_open).select(*df.columns))
    return part("_side > 0", "_place > _cut.take"), part("_side < 0", "_place <= _cut.take")


def temporal_split(df: DataFrame, train_days: int = 120, valid_days: int = 30, as_of=None,
                   date_col: str = "transaction_date") -> tuple[DataFrame, DataFrame]:
    """Validation holds the last days with both ends; training the days before it."""
    last = newest_day(df, as_of, date_col)
    start = F.date_sub(last, valid_days)
    train = df.where((F.col(date_col) >= F.date_sub(last, train_days + valid_days)) & (F.col(date_col) < start))
    return train, df.where(F.col(date_col).between(start, last))


def scale_features(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Standardised columns (population deviation; a constant column is only centred)."""
    source = df if fit_on is None else fit_on
    stats = source.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])
    spread = lambda f: F.when(F.col(f"_z.s_{f}") == 0, 1.0).otherwise(F.col(f"_z.s_{f}"))
    return with_scalars(df, "_z", stats).withColumns({f: (F.col(f) - F.col(f"_z.m_{f}")) / spread(f) for f in features}).drop("_z")


# ---- models ----------------------------------------------------------------------------------------------------

def _weighted(df: DataFrame, label: str) -> DataFrame:
    """Positive rows weigh negatives / positives, at least 1."""
    counts = cross_scalars(df, _pos=F.count_if(F.col(label) == 1), _neg=F.count_if(F.col(label) == 0))
    weight = F.greatest(F.lit(1.0), F.coalesce(ratio(F.col("_neg"), F.col("_pos")), F.lit(1.0)))
    return counts.withColumns({"_weight": F.when(F.col(label) == 1, weight).otherwise(1.0), "_label": F.col(label).cast("double")}).drop("_pos", "_neg")


def learner(kind: str, trees: int = 50, depth: int = 6, seed: int = 42):
    common = dict(featuresCol="_features", labelCol="_label", weightCol="_weight")
    if kind == "gbt":
        return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.9, seed=seed, **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.9, seed=seed, **common)
    if kind == "logistic":
        return LogisticRegression(maxIter=50, regParam=0.01, standardization=True, **common)
    raise ValueError(f"unknown learner {kind}")


def train_fraud_model(train: DataFrame, features: Sequence[str] = ALL_FEATURES, label: str = "fraud_proxy", kind: str = "gbt",
                      **params) -> PipelineModel:
    """Class-weighted model on the whole frame."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    return Pipeline(stages=[assembler, learner(kind, **params)]).fit(_weighted(train, label))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop(
        "_features", "rawPrediction", "probability", "prediction")


def benchmark_models(train: DataFrame, valid: DataFrame, features: Sequence[str] = ALL_FEATURES, label: str = "fraud_proxy",
                     kinds: Sequence[str] = ("gbt", "forest", "logistic"), **params) -> DataFrame:
    """One row of exact metrics per learner; the loop is over learners, each fit and scoring is a Spark job."""
    def one(kind: str) -> DataFrame:
        scored = score(train_fraud_model(train, features, label, kind, **params), valid)
        return classification_metrics(scored, "score", label).withColumn("model", F.lit(kind))

    return reduce(DataFrame.unionByName, [one(k) for k in kinds]).orderBy(F.col("roc_auc").desc())


def tune(train: DataFrame, features: Sequence[str] = ALL_FEATURES, label: str = "fraud_proxy", kind: str = "gbt",
         space: Mapping[str, Sequence | tuple] | None = None, trials: int = 10, seed: int = 42, parallelism: int = 2,
         **params) -> tuple[Model, DataFrame]:
    """Random search by area under the curve on the repeatable held-out fifth of each label.

    ``space`` gives a list of choices or a pair (low, high) for each parameter; whole-number pairs draw whole numbers.
    Repeated draws count once. The best model and (params, roc_auc), best first.
    """
    rng = random.Random(seed)
    draw = lambda v: (rng.randint(*v) if all(isinstance(x, int) for x in v) else rng.uniform(*v)) if isinstance(v, tuple) else rng.choice(list(v))
    space = space or {"maxDepth": (2, 8), "minInstancesPerNode": (1, 50)}
    points = list({tuple(sorted(p.items())): p for p in ({n: draw(v) for n, v in space.items()} for _ in range(trials))}.values())
    fit_on, held = (stored(part.select(*features, label), "split") for part in stratified_split(train, 0.2, seed, label=label))
    base = learner(kind, **params)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), base])
    weighted, judged = _weighted(fit_on, label), held.withColumn("_label", F.col(label).cast("double"))
    by_area = BinaryClassificationEvaluator(labelCol="_label")

    def trial(point: dict) -> tuple[Model, float]:
        model = pipeline.fit(weighted, {base.getParam(n): v for n, v in point.items()})
        return model, float(by_area.evaluate(model.transform(judged)))

    with ThreadPoolExecutor(parallelism) as pool:
        tried = list(pool.map(trial, points))
    rows = [(", ".join(f"{n}={v}" for n, v in sorted(point.items())), area) for point, (_, area) in zip(points, tried)]
    best = max(tried, key=lambda t: t[1])[0]
    return best, train.sparkSession.createDataFrame(rows, "params string, roc_auc double").orderBy(F.col("roc_auc").desc())


def halving_search(train: DataFrame, features: Sequence[str] = ALL_FEATURES, label: str = "fraud_proxy", kind: str = "gbt",
                   space: Mapping[str, Sequence | tuple] | None = None, trials: int = 9, eta: int = 3, seed: int = 42, parallelism: int = 2,
                   key: str = "transaction_id", **params) -> tuple[Model, DataFrame]:
    """Successive halving: many settings on few rows, the best ``1 / eta`` of each rung on ``eta`` times the rows.

    The rows of a rung are nested samples by a hash of their key, and the last rung fits on all of them, so settings are
    dropped early and the model returned has seen everything. All rungs are judged on the same repeatable held-out fifth.
    Gives that model and (rung, params, rows, roc_auc), the last rung first and the best first within a rung.
    """
    rng = random.Random(seed)
    draw = lambda v: (rng.randint(*v) if all(isinstance(x, int) for x in v) else rng.uniform(*v)) if isinstance(v, tuple) else rng.choice(list(v))
    space = space or {"maxDepth": (2, 8), "minInstancesPerNode": (1, 50)}
    points = list({tuple(sorted(p.items())): p for p in ({n: draw(v) for n, v in space.items()} for _ in range(trials))}.values())
    rungs = 1
    while eta ** (rungs - 1) < len(points):
        rungs += 1
    fit_on, held = (stored(part.select(*dict.fromkeys([key, *features, label])), "split") for part in stratified_split(train, 0.2, seed, key, label))
    base = learner(kind, **params)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), base])
    judged = held.withColumn("_label", F.col(label).cast("double"))
    by_area = BinaryClassificationEvaluator(labelCol="_label")
    rows, best = [], None
    for rung in range(rungs):
        share = SPLIT_BUCKETS // eta ** (rungs - 1 - rung)
        part = fit_on.where(hash_number(key, "rung") % SPLIT_BUCKETS < share)
        # Each setting reads the rows of the rung several times: their hashes and weights are found once.
        weighted = stored(_weighted(part, label).select(*dict.fromkeys([*features, "_weight", "_label"])), "rung")
        n = weighted.count()

        def trial(point: dict) -> tuple[dict, Model | None, float]:
            model = pipeline.fit(weighted, {base.getParam(k): v for k, v in point.items()})  # noqa: B023
            return point, model, float(by_area.evaluate(model.transform(judged)))

        with ThreadPoolExecutor(parallelism) as pool:
            tried = sorted(pool.map(trial, points), key=lambda t: -t[2])
        rows += [(rung, ", ".join(f"{k}={v}" for k, v in sorted(p.items())), n, area) for p, _, area in tried]
        points, best = [p for p, _, _ in tried[:max(1, len(tried) // eta)]], tried[0][1]
    table = train.sparkSession.createDataFrame(rows, "rung int, params string, rows bigint, roc_auc double")
    return best, table.orderBy(F.col("rung").desc(), F.col("roc_auc").desc())


# ---- metrics ---------------------------------------------------------------------------------------------------

def _by_score(scored: DataFrame, score_col: str, label: str) -> DataFrame:
    """Positives and negatives of each distinct score with running totals from the highest score down."""
    counts = scored.groupBy(F.col(score_col).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    s = F.least(F.greatest(F.col("threshold"), F.lit(1e-9)), F.lit(1 - 1e-9))
    return running_totals(counts, [], "threshold", {"tp": "pos", "fp": "neg"}, descending=True,
                          bin_of=F.floor(F.log(s / (1 - s)) * LOGIT_BINS))


def roc_points(scored: DataFrame, score_col: str = "score", label: str = "fraud_proxy") -> DataFrame:
    """All distinct thresholds, highest first; tied scores are one step."""
    cumulative = _by_score(scored, score_col, label)
    whole = scored.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return with_scalars(cumulative, "_w", whole).select(
        "threshold", "pos", "neg", "tp", "fp", ratio(F.col("tp"), F.col("_w.p")).alias("tpr"), ratio(F.col("fp"), F.col("_w.n")).alias("fpr"),
        F.col("_w.p").alias("positives"), F.col("_w.n").alias("negatives"))


def classification_metrics(scored: DataFrame, score_col: str = "score", label: str = "fraud_proxy", threshold: float = 0.5) -> DataFrame:
    """Area under the curve, average precision, largest gap, and precision, recall and F1 at the threshold."""
    roc = roc_points(scored, score_col, label)
    p, n = F.max("positives"), F.max("negatives")
    at = F.col("threshold") >= threshold
    tp = F.coalesce(F.sum(F.when(at, F.col("pos"))), F.lit(0))
    fp = F.coalesce(F.sum(F.when(at, F.col("neg"))), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    row = roc.agg(
        zero(ratio(F.sum(F.col("neg") * (F.col("tp") * 2 - F.col("pos"))), p.cast("double") * n * 2)).alias("roc_auc"),
        zero(ratio(F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))), p)).alias("pr_auc"),
        zero(F.max(F.abs(F.col("tpr") - F.col("fpr")))).alias("ks"),
        zero(ratio(tp, tp + fp)).alias("precision"), zero(ratio(tp, p)).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return row.withColumn("f1", zero(F.try_divide(F.col("precision") * F.col("recall") * 2, both)))


def confusion_matrix(scored: DataFrame, threshold: float = 0.5, score_col: str = "score", label: str = "fraud_proxy") -> DataFrame:
    flagged, fraud = F.col(score_col) >= threshold, F.col(label) == 1
    row = scored.agg(F.count_if(flagged & fraud).alias("tp"), F.count_if(flagged & ~fraud).alias("fp"),
                     F.count_if(~flagged & ~fraud).alias("tn"), F.count_if(~flagged & fraud).alias("fn"))
    share = lambda a, b: ratio(F.col(a), F.col(a) + F.col(b))
    return row.withColumns({"tpr": share("tp", "fn"), "fpr": share("fp", "tn"), "tnr": share("tn", "fp"), "fnr": share("fn", "tp")})


def recall_at_fpr(scored: DataFrame, targets: Sequence[float] = (0.01, 0.02), score_col: str = "score", label: str = "fraud_proxy") -> DataFrame:
    """Recall and threshold where the false-positive rate is nearest to each target; ties take the higher threshold."""
    points = roc_points(scored, score_col, label).select("threshold", "tpr", "fpr")
    start = scored.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    every = points.unionByName(start)
    nearest = lambda t: F.min_by(F.struct("tpr", "threshold"), F.struct(F.abs(F.col("fpr") - t), -F.col("threshold")))
    row = every.agg(*[nearest(t).alias(f"b{i}") for i, t in enumerate(targets)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("target_fpr"), F.col(f"b{i}.tpr").alias("recall"),
                                                  F.col(f"b{i}.threshold").alias("threshold")) for i, t in enumerate(targets)])))


def brier(scored: DataFrame, score_col: str = "score", label: str = "fraud_proxy") -> DataFrame:
    gap = F.col(score_col) - F.col(label)
    return scored.agg(F.avg(gap * gap).alias("brier"))


def _grid_value(i: Column) -> Column:
    return F.lit(GRID_LOW) + i * ((GRID_HIGH - GRID_LOW) / (GRID_POINTS - 1))


def ev_curve(scored: DataFrame, gain_tp: float = 1.0, cost_fp: float = 0.15, score_col: str = "score", label: str = "fraud_proxy") -> DataFrame:
    """Expected value of each grid threshold. Scores are counted into grid cells first, so rows never meet thresholds."""
    s = F.col(score_col)
    near = F.floor((s - GRID_LOW) / ((GRID_HIGH - GRID_LOW) / (GRID_POINTS - 1)))
    cell = F.when(_grid_value(near + 1) <= s, near + 1).when(_grid_value(near) > s, near - 1).otherwise(near)
    cell = F.least(F.greatest(cell, F.lit(-1)), F.lit(GRID_POINTS - 1))
    hist = scored.groupBy(cell.alias("i")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    grid = scored.sparkSession.range(GRID_POINTS).select(F.col("id").alias("i")).join(hist, "i", "left").na.fill(0)
    above = W.orderBy(F.col("i").desc()).rowsBetween(W.unboundedPreceding, 0)
    tp, fp = F.sum("pos").over(above), F.sum("neg").over(above)
    return grid.select("i", _grid_value(F.col("i")).alias("threshold"), tp.alias("tp"), fp.alias("fp"), (tp * gain_tp - fp * cost_fp).alias("ev"))


def ev_threshold(scored: DataFrame, gain_tp: float = 1.0, cost_fp: float = 0.15, score_col: str = "score", label: str = "fraud_proxy") -> DataFrame:
    """The first threshold of the grid with the largest value."""
    curve = ev_curve(scored, gain_tp, cost_fp, score_col, label)
    best = curve.agg(F.max_by(F.struct("threshold", "tp", "fp", "ev"), F.struct("ev", -F.col("i"))).alias("b"))
    return best.select("b.threshold", "b.tp", "b.fp", "b.ev")


# ---- calibration and explanations ------------------------------------------------------------------------------

def fit_isotonic(scored: DataFrame, score_col: str = "score", label: str = "fraud_proxy", digits: int = 6):
    """Monotone calibration, clipped outside the fitted range.

    Rows are first averaged per score rounded to ``digits``, so the fit sees at most 10^digits + 1 weighted points however
    many rows there are.
    """
    points = scored.groupBy(F.round(score_col, digits).alias("_s")).agg(F.avg(label).cast("double").alias("_y"), F.count("*").cast("double").alias("_w"))
    return IsotonicRegression(featuresCol="_s", labelCol="_y", weightCol="_w", predictionCol="calibrated").fit(points)


def calibrate_isotonic(scored: DataFrame, fit_on: DataFrame | None = None, score_col: str = "score", label: str = "fraud_proxy") -> DataFrame:
    model = fit_isotonic(scored if fit_on is None else fit_on, score_col, label)
    return model.setFeaturesCol(score_col).transform(scored)


def feature_importance(model: PipelineModel, spark, features: Sequence[str] = ALL_FEATURES) -> DataFrame:
    """The fitted trees' importances, ranked; one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(rows)], "rank int, feature string, importance double")


def _asked(model: PipelineModel, df: DataFrame, label: str) -> dict[str, list[float]]:
    """What the fitted trees compare each of their columns with, rising; empty for other models and for columns that are not plain numbers."""
    if len(model.stages) != 2 or not isinstance(model.stages[0], VectorAssembler) or not hasattr(model.stages[1], "trees"):
        return {}
    names = model.stages[0].getInputCols()
    if label in names or not all(isinstance(df.schema[n].dataType, NumericType) for n in names):
        return {}
    found: dict[str, set[float]] = {n: set() for n in names}
    todo = [tree._call_java("rootNode") for tree in model.stages[1].trees]
    while todo:
        node = todo.pop()
        if node.subtreeDepth() > 0:
            split = node.split()
            if split.getClass().getSimpleName() != "ContinuousSplit":
                return {}
            found[names[split.featureIndex()]].add(split.threshold())
            todo += [node.leftChild(), node.rightChild()]
    return {n: sorted(values) for n, values in found.items()}


def _tree_codes(asked: Mapping[str, Sequence[float]]) -> tuple[list[Column], dict[str, Callable[[Sequence[str]], Column]]]:
    """The columns of trees as a few whole numbers, and for each column a value on the same side of all that the trees ask,
    read from the named numbers: the trees take the same path with it as with the value itself."""
    codes, read, size = [F.lit(0).cast("bigint")], {}, 1
    for name, edges in asked.items():
        if size * (len(edges) + 1) >= 1 << 62:
            codes, size = [*codes, F.lit(0).cast("bigint")], 1
        gap = reduce(add, [(F.col(name).cast("double") > edge).cast("bigint") for edge in edges], F.lit(0).cast("bigint"))
        codes[-1] = codes[-1] + gap * size
        values = F.array(*[F.lit(v) for v in [*edges, math.nextafter(edges[-1], math.inf) if edges else 0.0]])
        read[name] = lambda cs, at=len(codes) - 1, w=size, n=len(edges) + 1, v=values: F.get(v, F.expr(f"{cs[at]} div {w}L % {n}L").cast("int"))
        size *= len(edges) + 1
    return codes, read


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str = "fraud_proxy", key: str = "transaction_id",
                           group_rows: int = 1000, seed: int = 42) -> DataFrame:
    """Loss of area under the curve when one column is shuffled.

    The shuffle is a shift by one row inside hashed groups of about ``group_rows`` rows in hashed order, so no task orders
    the whole column, however many rows there are. For trees a row moves as the number of the cell it has between their
    thresholds, with its hash and its label: its key and its values stay. Keys of equal hash, about one pair in eight million
    rows, then go by a second hash instead of by key.
    """
    groups = max(1, df.count() // group_rows)
    base = classification_metrics(score(model, df), "score", label).select(F.col("roc_auc").alias("base_auc"))
    asked = _asked(model, df, label)
    codes, read = _tree_codes(asked)
    names = [f"_code{c}" for c in range(len(codes))]
    earlier = [f"_earlier{c}" for c in range(len(codes))]

    def whole_rows(i: int, name: str) -> DataFrame:
        mixed = W.partitionBy(hash_number(key, f"{seed}g{i}") % groups).orderBy(hash_number(key, f"{seed}o{i}"), key)
        return df.withColumn(name, F.coalesce(F.lag(name).over(mixed), F.col(name)))

    def cells(i: int, name: str) -> DataFrame:
        place = (hash_number(key, f"{seed}o{i}") - (1 << 31)) * (1 << 32) + F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 32))
        moved = df.select((hash_number(key, f"{seed}g{i}") % groups).alias("_group"), place.alias("_place"), label, *[c.alias(n) for c, n in zip(codes, names)])
        mixed = W.partitionBy("_group").orderBy("_place")
        shifted = moved.withColumns({e: F.coalesce(F.lag(n).over(mixed), F.col(n)) for e, n in zip(earlier, names)})
        return shifted.select(label, *[value(earlier if n == name else names).alias(n) for n, value in read.items()])

    def one(i: int, name: str) -> DataFrame:
        shuffled = cells(i, name) if name in asked else whole_rows(i, name)
        return classification_metrics(score(model, shuffled), "score", label).select(F.lit(name).alias("feature"), "roc_auc")

    # The moved rows of all features would lie on disk together, so the results of all but the last few are written first.
    some = [[one(i, f) for i, f in [*enumerate(features)][at:at + TOGETHER]] for at in range(0, len(features), TOGETHER)]
    parts = [reduce(DataFrame.unionByName, p) for p in some]
    tried = reduce(DataFrame.unionByName, [*map(cut_lineage, parts[:-1]), parts[-1]])
    return with_scalars(tried, "_b", base).select("feature", (F.col("_b.base_auc") - F.col("roc_auc")).alias("importance")).orderBy(
        F.col("importance").desc(), "feature")


def reason_codes(model: PipelineModel, df: DataFrame, features: Sequence[str], k: int = 3, key: str = "transaction_id") -> DataFrame:
    """The factors that raise and lower each row's score most: coefficient times standardised value of a linear model."""
    weights = [float(w) for w in model.stages[-1].coefficients.toArray()]
    stats = df.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])
    framed = with_scalars(df.select(key, *features), "_z", stats)
    parts = [F.struct((F.lit(w) * (F.col(f) - F.col(f"_z.m_{f}"))).alias("effect"), F.lit(f).alias("feature")) for w, f in zip(weights, features)]
    ordered = F.array_sort(F.array(*parts))
    names = lambda a: F.concat_ws(",", F.transform(a, lambda s: s["feature"]))
    up = F.filter(F.slice(F.reverse(ordered), 1, k), lambda s: s["effect"] > 0)
    down = F.filter(F.slice(ordered, 1, k), lambda s: s["effect"] < 0)
    return framed.select(key, names(up).alias("raises"), names(down).alias("lowers"))


def _node_value(node, weight: float, vote: bool) -> float:
    """The tree's share of the margin if it ended at this node."""
    if not vote:
        return node.prediction() * weight
    counts = list(node.impurityStats().stats())
    return counts[1] / sum(counts) * weight


def _path_steps(root, features: int, weight: float, vote: bool) -> list[list[float]]:
    """For each leaf, left to right, what the steps of its path add by feature."""
    leaves: list[list[float]] = []
    todo = [(root, _node_value(root, weight, vote), [0.0] * features)]
    while todo:
        node, here, path = todo.pop()
        if node.subtreeDepth() == 0:
            leaves.append(path)
            continue
        asked = node.split().featureIndex()
        for child in (node.rightChild(), node.leftChild()):  # the left one is taken next
            there, added = _node_value(child, weight, vote), list(path)
            added[asked] += there - here
            todo.append((child, there, added))
    return leaves


def tree_contributions(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """(keep, margin, base, contributions): what each feature adds to the margin of the fitted trees, along the paths of the row.

    Every step from a node to its child changes the node's value; the change belongs to the feature that is asked there. The
    steps of all trees plus the values of their roots (``base``) are the margin: half the log odds of boosted trees, the
    probability of a forest. The table of leaves has trees x leaves x features numbers, whatever the number of rows, and is a
    constant of the plan; a row looks up one leaf per tree.
    """
    fitted = model.stages[-1]
    vote = isinstance(fitted, RandomForestClassificationModel)
    weights = [1.0 / len(fitted.trees)] * len(fitted.trees) if vote else [float(w) for w in fitted.treeWeights]
    roots = [tree._call_java("rootNode") for tree in fitted.trees]
    leaves = [_path_steps(root, len(features), weight, vote) for root, weight in zip(roots, weights)]
    base = sum(_node_value(root, weight, vote) for root, weight in zip(roots, weights))
    table = F.from_json(F.lit(json.dumps(leaves)), "array<array<array<double>>>")
    scored = PipelineModel([*model.stages[:-1], fitted.copy().setLeafCol("_leaves")]).transform(df)
    chosen = F.transform(vector_to_array("_leaves"), lambda leaf, tree: F.get(F.get(table, tree), leaf.cast("int")))
    total = F.aggregate(chosen, F.array_repeat(F.lit(0.0), len(features)), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    margin = vector_to_array("probability" if vote else "rawPrediction")[1]
    return scored.select(*keep, margin.alias("margin"), F.lit(base).alias("base"), total.alias("contributions"))


def tree_reason_codes(model: PipelineModel, df: DataFrame, features: Sequence[str], k: int = 3, keep: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """The k features that raise and that lower the margin of each row's own tree score most; ties go by name."""
    parts = tree_contributions(model, df, features, keep)
    effects = [F.struct(F.col("contributions")[i].alias("effect"), F.lit(f).alias("feature")) for i, f in enumerate(features)]
    rising = F.array_sort(F.transform(F.array(*effects), lambda s: F.struct((-s["effect"]).alias("effect"), s["feature"].alias("feature"))))
    names = lambda a: F.concat_ws(",", F.transform(F.slice(F.filter(a, lambda s: s["effect"] < 0), 1, k), lambda s: s["feature"]))
    return parts.select(*keep, "margin", "base", "contributions", names(rising).alias("raises"), names(F.array_sort(F.array(*effects))).alias("lowers"))


def fraud_end_to_end(txn: DataFrame, window_days: int = 90, train_days: int = 120, valid_days: int = 30, as_of=None,
                     card_days: Sequence[int] = (7, 30, 90), features: Sequence[str] = ALL_FEATURES, kind: str = "gbt", **params) -> DataFrame:
    """Graph features → card features → model → calibration → thresholds: one summary row.

    Frames that several jobs read, the features among them, are written once.
    """
    edges = graph_edges(txn, window_days, as_of)
    merchants = stored(merchant_graph_features(edges), "merchants")
    frame = stored(fraud_features(txn, card_features(txn, as_of, card_days), card_graph_features(edges, merchants), merchants), "features")
    train, valid = temporal_split(frame, train_days, valid_days, as_of)
    model = train_fraud_model(train, features, kind=kind, **params)
    scored = stored(calibrate_isotonic(score(model, valid)).select("fraud_proxy", "score", "calibrated"), "scores")
    raw, calibrated = brier(scored), brier(scored, "calibrated").withColumnRenamed("brier", "brier_calibrated")
    metrics = classification_metrics(scored)
    recalls = recall_at_fpr(scored, (0.01, 0.02), "calibrated").agg(
        F.max(F.when(F.col("target_fpr") == 0.01, F.col("recall"))).alias("recall_at_1pct"),
        F.max(F.when(F.col("target_fpr") == 0.02, F.col("recall"))).alias("recall_at_2pct"))
    best = ev_threshold(scored, score_col="calibrated").select(F.col("threshold").alias("ev_threshold"), F.col("ev").alias("ev_best"))
    summary = metrics
    for i, part in enumerate([raw.withColumnRenamed("brier", "brier_raw"), calibrated, recalls, best]):
        summary = with_scalars(summary, f"_p{i}", part).select("*", f"_p{i}.*").drop(f"_p{i}")
    return summary.sparkSession.createDataFrame(summary.collect(), summary.schema)  # one row
