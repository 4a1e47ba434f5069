"""Steps that many queries share: rows move once for windows and joins by card, and frames that jobs read again are written once."""
import datetime as dt
import math
import random
import re
import time

import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.functions.scalars import hash_number
from cardlens.operators import features, fraud, text
from cardlens.operators.joins import CARD_FEATURES, CARD_GRAPH, MERCHANT_GRAPH
from cardlens.operators.windows import sequence_features
from cardlens.plans import load_all
from cardlens.plans.features_queries import model_features
from cardlens.plans.registry import PLANS
from cardlens.session import cut_lineage
from cardlens.sources.bucketed import store_facts
from cardlens.sources.model import MCC_CODES
from cardlens.sources.writers import stored


def payments(spark, cards=30):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"t{i:04d}", None if i % cards == 0 else f"c{i % cards}", f"m{i % 7}" if i % 11 else None, start.date() + dt.timedelta(i % 40), start + dt.timedelta(i % 40, i % 5 * 900),
             i % 5 // 4, float(i % 90), i % 2, 6011 if i % 3 else 4111, "NATION_0" if i % 4 else "X", int(i % 10 == 0)) for i in range(600)]
    return spark.createDataFrame(rows, "transaction_id string, hpan string, merchant string, transaction_date date, transaction_time timestamp, hour_num int, amount_uzs double, p2p_flag int, mcc int, emitent_region string, fraud_proxy int")


def exchanges(spark, df):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_windows_of_a_card_need_one_exchange(spark):
    assert exchanges(spark, sequence_features(payments(spark))) == 1


def test_joins_by_card_move_only_the_features(spark):
    txn = payments(spark)
    wide = lambda key, names: txn.select(key).distinct().select(key, *[(F.length(F.coalesce(key, F.lit("none"))) + i).alias(n) for i, n in enumerate(names)])
    cards, graph = wide("hpan", CARD_FEATURES), wide("hpan", CARD_GRAPH)
    merchants = wide("merchant", MERCHANT_GRAPH).withColumnRenamed("merchant", "merchant_key")
    twice = merchants.unionByName(merchants.where("merchant_key = 'm1'"))  # a repeated key repeats its rows
    found = features.fraud_features(txn, cards, graph, twice)
    rows = found.collect()
    assert len(rows) == 600 + txn.where("merchant = 'm1'").count()
    assert {r.txn_count_30d for r in rows if r.hpan is None} == {4.0} and {r.merch_degree_cards_90d for r in rows} == {2.0, 4.0}
    plain = [spark.createDataFrame(x.collect(), x.schema) for x in (cards, graph, merchants)]
    assert exchanges(spark, features.fraud_features(txn, *plain)) == 5  # by card, two sets of features, two sides by merchant


def test_split_ranks_only_the_bucket_of_the_edge(spark):
    df = spark.range(3000).select((F.col("id") % 1500).alias("key"), F.when(F.col("id") % 7 < 5, F.col("id") % 2).alias("y"), F.lit(1).alias("x"))
    train, held = fraud.stratified_split(df, 0.2, key="key", label="y")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert train.unionByName(held).exceptAll(df).isEmpty() and train.count() + held.count() == 3000
    sizes = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    assert {r.y: r["count"] for r in held.groupBy("y").count().collect()} == {y: int(n * 0.2 + 0.5) for y, n in sizes.items()}


def test_fits_read_stored_features(spark):
    load_all()
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert PLANS["train_fraud_model"](spark, "/root/testdata/sf0.001").count() > 1000
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_stored_rows_are_whole_and_packed_closely(spark):
    frame = features.fraud_features_basic(payments(spark))
    found = stored(frame, "features")
    assert found.dtypes == frame.dtypes and found.count() == 600
    assert found.exceptAll(frame).isEmpty() and frame.exceptAll(found).isEmpty()
    columns = [c for p in found.inputFiles() for c in pq.ParquetFile(p.removeprefix("file://")).metadata.row_group(0).to_dict()["columns"]]
    assert {c["compression"] for c in columns} == {"ZSTD"}


@pytest.mark.parametrize("written", [cut_lineage, lambda df: stored(df, "rows")])
def test_written_rows_leave_no_shuffle(spark, written):
    """Rows that are written out free the shuffles behind them; the frame they came from can still be read."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(b.name()) for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllBlocks()) if "shuffle_" in b.name()}
    before = files()
    df = spark.range(5000).select((F.col("id") % 700).alias("k")).repartition(3, "k")
    found = written(df)
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)  # files go in the background
    assert not left and found.count() == df.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_model_features_join_transactions_once(spark):
    """Windows and joins by card read the written transactions, cards and graph, not the tables."""
    plan = model_features(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\b[lopsc]_\w+key#", plan)


def test_vocabulary_from_candidates(spark):
    """Terms of all chunks, of many places in few chunks and ties at the edge; only candidates are counted by chunk."""
    rows = [(f"c{i % 50}", f"everywhere always word{i % 7} rare{i}" + (" burst" * 40 if i < 3 else "")) for i in range(60)]
    frame = spark.createDataFrame(rows, "chunk_id string, text string")
    for most in (1, 3, 8, 500):
        vocab, index = text.tfidf_index(frame, max_features=most)
        whole = text.vocabulary(text._counts(frame, "chunk_id", "text", ()), frame.agg(F.count("*")).scalar(), most)
        assert sorted(vocab.collect()) == sorted(whole.collect())
        assert index.select("term").exceptAll(vocab.select("term").crossJoin(spark.range(60)).select("term")).isEmpty()
    known = text._candidates(text._terms(frame, "chunk_id", "text", ()), frame.agg(F.count("*")).scalar(), 2, 0.95)
    assert 2 < known.count() < 9


def test_unread_bands_stay(spark, monkeypatch):
    """Postings are not written a second time with their norms."""
    made = []
    cut = text.cut_lineage
    monkeypatch.setattr(text, "cut_lineage", lambda df: made.append(df.columns) or cut(df))
    frame = spark.createDataFrame([(f"c{i}", f"a{i % 9} b{i % 5} c{i}") for i in range(60)], "chunk_id string, text string")
    vocab, index = text.tfidf_index(frame)
    asked = spark.createDataFrame([("q", "a1 b1"), ("r", "c7 b2")], "query_id string, text string")
    assert {r.chunk_id for r in text.retrieve_batch(asked, vocab, index, k=1).collect()} == {"c1", "c7"}
    assert not [c for c in made if "_rest" in c]


def test_sections_and_stages_read_stored_rows(spark):
    load_all()
    for name, scans in (("analysis_report", 2), ("improvement_scores", 0)):  # the report's codes, and their whole
        found = PLANS[name](spark, "/root/testdata/sf0.001")
        assert found._jdf.queryExecution().optimizedPlan().toString().count("l_partkey") < 20 * scans + 1 and found.count() > 1


def test_missing_codes_stay_missing_in_the_report(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("lineitem", "orders", "customer", "nation", "region", "supplier", "part"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        rows = rows.withColumn("p_size", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))) if name == "part" else rows
        rows.write.parquet(f"{folder}/{name}.parquet")
    sizes = spark.read.parquet(f"{folder}/lineitem.parquet").join(spark.read.parquet(f"{folder}/part.parquet"), F.col("l_partkey") == F.col("p_partkey")).where("p_size IS NOT NULL")
    found = PLANS["analysis_report"](spark, folder).where("section = 'mcc' AND metric = 'transactions'").collect()
    want = {str(MCC_CODES[r.i]): r["count"] for r in sizes.groupBy((F.col("p_size") % 20).alias("i")).count().collect()}
    assert len(found) == 10 and all(want[r.key] == r.value for r in found)


def test_permuted_rows_of_trees_move_as_cells(spark):
    """The same importances as by moving whole rows; of what the trees know neither keys nor values move."""
    r = random.Random(8)
    rows = [(f"t{i}", r.random(), float(r.randint(0, 3)), r.randint(0, 90), r.uniform(-5, 5)) for i in range(2000)]
    rows = [(*x, int(x[1] + x[2] / 4 + r.random() > 1.3) if i % 50 else None) for i, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "transaction_id string, a double, b double, c int, unused double, fraud_proxy int")
    model = fraud.train_fraud_model(df.where("fraud_proxy IS NOT NULL"), ["a", "b", "c"], kind="forest", trees=3, depth=4)
    found = fraud.permutation_importance(model, df, ["a", "c", "unused"], group_rows=100).collect()
    auc = lambda frame: fraud.classification_metrics(fraud.score(model, frame)).first().roc_auc
    whole, want = auc(df), {}
    for i, name in enumerate(["a", "c"]):
        mixed = W.partitionBy(hash_number("transaction_id", f"42g{i}") % 20).orderBy(hash_number("transaction_id", f"42o{i}"), "transaction_id")
        want[name] = whole - auc(df.withColumn(name, F.coalesce(F.lag(name).over(mixed), F.col(name))))
    assert {x.feature: x.importance for x in found} == {**want, "unused": 0.0} and want["a"] > 0.05
    plan = spark._jvm.PythonSQLUtils.explainString(fraud.permutation_importance(model, df, ["a", "c"])._jdf.queryExecution(), "formatted")
    moved = re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning", plan)
    assert len(moved) >= 2 and not [m for m in moved if re.search(r"transaction_id|\b[abc]#", m)]


def test_cells_between_thresholds_keep_the_side(spark):
    """Values at, just above and beyond the thresholds, and more cells than one number holds."""
    edges = {f"x{j}": sorted(random.Random(j).sample([-1e300, -2.5, 0.0, 1e-9, 3.0, 7.0, 1e18], j % 8)) for j in range(40)}
    codes, read = fraud._tree_codes(edges)
    marks = [-math.inf, math.inf, math.nan, -0.0, *[f(t) for t in (-1e300, -2.5, 0.0, 1e-9, 3.0, 7.0, 1e18) for f in (float, lambda t: math.nextafter(t, math.inf))]]
    df = spark.createDataFrame([[random.Random(i * 50 + j).choice(marks) for j in range(40)] for i in range(60)], ", ".join(f"x{j} double" for j in range(40)))
    names = [f"_code{c}" for c in range(len(codes))]
    seen = df.select("*", *[c.alias(n) for c, n in zip(codes, names)]).select("*", *[v(names).alias(f"_{n}") for n, v in read.items()]).collect()
    assert len(codes) > 1 and all((x[n] <= t) == (x[f"_{n}"] <= t) for x in seen for n, ts in edges.items() for t in ts)


def test_permuted_rows_of_few_features_lie_on_disk_together(spark, monkeypatch):
    """Results of earlier features are written before the next are moved, and nothing else changes."""
    r = random.Random(9)
    names = ["a", "b", "c", "e", "f"]
    rows = [(f"t{i}", *(x := [r.random() for _ in names]), int(sum(x) + r.random() > 3)) for i in range(600)]
    df = spark.createDataFrame(rows, f"transaction_id string, {', '.join(f'{n} double' for n in names)}, fraud_proxy int")
    model = fraud.train_fraud_model(df, names, kind="forest", trees=3, depth=3)
    monkeypatch.setattr(fraud, "TOGETHER", 9, raising=False)
    want = fraud.permutation_importance(model, df, names, group_rows=100).collect()
    made = []
    monkeypatch.setattr(fraud, "TOGETHER", 2)
    monkeypatch.setattr(fraud, "cut_lineage", lambda f: made.append(f.columns) or cut_lineage(f))
    assert fraud.permutation_importance(model, df, names, group_rows=100).collect() == want and len(want) == 5
    assert made == [["feature", "roc_auc"]] * 2


def test_bucketed_tables_are_packed_closely_and_leave_no_shuffle(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(b.name()) for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllBlocks()) if "shuffle_" in b.name()}
    heavy = spark.createDataFrame([("=c1", 2)], "heavy_key string, parts int")
    before = files()
    table = store_facts(payments(spark), f"facts_{random.randrange(1 << 40)}", "hpan", ["transaction_id"], heavy, 4, str(tmp_path / "facts"))
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 600
    assert {pq.ParquetFile(p).metadata.row_group(0).column(0).compression for p in (tmp_path / "facts").glob("*.parquet")} == {"ZSTD"}
