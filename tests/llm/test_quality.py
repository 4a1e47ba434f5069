"""Quality scores: held-out accuracy, no influence of held-out labels, edge rows, isotonic pooling."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlens.llm import quality

PATH = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score)
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    ones = label == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum()), order


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{PATH}/documents.parquet"), spark.read.parquet(f"{PATH}/labels.parquet")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], known[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in known]
    score, label, said = map(np.array, zip(*held))
    assert auc(score, label)[0] > 0.9
    assert (said == label).mean() > 0.92


def test_held_out_labels_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{PATH}/documents.parquet").limit(300), spark.read.parquet(f"{PATH}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.quality(docs, flipped).collect()}
    assert a == pytest.approx(b, abs=1e-9)


def test_edge_rows(spark):
    schema = "doc_id long, text string, score double, _id string"
    docs = spark.createDataFrame([(1, None, 0.0, "a"), (2, "", 0.0, "b"), (None, "x y", 0.0, "c"), (3, "Fine words. " * 9000, 0.0, "d"), (3, "é", 0.0, "e")], schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 1), (3, 1), (7, 0)], "doc_id long, quality int")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0.5 for r in quality.quality(docs, labels.limit(0)).collect())
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_isotonic():
    at, p = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 3.0, 1.0, 4.0]), np.array([2.0, 4.0, 4.0, 4.0]))
    assert p.tolist() == [0.0, 0.5, 1.0]
    assert at == pytest.approx([0.1, 0.25, 0.4])
