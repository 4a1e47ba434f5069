"""From raw documents to packed training sequences: the stages, applied in order, each to what its predecessor kept."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardlens.llm import decontaminate, packing, quality, secrets, simhash
from cardlens.llm.queries import table, tokenizer_path
from cardlens.session import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by at most two differing fingerprint bits the one with the smallest id stays.

    Most texts of a Jaccard similarity of 0.8 to 1 differ in more bits and stay; the README has figures.
    """
    return simhash.keep_one(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go; what stays is not changed."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mask; all documents stay. ``n_chars`` still tells the original length."""
    return secrets.mask_secrets(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("secret scan", masked_documents),
    ("packing", packed_sequences),
]

#: The classifier and the packing of tokens have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. Each result is written as Parquet in the shared folder and read again.

    What a stage has read is deleted once its own result is written; the last result stays for the caller.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            used = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            used.getFileSystem(spark._jsc.hadoopConfiguration()).delete(used, True)
    return docs
