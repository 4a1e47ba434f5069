"""Shared pieces: word patterns, row identity, connected components."""
from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.session import cut_lineage

# What separates words; digits, letters and everything beyond ASCII belong to words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; all other letters stay. Pure ASCII text takes the quicker of two equal ways."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """Words of a text as an array; NULL has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def count_words(text: Column) -> Column:
    """How many words ``words_of`` finds, without changing the case first."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), CASED_WORD_BREAK), "")).cast("long")


def text_hash(text: Column) -> Column:
    """Second half of a row's identity beside its id: rows equal in both are interchangeable."""
    return F.xxhash64(text)


def match_rows(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which NULL keys meet; the key columns of the left side stay."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, match, how).drop(*[f"_r_{c}" for c in on])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a link table: (node, root), root the smallest node of the component.

    Alternates two steps until nothing changes: each node hands its larger neighbours to its smallest one, then its
    smaller neighbours and itself. Each step is a combinable minimum per node, a join back (which adaptive execution
    splits where a node has very many links) and a distinct. Each round is cut by a checkpoint; only its row count and
    checksum come to the driver. Nodes without links do not appear.
    """
    links = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()

    def state(df: DataFrame):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    links = cut_lineage(links)
    seen = state(links)
    while seen[0]:
        both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).union(links.select("u", "v"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where(F.col("y") > F.col("x")).join(least, "x").select(
            F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(small_least, "v").select(
            F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
                              F.struct(F.col("v").alias("v"), F.col("m").alias("u")))).alias("e")
        ).select("e.v", "e.u").where("v <> u").distinct()
        links = cut_lineage(small)
        now = state(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        links.select("u", "u")).distinct()
