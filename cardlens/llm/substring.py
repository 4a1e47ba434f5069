"""Removal of repeated passages: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

A window that occurs in two documents also has its anchor in both: the smallest hash among the half-length windows inside
it. All windows are hashed, but only those whose anchor occurs in several documents can repeat, so only they are sent to
be counted. Anchors and windows are counted exactly and over all documents; windows are told apart by two independent
64-bit values, the window's hash and its anchor's.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.llm.common import match_rows, text_hash
from cardlens.session import cut_lineage

WINDOW_WORDS = 50
BASE = 0x9E3779B97F4A7C15      # odd, hence invertible modulo 2^64
ANCHOR_BASE = 0xC2B2AE3D27D4EB4F
SHARE_ROWS = 20_000            # windows of one anchor that a salted group holds on average


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` values, modulo 2^64, from prefix sums, and mixed so that order is random."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    powers = np.full(n, np.uint64(base))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * powers[::-1])])
    # sums[i + size] - sums[i] carries the factor base^(n - size - i); its inverse brings all windows to one scale.
    inverse = np.full(n - size + 1, np.uint64(pow(base, -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)[::-1]
    out = (sums[size:] - sums[:-size]) * inverse
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def running_min(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each run of ``size`` values, by doubling."""
    have = 1
    while have * 2 <= size:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = size - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_anchors(hashes: np.ndarray, size: int) -> np.ndarray:
    """The anchor of each window of ``size`` words."""
    half = (size + 1) // 2
    grams = rolling(hashes, half, ANCHOR_BASE)
    return running_min(grams, size - half + 1) if len(hashes) >= size else np.zeros(0, np.uint64)


def _anchors(docs: DataFrame, size: int) -> DataFrame:
    """(_id, _text, _anchors): the distinct anchors of each document, with the number of windows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(window_anchors(word_hashes(split_words(t.as_py())), size), return_counts=True) for t in batch.column(2)]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f, _ in found])]).astype(np.int32)
            values = pa.StructArray.from_arrays([
                pa.array(np.concatenate([f for f, _ in found] or [np.zeros(0, np.uint64)]).view(np.int64)),
                pa.array(np.concatenate([n for _, n in found] or [np.zeros(0)]).astype(np.int32))], ["anchor", "windows"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), values)],
                                             names=["_id", "_text", "_anchors"])

    kind = dict(docs.dtypes)["_id"]
    return docs.mapInArrow(run, f"_id {kind}, _text long, _anchors array<struct<anchor:long,windows:int>>").where(F.size("_anchors") > 0)


def _order(id_col: str = "_id"):
    """Documents by id; those without id come last."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def _repeated_anchors(anchors: DataFrame) -> DataFrame:
    """(_id, _text, _shared): per document its anchors that occur in other documents too, with a number of salts each."""
    key = ["_id", "_text"]
    each = anchors.select(*key, F.explode_outer("_anchors").alias("a")).where(F.col("a").isNotNull()).select(*key, "a.*")
    totals = each.groupBy("anchor").agg(F.sum("windows").alias("n"), F.min("_id").alias("lo"), F.max("_id").alias("hi"),
                                        F.bool_or(F.col("_id").isNull()).alias("none"))
    several = (F.col("lo") != F.col("hi")) | (F.col("none") & F.col("lo").isNotNull())
    shared = totals.where(several).select("anchor", F.ceil(F.col("n") / SHARE_ROWS).cast("int").alias("salts"))
    return each.drop("windows").join(shared, "anchor").groupBy(*key).agg(F.collect_set(F.struct("anchor", "salts")).alias("_shared"))


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, salt, hash, _id, _text, start) of the windows whose anchor is shared, from rows with ``_shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "salts", "hash", "_id", "_text", "start"]
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = word_hashes(split_words(batch.column(2)[i].as_py()))
                anchors = window_anchors(hashes, size).view(np.int64)
                entries = batch.column(3)[i].values.flatten()
                known = entries[0].to_numpy(zero_copy_only=False)
                order = np.argsort(known)
                known, salts = known[order], entries[1].to_numpy(zero_copy_only=False)[order]
                place = np.minimum(np.searchsorted(known, anchors), len(known) - 1)
                start = np.flatnonzero(known[place] == anchors)
                if not len(start):
                    continue
                own = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(start), np.int32)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchors[start]), pa.array(salts[place[start]].astype(np.int32)),
                    pa.array(rolling(hashes, size, BASE)[start].view(np.int64)), own,
                    pa.array(np.full(len(start), batch.column(1)[i].as_py(), np.int64)), pa.array(start.astype(np.int32))], names=names)

    kind = dict(docs.dtypes)["_id"]
    found = docs.mapInArrow(run, f"anchor long, salts int, hash long, _id {kind}, _text long, start int")
    return found.withColumn("salt", F.pmod(F.xxhash64("_id", "_text"), F.col("salts").cast("long")).cast("int"))


def _later(windows: DataFrame) -> DataFrame:
    """(_id, _text, start) of windows that also start in a document with a smaller id.

    A window's rows are compared within salted groups first. Only the smallest documents of the groups of a common
    anchor are compared once more. Rows are dealt by anchor, so neighbouring windows stay together and pack well; both
    comparisons read the same shuffled rows.
    """
    dealt = windows.repartition("anchor", "salt")
    one = dealt.withColumn("_first", F.min(_order()).over(W.partitionBy("anchor", "salt", "hash")))
    beaten = one.where((_order() != F.col("_first")) & (F.col("salts") > 0)).select("_id", "_text", "start")
    heads = one.where((_order() == F.col("_first")) & (F.col("salts") > 1))
    again = heads.withColumn("_least", F.min(_order()).over(W.partitionBy("anchor", "hash"))).where(
        _order() != F.col("_least")).select("_id", "_text", "start")
    return beaten.unionByName(again)


def intervals(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal word ranges [from, to) covered by windows with these sorted starts."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > size) + 1
    begin, end = np.r_[0, cuts], np.r_[cuts, len(starts)] - 1
    return list(zip(starts[begin].tolist(), (starts[end] + size).tolist()))


def repeated_windows(docs: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(_id, _text, _starts): starts of the windows to remove, for documents that have any; from (_id, _text, _x)."""
    anchors = cut_lineage(_anchors(docs, size))
    shared = match_rows(docs, _repeated_anchors(anchors), ["_id", "_text"]).where(F.col("_shared").isNotNull())
    return _later(_windows(shared, size)).groupBy("_id", "_text").agg(F.collect_set("start").alias("_starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_WORDS,
                   with_text: bool = False) -> DataFrame:
    """One row per document row: id, n_words, n_removed, kept_sha256, and on request ``kept`` and the removed ``ranges``.

    A word goes when it lies in a window of ``size`` words whose words also start in a document with a smaller id. All
    windows are judged on the input. NULL texts have no words. Rows without id count as after all others, and not as
    different documents among themselves; rows that share an id are one document to each other. Kept words are joined
    by one space. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_text"), F.col(text_col).alias("_x"))
    joined = match_rows(source, repeated_windows(source, size), ["_id", "_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, removed, digests, kept_texts, ranges = [], [], [], [], []
                for text, starts in zip(part.column(2), part.column(3)):
                    words = split_words(text.as_py())
                    gone = intervals(np.sort(starts.values.to_numpy()), size) if starts.is_valid else []
                    kept, last = [], 0
                    for a, b in gone:
                        kept += words[last:a]
                        last = b
                    line = b" ".join(kept + words[last:])
                    counts.append(len(words))
                    removed.append(sum(b - a for a, b in gone))
                    digests.append(hashlib.sha256(line).hexdigest())
                    if with_text:
                        kept_texts.append(line.decode())
                        ranges.append([{"start": a, "end": b} for a, b in gone])
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
                names = ["_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    columns, names = columns + [pa.array(kept_texts), pa.array(ranges, span)], names + ["kept", "ranges"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string, ranges array<struct<start:int,end:int>>" * with_text
    return joined.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
