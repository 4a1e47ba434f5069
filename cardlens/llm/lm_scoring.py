"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

Documents are dealt into blocks by hash, long ones in segments; the number of blocks follows the length of the texts. A
block sends the distinct hashes of its n-grams, with their counts, to the count table, which is partitioned by ranges of
the hash; each part adds the counts up and answers in the same order. The answers are joined to the block's segments,
whose n-grams are scored and summed per document. Before the shuffle n-grams are thus distinct per block, sorted and
packed, so a very common n-gram costs one entry per block. What a document of several segments holds itself is counted in
the same table, under hashes of n-gram and document.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.llm.common import WORD_BREAK, count_words, text_hash
from cardlens.llm.licenses import split_words
from cardlens.session import cut_lineage

ORDER = 2
BACKOFF = 0.4
BLOCK_BYTES = 8 << 20   # text of a block, on average
SEGMENT = 1 << 20       # longer texts are cut into segments of about as many characters
ROW_BYTES = 256         # what a row counts besides its text
UNSEEN = 0.5        # count of a word that no other document has


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments(docs: DataFrame, id_col: str, text_col: str, order: int, size: int) -> DataFrame:
    """(_id, _x, _pre, _n, _doc, _seg, _deal): whole texts, and long ones cut behind words into segments.

    A segment has the ``order - 1`` words before it (``_pre``), its document's number of words and key; rows of whole
    texts have NULL there. Rows equal in id and text lie in different parts of the input or are numbered there, so their
    keys differ and do not depend on the order of rows.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x"),
                       F.xxhash64(id_col, text_hash(F.col(text_col)), F.spark_partition_id()).alias("_deal"))
    long = F.coalesce(F.octet_length("_x"), F.lit(0)) > size
    brk = re.compile(WORD_BREAK)

    def slices(text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            found = brk.search(text, at + size)
            end = found.end() if found else len(text)
            yield text[at:end]
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                text, deal = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                seen[deal] = seen.get(deal, 0) + 1
                key = xxhash.xxh64_intdigest(f"{deal}:{seen[deal]}") - (1 << 63)
                total = sum(len(split_words(x)) for x in slices(text))
                before: list[bytes] = []
                for seg, x in enumerate(slices(text)):
                    pre = b" ".join(before).decode()
                    before = (before + split_words(x))[1 - order:] if order > 1 else []
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), pa.array([x]), pa.array([pre]), pa.array([total], pa.int64()), pa.array([key], pa.int64()),
                         pa.array([seg], pa.int32()), pa.array([xxhash.xxh64_intdigest(f"{key}:{seg}") - (1 << 63)], pa.int64())],
                        names=["_id", "_x", "_pre", "_n", "_doc", "_seg", "_deal"])

    whole = rows.where(~long).select("_id", "_x", F.lit(None).cast("string").alias("_pre"), F.lit(None).cast("long").alias("_n"),
                                     F.lit(None).cast("long").alias("_doc"), F.lit(0).alias("_seg"), "_deal")
    return whole.union(rows.where(long).mapInArrow(run, f"_id {kind}, _x string, _pre string, _n long, _doc long, _seg int, _deal long"))


class Block:
    """n-gram hashes of the segments of a block, in a fixed order; words before a segment are known but not counted."""

    def __init__(self, table: pa.Table, order: int):
        import xxhash

        digest = xxhash.xxh64_intdigest
        each, before = [], []
        for text, pre in zip(table["_x"], table["_pre"]):
            known = split_words(pre.as_py())
            words = known + split_words(text.as_py())
            before.append(len(known))
            each.append(np.fromiter((digest(w) for w in words), np.uint64, len(words)))
        sizes, before = np.array([len(x) for x in each], np.int64), np.array(before, np.int64)
        self.sizes = sizes - before
        self.words = np.array([n if t is None else t for n, t in zip(self.sizes.tolist(), table["_n"].to_pylist())], np.int64)
        key = np.array([0 if k is None else k for k in table["_doc"].to_pylist()], np.int64).view(np.uint64)
        words = np.concatenate([*each, np.zeros(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(each)), sizes)
        starts = np.cumsum(sizes) - sizes
        self.place = np.arange(len(words)) - np.repeat(starts, sizes)
        self.inside = self.place >= before[self.doc]
        self.cut = ~np.array(table["_doc"].is_null().to_pylist(), bool)[self.doc]
        self.order = order
        self.keys, self.slots, self.counts = [], [], []
        levels, grams = [], words
        for n in range(1, order + 1):
            if n > 1:
                grams = np.concatenate([np.zeros(min(1, len(words)), np.uint64), mix(grams[:-1], words[1:])])
            levels.append(grams)
            self._enter(grams, self.place >= n - 1)
        for n, grams in enumerate(levels, 1):
            self._enter(mix(grams, key[self.doc]), (self.place >= n - 1) & self.cut)

    def _enter(self, grams: np.ndarray, known: np.ndarray) -> None:
        keys, slot = np.unique(grams[known], return_inverse=True)
        where = np.full(len(grams), -1, np.int64)
        where[known] = slot
        self.keys.append(keys)
        self.slots.append(where)
        self.counts.append(np.bincount(where[known & self.inside], minlength=len(keys)))

    def others(self, n: int, totals: list[np.ndarray]) -> np.ndarray:
        """For each word the count in other documents of the n-gram that ends there."""
        slot = self.slots[n - 1]
        out = np.zeros(len(slot), np.int64)
        known = (slot >= 0) & ~self.cut
        pair = self.doc[known] * max(1, len(self.keys[n - 1])) + slot[known]
        _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
        out[known] = totals[n - 1][slot[known]] - own[inverse]
        known = (slot >= 0) & self.cut
        at = self.order + n - 1
        out[known] = totals[n - 1][slot[known]] - totals[at][self.slots[at][known]]
        return out

    def score(self, totals: list[np.ndarray], words: int, backoff: float) -> np.ndarray:
        """Sum of the logarithms of the words' scores, per segment."""
        order = self.order
        counts = [self.others(n, totals) for n in range(1, order + 1)]
        rest = np.maximum(words - self.words, 1)[self.doc]
        log = np.log(np.maximum(counts[0], UNSEEN) / rest)
        longest = np.minimum(order, self.place + 1)
        log += np.log(backoff) * (longest - 1)
        for n in range(2, order + 1):
            found = np.flatnonzero((self.place >= n - 1) & (counts[n - 1] > 0))
            log[found] = np.log(counts[n - 1][found] / counts[n - 2][found - 1]) + np.log(backoff) * (longest[found] - n)
        return np.bincount(self.doc[self.inside], weights=log[self.inside], minlength=len(self.sizes)).astype(float)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, in six bytes each where all fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[:1] = 0
    small = len(keys) and int(steps.max()) < 1 << 48
    body = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6 if small else 8])
    return (b"\x06" if small else b"\x08") + (int(keys[0]) if len(keys) else 0).to_bytes(8, "little") + body.tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    width = packed[0]
    body = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    return np.uint64(int.from_bytes(packed[1:9], "little")) + np.add.accumulate(steps.view("<u8").ravel().astype(np.uint64))


def pack_counts(counts: np.ndarray) -> bytes:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(counts.max(initial=0)) < 1 << 8 * np.dtype(k).itemsize)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def edges(parts: int) -> np.ndarray:
    """Lower ends of the hash ranges of the count table."""
    return np.array([(i << 64) // parts for i in range(parts)], np.uint64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF,
          block_docs: int | None = None, block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT) -> DataFrame:
    """One row per document row: id, n_words, log_score (sum over words), mean_log_score (NULL without words).

    A word scores count(n-gram) / count(its context) for the longest n-gram up to ``order`` that other rows of the table
    hold, times ``backoff`` for each step back; at the end its share of all words of other rows, with ``UNSEEN`` for words
    that none of them has. Repeated rows are rows of their own, so they count for each other. NULL and empty texts have no
    words and score 0. An empty table gives an empty result; other columns are not looked at.

    A block holds about ``block_bytes`` of text, or ``block_docs`` documents where that is less, and texts beyond
    ``segment`` bytes are scored in segments, so a task's memory follows neither the table nor a document.
    """
    pieces = segments(docs, id_col, text_col, order, segment)
    own_words = F.when(F.col("_doc").isNull(), count_words(F.col("_x"))).when(F.col("_seg") == 0, F.col("_n"))
    rows, size, words = pieces.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("_x"), F.lit(0)).cast("long") + ROW_BYTES), F.sum(own_words)).first()
    blocks = parts = max(1, -(-(size or 0) // block_bytes), -(-rows // block_docs) if block_docs else 1)
    words = words or 0
    kind = dict(docs.dtypes)[id_col]
    dealt = pieces.withColumn("_block", F.pmod("_deal", F.lit(blocks))).drop("_deal", "_seg")

    def ask(table: pa.Table) -> pa.Table:
        block = Block(table, order)
        out = {"level": [], "part": [], "_block": [], "keys": [], "counts": []}
        for n in range(2 * order):
            cut = np.append(np.searchsorted(block.keys[n], edges(parts)), len(block.keys[n]))
            for p in range(parts):
                own = slice(cut[p], cut[p + 1])
                if cut[p] < cut[p + 1]:
                    for name, value in zip(out, (n, p, table["_block"][0].as_py(), pack_keys(block.keys[n][own]), pack_counts(block.counts[n][own]))):
                        out[name].append(value)
        return pa.table(out, schema=pa.schema([("level", pa.int32()), ("part", pa.int32()), ("_block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack_keys(k.as_py()) for k in table["keys"]]
        given = [unpack_counts(c.as_py()) for c in table["counts"]]
        keys = np.concatenate(asked)
        order_ = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order_], prepend=~keys[order_[:1]]) != 0) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(np.concatenate(given)[order_], first) if len(first) else np.zeros(0, np.int64)
        distinct = keys[order_][first]
        totals = [pack_counts(sums[np.searchsorted(distinct, k)]) for k in asked]
        return pa.table({"level": table["level"], "part": table["part"], "_block": table["_block"], "totals": pa.array(totals, pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, order)
        rows = sorted(zip(right["level"].to_pylist(), right["part"].to_pylist(), right["totals"].to_pylist()))
        totals = [np.concatenate([np.zeros(0, np.int64), *[unpack_counts(t) for level, _, t in rows if level == n]]) for n in range(2 * order)]
        return pa.table({"_id": left["_id"], "_doc": left["_doc"], "n_words": pa.array(block.sizes), "log_score": pa.array(block.score(totals, words, backoff))})

    asked = dealt.groupBy("_block").applyInArrow(ask, "level int, part int, _block long, keys binary, counts binary")
    told = asked.groupBy("level", "part").applyInArrow(answer, "level int, part int, _block long, totals binary")
    scored = cut_lineage(dealt.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(
        finish, f"_id {kind}, _doc long, n_words long, log_score double"))
    summed = scored.where("_doc IS NOT NULL").groupBy("_id", "_doc").agg(F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"))
    return scored.where("_doc IS NULL").union(summed).select(
        F.col("_id").alias(id_col), "n_words", "log_score",
        F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
