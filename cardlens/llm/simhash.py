"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: per document, XXH64 of its word shingles, one vote per shingle and bit. Links: pairs of fingerprints that
differ in few bits, found by an index over distinct fingerprints whose top nodes are masked bit patterns. The 64 bits are
cut into ``BLOCKS`` blocks; two fingerprints within ``distance`` bits agree in at least ``BLOCKS - distance`` blocks, so
each fingerprint enters one top node per choice of agreeing blocks. The rows of a top node are sorted by Gray rank, where
neighbours differ in few bits; runs of them form nodes that hold the bits all members share, and runs of nodes form the
levels above. A search goes down pairs of nodes, and drops whole pairs as soon as their shared patterns differ too often.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.llm.common import components
from cardlens.session import cut_lineage

SHINGLE_WORDS = 3
DISTANCE = 2
BLOCKS = 6
FANOUT = 16
SEED = 42
FRONTIER = 1 << 20  # node pairs looked at together


def fingerprint(text: str | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit fingerprint; NULL and wordless texts have zero."""
    import xxhash

    words = text.encode().lower().split() if text else []  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(line, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    total = len(words) - size + 1
    bits = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        s, e = starts[at:at + (1 << 16)][:total - at], ends[at + size - 1:at + size - 1 + (1 << 16)]
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(s.tolist(), e.tolist())), np.uint64, len(s))
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    votes = np.packbits(2 * bits > total, bitorder="little")
    return int(votes.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(_id, _fp) per document row; the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["_id", "_fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x")).mapInArrow(run, f"_id {kind}, _fp long")


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks of the top nodes, as signed numbers: all choices of ``blocks - distance`` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def gray_rank(c: Column) -> Column:
    """Place of a fingerprint in the Gray sequence, as unsigned order mapped to signed."""
    for shift in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, shift))
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def _levels(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of the nodes, leaves first; a mask holds the bits that all members share."""
    level = (values, np.full(len(values), np.uint64(0xFFFFFFFFFFFFFFFF)))
    out = [level]
    while len(level[0]) > 1:
        at = np.arange(0, len(level[0]), FANOUT)
        first = level[0][at]
        owner = np.arange(len(level[0])) // FANOUT
        differ = (level[0] ^ first[owner]) | ~level[1]
        level = (first, ~np.bitwise_or.reduceat(differ, at))
        out.append(level)
    return out


def linked_roots(values: np.ndarray, distance: int) -> np.ndarray:
    """For fingerprints in Gray order, the index of a representative of each one's group of linked fingerprints."""
    levels = _levels(values)
    parent = np.arange(len(values))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, a, b = stack.pop()
        pattern, mask = levels[depth]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
        a, b = a[near], b[near]
        if depth == 0:
            for i, j in zip(a.tolist(), b.tolist()):
                if i < j:
                    x, y = find(i), find(j)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
            continue
        below = len(levels[depth - 1][0])
        step = max(1, FRONTIER // FANOUT ** 2)
        for at in range(0, len(a), step):
            x = (a[at:at + step, None, None] * FANOUT + np.arange(FANOUT)[None, :, None]) + np.zeros((1, 1, FANOUT), np.int64)
            y = (b[at:at + step, None, None] * FANOUT + np.arange(FANOUT)[None, None, :]) + np.zeros((1, FANOUT, 1), np.int64)
            keep = (x < below) & (y < below) & (x <= y)
            stack.append((depth - 1, x[keep], y[keep]))
    return np.array([find(i) for i in range(len(values))])


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``distance`` bits; per top node each to its group's first.

    Only distinct fingerprints enter. A top node's rows come to one task in Gray order; they share all but
    ``distance`` blocks, so their number is bounded by the bits left (22 of 64), whatever the size of the table.
    """
    masks = F.array(*[F.lit(m) for m in block_masks(distance, blocks)])
    nodes = (prints.select("_fp").distinct().select("_fp", F.posexplode(masks).alias("_mask", "_m"))
             .select("_mask", F.col("_fp").bitwiseAND(F.col("_m")).alias("_node"), "_fp"))
    placed = nodes.repartition("_mask", "_node").sortWithinPartitions("_mask", "_node", gray_rank(F.col("_fp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(mask, node, fps):
            cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(node) != 0)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(fps)]
            a, b = [], []
            several = ends - starts > 1
            for s, e in zip(starts[several].tolist(), ends[several].tolist()):
                own = fps[s:e]
                roots = linked_roots(own.view(np.uint64), distance)
                other = roots != np.arange(len(own))
                a.append(own[roots[other]])
                b.append(own[other])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        held = None  # the last node of a batch may go on in the next
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from out(*[x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None:
            yield from out(*held)

    return placed.mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``prints`` (_id, _fp) with ``_root``, the representative fingerprint of the class."""
    roots = components(links(prints, distance))
    return prints.join(roots, prints["_fp"] == roots["node"], "left").select(
        *prints.columns, F.coalesce("root", "_fp").alias("_root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document row: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Texts that are NULL, empty or wordless have fingerprint zero and are linked like any other. Equal fingerprints are
    linked, so repeated rows meet. Rows without id do not set a component's id; a component of such rows has none. An empty
    table gives an empty result; other columns, whatever their names, are not looked at.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    found = classes(prints, distance)
    least = found.groupBy("_root").agg(F.min("_id").alias("component_id"))
    return found.join(least, "_root").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One document row per component: the smallest id (rows without id last); among rows that share it, the first by a
    digest of id and text, and one of those that are equal in both. Texts are shuffled once."""
    part = lambda c: F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), c.cast("string")))
    digest = F.md5(F.concat(part(F.col(id_col)), F.lit("\0"), part(F.col(text_col))))
    prints = cut_lineage(fingerprints(docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("digest")).alias("_k"),
                                                  F.col(text_col).alias("_x")), "_k", "_x"))
    kept = classes(prints, distance).groupBy("_root").agg(F.min("_id").alias("_k")).select(F.col("_k.digest").alias("_digest"))
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), digest.alias("_digest"))
    return rows.join(kept, "_digest", "left_semi").groupBy("_digest").agg(F.first("_row").alias("_row")).select("_row.*")
