"""Removal of repeated byte strings: a depth-limited radix sort of suffixes by most-significant-digit passes.

Suffixes are ordered only through their first ``size`` bytes; what is still together after the last digit is a repeated
window. A group of one is done and drops out at once, which is nearly all suffixes at the first digit:

1. The first digit of a suffix is its anchor, the smallest hash among the ``ANCHOR``-byte strings inside the window. Equal
   windows have equal anchors. Neighbouring windows share one, so the pass moves a row per run of windows, not per byte.
   Equal texts are counted before it and pass once. Anchors that stand at one place of the corpus are done.
2. The second digit is the run itself, the bytes from its first window's start to its last window's end. Runs that stand
   twice are repeated as a whole. Of each different run of an anchor one copy goes on, with its bytes.
3. Within an anchor the windows of different runs are ordered by the digits of ``DIGIT`` bytes, in the task that holds the
   anchor, and compared byte by byte at the end. An anchor with very many different runs is not held by one task: its
   windows are ordered by all their digits in Spark.
"""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.session import cut_lineage

SIZE = 400
ANCHOR = 100
DIGIT = 80
CHUNK = 1 << 20           # window starts that are hashed together
SORTED = 400_000          # windows that are ordered together
HOT_RUNS = 512            # different runs of an anchor up to which one task orders its windows
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, hence invertible modulo 2^64


class Hasher:
    """Polynomial hashes modulo 2^64 of byte strings, from prefix sums; bytes are replaced by random numbers first."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.letters = np.random.default_rng(base % 1000).integers(0, 2**64, 256, dtype=np.uint64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                run = np.full(len(data) + 1, np.uint64(base))
                run[0] = 1
                setattr(self, name, np.multiply.accumulate(run))
        return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(self.letters[data] * self.powers[:len(data)])])

    def strings(self, sums: np.ndarray, size: int) -> np.ndarray:
        """Hash of each run of ``size`` bytes."""
        if len(sums) <= size:
            return np.zeros(0, np.uint64)
        return mixed((sums[size:] - sums[:-size]) * self.inverses[:len(sums) - size])

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes [start, end) of each pair."""
        return mixed((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """Least or largest of each run of ``size`` values: in blocks of that length, from the block's start and from its end."""
    n = len(values)
    if n < size:
        return values[:0]
    rest = -n % size
    blocks = np.concatenate([values, np.repeat(values[-1:], rest)]).reshape(-1, size)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n - size + 1], ahead[size - 1:n])


def pieces(texts: Iterator[tuple[int, bytes]], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, first start, bytes) in lists of about ``CHUNK`` starts; a long text is cut so that each start has its window."""
    held, total = [], 0
    for i, text in texts:
        for at in range(0, len(text) - size + 1, CHUNK):
            piece = text[at:at + CHUNK + size - 1]
            held.append((i, at, piece))
            total += len(piece)
            if total >= CHUNK:
                yield held
                held, total = [], 0
    if held:
        yield held


def runs_of(held: list[tuple[int, int, bytes]], hasher: Hasher, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(piece, anchor, run hash, first start, last start, places) of each run of windows with one anchor.

    ``places`` counts where the anchor's string is selected within the run; more than one if the run repeats itself.
    """
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    lengths = np.array([len(p) for _, _, p in held])
    begin = np.cumsum(lengths) - lengths
    starts = lengths - size + 1
    sums = hasher.prefix(data)
    strings = hasher.strings(sums, anchor)
    wide = size - anchor + 1
    least = sliding(strings, wide, np.minimum)
    inside = np.zeros(len(least) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, np.minimum(begin + starts, len(least)), -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    edge = np.zeros(len(least) + 1, bool)
    edge[1:-1] = least[1:] != least[:-1]
    edge[begin], edge[begin + starts] = True, True
    edge[-1] = True
    cuts = np.flatnonzero(edge)
    lo, hi = cuts[:-1], cuts[1:] - 1
    real = inside[lo]
    lo, hi = lo[real], hi[real]
    value = least[lo]
    none = np.zeros(wide - 1, np.uint64)
    chosen = np.flatnonzero(strings == sliding(np.concatenate([none, np.where(inside, least, 0), none]), wide, np.maximum))
    ranks = np.unique(np.concatenate([value, strings[chosen]]), return_inverse=True)[1]
    n = len(data) + 1
    at = np.sort(ranks[len(value):] * n + chosen)
    own = ranks[:len(value)] * n
    places = np.searchsorted(at, own + hi + wide) - np.searchsorted(at, own + lo)
    piece = np.searchsorted(begin, lo, "right") - 1
    first = np.array([s for _, s, _ in held])[piece] - begin[piece]
    return piece, value, hasher.between(sums, lo, hi + size), lo + first, hi + first, places


RUN = "struct<a:long,c:long,lo:int,hi:int,places:int>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, row, _id, _x): a text is known by two hashes of it, a row of a text by a hash of its id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), F.xxhash64(id_col).alias("row"), F.col(id_col).alias("_id"),
                       text.cast("binary").alias("_x"))


def _texts(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    """(k1, k2, copies, row, runs), one row per different text that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BASES[0])
        for batch in batches:
            column = batch.column(3)
            parts = []
            for held in pieces(((i, column[i].as_py()) for i in range(batch.num_rows)), size):
                piece, *found = runs_of(held, hasher, size, anchor)
                parts.append((np.array([i for i, _, _ in held])[piece], *found))
            if not parts:
                continue
            owner, a, c, lo, hi, places = (np.concatenate(x) for x in zip(*parts))
            cuts = np.r_[0, np.flatnonzero(np.diff(owner)) + 1].astype(np.int64)
            rows = pa.StructArray.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (lo, hi, places)]],
                                              ["a", "c", "lo", "hi", "places"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(owner)].astype(np.int32)), rows)
            whose = pa.array(owner[cuts])
            yield pa.RecordBatch.from_arrays([batch.column(i).take(whose) for i in range(3)] + [lists], names=["k1", "k2", "row", "runs"])

    found = docs.select("k1", "k2", "row", "_x").where(F.octet_length("_x") >= size).mapInArrow(run, f"k1 long, k2 long, row long, runs array<{RUN}>")
    return found.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.first("runs").alias("runs"))


def _runs(texts: DataFrame) -> DataFrame:
    """Runs whose anchor stands in several places, with what the corpus holds of them: ``n`` places of equal bytes, ``m``
    different runs of the anchor, ``places`` of the anchor in all; ``rep`` tells which of equal runs stands for them."""
    each = texts.select("k1", "k2", "row", F.explode("runs").alias("r")).select("k1", "k2", "row", "r.*")
    several = each.groupBy("a").agg(F.sum("places").alias("all")).where(F.col("all") > 1).select("a", "all")
    left = cut_lineage(each.join(several, "a"))
    equal = left.groupBy("a", "c").agg(F.count("*").alias("n"), F.min("k1").alias("rep"))
    different = equal.groupBy("a").agg(F.count("*").alias("m"))
    return cut_lineage(left.join(equal.join(different, "a"), ["a", "c"]))


SHIPPED = "a long, c long, n long, k1 long, k2 long, lo int, hi int, bytes binary, windows array<struct<h1:long,h2:long>>"


def _ship(docs: DataFrame, runs: DataFrame, size: int, hot: int) -> DataFrame:
    """Runs with their bytes, or with the hashes of their windows if the anchor is hot; equal runs may come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [Hasher(b) for b in BASES]
        kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary(), pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())]))]
        names = ["a", "c", "n", "k1", "k2", "lo", "hi", "bytes", "windows"]
        for batch in batches:
            for i in range(batch.num_rows):
                k1, k2, text, own = (batch.column(j)[i].as_py() for j in range(4))
                rows = []
                for r in own:
                    part = text[r["lo"]:r["hi"] + size]
                    hashes = None
                    if r["m"] > hot:
                        data = np.frombuffer(part, np.uint8)
                        both = [h.strings(h.prefix(data), size).view(np.int64).tolist() for h in hashers]
                        part, hashes = None, [{"h1": x, "h2": y} for x, y in zip(*both)]
                    rows.append((r["a"], r["c"], r["n"], k1, k2, r["lo"], r["hi"], part, hashes))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    wanted = runs.where(F.when(F.col("m") > 1, (F.col("n") == 1) | (F.col("k1") == F.col("rep"))).otherwise((F.col("n") == 1) & (F.col("all") > 1)))
    own = wanted.groupBy("k1", "k2", "row").agg(F.collect_list(F.struct("a", "c", "lo", "hi", "n", "m")).alias("own"))
    return docs.select("k1", "k2", "row", "_x").join(own, ["k1", "k2", "row"]).select("k1", "k2", "_x", "own").mapInArrow(run, SHIPPED)


def repeated(rows: list[dict], hasher: Hasher, size: int) -> np.ndarray:
    """Which windows of these runs stand in them more than once; windows of different anchors are never compared.

    Passes from the most significant digit on. After each, windows alone in their group are done.
    """
    raw = b"".join(r["bytes"] for r in rows)
    data = np.frombuffer(raw, np.uint8)
    sums = hasher.prefix(data)
    counts = np.array([r["hi"] - r["lo"] + 1 for r in rows])
    begin = np.cumsum([0, *[len(r["bytes"]) for r in rows[:-1]]])
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    anchors = np.unique(np.array([r["a"] for r in rows]), return_inverse=True)[1]
    live, group = np.arange(len(at)), np.repeat(anchors, counts)
    for depth in range(0, size, DIGIT):
        if not len(live):
            break
        start = at[live] + depth
        digit = hasher.between(sums, start, start + min(DIGIT, size - depth))
        order = np.lexsort((digit, group))
        group, digit, live = group[order], digit[order], live[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        group, live = group[many], live[many]
    out = np.zeros(len(at), bool)
    if not len(live):
        return out
    # Equal hashes are checked by the bytes themselves, each window against the one before it.
    words = np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,))
    one, two = at[live][:-1], at[live][1:]
    same = group[:-1] == group[1:]
    differ = np.zeros(len(one), bool)
    for k in [*range(0, size - 7, 8), max(size - 8, 0)] if size >= 8 else []:
        differ |= words[one + k] != words[two + k]
    for k in range(size if size < 8 else 0):
        differ |= data[one + k] != data[two + k]
    out[live] = True
    wrong = np.unique(group[1:][differ & same])
    for g in wrong.tolist():
        members = live[group == g]
        seen = Counter(raw[at[i]:at[i] + size] for i in members)
        out[members] = [seen[raw[at[i]:at[i] + size]] > 1 for i in members]
    return out


def _within_anchors(shipped: DataFrame, size: int) -> DataFrame:
    """(k1, k2, first, last): repeated windows of the runs that one task orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BASES[1])

        def judge(rows: list[dict]) -> pa.RecordBatch:
            marks, out, at = repeated(rows, hasher, size), [], 0
            for r in rows:
                n = r["hi"] - r["lo"] + 1
                if r["n"] == 1:
                    steps = np.flatnonzero(np.diff(np.r_[0, marks[at:at + n].astype(np.int8), 0]))
                    out += [(r["k1"], r["k2"], r["lo"] + int(a), r["lo"] + int(b) - 1) for a, b in zip(steps[::2], steps[1::2])]
                at += n
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["k1", "k2", "first", "last"])

        closed, open_, windows = [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if open_ and r["a"] != open_[-1]["a"]:
                    closed += open_
                    open_ = []
                    if windows >= SORTED:
                        yield judge(closed)
                        closed, windows = [], 0
                if not (open_ and open_[-1]["c"] == r["c"]):
                    open_.append(r)
                    windows += r["hi"] - r["lo"] + 1
        if closed or open_:
            yield judge(closed + open_)

    cold = shipped.where("bytes IS NOT NULL").drop("windows")
    return cold.repartition("a").sortWithinPartitions("a", "c").mapInArrow(run, "k1 long, k2 long, first int, last int")


def _across_tasks(shipped: DataFrame) -> DataFrame:
    """(k1, k2, first, last): repeated windows of hot anchors, by all their digits at once, counted in Spark."""
    hot = shipped.where("windows IS NOT NULL").dropDuplicates(["a", "c"])
    each = cut_lineage(hot.select("k1", "k2", "n", "lo", F.posexplode("windows").alias("i", "h")).select(
        "k1", "k2", "n", (F.col("lo") + F.col("i")).alias("first"), "h.h1", "h.h2"))
    several = each.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    return each.where("n = 1").join(several, ["h1", "h2"], "left_semi").select("k1", "k2", "first", F.col("first").alias("last"))


def spans(first: np.ndarray, last: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges [from, to) covered by windows that start in these ranges."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(last[order] + size)
    cut = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return list(zip(begin[np.r_[0, cut]].tolist(), end[np.r_[cut, len(end)] - 1].tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, anchor: int | None = None,
                   with_text: bool = False, hot: int = HOT_RUNS) -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, n_spans, kept_sha256; on request ``kept`` bytes and ``ranges``.

    A byte goes when it lies in a string of ``size`` bytes that also starts anywhere else, in the same text too; strings
    overlap, none crosses texts, and all are judged on the input, so no copy stays. NULL texts have no bytes. Rows are
    documents each, whatever their ids: repeated rows, rows without id and rows that share one repeat each other's text.
    ``kept`` may be cut inside a character. Other columns are not looked at; an empty table gives an empty result.
    """
    source = _keyed(docs, id_col, text_col)
    texts = cut_lineage(_texts(source, size, anchor or max(1, min(ANCHOR, size // 4))))
    runs = _runs(texts)
    shipped = cut_lineage(_ship(source, runs, size, hot))
    found = runs.where("n > 1").select("k1", "k2", F.col("lo").alias("first"), F.col("hi").alias("last")).unionByName(
        _within_anchors(shipped, size)).unionByName(_across_tasks(shipped))
    gone = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    copied = texts.where("copies > 1").select("k1", "k2", F.lit(True).alias("copied"))
    decided = gone.join(copied, ["k1", "k2"], "full")
    joined = source.select("k1", "k2", "_id", "_x").join(decided, ["k1", "k2"], "left").select("_id", "_x", "gone", "copied")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text, listed, copied in zip(*(part.column(i) for i in (1, 2, 3))):
                    text = text.as_py()
                    if copied.is_valid:
                        away = [(0, len(text))]
                    elif listed.is_valid:
                        away = spans(*(listed.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)), size)
                    else:
                        away = []
                    kept = b"".join(text[a:b] for a, b in zip([0, *[b for _, b in away]], [*[a for a, _ in away], len(text)]))
                    rows.append((len(text), len(text) - len(kept), len(away), hashlib.sha256(kept).hexdigest(),
                                 *[kept, [{"start": a, "end": b} for a, b in away]][:2 * with_text]))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))][:1 + 2 * with_text]
                names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "ranges"][:len(kinds) + 1]
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, ranges array<struct<start:long,end:long>>" * with_text
    return joined.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def kept_text(kept: Column) -> Column:
    """Kept bytes as text; bytes of a character that was cut become the replacement character."""
    return F.decode(kept, "UTF-8")
