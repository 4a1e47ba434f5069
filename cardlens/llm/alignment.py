"""Alignment of two tokenizers: which tokens of one cover which tokens of the other, and which pairs the corpus prefers.

Each batch is tokenised by both, every token gets the bytes it stands for, and two ordered joins (pandas ``merge_asof``,
keyed by document) find for each token start the covering token of the other side. The union of both directions is the set
of overlaps; overlaps with equal ends cut a text into groups. A second pass reads how many documents hold each pair of
linked ids: the most frequent pairs are looked up where the documents lie, the rest, each of which few documents hold, are
joined by a shuffle.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.llm.packing import byte_letters
from cardlens.session import checkpoint_dir

UNITS = 300_000          # units of text whose ids a worker process keeps
TOGETHER = 2_000         # new units that are tokenised as one text
CHUNK_BYTES = 1 << 20    # text that is aligned together
SENT_PAIRS = 2_000_000   # most frequent id pairs that are sent to all executors, 24 bytes each
BLANK = "▁"         # fixed value: what stands for a space in the pieces of the second tokenizer
INSIDE = re.compile(r"(?<=\S)(?= )")
APART = re.compile(r" \s|\s ")


class Pair:
    """Both tokenizers. ``ids`` gives the ids of a unit of text for either, or None where they do not give back its bytes.

    A unit is a text, or the part of one from a space behind a visible character up to the next such place. Neither
    tokenizer joins across such a place if the first splits by the byte-level rule and no piece of the second has a space
    behind another character; else the whole text is the unit.
    """

    def __init__(self, definition: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(definition)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = {letter: byte for byte, letter in byte_letters().items()}
        names = [self.first.id_to_token(i) or "" for i in range(self.first.get_vocab_size())]
        self.first_bytes = [bytes(plain[c] for c in t) if all(c in plain for c in t) else t.encode() for t in names]
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.first_lengths, self.second_lengths = (np.array([len(x) for x in table], np.int64) for table in (self.first_bytes, self.second_bytes))
        rules = json.loads(definition)
        split = rules.get("pre_tokenizer") or {}
        self.cut = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not rules.get("normalizer")
                    and not any(BLANK in p.lstrip(BLANK) for p in pieces) and self.second.normalize("a  b ﬁ ") == "a  b ﬁ ".replace(" ", BLANK).join([BLANK, ""]))
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def units(self, text: str) -> list[str]:
        """The text in units, each without its first space; the text itself is read with a space before it."""
        if not self.cut:
            return [text]
        if APART.search(text) or text[:1].isspace():
            return [u[1:] for u in INSIDE.split(" " + text)]
        return text.split(" ")

    def learn(self, units: set[str]) -> None:
        """Ids of units not met yet. Units that end visibly are read side by side as one text and told apart by their bytes."""
        if len(self.known) > UNITS:
            self.known.clear()
        new = [u for u in units if u not in self.known]
        joined = [u for u in new if u and not u[-1].isspace() and BLANK not in u] if self.cut else []
        for at in range(0, len(joined), TOGETHER):
            self._learn_joined(joined[at:at + TOGETHER])
        for unit in new:
            if unit not in self.known:
                a = self.first.encode(" " + unit, add_special_tokens=False).ids
                b, whole = self.second.encode(unit) if unit else [self.second.piece_to_id(BLANK)], (" " + unit).encode()
                good = b"".join(map(self.first_bytes.__getitem__, a)) == whole == b"".join(map(self.second_bytes.__getitem__, b))
                self.known[unit] = (np.asarray(a, np.int32).tobytes(), np.asarray(b, np.int32).tobytes()) if good else None

    def _learn_joined(self, units: list[str]) -> None:
        text = " ".join(units)
        whole = (" " + text).encode()
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        parts = []
        for ids, table, lengths in ((self.first.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.first_bytes, self.first_lengths),
                                    (self.second.encode(text), self.second_bytes, self.second_lengths)):
            ids = np.asarray(ids, np.int32)
            token_ends = np.cumsum(lengths[ids])
            last = np.searchsorted(token_ends, ends)
            if b"".join(map(table.__getitem__, ids.tolist())) != whole or (token_ends[last] != ends).any():
                return  # each is read alone
            raw, cuts = ids.tobytes(), (4 * np.r_[0, last + 1]).tolist()
            parts.append([raw[x:y] for x, y in zip(cuts[:-1], cuts[1:])])
        self.known.update(zip(units, zip(*parts)))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(which texts have tokens, ids and their numbers per such text for the first, the same for the second)."""
        split = [self.units(t) for t in texts]
        self.learn({u for units in split for u in units})
        usable, firsts, seconds, n_first, n_second = [], [], [], [], []
        for i, units in enumerate(split):
            found = list(map(self.known.__getitem__, units))
            if None in found:
                continue
            usable.append(i)
            a, b = b"".join([f for f, _ in found]), b"".join([s for _, s in found])
            firsts.append(a)
            seconds.append(b)
            n_first.append(len(a) // 4)
            n_second.append(len(b) // 4)
        return (np.array(usable, np.int64), np.frombuffer(b"".join(firsts), np.int32), np.array(n_first, np.int64),
                np.frombuffer(b"".join(seconds), np.int32), np.array(n_second, np.int64))


def pair_of(definition: str, model: bytes) -> Pair:
    """A worker process serves many tasks: it loads the tokenizers once, and what it has met stays known to it."""
    kept = sys.modules.setdefault("_aligned_tokenizers", types.ModuleType("_aligned_tokenizers"))
    mark = hashlib.sha256(definition.encode() + model).hexdigest()
    if getattr(kept, "mark", None) != mark:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        kept.mark, kept.pair = mark, Pair(definition, model)
    return kept.pair


def groups(doc_a: np.ndarray, start_a: np.ndarray, end_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side, numbered alike on both, from byte ranges that ascend over all documents."""
    a = pd.DataFrame({"doc": doc_a, "start": start_a, "a": np.arange(len(doc_a))})
    b = pd.DataFrame({"doc": doc_b, "start": start_b, "b": np.arange(len(doc_b))})
    over = pd.concat([pd.merge_asof(a, b, on="start", by="doc")[["a", "b"]], pd.merge_asof(b, a, on="start", by="doc")[["a", "b"]]])
    i, j = over["a"].to_numpy(), over["b"].to_numpy()
    ends = end_a[i] == end_b[j]
    cut_a, cut_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    cut_a[i[ends]], cut_b[j[ends]] = 1, 1
    return np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b


def links(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc_of: np.ndarray, width: int,
          block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair key, links): how often each document links each id pair, ordered by document and key.

    A group of n and m tokens makes n times m links; groups that would make more than ``block`` are counted by different ids.
    """
    number = len(doc_of)
    n_a, n_b = np.bincount(group_a, minlength=number), np.bincount(group_b, minlength=number)
    first_b = np.cumsum(n_b) - n_b
    found = []

    def add(group: np.ndarray, key: np.ndarray, times: np.ndarray | None) -> None:
        """Counts of equal (document, key); keys are below 2^40, documents of a chunk below 2^23."""
        both = (doc_of[group] << 40) | key
        both, at, count = np.unique(both, return_inverse=True, return_counts=True)
        found.append((both, count if times is None else np.bincount(at, times).astype(np.int64)))

    wide = n_a * n_b > block
    token = np.flatnonzero(~wide[group_a])
    per_token = n_b[group_a[token]]
    cuts = np.searchsorted(np.cumsum(per_token), np.arange(block, per_token.sum() + block, block))
    for lo, hi in zip([0, *cuts], [*cuts, len(token)]):
        t, n = token[lo:hi], per_token[lo:hi]
        if not len(t):
            continue
        own = np.repeat(t, n)
        other = np.repeat(first_b[group_a[t]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        add(group_a[own], ids_a[own].astype(np.int64) * width + ids_b[other], None)
    for g in np.flatnonzero(wide):
        x, nx = np.unique(ids_a[group_a == g], return_counts=True)
        y, ny = np.unique(ids_b[group_b == g], return_counts=True)
        rows = max(1, block // len(y))
        for at in range(0, len(x), rows):
            key = (x[at:at + rows, None].astype(np.int64) * width + y).ravel()
            add(np.full(len(key), g), key, (nx[at:at + rows, None] * ny).ravel())
    if not found:
        return (np.zeros(0, np.int64),) * 3
    both, at = np.unique(np.concatenate([b for b, _ in found]), return_inverse=True)
    times = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
    return both >> 40, both & ((1 << 40) - 1), times


def digests(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, tokens: np.ndarray,
            names: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Per document the SHA-256 of its groups written as ``a1,a2|b1;a3|b2,b3``. ``names`` hold each id with the mark that
    stands within a group, and behind those each id with the mark at the end of its side."""
    number = int(group_a[-1]) + 1 if len(group_a) else 0
    n_a, n_b = np.bincount(group_a, minlength=number), np.bincount(group_b, minlength=number)
    written = np.empty(len(ids_a) + len(ids_b), object)
    place_a = np.arange(len(ids_a)) + (np.cumsum(n_b) - n_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(n_a)[group_b]
    for place, ids, n, table in ((place_a, ids_a, n_a, names[0]), (place_b, ids_b, n_b, names[1])):
        which = ids.astype(np.int64)
        which[np.cumsum(n) - 1] += len(table) // 2
        written[place] = table[which]
    ends = np.cumsum(tokens)
    parts = written.tolist()
    return [hashlib.sha256("".join(parts[e - n:e])[:-1].encode()).hexdigest() for e, n in zip(ends.tolist(), tokens.tolist())]


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<int>"


def align(docs: DataFrame, definition: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times): each document's links, without corpus counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        pair = pair_of(definition, model)
        lengths = pair.first_lengths, pair.second_lengths
        names = tuple(np.array([f"{i}{mark}" for mark in (",", end) for i in range(len(t))], object) for t, end in zip(lengths, "|;"))
        width = len(pair.second_bytes)

        def part(rows: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in rows.column(1).to_pylist()]
            some = np.array([i for i, t in enumerate(texts) if t], np.int64)
            usable, ids_a, n_a, ids_b, n_b = pair.ids([texts[i] for i in some])
            whose = some[usable]
            n = len(texts)
            counts = np.zeros((4, n), np.int64)
            sums, key_ends = [""] * n, np.zeros(n, np.int64)
            keys = times = np.zeros(0, np.int64)
            if len(whose):
                doc_a, doc_b = np.repeat(whose, n_a), np.repeat(whose, n_b)
                end_a, end_b = np.cumsum(lengths[0][ids_a]), np.cumsum(lengths[1][ids_b])
                group_a, group_b = groups(doc_a, end_a - lengths[0][ids_a], end_a, doc_b, end_b - lengths[1][ids_b], end_b)
                first = np.flatnonzero(np.r_[True, group_a[1:] != group_a[:-1]])
                doc_of = doc_a[first]
                product = np.bincount(group_a) * np.bincount(group_b)
                counts[0, whose], counts[1, whose] = n_a, n_b
                counts[2] = np.bincount(doc_of, minlength=n)
                np.add.at(counts[3], doc_of, product)
                for i, digest in zip(whose.tolist(), digests(ids_a, ids_b, group_a, group_b, n_a + n_b, names)):
                    sums[i] = digest
                owner, keys, times = links(ids_a, ids_b, group_a, group_b, doc_of, width)
                key_ends = np.bincount(owner, minlength=n)
            offsets = pa.array(np.r_[0, np.cumsum(key_ends)].astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [rows.column(0), *[pa.array(c) for c in counts], pa.array(sums), pa.ListArray.from_arrays(offsets, pa.array(keys)),
                 pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                names=["_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            chunk = np.cumsum(sizes) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    yield part(batch.slice(a, b - a))

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_x")).mapInArrow(run, f"_id {kind}, {ALIGNED}")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(key, n, best): how many documents link each id pair, and whether no pair of its first id is linked by more."""
    counts = aligned.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    first = F.expr(f"key div {width}")
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("a", first).join(most, "a")
    return joined.select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text",
              sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """One row per document row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The first tokenizer (a) is byte-level and reads a space and the text, the second (b) has pieces with byte fallback and
    adds the space itself; special tokens are neither added nor read. Groups lie between bytes where tokens of both end.
    Links are all pairs of an a and a b token of one group. The count of a pair of ids is the number of documents that
    link it, repeated rows counted each; ``n_best`` are the links whose count no other pair of the same a id exceeds,
    ``count_sum`` adds the counts up over the links. Texts that are NULL or empty, or that either tokenizer does not give
    back byte by byte, have no tokens: zeros, and ''. The ids of documents only label rows. Other columns are not looked
    at; an empty table gives no rows. Tokens, links and counts are written once to the shared folder and read from there.
    """
    with open(byte_level_path, encoding="utf-8") as file:
        definition = file.read()
    with open(pieces_path, "rb") as file:
        model = file.read()
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    width = Pair(definition, model).second.get_piece_size()
    align(docs, definition, model, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()).write.option(
        "compression", "zstd").parquet(f"{folder}/documents")
    aligned = spark.read.parquet(f"{folder}/documents")
    pair_counts(aligned, width).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    frequent, all_sent = most_frequent(pairs, sent_pairs)
    sent = spark.sparkContext.broadcast(frequent)
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(sent.value).read_all()
        known, n, best = (table[c].to_numpy() for c in ("key", "n", "best"))
        for batch in batches:
            lists, times = batch.column("keys"), batch.column("times").flatten().to_numpy()
            keys = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            found = known[place] == keys if len(known) else np.zeros(len(keys), bool)
            total, good = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            at, own, weight = place[found], owner[found], times[found].astype(np.int64)
            np.add.at(total, own, n[at] * weight)
            np.add.at(good, own, best[at] * weight)
            rest = np.bincount(owner[~found], minlength=batch.num_rows) if len(keys) else np.zeros(batch.num_rows, np.int64)
            offsets = pa.array(np.r_[0, np.cumsum(rest)].astype(np.int32))
            open_ = pa.StructArray.from_arrays([pa.array(keys[~found]), pa.array(times[~found])], ["key", "times"])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("_row", "_id", *names)] + [pa.array(good), pa.array(total), pa.ListArray.from_arrays(offsets, open_)],
                                             names=["_row", "_id", *names, "n_best", "count_sum", "open"])

    kind = dict(docs.dtypes)[id_col]
    looked = aligned.mapInArrow(run, f"_row long, _id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, "
                                     "count_sum long, open array<struct<key:long,times:int>>")
    if not all_sent:
        each = looked.select("_row", F.explode("open").alias("o")).select("_row", "o.*").join(pairs, "key")
        more = each.groupBy("_row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        looked = looked.drop("open").join(more, "_row", "left").withColumns({
            "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    return looked.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def most_frequent(pairs: DataFrame, limit: int) -> tuple[bytes, bool]:
    """An Arrow stream of (key, n, best) by key of the pairs above a count, at most ``limit`` of them, and whether that is all.

    The count is found from how many pairs have each count, one row per different count and above a power of two only
    one, so ties of the border count stay out together.
    """
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.expr("shiftleft(1L, length(bin(n)) - 1)"))
    steps = pairs.groupBy(level.alias("level")).count().withColumn("above", F.sum("count").over(W.orderBy(F.col("level").desc())))
    least = steps.where(F.col("above") <= limit).agg(F.min("level")).first()[0]
    whole = steps.agg(F.max("above")).first()[0] or 0
    chosen = pairs.where(F.col("n") >= (least if least is not None else 0)) if least is not None else pairs.limit(0)
    table = chosen.select("key", "n", F.col("best").cast("long").alias("best")).toArrow().sort_by("key").combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes(), whole <= limit
