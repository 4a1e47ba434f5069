"""Divergence audit of sources: an exact recount of the vocabulary through sharded minimal perfect hashes.

First pass: document frequencies per (lang, term); the terms that enough documents hold are kept. Kept terms are dealt by
hash into shards, and each shard gets a minimal perfect hash (levels of bit sets, the slot is the rank of the key's bit)
that stores its keys, so that a foreign term is told apart. Second pass: texts are counted per (lang, source), terms turn
into slots where the texts lie, and the task that owns a shard increments the dense slots of its groups. All arithmetic is
in whole numbers.
"""
from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.session import cut_lineage

MIN_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
SHARD_CELLS = 1 << 18             # dense counters of a shard: its terms times the sources of the widest lang
SHARD_TERMS = (64, 32_768)        # least and most terms a shard holds on average
ENTRIES = 400_000                 # distinct counters that a task holds before it writes them out
INDEX_BYTES = 64 << 20            # an index up to this size is sent to all executors, of a larger one each shard stays where it is
GROUP_ROWS = 200_000              # groups up to this number are sent to all executors as a join side
SPREAD = np.uint64(0x9E3779B97F4A7C15)

# Letters of ASCII in lower case, bytes beyond ASCII as they are, blanks for all others.
TERM_BYTES = bytes(b if b >= 128 or chr(b) in string.ascii_lowercase else ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else 32
                   for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, with repeats."""
    return text.translate(TERM_BYTES).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    """The bytes of each string, one at a time."""
    for value in column.cast(pa.binary()):
        yield value.as_py()


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n) from (lang, source, text): in how many documents of the lang the term stands; partial sums per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                terms, numbers = list(counts), list(counts.values())
                for at in range(0, len(terms), 50_000):
                    part = terms[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), _strings(part), pa.array(numbers[at:at + 50_000], pa.int64())],
                                                     names=["lang", "term", "n"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _texts(batch.column(2))):
                seen[lang].update(set(terms_of(text)))
                if sum(map(len, seen.values())) > ENTRIES:
                    yield from flush()
        yield from flush()

    partial = docs.mapInArrow(run, "lang string, term string, n long")
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def hash_pairs(langs: list[str], terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each (lang, term)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    heads = {lang: lang.encode() + b"\x00" for lang in set(langs)}
    keys = [heads[lang] + term for lang, term in zip(langs, terms)]
    return (np.fromiter((digest(k, 1) for k in keys), np.uint64, len(keys)), np.fromiter((digest(k, 2) for k in keys), np.uint64, len(keys)))


def _places(one: np.ndarray, two: np.ndarray, level: int, size) -> np.ndarray:
    """Bit of each key at a level: the second hash, multiplied by the level, moves the first."""
    x = one + two * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(31))) * SPREAD
    return ((x ^ (x >> np.uint64(29))) % np.asarray(size, np.uint64)).astype(np.int64)


def perfect_hash(one: np.ndarray, two: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits per level, the bits, slot of each key) of a minimal perfect hash over keys with these hashes.

    At each level the keys that fall on a bit alone take it; the others go on to the next level of twice their number.
    """
    left = np.arange(len(one))
    sizes, levels, slots, taken = [], [], np.zeros(len(one), np.int64), 0
    while len(left):
        size = 2 * len(left)
        place = _places(one[left], two[left], len(sizes), size)
        alone = np.bincount(place, minlength=size)
        bits = alone == 1
        own = bits[place]
        rank = np.cumsum(bits) - 1
        slots[left[own]] = taken + rank[place[own]]
        taken += int(own.sum())
        sizes.append(size)
        levels.append(bits)
        left = left[~own]
        if len(sizes) > 200:
            raise ValueError("two keys share both hashes")
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool), slots


class Index:
    """Perfect hashes of some shards side by side. ``find`` gives the place of a key among all of them, or -1."""

    def __init__(self, shards: pa.Table, total: int):
        self.total = total
        self.shard = shards["shard"].to_numpy()
        self.row = np.full(total, -1, np.int64)
        self.row[self.shard] = np.arange(len(self.shard))
        self.terms, self.langs = (pa.chunked_array([c.flatten() for c in shards[n].chunks], kind).combine_chunks()
                                  for n, kind in (("terms", pa.binary()), ("langs", pa.string())))
        self.first = np.r_[0, np.cumsum([len(x) for x in shards["langs"]], dtype=np.int64)].astype(np.int64)
        sizes = shards["sizes"].to_pylist()
        self.deepest = max(map(len, sizes), default=0)
        self.size = np.array([s + [0] * (self.deepest - len(s)) for s in sizes], np.int64).reshape(len(sizes), self.deepest)
        flat = self.size.ravel()
        self.offset = (np.cumsum(flat) - flat).reshape(self.size.shape)
        bits = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=sum(s)).astype(bool) for b, s in zip(shards["bits"], sizes)]
        self.rank = np.concatenate([np.where(b, np.cumsum(b) - 1, -1).astype(np.int32) for b in bits] or [np.zeros(0, np.int32)])

    def find(self, lang: str, terms: list[bytes]) -> np.ndarray:
        import pyarrow.compute as pc

        one, two = hash_pairs([lang] * len(terms), terms)
        row = self.row[shard_of(one, self.total)]
        found = np.full(len(terms), -1, np.int64)
        open_ = np.flatnonzero(row >= 0)
        for level in range(self.deepest):
            r = row[open_]
            open_ = open_[self.size[r, level] > 0]
            if not len(open_):
                break
            r = row[open_]
            rank = self.rank[self.offset[r, level] + _places(one[open_], two[open_], level, self.size[r, level])]
            hit = rank >= 0
            found[open_[hit]] = self.first[r[hit]] + rank[hit]
            open_ = open_[~hit]
        some = np.flatnonzero(found >= 0)
        if len(some):  # the stored keys tell members from others that fell on a member's bit
            at = pa.array(found[some])
            same = pc.and_(pc.equal(self.terms.take(at), pa.array([terms[i] for i in some], pa.binary())),
                           pc.equal(self.langs.take(at), pa.scalar(lang)))
            found[some[~same.to_numpy(zero_copy_only=False)]] = -1
        return found


def shard_of(one: np.ndarray, total: int) -> np.ndarray:
    return ((one >> np.uint64(17)) % np.uint64(total)).astype(np.int64)


SHARD_SCHEMA = "shard long, sizes array<int>, bits binary, langs array<string>, terms array<binary>"


def build_index(vocabulary: DataFrame, total: int) -> DataFrame:
    """One row per shard: the levels of its perfect hash and its keys in slot order, from (lang, term)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = hash_pairs(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(one, total)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                                              batch.column(0), batch.column(1).cast(pa.binary())], names=["shard", "one", "two", "lang", "term"])

    def build(table: pa.Table) -> pa.Table:
        one, two = (table[c].to_numpy().view(np.uint64) for c in ("one", "two"))
        sizes, bits, slots = perfect_hash(one, two)
        order = pa.array(np.argsort(slots))
        return pa.table([pa.array([table["shard"][0].as_py()], pa.int64()), pa.array([sizes], pa.list_(pa.int32())), pa.array([np.packbits(bits).tobytes()], pa.binary()),
                         pa.array([table["lang"].take(order).to_pylist()], pa.list_(pa.string())),
                         pa.array([table["term"].take(order).to_pylist()], pa.list_(pa.binary()))], names=["shard", "sizes", "bits", "langs", "terms"])

    placed = vocabulary.select("lang", "term").mapInArrow(place, "shard long, one long, two long, lang string, term binary")
    return placed.groupBy("shard").applyInArrow(build, SHARD_SCHEMA)


COUNT_SCHEMA = "shard long, lang string, source string, slots binary, terms array<binary>, counts binary"


def partial_counts(docs: DataFrame, total: int, index) -> DataFrame:
    """Counts of a task per (shard, lang, source), from (lang, source, text).

    With an ``index`` (a broadcast of all shards) terms become slots here and unknown ones end here; without it the terms
    themselves travel to their shard.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
        known = Index(pa.ipc.open_stream(index.value).read_all(), total) if index is not None else None

        def rows(lang: str, source: str, counts: Counter) -> Iterator[tuple]:
            terms = list(counts)
            numbers = np.fromiter(counts.values(), np.int64, len(terms))
            if known is not None:
                place = known.find(lang, terms)
                order = np.argsort(place)
                order = order[np.searchsorted(place[order], 0):]
                place, numbers = place[order], numbers[order]
                shard = np.searchsorted(known.first, place, "right") - 1
                owner = known.shard[shard]
                slots = (place - known.first[shard]).astype(np.int32)
            else:
                shard = owner = shard_of(hash_pairs([lang] * len(terms), terms)[0], total)
                order = np.argsort(shard, kind="stable")
                shard, owner, numbers = shard[order], owner[order], numbers[order]
            if not len(shard):
                return
            cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if known is not None:
                    yield int(owner[a]), lang, source, slots[a:b].tobytes(), None, numbers[a:b].tobytes()
                else:
                    yield int(owner[a]), lang, source, None, [terms[i] for i in order[a:b]], numbers[a:b].tobytes()

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in seen.items():
                if made := list(rows(lang, source, counts)):
                    columns = list(zip(*made))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                     names=["shard", "lang", "source", "slots", "terms", "counts"])
            seen.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))):
                own = seen[lang, source]
                held -= len(own)
                own.update(terms_of(text))
                held += len(own)
                if held > ENTRIES:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.mapInArrow(run, COUNT_SCHEMA)


CELL_SCHEMA = "shard long, lang string, terms array<binary>, sources array<string>, totals array<long>, counts binary"


def dense_counts(index: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """One row per (shard, lang): its terms, the sources that hold any, their totals and counters (sources x terms).

    The counts of a shard reach its task one by one and are added to the slots of their group; one shard is open at a time.
    """
    parts = index.select("shard", F.lit(0).alias("kind"), "sizes", "bits", "langs", "terms", F.lit(None).cast("string").alias("lang"),
                         F.lit(None).cast("string").alias("source"), F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("binary").alias("counts"))
    more = counts.select("shard", F.lit(1).alias("kind"), F.lit(None).cast("array<int>").alias("sizes"), F.lit(None).cast("binary").alias("bits"),
                         F.lit(None).cast("array<string>").alias("langs"), "terms", "lang", "source", "slots", "counts")

    def close(index: Index, shard: int, groups: dict) -> pa.RecordBatch:
        langs = np.array(index.langs.to_pylist(), object)
        rows = []
        for lang in dict.fromkeys(langs.tolist()):
            own = np.flatnonzero(langs == lang)
            sources = sorted(s for g, s in groups if g == lang)
            cells = np.stack([groups[lang, s][own] for s in sources]) if sources else np.zeros((0, len(own)), np.int64)
            rows.append((shard, lang, index.terms.take(pa.array(own)).to_pylist(), sources, cells.sum(1).tolist(), cells.tobytes()))
        kinds = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          names=["shard", "lang", "terms", "sources", "totals", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, shard, groups = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                if row["kind"].as_py() == 0:
                    if index is not None:
                        yield close(index, shard, groups)
                    shard, groups = row["shard"].as_py(), {}
                    index = Index(pa.Table.from_batches([batch.slice(i, 1)]), total)
                    continue
                if index is None or row["shard"].as_py() != shard:
                    continue  # no term of this shard is kept
                group = row["lang"].as_py(), row["source"].as_py()
                numbers = np.frombuffer(row["counts"].as_py(), np.int64)
                if row["slots"].is_valid:
                    slots = np.frombuffer(row["slots"].as_py(), np.int32)
                else:
                    slots = index.find(group[0], row["terms"].as_py())
                    slots, numbers = slots[slots >= 0], numbers[slots >= 0]
                if len(slots):
                    if group not in groups:
                        groups[group] = np.zeros(len(index.terms), np.int64)
                    groups[group][slots] += numbers  # a slot stands once in a row
        if index is not None:
            yield close(index, shard, groups)

    return parts.unionByName(more).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, CELL_SCHEMA)


def scaled(part: np.ndarray, whole: int) -> np.ndarray:
    """floor(SCALE * part / whole) for whole numbers with part <= whole, without leaving 64 bits: division in two steps.

    Exact up to a whole of 2.8e14, which is more terms than 100 TB of text hold.
    """
    step = 31_250
    whole = np.int64(whole)
    units, rest = part // whole, part % whole
    high, rest = (rest * step) // whole, (rest * step) % whole
    return units * SCALE + high * (SCALE // step) + (rest * (SCALE // step)) // whole


def best(found: list[tuple[int, bytes]], top: int) -> list[tuple[int, bytes]]:
    return sorted(found, key=lambda x: (-x[0], x[1]))[:top]


def scores(cells: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value): partial sums of the pairs and the best terms of each task.

    Rows of ``cells`` carry ``v``, the lang's number of terms, and ``groups``, all its sources with their totals.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "part", "item", "value"]
        pairs: dict[str, tuple[list[str], np.ndarray]] = {}
        terms: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (sources, sums) in pairs.items():
                for i, source in enumerate(sources):
                    others = [s for s in sources if s != source]
                    values = np.delete(sums[i], i)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(others), pa.string()), pa.array([source] * len(others), pa.string()),
                                                      pa.array(["pair"] * len(others), pa.string()), pa.array(others, pa.string()), pa.array(values)], names=names)
            for (lang, source), found in terms.items():
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([source] * len(found)), pa.array(["term"] * len(found)),
                                                      _strings([t for _, t in found]), pa.array([v for v, _ in found], pa.int64())], names=names)
            pairs.clear()
            terms.clear()

        for batch in batches:
            for lang, words, held, raw, v, groups in zip(*(batch.column(i) for i in range(6))):
                lang, words, held, v, groups = lang.as_py(), words.as_py(), held.as_py(), v.as_py(), groups.as_py()
                sources = [g["source"] for g in groups]
                cells = np.zeros((len(sources), len(words)), np.int64)
                if held:
                    at = {s: i for i, s in enumerate(sources)}
                    cells[[at[s] for s in held]] = np.frombuffer(raw.as_py(), np.int64).reshape(len(held), -1)
                whole = [g["total"] for g in groups]
                p = np.stack([1 + scaled(row + 1, n + v) for row, n in zip(cells, whole)])
                q = 1 + scaled(cells.sum(0) + 1, sum(whole) + v)
                if lang not in pairs:
                    pairs[lang] = sources, np.zeros((len(sources), len(sources)), np.int64)
                sums = pairs[lang][1]
                for i in range(len(sources)):
                    sums[i] += ((p[i] - p) ** 2 // p).sum(1)
                    good = np.flatnonzero((cells[i] > 0) & (p[i] > q))
                    value = (p[i, good] - q[good]) ** 2 // q[good]
                    if len(good) > top:
                        good, value = (x[value >= np.partition(value, -top)[-top]] for x in (good, value))
                    new = [(int(n), words[k]) for n, k in zip(value, good)]
                    terms[lang, sources[i]] = best(terms.get((lang, sources[i]), []) + new, top)
                if sum(s.size for _, s in pairs.values()) + sum(map(len, terms.values())) > 20 * ENTRIES:
                    yield from flush()
        yield from flush()

    given = cells.select("lang", "terms", "sources", "counts", "v", "groups")
    return given.mapInArrow(run, "lang string, source string, part string, item string, value long")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a lang lies from the others, and by which terms.

    A term is a run of ASCII letters, in lower case, and of characters beyond ASCII. Each lang keeps the terms that stand in
    ``min_documents`` of its documents. Part ``pair`` has all other sources of the lang; part ``term`` the ``top`` kept
    terms that a source holds more often than its lang; values are whole-number chi-squared distances. NULL text, lang and
    source read as ''. Repeated rows are documents each; ids are not looked at, nor are other columns. Ties rank by the
    item's UTF-8. A source without any kept term takes part with zero counts; a lang without kept terms has pairs of value
    0. An empty table gives no rows. The pairs are sources x sources per lang, as the result asks for them.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                          for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    vocabulary = cut_lineage(document_frequencies(texts).where(F.col("n") >= min_documents).select("lang", "term"))
    groups = cut_lineage(texts.select("lang", "source").distinct())
    widest = groups.groupBy("lang").count().agg(F.max("count"), F.sum("count")).first()
    kept = vocabulary.agg(F.count("*"), F.sum(F.octet_length("term") + F.octet_length("lang") + 16)).first()
    per_shard = min(max(SHARD_CELLS // (widest[0] or 1), SHARD_TERMS[0]), SHARD_TERMS[1])
    total = max(1, -(-kept[0] // per_shard))
    index = cut_lineage(build_index(vocabulary, total))
    sent = None
    if (kept[1] or 0) <= index_bytes:
        sent = docs.sparkSession.sparkContext.broadcast(_stream(index.toArrow()))
    cells = cut_lineage(dense_counts(index, partial_counts(texts, total, sent), total))
    if sent is not None:
        sent.unpersist()
    totals = cells.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(
        F.sum("e.totals").alias("total"))
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    langs = cut_lineage(groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("source", "total"))).alias("groups")).join(sizes, "lang", "left").na.fill(0, ["v"]))
    few = (widest[1] or 0) <= GROUP_ROWS
    ready = cells.join(F.broadcast(langs) if few else langs, "lang")
    bare = langs.where("v = 0").select("lang", "v", "groups")
    pairs_of_bare = bare.select("lang", F.explode("groups.source").alias("source"), "groups").select(
        "lang", "source", F.lit("pair").alias("part"), F.explode("groups.source").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    found = scores(ready, top)
    summed = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(pairs_of_bare)
    order = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = summed.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
