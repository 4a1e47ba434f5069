"""Packing token sequences: first-fit decreasing in randomised groups of documents.

Texts are tokenised where they lie; what is shuffled are pieces, some tens of bytes each. The rests of documents, at most
one of each and shorter than ``size``, are dealt by hash into groups of some thousands, and each group is packed by itself
with a tournament tree over the space left in its bins. Full pieces fill a sequence each and are only numbered, in groups
that follow the bytes of the texts, so that long documents make more groups and not larger ones.
"""
from __future__ import annotations

import json
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 2048
GROUP = 4096       # pieces a group holds on average
END_ID = 1
CACHE = 500_000    # words, and twice as many of their letter parts, whose ids a worker process keeps
ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: printable bytes stand for themselves, others follow U+00FF."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_encoder(definition: str) -> Callable[[str], bytes]:
    """Text to ids (little-endian 32-bit) for a tokenizer that never joins across blanks and ignores ASCII case.

    Blanks and line feeds split the text exactly there, so ids are kept by word. A word that is not known is taken apart
    once more: ASCII marks behind a final letter are tokens of their own. What is then all Latin letters is one piece to
    the tokenizer's splitter, so it goes straight to the merges of a byte-level model, in lower case.
    """
    from tokenizers import Tokenizer

    # A worker process serves many tasks: what it has met stays known to it, in a module of its own.
    kept = sys.modules.setdefault("_word_encoders", types.ModuleType("_word_encoders"))
    if found := getattr(kept, "by_definition", {}).get(definition):
        return found
    tokenizer = Tokenizer.from_str(definition)
    model, letters = tokenizer.model, byte_letters()
    straight = all(f'"{kind}"' in definition for kind in ("ByteLevel", "Lowercase", "NFC")) and json.loads(definition)["model"]["type"] == "BPE"

    def encode(word: str) -> bytes:
        if straight and word.isalpha() and max(word) <= "\xff":
            ids = [t.id for t in model.tokenize(word.lower().encode().decode("latin-1").translate(letters))]
        else:
            ids = tokenizer.encode(word, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    class Known(dict):
        def __init__(self, find, limit):
            self.find, self.limit = find, limit

        def __missing__(self, word: str) -> bytes:
            if len(self) >= self.limit:
                self.clear()
            ids = self[word] = self.find(word)
            return ids

    parts = Known(encode, 2 * CACHE)

    def split(word: str) -> bytes:
        core = word.rstrip(ASCII_MARKS)
        marks = word[len(core):]
        if not core or not core[-1].isalpha() or "<|" in word:
            return encode(word)
        if max(core) <= "\xff":
            core = core.lower()
        return parts[core] + parts[marks] if marks else parts[core]

    words = Known(split, CACHE)
    kept.by_definition = {definition: lambda text: b"".join(map(words.__getitem__, text.replace("\n", " ").split(" ")))}
    return kept.by_definition[definition]


def cut(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
        with_ids: bool = False) -> DataFrame:
    """(_id, start, length, ids_crc32, doc_tokens, copy[, ids]): the pieces of each document, full ones and the rest.

    ``copy`` counts equal pieces of a task, so that repeated rows are dealt to different groups. NULL and empty texts
    have the end id only. The tokenizer's definition is read by the driver and sent along.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(definition)
        seen: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids_in, texts = batch.column(0).slice(at, 256), batch.column(1).slice(at, 256)
                owner, start, length, crc, total, copy, raw = [], [], [], [], [], [], []
                for i, text in enumerate(texts):
                    ids = encode(text.as_py() or "") + END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    for s in range(0, n, size):
                        piece = ids[4 * s:4 * (s + size)]
                        owner.append(i)
                        start.append(s)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        mark = (crc[-1], s, n)
                        copy.append(seen.get(mark, 0))
                        seen[mark] = copy[-1] + 1
                        if with_ids:
                            raw.append(piece)
                if len(seen) > CACHE:
                    seen.clear()
                columns = [ids_in.take(pa.array(owner, pa.int32()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total, copy)]
                names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]
                if with_ids:
                    columns, names = columns + [pa.array(raw, pa.binary())], names + ["ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, copy long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x")).mapInArrow(run, schema)


def first_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, which must come in falling length. The tree's inner nodes hold the most space below."""
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    space = [size] * (2 * leaves)
    bins, offsets = [], []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if space[node] < length:
                node += 1
        bins.append(node - leaves)
        offsets.append(size - space[node])
        space[node] -= length
        while node > 1:
            node //= 2
            space[node] = max(space[2 * node], space[2 * node + 1])
    return bins, offsets


def pack(pieces: DataFrame, rest_groups: int, full_groups: int, size: int = SIZE) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; each group is one task's small table, packed by itself.

    Ties in length go by start, checksum and then id, so equal input gives equal packing.
    """
    number = F.xxhash64("_id", "start", "ids_crc32", "copy")
    full = F.col("length") == size
    dealt = pieces.withColumn("_group", F.when(full, rest_groups + F.pmod(number, F.lit(full_groups))).otherwise(F.pmod(number, F.lit(rest_groups))))

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        by_id = table.take(pc.sort_indices(table, [("_id", "ascending")]))
        order = np.lexsort([by_id[c].to_numpy() * sign for c, sign in (("ids_crc32", 1), ("start", 1), ("length", -1))])
        table = by_id.take(pa.array(order))
        group = table["_group"][0].as_py()
        if group >= rest_groups:
            bins, offsets = np.arange(table.num_rows), np.zeros(table.num_rows, np.int64)
        else:
            bins, offsets = map(np.array, first_fit_decreasing(table["length"].to_pylist(), size))
        return table.append_column("sequence_id", pa.array((group << 32) + bins, pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64())).drop_columns(["_group"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids`` on request).

    The groups of rests follow the row count, those of full pieces the bytes of the texts, as a token has a byte or more.
    Sequences are gapless from 0; a sequence shorter than ``size`` is to be padded at its end. NULL and empty texts have one
    id, the end; repeated rows are packed each; an empty table gives no pieces; other columns are not looked at.
    """
    rows, weight = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    groups = [max(1, -(-n // GROUP)) for n in (rows, weight // size)]
    packed = pack(cut(docs, tokenizer_path, id_col, text_col, size, with_ids), *groups, size)
    return packed.select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                         *["ids"] * with_ids)


def sequences(packed: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """(sequence_id, ids array of ``size``) from pieces packed with their ids: at most ``size`` ids meet per row."""
    def run(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table["offset"].to_pylist(), table["ids"].to_pylist()))
        ids = np.frombuffer(b"".join(p for _, p in parts), "<u4").astype(np.int64)
        filled = np.concatenate([ids, np.full(size - len(ids), pad, np.int64)])
        return pa.table({"sequence_id": table["sequence_id"][:1], "ids": pa.array([filled.tolist()], pa.list_(pa.int64()))})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(
        run, "sequence_id long, ids array<long>")
