"""Packing: ids as the tokenizer gives them, each id in one piece, gapless sequences, little padding."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cardlens.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts):
    tokenizer = Tokenizer.from_file(PATH)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            part = np.asarray(ids[at:at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    used = padding = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE
        used += at
        padding += 0 if at & (at - 1) == 0 else packing.SIZE - at
    return used, padding


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, PATH).collect()
    used, padding = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert padding < 0.02 * used


def test_odd_texts(spark):
    r = random.Random(2)
    odd = ["", None, " ", "\n\n a  b\t\r\nc", "It's the dog's, we'll see'", "...", "x…. y", "É̀tat. ÉTAT, é. a̸.", "ΣΑΣ Σ. İSTANBUL ſ K", "<|endoftext|> a<|startoftext|>.b <|endoftext|>,",
           "１２３ 123abc4.5,6", "日本語。テスト! 日本語!!", "emoji😀😀!! x😀.", "a b c\x1cd\x85e", "don't!!' can't'.", "word " * 5000, "x" * 3000, "'s 's' s's.", "≠ ≮.", "_a_ b_ _", "«oui», non».", "ÀÉÎÕÜß Æø. ŸÿªºµÐÞ straße ﬁn Ĳ ĳ."]
    letters = "aZéÀÿµª'.!,<|> \n9ß̸́日-_"
    odd += ["".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(800)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(odd)], "doc_id long, text string, length int, ids string")
    check(packing.pack_documents(docs, PATH).collect(), dict(enumerate(odd)))


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "one two")] * 3 + [(4, "one two")] * 5, "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH).collect()
    assert len(rows) == 8
    places = [(r["sequence_id"], r["offset"]) for r in rows]
    assert len(set(places)) == 8
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_long_documents_make_groups_and_not_large_ones(spark, monkeypatch):
    """Three hundred texts, some of exactly a whole number of sequences, with groups of some 64 pieces."""
    monkeypatch.setattr(packing, "GROUP", 64)
    r = random.Random(7)
    texts = {i: "word " * (r.choice([2047, 4095, 2048, 9000, 30]) if i % 3 else r.randint(0, 12000)) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(docs, PATH).collect()
    used, padding = check(rows, texts)
    assert padding < 0.05 * used
    full = defaultdict(list)
    for row in rows:
        full[row["sequence_id"] >> 32].append(row["length"])
    rests = [g for g, n in full.items() if packing.SIZE not in n]
    assert len(rests) <= 5 and max(rests) < min(set(full) - set(rests))
    assert all(set(n) == {packing.SIZE} for g, n in full.items() if g not in rests) and max(map(len, full.values())) < 160


def test_sequences_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    packed = packing.pack_documents(docs, PATH, with_ids=True).cache()
    rows = packing.sequences(packed, pad=49407).collect()
    assert len(rows) == packed.select("sequence_id").distinct().count()
    whole = {r["sequence_id"]: r["ids"] for r in rows}
    for p in packed.collect():
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert whole[p["sequence_id"]][p["offset"]:p["offset"] + p["length"]] == ids
    assert all(len(x) == packing.SIZE for x in whole.values())


def test_first_fit():
    assert packing.first_fit_decreasing([6, 5, 5, 4], 10) == ([0, 1, 1, 0], [0, 0, 5, 6])
    assert packing.first_fit_decreasing([7], 10) == ([0], [0])
