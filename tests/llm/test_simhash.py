"""Fingerprints and links against brute force."""
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cardlens.llm import simhash
from conftest import SMALL


def slow_fingerprint(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, distance=2):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    return {doc: min(x for x in ids[find(i)] if x is not None) for i, (doc, _) in enumerate(rows) if doc is not None}


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect()]
    want = slow_components(rows)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == dict(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_edge_rows(spark):
    rows = [(7, None), (3, ""), (5, "   "), (1, "One"), (1, "One"), (2, "ONE"), (9, "One two"), (None, "One"), (None, "é É x y z"), (8, "a b c " * 20000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, _fp int, node string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (7, 3, 5):
            assert (r["fingerprint"], r["component_id"]) == ("0" * 16, 3)
        if r["doc_id"] in (1, 2):
            assert r["component_id"] == 1
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 8, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_links_lose_nothing(spark):
    r = random.Random(3)
    prints = set()
    for _ in range(60):
        seed = r.getrandbits(64)
        for _ in range(r.randint(1, 40)):
            prints.add(seed)
            for _ in range(r.randint(0, 4)):
                seed ^= 1 << r.randrange(64)
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    frame = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in rows], "_id long, _fp long")
    got = simhash.classes(frame).groupBy("_root").agg(F.collect_set("_id").alias("ids")).collect()
    want = slow_components(rows)
    assert sum(len(g["ids"]) for g in got) == len(rows)
    for g in got:
        assert {want[i] for i in g["ids"]} == {min(g["ids"])}


def test_gray_neighbours(spark):
    rows = spark.range(64).select(F.col("id"), F.col("id").bitwiseXOR(F.shiftrightunsigned("id", 1)).alias("g"))
    assert all(r["rank"] == r["id"] - (1 << 63) for r in rows.withColumn("rank", simhash.gray_rank(F.col("g"))).collect())
