"""Hits, items and verdicts against a direct reading, with short items and odd rows."""
import hashlib
import random
import re

from cardlens.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, n=13):
    grams = {}
    for item, text in items:
        w = words(text)
        m = min(n, len(w))
        for p in range(len(w) - m + 1) if m else ():
            grams.setdefault(tuple(w[p:p + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(g) for g in grams}:
            for p in range(len(w) - m + 1):
                if tuple(w[p:p + m]) in grams:
                    hit.update(range(p, p + m))
                    found |= {i for i in grams[tuple(w[p:p + m])] if i is not None}
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def make(spark):
    r = random.Random(6)
    vocabulary = "alpha Beta gamma d é1 2 x".split()
    items = [(i, " ".join(r.choices(vocabulary, k=k))) for i, k in enumerate([40, 13, 14, 12, 5, 3, 0, 25, 16, 16])]
    items += [(10, items[0][1]), (11, None), (None, "null item words"), (2, items[2][1])]
    docs = []
    for i in range(80):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 40)))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), (r.choice(items)[1] or "null item words").upper())
        docs.append((i, " -- ".join(parts)))
    docs += [(3, docs[3][1]), (3, "other text"), (None, items[0][1]), (None, None), (90, ""), (91, ("word " * 20000) + items[1][1]), (92, items[0][1] + " x" * 600)]
    return docs, items


def test_against_direct_reading(spark):
    docs, items = make(spark)
    d = spark.createDataFrame([(*x, 0, "k") for x in docs], "doc_id long, text string, length int, gram string")
    i = spark.createDataFrame([(*x, "b") for x in items], "item_id long, text string, hash string")
    want = expected(docs, items)
    assert got(decontaminate.contamination(d, i)) == want
    assert any(w[-1] for w in want) and any(w[2] and not w[-1] for w in want)
    kept = decontaminate.drop_contaminated(d, i)
    assert kept.columns == d.columns
    assert kept.count() == sum(not w[-1] for w in want)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    docs, items = make(spark)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.contamination(d, i)) == expected(docs, items)


def test_empty_tables(spark):
    docs, items = make(spark)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.contamination(d, i.limit(0))) == expected(docs, [])
    assert got(decontaminate.contamination(d.limit(0), i)) == []
