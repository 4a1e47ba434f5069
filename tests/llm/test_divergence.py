"""Divergence of sources against a direct reading of the rule."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cardlens.llm import divergence as dv
from conftest import SMALL


def expected(rows, top=200):
    """(lang, source, text) to result rows."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or "")))
            for lang, source, text in rows]
    held, out = defaultdict(Counter), []
    for lang, _, words in docs:
        held[lang].update(set(words))
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= 3]
        counts = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, words in docs:
            if g == lang:
                counts[s].update(w for w in words if w in set(kept))
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def got(frame):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in frame.collect())


def some_rows():
    r = random.Random(3)
    words = ["the", "The", "café", "x1y", "日本", "wo_rd", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = [(r.choice(["en", "en", "fr", None, ""]), r.choice(["a", "b", None, "c"]), " ".join(r.choices(words, k=r.randint(0, 40)))) for _ in range(120)]
    rows += [("en", "lonely", None), ("zz", "only", "one two"), ("zz", "other", ""), ("en", "a", "the " * 5000), ("en", "b", "q" * 30_000)]
    return rows + rows[:3]


@pytest.mark.parametrize("index_bytes", [dv.INDEX_BYTES, 0])
def test_edge_rows(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(dv, "SHARD_TERMS", (4, 4))
    monkeypatch.setattr(dv, "ENTRIES", 50)
    monkeypatch.setattr(dv, "GROUP_ROWS", dv.GROUP_ROWS if index_bytes else 0)
    rows = some_rows()
    docs = spark.createDataFrame([(*x, 1, "e") for x in rows], "lang string, source string, text string, shard int, counts string")
    assert got(dv.divergence(docs, index_bytes=index_bytes)) == expected(rows)


def test_few_ranks_and_ties(spark):
    rows = [("en", s, t) for s, t in (("a", "one two three four"), ("a", "one two three four"), ("b", "one two three five"), ("b", "five four"), ("b", "four five"))]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(dv.divergence(docs, top=2)) == expected(rows, 2)


def test_empty_and_rare(spark):
    docs = spark.createDataFrame([("en", "a", "x"), ("en", "b", "y")], "lang string, source string, text string")
    assert got(dv.divergence(docs)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert dv.divergence(docs.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got(dv.divergence(docs)) == expected([(r["lang"], r["source"], r["text"]) for r in docs.collect()])


def test_perfect_hash_is_minimal():
    r = np.random.default_rng(1)
    one, two = (r.integers(0, 2**64, 5000, np.uint64) for _ in range(2))
    sizes, bits, slots = dv.perfect_hash(one, two)
    assert sorted(slots.tolist()) == list(range(5000)) and bits.sum() == 5000 and len(bits) == sum(sizes)


def test_scaled_is_exact():
    r = random.Random(2)
    for _ in range(300):
        whole = r.randint(1, 2 * 10**14)
        part = [r.randint(0, whole) for _ in range(5)] + [whole]
        assert dv.scaled(np.array(part, np.int64), whole).tolist() == [10**9 * x // whole for x in part]
