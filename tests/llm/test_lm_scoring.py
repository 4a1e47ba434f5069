"""Scores against a direct count, odd rows, and packing of the exchanged tables."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from cardlens.llm import lm_scoring as lm


def slow(texts, order):
    docs = [[w.decode() for w in lm.split_words(t)] for t in texts]
    grams = [Counter(tuple(d[i:i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1)) for d in docs]
    total = sum(grams, Counter())
    words = sum(map(len, docs))
    out = []
    for d, own in zip(docs, grams):
        s = 0.0
        for i in range(len(d)):
            top = n = min(order, i + 1)
            while n > 1:
                g, c = tuple(d[i - n + 1:i + 1]), tuple(d[i - n + 1:i])
                if total[g] > own[g]:
                    s += math.log(lm.BACKOFF ** (top - n) * (total[g] - own[g]) / (total[c] - own[c]))
                    break
                n -= 1
            else:
                g = (d[i],)
                s += math.log(lm.BACKOFF ** (top - 1) * max(total[g] - own[g], lm.UNSEEN) / max(words - len(d), 1))
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("order,block", [(1, 3), (2, 7), (3, 1000)])
def test_against_direct_count(spark, order, block):
    r = random.Random(order)
    texts = [" ".join(r.choices("a b c d é f g h Ä i. j".split(), k=r.randint(0, 30))) for _ in range(60)]
    texts += [None, "", "  ", "a b " * 3000, texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, level int, keys string")
    rows = {x["doc_id"]: x for x in lm.score(docs, order=order, block_docs=block).collect()}
    assert len(rows) == len(texts)
    for i, (n, s) in enumerate(slow(texts, order)):
        assert rows[i]["n_words"] == n and rows[i]["log_score"] == pytest.approx(s, abs=1e-6)
        assert (rows[i]["mean_log_score"] is None) == (n == 0)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b")] * 3, "doc_id long, text string")
    rows = lm.score(docs).collect()
    assert len(rows) == 3 and {round(r["log_score"], 9) for r in rows} == {round(s, 9) for _, s in slow(["a b"] * 3, 2)}
    assert lm.score(docs.limit(0)).count() == 0


def test_packing():
    r = np.random.default_rng(1)
    for size in (0, 1, 2, 5000):
        keys = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()
    counts = np.array([1, 255, 256, 70000, 1 << 40])
    assert (lm.unpack_counts(lm.pack_counts(counts)) == counts).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_segments_of_long_texts(spark, order):
    """Blocks and segments of some tens of bytes give the same scores, for repeated long rows too."""
    r = random.Random(order)
    texts = [" ".join(r.choices("a b c dd é f g hhh Ä i. j".split(), k=r.randint(0, 90))) for _ in range(30)]
    texts += [None, "", " ., ", "日本語" * 40, texts[0] * 2, texts[0] * 2, "a b " * 300]
    docs = spark.createDataFrame([(7 if i > 33 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    rows = lm.score(docs, order=order, block_bytes=600, segment=40).collect()
    want = sorted((7 if i > 33 else i, n, round(s, 6)) for i, (n, s) in enumerate(slow(texts, order)))
    assert [x[:2] for x in want] == [x[:2] for x in sorted((x["doc_id"], x["n_words"], x["log_score"]) for x in rows)]
    assert [x[2] for x in want] == pytest.approx([x[2] for x in sorted((x["doc_id"], x["n_words"], round(x["log_score"], 6)) for x in rows)], abs=1e-5)


def test_rows_are_bounded_by_text(spark):
    """A few long texts are dealt as many short segments, which lose nothing."""
    pieces = lm.segments(spark.createDataFrame([(i, "ab cd " * 5000) for i in range(20)], "doc_id long, text string"), "doc_id", "text", 2, 4000)
    lengths = [len(x["_x"]) for x in pieces.collect()]
    assert sum(lengths) == 20 * 30000 and max(lengths) <= 4010 and len(lengths) >= 20 * 7
