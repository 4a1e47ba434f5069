"""Removed passages against a direct reading of the rule."""
import hashlib
import random
import re

import numpy as np

from cardlens.llm import substring
from conftest import SMALL


def expected(rows, size):
    """id and text pairs to (n_words, n_removed, hash); ids without value come last."""
    rank = lambda i: (i is None, i or 0)
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - size + 1):
            k = tuple(w[p:p + size])
            first[k] = min(first.get(k, rank(i)), rank(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p:p + size])] < rank(i):
                gone.update(range(p, p + size))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (rank(r[0]), r[1:]))


def got(frame):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in frame.collect()), key=lambda r: ((r[0] is None, r[0] or 0), r[1:]))


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    assert got(substring.remove_repeats(docs)) == want
    assert sum(r[2] for r in want) > 0


def test_small_windows_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARE_ROWS", 3)  # common anchors are split over salts
    r = random.Random(4)
    passage = [" ".join(r.choices("abcdefgh", k=r.randint(3, 30))) for _ in range(12)]
    rows = [(r.choice([None, *range(60)]), " ".join(r.choices(passage + ["x y", "\n", "é É", "q\x1cq"], k=r.randint(0, 6)))) for _ in range(150)]
    rows += [(5, None), (None, None), (3, ""), (61, passage[0]), (61, passage[0]), (62, "a " * 4000), (2, "a " * 300)]
    docs = spark.createDataFrame([(*x, 1, "t") for x in rows], "doc_id long, text string, _id int, anchor string")
    assert got(substring.remove_repeats(docs, size=5)) == expected(rows, 5)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_kept_text_and_ranges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x  a b c d e f\ny")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substring.remove_repeats(docs, size=3, with_text=True).collect()}
    assert rows[2]["kept"] == "x y" and [tuple(s) for s in rows[2]["ranges"]] == [(1, 7)]
    assert rows[1]["kept"] == "a b c d e f" and rows[1]["ranges"] == []


def test_rolling():
    r = random.Random(1)
    values = np.array([r.getrandbits(64) for _ in range(40)] * 2, np.uint64)
    windows = substring.rolling(values, 7, substring.BASE)
    assert len(windows) == 74 and (windows[:34] == windows[40:]).all() and len(set(windows[:40].tolist())) == 40
    assert substring.running_min(values, 7).tolist() == [min(values[i:i + 7].tolist()) for i in range(74)]
