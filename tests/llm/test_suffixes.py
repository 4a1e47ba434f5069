"""Removed byte strings against a direct reading of the rule."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cardlens.llm import suffixes as sx
from conftest import SMALL


def expected(rows, size):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p:p + size] for _, b in texts for p in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - size + 1):
            if seen[b[p:p + size]] > 1:
                gone[p:p + size] = True
        gone = gone[:-1] if len(b) else gone[:0]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect()), key=str)


def some_rows(size):
    r = random.Random(size)
    word = lambda n: "".join(r.choices("abcdéf 🙂", k=n))
    shared = [word(r.randint(size // 2, 3 * size)) for _ in range(8)] + ["ab" * size, "x" * (2 * size), word(size)]
    rows = [(r.choice([None, *range(40)]), "".join(r.choice(shared + [word(r.randint(1, size))] * 6) for _ in range(r.randint(0, 5)))) for _ in range(120)]
    rows += [(1, None), (2, ""), (3, shared[0]), (4, shared[0]), (3, shared[0]), (None, "y" * 50 * size), (5, "z" * size), (6, "z" * (size - 1))]
    return rows


@pytest.mark.parametrize("size,anchor,hot,chunk", [(20, None, 512, 1 << 20), (20, 7, 0, 64), (5, 1, 2, 1000), (40, 39, 1, 1 << 20), (100, 25, 3, 300)])
def test_edge_rows(spark, monkeypatch, size, anchor, hot, chunk):
    monkeypatch.setattr(sx, "CHUNK", chunk)
    monkeypatch.setattr(sx, "SORTED", 50)
    monkeypatch.setattr(sx, "DIGIT", 16)
    rows = some_rows(size)
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, row int, runs string")
    assert got(sx.remove_repeats(docs, size=size, anchor=anchor, hot=hot)) == expected(rows, size)
    assert sx.remove_repeats(docs.limit(0), size=size).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()], sx.SIZE)
    assert got(sx.remove_repeats(docs)) == want
    assert sum(r[2] for r in want) > 0


def test_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "A--0123456789--B"), (2, "C0123456789"), (3, "ééé")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sx.remove_repeats(docs, size=8, with_text=True).select("*", sx.kept_text("kept").alias("t")).collect()}
    assert (rows[1]["t"], rows[2]["t"], rows[3]["t"]) == ("A----B", "C", "ééé")
    assert [tuple(s) for s in rows[1]["ranges"]] == [(3, 13)] and rows[3]["ranges"] == []


def test_equal_hashes_are_checked_by_bytes(monkeypatch):
    class Blind(sx.Hasher):
        def between(self, sums, start, end):
            return np.zeros(len(start), np.uint64)

    rows = [{"a": 1, "lo": 0, "hi": 4, "bytes": b"abcdefghijkl"}, {"a": 1, "lo": 0, "hi": 1, "bytes": b"XabcdefgY"}, {"a": 2, "lo": 0, "hi": 0, "bytes": b"abcdefgh"}]
    want = [False] * 8
    assert sx.repeated(rows, sx.Hasher(sx.BASES[0]), 8).tolist() == sx.repeated(rows, Blind(sx.BASES[0]), 8).tolist() == want
    rows[1]["bytes"] = b"XabcdefghY"
    rows[1]["hi"] = 2
    assert sx.repeated(rows, Blind(sx.BASES[0]), 8).tolist() == [True, False, False, False, False, False, True, False, False]


def test_sliding():
    v = np.random.default_rng(0).integers(0, 50, 97)
    for size in (1, 7, 96, 97):
        assert sx.sliding(v, size, np.minimum).tolist() == [v[i:i + size].min() for i in range(98 - size)]
