"""Pruned similarity search against all products."""
import math
import random
import re
from collections import Counter

import pytest

from cardlens.operators import text as t
from cardlens.plans import text_queries as tq
from cardlens.sources.model import table

MIDDLE = "/root/testdata/sf0.01"


def brute(chunks, queries, k, min_sim, max_features=500, max_df=0.95):
    """(id, text) lists to sorted (query, chunk, similarity, rank)."""
    def terms(text):
        words = [w for w in re.split(r"[^\w]+", text.lower()) if len(w) > 1]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    counts = {i: terms(x) for i, x in chunks}
    df, total = Counter(w for c in counts.values() for w in c), sum(counts.values(), Counter())
    kept = sorted((w for w in df if df[w] <= len(counts) * max_df), key=lambda w: (-total[w], w))[:max_features]
    idf = {w: math.log((len(counts) + 1) / (df[w] + 1)) + 1 for w in kept}

    def weights(c):
        raw = {w: n * idf[w] for w, n in c.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    index, out = {i: weights(c) for i, c in counts.items()}, []
    for q, text in queries:
        asked = weights(terms(text))
        sims = [(round(sum(x * c[w] for w, x in asked.items() if w in c), 6), i) for i, c in index.items()]
        best = sorted((s for s in sims if s[0] > min_sim), key=lambda s: (-s[0], s[1]))[:k]
        out += [(q, i, s, r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("k,min_sim,rows", [(5, 0.1, 100_000), (1, 0.5, 3), (50, 0.0, 7), (3, 0.95, 100_000)])
def test_same_as_all_products(spark, monkeypatch, k, min_sim, rows):
    monkeypatch.setattr(t, "BAND_ROWS", rows)
    monkeypatch.setattr(t, "CHAMPIONS", 3)
    r = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    line = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    chunks = [(f"c{i:03d}", line(r.randint(1, 30))) for i in range(150)] + [("e", ""), ("n", "zz"), ("same1", "w1 w2 w40"), ("same2", "w1 w2 w40")]
    queries = [(f"q{i}", line(r.randint(1, 12))) for i in range(25)] + [("none", "unknown words"), ("empty", ""), ("same", "w1 w2 w40")]
    frame = spark.createDataFrame(chunks, "chunk_id string, text string")
    vocab, index = t.tfidf_index(frame, max_features=40)
    got = t.retrieve_batch(spark.createDataFrame(queries, "query_id string, text string"), vocab, index, k, min_sim)
    assert sorted((x["query_id"], x["chunk_id"], x["similarity"], x["rank"]) for x in got.collect()) == brute(chunks, queries, k, min_sim, 40)


def test_few_pairs_are_made(spark):
    vocab, index = t.tfidf_index(tq._chunks(spark, MIDDLE), stop_words=tq.STOPS)
    queries = table(spark, MIDDLE, "benchmark").select("item_id", "text").toDF("query_id", "text")
    asked = t._weights(t._counts(queries, "query_id", "text", tq.STOPS), vocab, "query_id").withColumnRenamed("weight", "q")
    pairs = t.open_pairs(asked, vocab, index, 5, 0.1).count()
    assert 0 < pairs < 0.1 * asked.select("query_id").distinct().count() * index.select("chunk_id").distinct().count()


def test_documents_are_read_once(spark):
    vocab, index = t.tfidf_index(tq._chunks(spark, MIDDLE), stop_words=tq.STOPS)
    plan = index._jdf.queryExecution().toString() + vocab._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan


@pytest.mark.parametrize("k,min_sim,parts,queries,at_once", [(5, 0.1, 1 << 18, 1000, 4096), (50, 0.0, 7, 9, 3), (200, 0.2, 64, 20, 100)])
def test_packed_same_as_all_products(spark, monkeypatch, k, min_sim, parts, queries, at_once):
    """Many ties, keys that come in several rows, terms of almost all chunks, a few hash parts, and several passes."""
    monkeypatch.setattr(t, "PARTS", parts)
    monkeypatch.setattr(t, "FIRST_PARTS", int(parts > 16))
    monkeypatch.setattr(t, "QUERIES", queries)
    monkeypatch.setattr(t, "CHUNKS", at_once)
    r = random.Random(k)
    words = ["every", *[f"w{i}" for i in range(60)]]
    line = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(61)], k=n))
    chunks = [(f"c{i:03d}", "every " + line(r.randint(1, 30))) for i in range(150)] + [(f"same{i}", "w1 w2 w40") for i in range(30)] + [("e", ""), ("n", "zz"), ("null", None)]
    asked = [(f"q{i}", line(r.randint(1, 12))) for i in range(25)] + [("none", "unknown words"), ("empty", ""), ("same", "w1 w2 w40")]
    frame = spark.createDataFrame(chunks, "chunk_id string, text string").repartition(5)
    vocab, index = t.tfidf_index(frame, max_features=40, packed=True)
    got = t.retrieve_batch(spark.createDataFrame(asked, "query_id string, text string"), vocab, index, k, min_sim)
    want = brute([(i, x or "") for i, x in chunks], asked, k, min_sim, 40)
    assert sorted((x["query_id"], x["chunk_id"], x["similarity"], x["rank"]) for x in got.collect()) == want
    assert index.count() == t.tfidf_index(frame, max_features=40)[1].select("chunk_id").distinct().count()


def test_rows_of_a_key_are_counted_together(spark):
    """A key that comes in more rows than a batch holds, beside others and a missing one."""
    rows = [("many", "a1 b1")] * 25_000 + [(None, "b1 c1")] * 3 + [("one", "c1 c1 d1"), ("two", "a1")]
    worded = t._words(spark.createDataFrame(rows, "key string, text string").repartition(4), "key", "text", ())
    words = ["a1", "b1", "c1", "a1 b1", "never"]
    found = {x["key"]: dict(zip([words[i] for i in x["at"]], x["tf"])) for x in t._places(worded, "key", words).collect()}
    assert found == {"many": {"a1": 25_000, "b1": 25_000, "a1 b1": 25_000}, None: {"b1": 3, "c1": 3}, "one": {"c1": 2}, "two": {"a1": 1}}


def test_no_text_is_moved(spark, monkeypatch):
    """Of a chunk only numbers of terms move to its key, and postings by term are written nowhere."""
    made = []
    for name in ("cut_lineage", "stored"):
        whole = getattr(t, name)
        monkeypatch.setattr(t, name, lambda df, *a, whole=whole: made.append(df) or whole(df, *a))
    vocab, index = t.tfidf_index(tq._chunks(spark, MIDDLE), stop_words=tq.STOPS, packed=True)
    t.retrieve(tq.QUESTION, vocab, index, stop_words=tq.STOPS)
    assert made and not [df for df in made if "text" in df.columns or "weight" in df.columns]
    places, = (df for df in made if df.columns == ["chunk_id", "at", "tf"])
    moved = re.findall(r"Exchange hashpartitioning\((.*?)\)", places._jdf.queryExecution().executedPlan().toString())
    assert len(moved) == 1 and moved[0].startswith("chunk_id")
