"""Each stage on its own input against a direct reading; the whole run; odd rows."""
import corpus_pipeline
from cardlens.llm import quality, secrets, simhash
from llm.test_decontaminate import expected as contamination
from llm.test_packing import check as check_packing
from llm.test_secrets import expected as base_spans
from llm.test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = dict(text)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        now = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality classifier":
            scores = quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            want = {r["doc_id"] for r in scores if r["predicted"] == 1}
        elif name == "simhash near-dedup":
            want = set(slow_components([(i, slow_fingerprint(t)) for i, t in kept.items()]).values())
        elif name == "benchmark decontamination":
            want = {r[0] for r in contamination(list(kept.items()), items) if not r[-1]}
        else:
            want = set(kept)
            spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
            assert all(base_spans(t) == "" for t in now.values())
            assert all(now[i] == kept[i] for i in now if not spans[i])
        assert set(now) == want
        if name != "secret scan":
            assert all(now[i] == kept[i] for i in now)
        docs, kept = out, now
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(rows, kept)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows)


def test_odd_rows_pass(spark):
    rows = [(None, None, None, None, None, 1)] * 3 + [(1, "", "en", "a", 0, 2), (1, "", "en", "a", 0, 2), (2, "w " * 50000, None, "b", 1, 3), (3, "token=abcdefghij", "de", "c", 2, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text int")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SF).columns == docs.columns
            stage(spark, frame, SF).collect()
        corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len({simhash.fingerprint(r[1]) for r in rows})
