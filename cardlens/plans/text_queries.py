"""Text retrieval over the whole documents table; the benchmark table gives the queries."""
from pyspark.sql import functions as F

from cardlens.operators import text as t
from cardlens.plans.registry import query
from cardlens.sources.model import table

CHUNKS = r"""WITH src AS ({source}), w AS (SELECT doc_id, section, list_filter(string_split_regex(content, '\s+'), lambda x: x <> '') AS ws, content FROM src),
z AS (SELECT *, CASE WHEN len(ws) > 0 THEN greatest(CAST(floor(500::DOUBLE / (CAST(list_sum(list_transform(ws[1:100], lambda x: length(x))) AS DOUBLE) / len(ws[1:100]) + 1)) AS INT), 1) END AS pc FROM w),
sp AS (SELECT *, greatest(pc - CAST(floor(pc * 0.1::DOUBLE) AS INT), 1) AS step FROM z),
win AS (SELECT doc_id, section, unnest(range(0, len(ws), step)) AS s, ws, pc, step FROM sp WHERE len(ws) > 0),
piece AS (SELECT doc_id, section, s // step AS idx, array_to_string(ws[s + 1:s + pc], ' ') AS text FROM win)
"""
GENERIC = CHUNKS.replace("{source}", "SELECT doc_id, 0 AS section, text AS content FROM documents")
INDEX = GENERIC + r""", chunk AS (SELECT doc_id, idx AS section, CAST(doc_id AS VARCHAR) || '_' || idx || '_0' AS chunk_id, text FROM piece),
tk AS (SELECT chunk_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: x NOT IN ('the', 'and', 'of', 'de', 'la', 'der')) AS t FROM chunk),
tm AS (SELECT chunk_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tk),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tm GROUP BY ALL),
nc AS (SELECT count(*) AS n FROM chunk),
vc AS (SELECT term, count(*) AS df, sum(tf) AS total, ln(CAST(any_value(n) + 1 AS DOUBLE) / (count(*) + 1)) + 1 AS idf FROM tf, nc GROUP BY term
  HAVING count(*) <= any_value(n) * 0.95 ORDER BY total DESC, term LIMIT 500),
rw AS (SELECT chunk_id, term, tf * idf AS w FROM tf JOIN vc USING (term)),
ix AS (SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS weight FROM rw)
"""
STOPS = ["the", "and", "of", "de", "la", "der"]


def _docs(spark, d, kind: str):
    return table(spark, d, "documents").select("doc_id", F.lit(kind).alias("type"), F.col("text").alias("content"))


def _chunks(spark, d):
    return t.chunk_key(t.chunk_documents(_docs(spark, d, "text")))


@query("chunk_documents", GENERIC + "SELECT doc_id, 'text' AS type, idx AS section, 0 AS subsection, md5(text) AS text FROM piece")
def _(spark, d):
    return t.chunk_documents(_docs(spark, d, "text")).withColumn("text", F.md5("text"))


@query("chunk_reports", CHUNKS.replace("{source}", r"""SELECT doc_id, s - 1 AS section, CASE WHEN s > 1 THEN '## ' ELSE '' END || parts[s] AS content FROM (
    SELECT doc_id, string_split(replace(text, chr(10), chr(10) || '## '), chr(10) || '## ') AS parts, unnest(range(1, len(parts) + 1)) AS s FROM documents) WHERE trim(parts[s]) <> ''""") + """
SELECT doc_id, 'weekly_report' AS type, section, 0 AS subsection, md5(content) AS text FROM src WHERE length(content) <= 500
UNION ALL SELECT piece.doc_id, 'weekly_report', piece.section, idx, md5(piece.text) FROM piece JOIN src ON piece.doc_id = src.doc_id AND piece.section = src.section WHERE length(content) > 500""")
def _(spark, d):
    docs = _docs(spark, d, "weekly_report").withColumn("content", F.regexp_replace("content", "\n", "\n## "))
    return t.chunk_documents(docs).withColumn("text", F.md5("text"))


@query("chunk_tables", """WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, lines, list_transform(lines, lambda x: length(x)) AS lens, len(lines) AS n FROM l),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS made, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM n
  UNION ALL SELECT doc_id, i + 1, CASE WHEN full_ THEN i - back ELSE first END,
    CASE WHEN full_ THEN coalesce(list_sum(lens[i - back + 1:i]), 0) ELSE size END + lens[i + 1], made + CASE WHEN full_ THEN 1 ELSE 0 END, CASE WHEN full_ THEN first END, CASE WHEN full_ THEN i END
  FROM (SELECT f.*, n.lens, size + lens[i + 1] > 500 AND i > first AS full_, CAST(floor((i - first) * 0.1) AS BIGINT) AS back FROM f JOIN n USING (doc_id) WHERE i < n.n)),
c AS (SELECT doc_id, made - 1 AS section, a, b FROM f WHERE a IS NOT NULL UNION ALL SELECT f.doc_id, made, first, n.n FROM f JOIN n ON f.doc_id = n.doc_id AND f.i = n.n)
SELECT c.doc_id, 'table' AS type, CAST(section AS BIGINT) AS section, CAST(0 AS BIGINT) AS subsection, array_to_string(lines[a + 1:b], chr(10)) AS text FROM c JOIN n USING (doc_id)""")
def _(spark, d):
    return t.chunk_documents(_docs(spark, d, "table"))


@query("tfidf_vocabulary", INDEX + "SELECT term, df, total, round(idf, 6) AS idf FROM vc")
def _(spark, d):
    return t.tfidf_index(_chunks(spark, d), stop_words=STOPS)[0].withColumn("idf", F.round("idf", 6))


@query("tfidf_index", INDEX + "SELECT chunk_id, term, round(weight, 6) AS weight FROM ix")
def _(spark, d):
    return t.tfidf_index(_chunks(spark, d), stop_words=STOPS)[1].withColumn("weight", F.round("weight", 6))


ASKED = r""", qt AS (SELECT query_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: x NOT IN ('the', 'and', 'of', 'de', 'la', 'der')) AS t FROM ({queries})),
qm AS (SELECT query_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM qt),
qw AS (SELECT query_id, term, count(*) * any_value(idf) AS w FROM qm JOIN vc USING (term) GROUP BY query_id, term),
qx AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS q FROM qw),
si AS (SELECT query_id, chunk_id, round(sum(weight * q), 6) AS similarity FROM ix JOIN qx USING (term) GROUP BY ALL),
hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM si WHERE similarity > 0.1 QUALIFY rank <= 5)
"""
BATCH = INDEX + ASKED.replace("{queries}", "SELECT item_id AS query_id, text FROM benchmark")
QUESTION = "is the merchant that he and retitioning ont thon er"


def _hits(spark, d):
    vocab, index = t.tfidf_index(_chunks(spark, d), stop_words=STOPS, packed=True)
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return t.retrieve_batch(queries, vocab, index, stop_words=STOPS)


@query("retrieve_batch", BATCH + "SELECT query_id, chunk_id, similarity, rank FROM hit")
def _(spark, d):
    return _hits(spark, d)


@query("retrieve", INDEX + ASKED.replace("{queries}", f"SELECT 'q' AS query_id, '{QUESTION}' AS text") + "SELECT chunk_id, similarity, rank FROM hit")
def _(spark, d):
    vocab, index = t.tfidf_index(_chunks(spark, d), stop_words=STOPS, packed=True)
    return t.retrieve(QUESTION, vocab, index, stop_words=STOPS)


@query("rank_citations", BATCH + """SELECT query_id, rank AS citation, doc_id || '_' || section AS source_key, similarity AS relevance, substr(text, 1, 100) AS snippet
FROM hit JOIN chunk USING (chunk_id)""")
def _(spark, d):
    return t.rank_citations(_hits(spark, d), _chunks(spark, d))


@query("expand_query", "SELECT item_id, concat_ws(' ', text, " + " ".join(
    f"nullif(CASE WHEN contains(lower(text), '{word}') THEN array_to_string(list_filter({many}, lambda s: NOT contains(lower(text), s)), ' ') END, ''),"
    for word, many in t.SYNONYMS.items()) + """
  CASE WHEN regexp_matches(lower(text), '\\b\\d{4}-\\d{2}-\\d{2}\\b') THEN 'дата период время' END) AS expanded
FROM (SELECT item_id, text || CASE WHEN item_id % 2 = 0 THEN ' Card' ELSE ' 2024-01-05 risk угроза' END AS text FROM benchmark)""")
def _(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", F.concat("text", F.when(F.col("item_id") % 2 == 0, " Card").otherwise(" 2024-01-05 risk угроза")).alias("text"))
    return t.expand_query(asked).select("item_id", "expanded")
