"""The registered queries of this subpackage and the SQL that each must agree with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


@query("op9_decontaminate", f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS m FROM (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, m, array_to_string(w[p + 1:p + m], ' ') AS gram
      FROM (SELECT item_id, m, w, unnest(range(0, len(w) - m + 1)) AS p FROM b)),
x AS (SELECT doc_id, m, p, array_to_string(w[p + 1:p + m], ' ') AS gram
      FROM (SELECT doc_id, w, m, unnest(range(0, greatest(len(w) - m + 1, 0))) AS p FROM d, (SELECT DISTINCT m FROM g))),
h AS (SELECT x.doc_id, x.m, x.p, g.item_id FROM x JOIN g ON x.m = g.m AND x.gram = g.gram),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardlens.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardlens.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardlens.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardlens.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op6_repeats", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS q FROM d),
x AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 50], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS p FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
r AS (SELECT DISTINCT doc_id, q FROM (SELECT x.doc_id, unnest(range(p, p + 50)) AS q FROM x JOIN f USING (g) WHERE x.doc_id > first)),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.q) AS kept FROM t ANTI JOIN r USING (doc_id, q) GROUP BY t.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardlens.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardlens.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_vector_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cardlens.llm.vector_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_licences")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardlens.llm.licenses import licences

    return licences(table(spark, sf_dir, "documents"))


@query("op8_lm_scoring", f"""
WITH t AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)),
b AS (SELECT doc_id, p, w, lag(w) OVER (PARTITION BY doc_id ORDER BY p) AS v FROM t),
n AS (SELECT count(*) AS n FROM t),
l AS (SELECT doc_id, count(*) AS l FROM t GROUP BY doc_id),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
ud AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY doc_id, w),
g AS (SELECT v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY v, w),
gd AS (SELECT doc_id, v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY doc_id, v, w),
s AS (SELECT b.doc_id, CASE
        WHEN b.v IS NULL THEN ln(greatest(u.c - ud.c, 0.5) / greatest(n.n - l.l, 1))
        WHEN g.c > gd.c THEN ln((g.c - gd.c) / (x.c - xd.c))
        ELSE ln(0.4) + ln(greatest(u.c - ud.c, 0.5) / greatest(n.n - l.l, 1)) END AS s
      FROM b CROSS JOIN n JOIN l USING (doc_id) JOIN u ON u.w = b.w JOIN ud ON ud.doc_id = b.doc_id AND ud.w = b.w
      LEFT JOIN g ON g.v = b.v AND g.w = b.w LEFT JOIN gd ON gd.doc_id = b.doc_id AND gd.v = b.v AND gd.w = b.w
      LEFT JOIN u x ON x.w = b.v LEFT JOIN ud xd ON xd.doc_id = b.doc_id AND xd.w = b.v)
SELECT d.doc_id, coalesce(k, 0) AS n_words, coalesce(round(s, 3), 0.0) AS log_score, round(s / k, 6) AS mean_log_score
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS k, sum(s) AS s FROM s GROUP BY doc_id) USING (doc_id)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cardlens.llm.lm_scoring import score

    scored = score(table(spark, sf_dir, "documents"))
    return scored.withColumns({"log_score": F.round("log_score", 3), "mean_log_score": F.round("mean_log_score", 6)})


# The tables hold plain messages only; linking of calls is tested on fixtures against a direct reading.
@query("op5_tool_calls", """
SELECT conv_id, turn AS at, CAST(-1 AS INTEGER) AS level, CAST(0 AS INTEGER) AS seq, CAST(0 AS INTEGER) AS part, turn, 'message' AS kind,
  CAST(NULL AS VARCHAR) AS call_id, 'ok' AS status,
  '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS line
FROM (SELECT conv_id, coalesce(turn, -1) AS turn, role, text FROM conversations)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardlens.llm.tool_calls import link

    return link(table(spark, sf_dir, "conversations"))


@query("op11_divergence", r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, r, w AS term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS w FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT g.lang, g.source, coalesce(n.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) g
      LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) n USING (lang)),
o AS (SELECT lang, source, term, sum(n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT v.lang, v.source, k.term, v.v, coalesce(o.n, 0) AS n
      FROM v JOIN k ON k.lang = v.lang LEFT JOIN o ON o.lang = v.lang AND o.source = v.source AND o.term = k.term),
t AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own, sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS lw FROM f),
p AS (SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * CAST(n + 1 AS HUGEINT)) // CAST(own + v AS HUGEINT) AS BIGINT) AS p,
        CAST(1 + (CAST(1000000000 AS HUGEINT) * CAST(ln + 1 AS HUGEINT)) // CAST(lw + v AS HUGEINT) AS BIGINT) AS q FROM t),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rest AS (SELECT a.lang, a.source, b.source AS item FROM v a JOIN v b ON a.lang = b.lang AND a.source <> b.source),
u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM rest LEFT JOIN pair USING (lang, source, item)
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
WHERE part = 'pair' OR rank <= 200""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardlens.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


@query("op13_suffixes", """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, p, md5(substr(x, 2 * p + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, greatest(len(x) // 2 - 399, 0))) AS p FROM d)),
f AS (SELECT r, p FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT r, p, sum(CASE WHEN p > q + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g
      FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM f)),
s AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY r, g),
c AS (SELECT r, a AS o, substr(x, 2 * coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1,
               2 * (a - coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0))) AS part FROM s JOIN d USING (r)
      UNION ALL SELECT r, len(x), substr(x, 2 * coalesce(e, 0) + 1) FROM d LEFT JOIN (SELECT r, max(b) AS e FROM s GROUP BY r) USING (r)),
k AS (SELECT r, sha256(unhex(string_agg(part, '' ORDER BY o))) AS kept_sha256 FROM c GROUP BY r),
n AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN k USING (r) LEFT JOIN n USING (r)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardlens.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardlens.llm.alignment import alignment

    return alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
