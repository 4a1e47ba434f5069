"""Secret scan against pattern matches found one text at a time, edge rows, and the randomness battery."""
import hashlib
import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from cardlens.llm import secrets

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def expected(text):
    spans = sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))
    return ",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in spans)


EDGE = [
    None, "", "token", "token=abc", "é😀 token = 'abcdefgh' x", "PASSWORD:secret=abcdefgh token=12345678",
    "AKIA" + "A" * 11, "AKIAAKIA" + "9" * 12, "f" * 31, "g" + "f" * 32 + "g" + "0" * 40, "api_key=\"a-b_c/d+e=f.\"",
    ("x token=abcdefgh1 " * 700), "apikey:12345678apikey:12345678",
]


def check(rows):
    for row in rows:
        base = expected(row["x"])
        kept = [s for s in row["spans"].split(",") if s and not s.startswith("random")]
        assert ",".join(kept) == base
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        for kind in ("assign", "access", "hex"):
            assert row[f"n_{kind}"] == base.count(kind + ":")


def test_edge_texts(spark):
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(EDGE)] + [(None, "token=abcdefgh", "token=abcdefgh")], "doc_id long, text string, _base string")
    found = secrets.find_secrets(docs)
    texts = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("x"))
    check(found.join(texts, F.col("doc_id").eqNullSafe(F.col("i"))).collect())
    assert found.count() == len(EDGE) + 1
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = secrets.find_secrets(docs).join(docs.select("doc_id", F.col("text").alias("x")), "doc_id").collect()
    check(rows)
    assert len(rows) == docs.count()
    assert sum(r["n_assign"] + r["n_hex"] + r["n_access"] for r in rows) > 0


def test_battery_tells_random_from_structured(spark):
    r = random.Random(5)
    rand = ["".join(r.choices(string.ascii_letters + string.digits, k=r.randint(32, 60))) for _ in range(60)]
    plain = ["internationalisation_of_configuration", "abcdefghijklmnopqrstuvwxyz", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa",
             "path/to/some/ordinary/module/name", "12345678901234567890", "the-quick-brown-fox-jumps-over-the-lazy-dog"]
    text = [(i, f"see {t} here") for i, t in enumerate(rand + plain)]
    rows = {x["doc_id"]: x for x in secrets.find_secrets(spark.createDataFrame(text, "doc_id long, text string")).collect()}
    caught = sum(rows[i]["n_random"] for i in range(60))
    assert caught >= 50
    assert all(rows[i]["n_random"] == 0 for i in range(60, 66))


def test_upper_tail(spark):
    rows = spark.createDataFrame([(0.0, 0.5), (1.6448536, 0.05), (-1.6448536, 0.95), (3.0902323, 0.001)], "z double, p double")
    for r in rows.withColumn("got", secrets.upper_tail(F.col("z"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=1e-6)


def test_mask(spark):
    names = ["_all", "_base", "_new", "_tokens", "_t", "_m0", "_s1", "_v0", "_row", "_x", "_limits", "v", "a.b"]
    docs = spark.createDataFrame([(i, t, "en", *range(i, i + len(names))) for i, t in enumerate(EDGE)],
                                 "doc_id long, text string, lang string, " + ", ".join(f"`{n}` int" for n in names))
    out = secrets.mask_secrets(docs)
    assert out.dtypes == docs.dtypes
    for row in out.collect():
        assert tuple(row)[2:] == ("en", *range(row["doc_id"], row["doc_id"] + len(names)))
        text = EDGE[row["doc_id"]]
        spans, cut, at = [], "", 0
        for s in filter(None, expected(text).split(",")):
            _, a, b = s.split(":")
            spans.append((int(a), int(b)))
        for a, b in spans:
            if a >= at:
                cut += text[at:a] + secrets.MASK
            at = max(at, b)
        assert row["text"] == (cut + text[at:] if text is not None else None)
        assert expected(row["text"]) == ""


def test_time_is_linear_in_the_matches(spark):
    """Many matches in one text, found and masked; the work of one round is left out of the comparison."""
    took = {}
    for n in (1_000, 25_000, 100_000):
        text = " ".join(f"token=abcdefgh{i:06d}" for i in range(n))
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        row, masked = secrets.find_secrets(frame).first(), secrets.mask_secrets(frame).first()["text"]
        took[n] = time.perf_counter() - began
        assert row["n_assign"] == n and masked == " ".join([secrets.MASK] * n)
        assert row["spans"].endswith(f"{len(text) - 20}:{len(text)}")
    print(took)
    assert took[100_000] < 8 * max(took[25_000], 4)


ALPHABETS = {"base64url": string.ascii_letters + string.digits + "-_", "base36": string.ascii_lowercase + string.digits,
             "base32": string.ascii_uppercase + "234567", "hex": "0123456789abcdef"}


def structured(r, size):
    words = "the of and secret_key load Main read config user item value path data is to in new number order with from service page".split()
    glue, out = r.choice("_ - / T N".split()), ""
    while len(out) < size:
        w = r.choice(words)
        out += w.title() if glue == "T" else w + (str(r.randrange(100)) if glue == "N" else glue)
    return out[:size]


def recall(spark, secrets_each, plain):
    """{(alphabet, length): share found} with that many secrets among ``plain`` tokens of each length, and the false share."""
    r, rows = random.Random(9), []
    for size in (24, 40, 64):
        rows += [(None, size, structured(r, size)) for _ in range(plain)]
    rows += [(a, size, "".join(r.choices(x, k=size))) for a, x in ALPHABETS.items() for size in (24, 40, 64) for _ in range(secrets_each)]
    frame = spark.createDataFrame([(i, f"see {t} here") for i, (_, _, t) in enumerate(rows)], "doc_id long, text string").repartition(8)
    found = {x["doc_id"] for x in secrets.find_secrets(frame).where("n_random > 0").collect()}
    share = {}
    for a in (None, *ALPHABETS):
        for size in (24, 40, 64):
            own = [i for i, x in enumerate(rows) if x[:2] == (a, size)]
            share[a, size] = sum(i in found for i in own) / len(own)
    return share


@pytest.mark.parametrize("secrets_each,plain,least", [
    (8, 3200, {("base64url", 40): 0.6, ("base64url", 64): 0.9, ("base32", 64): 0.5}),
    (3, 10000, {("base64url", 64): 0.6})])
def test_recall_per_encoding_and_length(spark, secrets_each, plain, least):
    """About 1 % and 0.1 % secrets among structured tokens; lower case with digits is too like numbered words to be asked for."""
    share = recall(spark, secrets_each, plain)
    print({k: round(v, 4) for k, v in share.items()})
    assert all(share[k] >= v for k, v in least.items()), share
    assert all(share[None, size] <= 0.001 for size in (24, 40, 64)), share
