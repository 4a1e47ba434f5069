"""Alignment of two tokenizers against a direct reading of the rule, on whole texts."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cardlens.llm import alignment as al
from cardlens.llm.packing import byte_letters
from cardlens.llm.queries import tokenizer_path
from conftest import SMALL

FIRST, SECOND = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def expected(rows):
    first, second = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    plain = {c: b for b, c in byte_letters().items()}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for i, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        tokens_a, tokens_b = [bytes(plain[c] for c in first.id_to_token(x)) for x in a], [piece(x) for x in b]
        if not text or not b"".join(tokens_a) == b"".join(tokens_b) == (" " + text).encode():
            docs.append((i, [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in tokens_a]).tolist(), np.cumsum([len(t) for t in tokens_b]).tolist()
        groups, at_a, at_b = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
            groups.append((a[at_a:to_a], b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        docs.append((i, a, b, groups))
    linked = [Counter((x, y) for g, h in groups for x in g for y in h) for _, _, _, groups in docs]
    counts = Counter(p for c in linked for p in c)
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (i, a, b, groups), c in zip(docs, linked):
        line = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((i, len(a), len(b), len(groups), sum(c.values()), sum(n for p, n in c.items() if counts[p] == most[p[0]]),
                    sum(n * counts[p] for p, n in c.items()), hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def some_rows():
    r = random.Random(6)
    bits = ["the", "The", "it's", "naïve", "日本語テキスト", "🙂🙃", " ", "\t", "\n", "\n\n", " ", "  ", "   ", "a b", "<|endoftext|>", "<s>", "</s>", "<0x41>",
            "www.example.com/x?y=1", "12,345.678", "é", "ﬁ", "\x1c", "\x00", "def f(x):\r\n    return", "don't", "x" * 40, "ẞß", "​", "''"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " ", " ", "  ", "\n"]) for _ in range(r.randint(1, 25)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "  "), (204, "a "), (205, "▁x y"), (206, "plain▁"), (None, "no id"), (207, "\n"), (208, " x")]
    rows += [(209, "word and more, " * 6000), (210, "zq" * 20_000)]
    return rows + rows[:4]


@pytest.mark.parametrize("sent", [al.SENT_PAIRS, 40, 0])
def test_edge_rows(spark, sent):
    rows = some_rows()
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, n_a int, keys string")
    assert got(al.alignment(docs, FIRST, SECOND, sent_pairs=sent)) == expected(rows)
    assert al.alignment(docs.limit(0), FIRST, SECOND).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(al.alignment(docs, FIRST, SECOND)) == want
    assert sum(r[4] for r in want) > 50_000


def test_links_of_wide_groups():
    r = np.random.default_rng(2)
    ids_a, ids_b = r.integers(0, 5, 60), r.integers(0, 4, 50)
    group_a, group_b = np.sort(r.integers(0, 3, 60)), np.sort(r.integers(0, 3, 50))
    doc_of = np.array([0, 0, 4])
    want = Counter((int(doc_of[g]), int(x) * 10 + int(y)) for x, g in zip(ids_a, group_a) for y, h in zip(ids_b, group_b) if g == h)
    for block in (1, 7, 1000):
        doc, key, times = al.links(ids_a.astype(np.int32), ids_b.astype(np.int32), group_a, group_b, doc_of, 10, block)
        assert {(d, k): t for d, k, t in zip(doc.tolist(), key.tolist(), times.tolist())} == want
