"""Base phrases against brute force; templates on notices, variants and near misses."""
import re

from cardlens.llm import licenses


def expected(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(words))
             if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def check(rows, texts):
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == expected(texts[r["doc_id"]])
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = licenses.licences(docs).collect()
    assert len(rows) == docs.count()
    check(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert {"apache-2.0", "mit", "cc-by", "gpl", "reserved"} <= {x for r in rows for x in r["labels"].split(",")}
    plain = [r for r in rows if not r["labels"]]
    assert len(plain) > 900 and all(r["score"] == 0 for r in plain)


CASES = {
    0: (None, ""), 1: ("", ""), 2: ("Released under the MIT License.", "mit"),
    3: ("released and under the MIT, then a license", ""), 4: ("cc by cc by! CC-BY", "cc-by"),
    5: ("x " * 30000 + "Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    6: ("This work is licensed under the GNU General Public License, version 3. All rights reserved.", "gpl,gpl-3.0,reserved"),
    7: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction", "mit"),
    8: ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    9: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"), 10: ("all é rights reserved allrights reserved", ""),
    11: ("license " * 3000, ""),
}


def test_notices(spark):
    filler = [(100 + i, "ordinary words of a text in the world") for i in range(50)]
    docs = spark.createDataFrame([(i, t, 0.5, "z") for i, (t, _) in CASES.items()] + [(i, t, 0.5, "z") for i, t in filler], "doc_id long, text string, score double, labels string")
    rows = licenses.licences(docs).collect()
    check(rows, {**{i: t for i, (t, _) in CASES.items()}, **dict(filler)})
    assert {r["doc_id"]: r["labels"] for r in rows if r["doc_id"] < 100} == {i: x for i, (_, x) in CASES.items()}
    assert licenses.licences(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "cc by")] * 2, "doc_id long, text string")
    assert [r["n_base"] for r in licenses.licences(twice).collect()] == [1, 1]
