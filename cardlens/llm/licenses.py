"""Licence scan with a positional index of rare words.

Document frequencies of the templates' words are counted over the whole table. The rarest words of each template are
indexed with their places; a document's occurrences of them vote for (template, relative position). Where several rare
words agree, the template's mandatory phrases are looked for around that place, and the agreeing words are weighed by
their inverse document frequency. Fixed base phrases are found wherever their words stand consecutively.
"""
from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Opening words of public licence notices: label, text, mandatory phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction",
     ["permission is hereby granted", "without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                   "http www apache org licenses license 2 0", ["compliance with the license", "apache org licenses"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation", ["free software", "gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]
RARE = 6    # rarest words of a template that are indexed
AGREE = 2   # different rare words that must agree on a relative position
SLACK = 8   # words by which a mandatory phrase may lie outside the aligned template
MIN_SCORE = 0.5

#: Letters and digits stay, A-Z in lower case; bytes beyond ASCII stay; everything else becomes a blank.
_KEEP = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


def places(words: list[bytes], phrase: list[bytes], low: int = 0, high: int | None = None) -> list[int]:
    """Starts of a phrase between two word positions."""
    found, at, end = [], low, len(words) if high is None else min(high, len(words))
    while True:
        try:
            at = words.index(phrase[0], at, end)
        except ValueError:
            return found
        if words[at:at + len(phrase)] == phrase:
            found.append(at)
        at += 1


def word_weights(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency of the templates' words, over all rows; the result is bounded by the templates."""
    vocabulary = frozenset(w for _, text, _ in templates for w in split_words(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                for w in vocabulary.intersection(split_words(text.as_py())):
                    counts[w] += 1
        counts[b""] = rows
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

    rows = docs.select(text_col).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = {r["w"].encode(): r["n"] for r in rows}
    total = df.get(b"", 0)
    return {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary}


class Index:
    """Postings of the rarest words of each template, by word: (template, place)."""

    def __init__(self, weights: dict[bytes, float], templates=TEMPLATES):
        self.templates = [(label, split_words(text), [split_words(p) for p in phrases]) for label, text, phrases in templates]
        self.weights = weights
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for t, (_, words, _) in enumerate(self.templates):
            rare = sorted(set(words), key=lambda w: (-weights[w], w))[:RARE]
            self.need.append(min(AGREE, len(rare)))
            for place, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((t, place))

    def search(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of the verified templates and the best score."""
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for at in [i for i, w in enumerate(words) if w in self.postings]:
            for t, place in self.postings[words[at]]:
                votes[t, at - place].add(words[at])
        labels, best = set(), 0.0
        for (t, start), agreed in votes.items():
            label, wanted, phrases = self.templates[t]
            if len(agreed) < self.need[t]:
                continue
            low, high = max(0, start - SLACK), start + len(wanted) + SLACK
            if not all(places(words, p, low, high) for p in phrases):
                continue
            same = sum(self.weights[w] for i, w in enumerate(wanted) if 0 <= start + i < len(words) and words[start + i] == w)
            score = same / sum(self.weights[w] for w in wanted)
            if score >= MIN_SCORE:
                labels.add(label)
                best = max(best, score)
        return labels, best


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per document row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of base phrases, overlapping ones too; ``first_word`` and ``last_word`` are their smallest
    and largest start, NULL where there are none. The score is 1 where a base phrase stands, else the best share of a
    verified template, else 0. NULL and empty texts have no words. Repeated rows are each returned; an empty table gives
    an empty result; other columns are not looked at.
    """
    index = Index(word_weights(docs, text_col, templates), templates)
    base = [(split_words(p), label) for p, label in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                words = split_words(text.as_py())
                starts, own = [], set()
                for phrase, label in base:
                    if found := places(words, phrase):
                        starts += found
                        own.add(label)
                labels, score = index.search(words)
                for column, value in zip(out, (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                                               ",".join(sorted(own)), ",".join(sorted(own | labels)), 1.0 if own else score)):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=[
                "_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x")).mapInArrow(
        run, f"_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    ).withColumnRenamed("_id", id_col)
