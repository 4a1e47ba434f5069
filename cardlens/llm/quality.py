"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are taken from whole texts, once. Normal equations are summed per partition and fold and then per matrix row;
only these sums, the scaling and the counts of scores per step come to the driver, all of fixed size. Calibration uses
scores of models that have not seen the row's fold.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.llm.common import text_hash
from cardlens.session import cut_lineage

FEATURES = 192     # random Fourier features
WIDTH = 3.0        # width of the Gaussian kernel in standardised statistics
RIDGE = 1e-3       # penalty per row
FOLDS = 5
STEPS = 2000       # steps of a score for calibration
SEED = 7
STATISTICS = 21


def statistics(text: str | None) -> np.ndarray:
    """What a text looks like, in ``STATISTICS`` numbers of similar size; NULL is an empty text."""
    raw = (text or "").encode()
    words, lines = raw.split(), raw.split(b"\n")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n, upper, lower, digits = len(words), seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    per_word, letters = 1.0 / max(n, 1), max(upper + lower, 1.0)
    share = seen[seen > 0] / max(len(raw), 1)
    distinct, repeats = len(set(words)), sum(a == b for a, b in zip(words, words[1:]))
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    count = lambda chars: sum(seen[ord(c)] for c in chars)
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    return np.array([
        np.log1p(n), lengths.mean() / 5, lengths.std() / 5, np.log1p(lengths.max()),
        4 * upper / letters, np.sqrt(digits * per_word), np.sqrt(seen[128:].sum() / max(len(raw), 1)),
        np.sqrt(count("!?") * per_word), np.sqrt(count("#$%&*@^~") * per_word), np.sqrt(count("|<>{}[]\\/_=+") * per_word),
        np.sqrt(count(".") * per_word), np.sqrt(count(",;:") * per_word), np.sqrt(marks * per_word), np.sqrt(count("\n") * per_word),
        4 * distinct * per_word, 4 * np.log1p(distinct) / np.log1p(max(n, 1)), 4 * np.sqrt(repeats * per_word),
        4 * (1 - len(set(lines)) / len(lines)), (share * -np.log2(share)).sum() if len(share) else 0.0,
        4 * (lengths <= 3).mean(), np.log1p(len(raw) / max(len(lines), 1)),
    ])


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _held, _fold, _stats), one per document row. Of three parts of the ids one is held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column(4)]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0))
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * STATISTICS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(offsets, flat)],
                                             names=["_id", "_text", "_held", "_fold", "_stats"])

    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_text"), (F.crc32(name) % 3 == 1).alias("_held"),
                         F.pmod(F.xxhash64(name), F.lit(FOLDS)).cast("int").alias("_fold"), F.col(text_col).alias("_x"))
    return source.mapInArrow(run, f"_id {kind}, _text long, _held boolean, _fold int, _stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray        # one row per fold left out, the last with all rows
    at: np.ndarray | None = None      # calibration: raw scores and
    chance: np.ndarray | None = None  # the chance of label 1 there

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
        z = self.features(stats)
        w = self.weights[-1] if fold is None else self.weights[fold]
        return np.clip((z * w).sum(axis=1), 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.at, self.chance)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATISTICS)


def _sums(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per fold Z'Z and Z'y: partial sums per partition, then one group per fold and matrix row."""
    size = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        some = False
        for batch in batches:
            z, y = model.features(_matrix(batch.column(1))), batch.column(2).to_numpy(zero_copy_only=False)
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(fold):
                own = z[fold == k]
                total[k] += np.hstack([own.T @ own, (own.T @ y[fold == k])[:, None]])
                some = True
        if some:
            for k in range(FOLDS):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(size, k, np.int32)), pa.array(np.arange(size, dtype=np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * (size + 1)), pa.array(total[k].ravel()))],
                    names=["fold", "i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = table["row"].combine_chunks()
        row = rows.flatten().to_numpy().reshape(len(rows), size + 1).sum(axis=0)
        return pa.table({"fold": table["fold"][:1], "i": table["i"][:1], "row": pa.array([row.tolist()], pa.list_(pa.float64()))})

    schema = "fold int, i int, row array<double>"
    parts = rows.select("_fold", "_stats", "y").mapInArrow(partial, schema).groupBy("fold", "i").applyInArrow(add, schema).collect()
    out = np.zeros((FOLDS, size, size + 1))
    for r in parts:
        out[r["fold"], r["i"]] = r["row"]
    return out[:, :, :size], out[:, :, size]


def isotonic(at: np.ndarray, ones: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rising scores: (centre of each pool, its share of ones)."""
    pools: list[list[float]] = []
    for x, s, n in zip(at, ones, count):
        pools.append([x * n, s, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    table = np.array(pools)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """A model from labelled rows that are not held out; None where none are labelled.

    Repeated labels of an id count by their mean; labels without id or value are left out.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(
        F.avg(F.col(label_col).cast("double")).alias("y"))
    rows = stats.where(~F.col("_held")).join(known, F.col("_id") == F.col("_of")).select("_fold", "_stats", "y")
    moments = rows.agg(F.count("*"), *[f(F.get("_stats", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(STATISTICS)]).first()
    if not moments[0]:
        return None
    random = np.random.default_rng(SEED)
    model = Model(np.array(moments[1:STATISTICS + 1], float), np.maximum(np.array(moments[STATISTICS + 1:], float), 1e-3),
                  random.normal(0, 1 / WIDTH, (STATISTICS, FEATURES)), random.uniform(0, 2 * np.pi, FEATURES), np.zeros((1, 1)))
    gram, right = _sums(rows, model)

    def solve(fold: int | None) -> np.ndarray:
        keep = np.arange(FOLDS) != fold if fold is not None else np.ones(FOLDS, bool)
        a = gram[keep].sum(axis=0)
        penalty = RIDGE * max(a[-1, -1], 1.0) * np.eye(FEATURES + 1)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(a + penalty, right[keep].sum(axis=0))

    model.weights = np.array([solve(k) for k in range(FOLDS)] + [solve(None)])

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(raw * STEPS).astype(np.int32)), batch.column(2)], names=["step", "y"])

    steps = rows.mapInArrow(unseen, "step int, y double").groupBy("step").agg(F.sum("y"), F.count("*")).orderBy("step").collect()
    table = np.array([tuple(r) for r in steps], float)
    model.at, model.chance = isotonic(table[:, 0] / STEPS, table[:, 1], table[:, 2])
    return model


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(_id, _text, held_out, score, predicted), one per document row.

    NULL and empty texts are scored by the statistics of an empty text. Rows without id are not held out and not learned
    from. Without any label to learn from all scores are 0.5. An empty table gives an empty result; other columns, language and
    source among them, are not looked at.
    """
    stats = cut_lineage(measured(docs, id_col, text_col))
    model = fit(stats, labels, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(model.score(_matrix(batch.column(3))), 0, 1) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             names=["_id", "_text", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    return stats.select("_id", "_text", "_held", "_stats").mapInArrow(
        run, f"_id {kind}, _text long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document row: id, held_out, score, predicted (see ``judge``)."""
    judged = judge(docs, labels, id_col, text_col, label_col)
    return judged.select(F.col("_id").alias(id_col), "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The document rows that the classifier does not reject, unchanged."""
    bad = judge(docs, labels, id_col, text_col, label_col).where("predicted = 0").select("_id", "_text").distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (text_hash(docs[text_col]) == bad["_text"]), "left_anti")
