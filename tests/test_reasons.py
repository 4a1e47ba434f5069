"""Contributions along the paths of fitted trees against a walk of the printed trees."""
import random
import re

import pytest

from cardlens.operators import fraud

NAMES = ["a", "b", "c", "unused"]


@pytest.fixture(scope="module")
def df(spark):
    r = random.Random(11)
    rows = [(f"t{i}", *(x := [r.uniform(-1, 1) for _ in range(3)]), 0.0, int(x[0] + x[1] * x[2] > 0.1)) for i in range(800)]
    return spark.createDataFrame(rows, "transaction_id string, a double, b double, c double, unused double, fraud_proxy int").persist()


def leaf_values(text):
    """Predictions of the leaves of each printed tree, left to right."""
    return [[float(v) for v in re.findall(r"Predict: (\S+)", tree)] for tree in re.split(r"\n\s*Tree \d+", text)[1:]]


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_adds_up(spark, df, kind):
    model = fraud.train_fraud_model(df, NAMES, kind=kind, trees=6, depth=4)
    rows = fraud.tree_reason_codes(model, df, NAMES, k=2).collect()
    assert len(rows) == 800 and len({r.margin for r in rows}) > 20
    for r in rows:
        assert r.base + sum(r.contributions) == pytest.approx(r.margin, abs=1e-9)
        assert r.contributions[3] == 0.0
        effects = dict(zip(NAMES, r.contributions))
        up = sorted((n for n in NAMES if effects[n] > 0), key=lambda n: (-effects[n], n))[:2]
        down = sorted((n for n in NAMES if effects[n] < 0), key=lambda n: (effects[n], n))[:2]
        assert (r.raises, r.lowers) == (",".join(up), ",".join(down))


def test_one_split_by_hand(spark, df):
    """A single tree of one level: all of the leaf's difference from the root belongs to the feature that was asked."""
    model = fraud.train_fraud_model(df, NAMES, kind="gbt", trees=1, depth=1)
    text = model.stages[-1].toDebugString
    (feature, limit), = re.findall(r"If \(feature (\d+) <= (\S+)\)", text)
    low, high = leaf_values(text)[0]
    values = {r.transaction_id: r for r in df.collect()}
    for r in fraud.tree_contributions(model, df, NAMES).collect():
        leaf = low if values[r.transaction_id][NAMES[int(feature)]] <= float(limit) else high
        assert r.margin == pytest.approx(leaf) and r.contributions[int(feature)] == pytest.approx(leaf - r.base)
        assert [c for i, c in enumerate(r.contributions) if i != int(feature)] == [0.0] * 3
