"""Successive halving finds a planted optimum and spends its rows rung by rung; registered fits are whole."""
import inspect
import random

import pytest
from conftest import SMALL

from cardlens.operators import fraud
from cardlens.plans import load_all
from cardlens.plans.registry import PLANS


def test_planted_optimum(spark):
    """The label is a parity of two signs, which trees of one level cannot see."""
    r = random.Random(5)
    rows = [(f"t{i}", *(x := [r.uniform(-1, 1) for _ in range(3)]), int((x[0] > 0) != (x[1] > 0))) for i in range(1500)]
    df = spark.createDataFrame(rows, "transaction_id string, a double, b double, c double, y int")
    model, table = fraud.halving_search(df, ["a", "b", "c"], "y", "forest", {"maxDepth": [1, 6], "minInstancesPerNode": [1, 400, 401]}, trials=40, eta=2, trees=10)
    found = table.collect()
    assert found[0].params == "maxDepth=6, minInstancesPerNode=1" and found[0].roc_auc > 0.9
    sizes = [[x.rows for x in found if x.rung == g] for g in range(max(x.rung for x in found) + 1)]
    assert [len(s) for s in sizes] == [6, 3, 1, 1] and [s[0] for s in sizes] == sorted(s[0] for s in sizes) and sizes[-1][0] == 1200
    scored = fraud.score(model, df)
    assert scored.where("(score >= 0.5) = (y = 1)").count() > 1300
    assert not [x for x in spark.sparkContext._jsc.getPersistentRDDs().values()]


@pytest.mark.parametrize("name", ["train_fraud_model", "benchmark_models"])
def test_models_are_fitted_in_full(spark, monkeypatch, name):
    """The registered queries fit with the operator's own number and depth of trees."""
    class Asked(Exception):
        pass

    whole = inspect.signature(fraud.learner)

    def asked(*args, **params):
        given = whole.bind(*args, **params)
        given.apply_defaults()
        raise Asked(given.arguments["trees"], given.arguments["depth"])

    load_all()
    monkeypatch.setattr(fraud, "learner", asked)
    with pytest.raises(Asked) as found:
        PLANS[name](spark, SMALL)
    assert found.value.args == (whole.parameters["trees"].default, whole.parameters["depth"].default) == (50, 6)
