"""Every registered query against its SQL on the smallest scale; queries without SQL must give rows."""
import pytest
from compare import differences, duck
from conftest import SMALL

from cardlens.plans import load_all
from cardlens.plans.registry import PLANS, SQL

load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(spark, con, PLANS[name], SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_gives_rows(spark, name):
    assert PLANS[name](spark, SMALL).limit(1).count() == 1
