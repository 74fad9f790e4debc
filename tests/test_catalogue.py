import pytest

from tests.conftest import SF
from tests.oracle import connect, same
from weir.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    same(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])


def test_dump_statistics(spark):
    text = [r.text for r in catalogue.queries()["dump_statistics"](spark, SF).orderBy("line").collect()]
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert text[0] == f"[events] entities: event({n})"
    assert text[1].startswith("[events] events: click(")


def test_auto_complete(spark):
    assert sorted(tuple(r) for r in catalogue.queries()["auto_complete"](spark, SF).collect()) == [(1, 25), (2, 25), (3, 25)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
