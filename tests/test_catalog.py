"""Every named query against its SQL equivalent."""

import pytest
from compare import connect, differences
from places import DATA

import __spark_entry__ as driver
from beaconlake.plans import catalog
from beaconlake.schema import SUPERVISED_FEATURES

# The corpus operators have tests of their own.
QUERIES = {name: run for name, run in driver.queries().items() if name not in driver.CORPUS}
ORACLES = {name: sql for name, sql in driver.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLES:
        assert differences(got, duck.execute(ORACLES[name]).df()) == []
    else:
        assert len(got) > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_training_stores_only_what_it_reads(spark, monkeypatch):
    """Of the features' table; sizes and features are those of training on all columns."""
    stored, write = {}, catalog.materialise
    monkeypatch.setattr(catalog, "materialise", lambda df, label: stored.setdefault(label, write(df, label)))
    _, features, metrics = catalog._trained(spark, DATA)
    needed = {"sensor_id", "frame_id", "ssid", "label", "security", *SUPERVISED_FEATURES}
    assert set(stored["features"].columns) == needed
    whole, wanted, counted = [catalog._labelled(spark, DATA), *metrics.select("train_rows", "test_rows").first()]
    assert (set(features), wanted + counted) == (set(SUPERVISED_FEATURES), whole.count())
