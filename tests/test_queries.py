"""Every registered query gives the rows its SQL twin gives."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry
from roadpulse.plans.oracle import ORACLE
from roadpulse.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_same_rows_as_sql(spark, con, name):
    assert difference(REGISTRY[name](spark, SF_DIR), con, ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)


def test_time_zone_plays_no_part(spark, con):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        for name in ("usage_type_lookup", "vehicle_anomalies", "select_can_file"):
            assert difference(REGISTRY[name](spark, SF_DIR), con, ORACLE[name]) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
