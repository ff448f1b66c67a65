"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_oracles import compare

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["gisjoin", "formatted_date", "avg", "num_days", "start_date"]


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        assert compare(spark, SF, name) == ""
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
