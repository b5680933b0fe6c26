"""Reports whose statement for Spark is not the one for other engines."""

import os

import pytest

from tidewell.plans import reports
from tidewell.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(reports.PLANS))
def test_plans_give_the_rows_of_their_statements(spark, name):
    frames = {s: getattr(reports.model, s)(spark, DATA) for s in reports.SOURCES if "{" + s + "}" in reports.REPORTS[name]}
    want = spark.sql(reports.REPORTS[name], **frames)
    got = QUERIES[name](spark, DATA)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) != []
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
