"""Laws: arrival order and reruns change nothing; numbering by buckets equals numbering in one window."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfold.operators import sets, windows

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ROWS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.text("ab", max_size=2)), min_size=1, max_size=25)
SCHEMA = "k int, p int, v string"


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


@QUICK
@given(ROWS)
def test_first_row_equals_window(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    by = W.partitionBy("k").orderBy("p", "v")
    want = df.withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")
    assert rows(windows.first_observation(df, ["k"], ["p"])) == rows(want) == rows(windows.first_observation(df.orderBy(F.desc("v")), ["k"], ["p"]))


@QUICK
@given(ROWS)
def test_spread_numbers_equal_window(spark, data):
    df = spark.createDataFrame(sorted(set(data)), SCHEMA)
    want = df.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("p", "v")))
    assert rows(windows.spread_row_number(df, ["k"], "p", ["v"], "n")) == rows(want)


@QUICK
@given(ROWS)
def test_union_of_overlapping_parts_is_the_whole(spark, data):
    df = spark.createDataFrame(sorted(set(data)), SCHEMA)
    parts = [df.filter("p < 4"), df.filter("p > 1"), df.filter("k = 0")]
    assert rows(sets.union_observations(*parts, key=["k", "p", "v"])) == rows(df)
