"""Every registered query of the package proper against its SQL."""

from __future__ import annotations

import pytest
from oracle import SF, both

from tarnfold.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    ours, theirs = both(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert ours == theirs


def test_entry_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert {r["reason"] for r in rows} >= {"ok", "sum_mismatch", "failed_mismatch"}


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
