"""Set operations and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.windows import first_observation


def union_observations(*parts: DataFrame, key: list[str]) -> DataFrame:
    """Rows of all selectors, each element once; where selectors differ on one, its least row."""
    return first_observation(reduce(DataFrame.unionByName, parts), key, [])


def union_report_rows(*parts: DataFrame) -> DataFrame:
    """Rows with different optional columns; what a row hasn't is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def excluded_in_snapshot(done: DataFrame, scope: DataFrame) -> DataFrame:
    """Finished ids cut to this snapshot, so that candidates, excluded and capped add up to it."""
    return done.intersect(scope)


def pending(items: DataFrame, state: str = "state") -> DataFrame:
    return items.filter(F.col(state).isNull() | (F.col(state) != "verified"))


def take_by_position(df: DataFrame, n: int = 200, position: str = "source_position") -> DataFrame:
    return df.orderBy(position).limit(n)


def scan_cap(obs: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The first n unique items of a scan."""
    return first_observation(obs, key, order).orderBy(*order, *key).limit(n)


def recent_jobs(jobs: DataFrame, n: int = 8) -> DataFrame:
    return jobs.groupBy("job_id").agg(F.max("ts").alias("last_seen")).orderBy(F.desc("last_seen"), "job_id").limit(n)


def log_tail(lines: DataFrame, n: int = 200, position: str = "position") -> DataFrame:
    return lines.orderBy(F.desc(position)).limit(n)


def ordered_listing(df: DataFrame, by: list[str]) -> DataFrame:
    """All rows in order, through a range-partitioned sort."""
    return df.orderBy(*by)
