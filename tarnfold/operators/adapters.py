"""How a new source or target is plugged in: a few functions over DataFrames."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession


@runtime_checkable
class Source(Protocol):
    """scan gives items (stable_key, ...); extract gives content for items, one row each, with quality and degradations."""

    def scan(self, spark: SparkSession) -> DataFrame: ...

    def extract(self, items: DataFrame) -> DataFrame: ...


@runtime_checkable
class Target(Protocol):
    """plan gives paths for content, keeping those of known notes; write stores notes where it may; verify compares files with what was written; index lists shards."""

    def plan(self, content: DataFrame, known: DataFrame | None = None) -> DataFrame: ...

    def write(self, plan: DataFrame) -> DataFrame: ...

    def verify(self, written: DataFrame) -> DataFrame: ...

    def index(self, entries: DataFrame) -> DataFrame: ...


def contract_violations(source: Source, spark: SparkSession) -> list[str]:
    """What a source gets wrong, by counts alone: missing or repeated keys, items without content, content without items, broken quality."""
    from tarnfold.operators.guards import fk_violations, quality_contract, unique_violations

    items = source.scan(spark)
    content = source.extract(items)
    found = []
    if items.filter("stable_key is null").limit(1).count():
        found.append("null_key")
    if unique_violations(items, ["stable_key"]).limit(1).count():
        found.append("repeated_key")
    if fk_violations(items, content, "stable_key").limit(1).count():
        found.append("item_without_content")
    if fk_violations(content, items, "stable_key").limit(1).count():
        found.append("content_without_item")
    if quality_contract(content).filter("error_code is not null").limit(1).count():
        found.append("quality")
    return found
