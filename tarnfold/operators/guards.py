"""Data-quality guards. What would be an exception for one item is a row with a code here, and the job goes on."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.vocabulary import DEGRADATION_CODES, DEGRADATION_STAGES, DISPOSITIONS, RATE_LIMITED


def vocabulary_violations(df: DataFrame, words: dict[str, tuple[str, ...]], rules: dict[str, Column] | None = None, shown: int | None = 10, order: list[str] | None = None) -> DataFrame:
    """Rows with a value outside its vocabulary, or that break a rule; violation names the first of them. shown: how many are listed, None for all."""
    told = F.when(F.lit(False), "")
    for column, allowed in words.items():
        told = told.when(F.col(column).isNotNull() & ~F.col(column).isin(*allowed), column)
    for name, holds in (rules or {}).items():
        told = told.when(~F.coalesce(holds, F.lit(False)), name)
    out = df.withColumn("violation", told).filter("violation is not null")
    return out if shown is None else out.orderBy(*(order or df.columns)).limit(shown)


def unique_violations(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys with more than one row, with their row counts."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def fk_violations(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of child whose key isn't in parent; null keys refer to nothing."""
    keys = parent.select(F.col(parent_key or key).alias(key))
    return child.filter(F.col(key).isNotNull()).join(keys, key, "left_anti")


def quality_contract(df: DataFrame) -> DataFrame:
    """df with error_code: full has no degradations, degraded has some, and each has a known code and stage and a message."""
    bad = F.exists("degradations", lambda d: ~d["code"].isin(*DEGRADATION_CODES) | ~d["stage"].isin(*DEGRADATION_STAGES) | (F.coalesce(F.length(d["message"]), F.lit(0)) == 0))
    n = F.size("degradations")
    code = F.when(~F.col("quality").isin("full", "degraded") | F.col("quality").isNull(), "unknown_quality").when(bad, "bad_degradation").when((F.col("quality") == "full") & (n > 0), "full_with_degradations").when((F.col("quality") == "degraded") & (n == 0), "degraded_without_degradations")
    return df.withColumn("error_code", code)


def disposition_contract(errors: DataFrame) -> DataFrame:
    """errors (retryable, scope, disposition) with error_code: null where the contract holds."""
    has = F.col("disposition").isNotNull()
    code = (
        F.when(F.col("retryable") & has, "retryable_with_disposition").when((F.col("scope") == "job") & has, "job_with_disposition").when(has & ~F.col("disposition").isin(*DISPOSITIONS), "unknown_disposition")
        .when(~F.col("retryable") & (F.col("scope") == "item") & ~has, "disposition_missing")
    )
    return errors.withColumn("error_code", code)


def final_state(errors: DataFrame) -> DataFrame:
    """errors (aborted, disposition, code, http_status) with the state their item gets."""
    state = (
        F.when(F.coalesce(F.col("aborted"), F.lit(False)), "skipped").when(F.col("disposition") == "unsupported", "unsupported").when(F.col("disposition") == "blocked", "blocked")
        .when(F.coalesce(F.col("code").contains("CONSTRAINT"), F.lit(False)), "conflict").when(F.col("http_status").isin(*RATE_LIMITED), "paused").otherwise("permanent_failed")
    )
    return errors.withColumn("item_state", state)


def verify_files(expected: DataFrame, observed: DataFrame, key: str = "id") -> DataFrame:
    """expected (key, expected) against files (key, observed, size): ok, missing, empty or hash_mismatch."""
    told = F.when(F.col("observed").isNull(), "missing").when(F.col("size") == 0, "empty").when(F.col("observed") != F.col("expected"), "hash_mismatch").otherwise("ok")
    return expected.join(observed, key, "left").select(key, told.alias("outcome"))
