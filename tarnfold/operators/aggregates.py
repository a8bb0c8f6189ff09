"""Counts, reconciliation and reports. Every job is handled in one pass; counts are exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.vocabulary import CLEANUP_BUCKETS, FAILED_STATES, FINAL_STATES, RECOVERABLE_STATES


def state_counts(df: DataFrame, by: list[str], state: str = "state") -> DataFrame:
    """n_items, a count for each final state, recoverable and unknown."""
    s = F.col(state)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_items"), *(F.count_if(s == v).alias(v) for v in FINAL_STATES), F.count_if(s.isin(*RECOVERABLE_STATES)).alias("recoverable"),
        F.count_if(s.isNull() | ~s.isin(*FINAL_STATES, *RECOVERABLE_STATES)).alias("unknown"),
    )


def failed_count(counts: DataFrame) -> DataFrame:
    """counts with failed, the sum of the failure states."""
    return counts.withColumn("failed", reduce(Column.__add__, [F.col(c) for c in FAILED_STATES]))


def reconcile(counts: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """One row for each job: ok and the first reason against it. counts: as failed_count gives them; a job without items counts as zeros.

    In order: the reported recoverable count is wrong; recoverable items are left; unknown states; the final states don't add up
    to the scan; the cached failed count is wrong; another cached count is.
    """
    names = [*FINAL_STATES, "recoverable", "unknown", "failed"]
    own = counts.select(key, *(F.col(c).alias(f"n_{c}") for c in names))
    n = {c: F.coalesce(F.col(f"n_{c}"), F.lit(0)) for c in names}
    total = reduce(Column.__add__, [n[c] for c in FINAL_STATES])
    others = reduce(Column.__or__, [F.col(f"{c}_count") != n[c] for c in ("verified", "degraded", "conflict", "skipped")])
    reason = (
        F.when(F.col("recoverable_count") != n["recoverable"], "recoverable_desync").when(n["recoverable"] > 0, "recoverable_left").when(n["unknown"] > 0, "unknown_states")
        .when(total != F.col("scan_count"), "sum_mismatch").when(F.col("failed_count") != n["failed"], "failed_mismatch").when(others, "cached_mismatch").otherwise("ok")
    )
    return jobs.join(own, key, "left").select(key, (reason == "ok").alias("ok"), reason.alias("reason"), total.alias("final_items"))


def scan_report(obs: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Observations, unique items and duplicates. Keys are counted after a distinct, so a hot group isn't one set in memory."""
    each = obs.groupBy(*by, *key).agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("observations"), F.count("*").alias("unique_items"), (F.sum("n") - F.count("*")).alias("duplicates"))


def count_by_notebook(notes: DataFrame) -> DataFrame:
    return notes.groupBy(F.concat_ws("/", "stack", "notebook").alias("place")).agg(F.count("*").alias("n_notes"))


def reason_histogram(attempts: DataFrame) -> DataFrame:
    """Reasons with counts, most frequent first."""
    return attempts.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def resource_report(matched: DataFrame) -> DataFrame:
    """Per note, over what resource_match gives: total, matched, missing, unreferenced."""
    return matched.groupBy("note_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("matched", "missing", "unreferenced")))


def progress(items: DataFrame, by: str, state: str = "state") -> DataFrame:
    return items.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col(state) == "verified").alias("verified"))


def job_status(counts: DataFrame) -> DataFrame:
    """The counts a job's status line shows. counts: as failed_count gives them."""
    return counts.select("job_id", "n_items", "verified", "degraded", "failed", "conflict", "skipped")


def cleanup_summary(items: DataFrame, status: str = "cleanup_status") -> DataFrame:
    """Items in each bucket of the report. A status that is in no bucket fails the run: no item may vanish from all lists."""
    bucket = reduce(lambda c, x: c.when(F.col(status) == x[0], x[1]), CLEANUP_BUCKETS.items(), F.when(F.lit(False), ""))
    known = F.coalesce(bucket, F.raise_error(F.concat(F.lit("clean-up status in no bucket: "), F.coalesce(F.col(status), F.lit("null")))).cast("string"))
    return items.groupBy(known.alias("bucket")).agg(F.count("*").alias("n"))


def plan_hash(rows: DataFrame, columns: list[str], by: list[str], leaf: int = 64) -> DataFrame:
    """A hash of each group's rows that depends on nothing but the rows, and their number.

    A tree over the digits of row hashes: a node of at most `leaf` distinct rows hashes their sorted hashes with how often each
    occurs, any other the hashes of its up to 16 children. It is built from the digits that the greatest group needs upwards, so no list has more than
    16 * leaf entries, however many rows a group has or repeats. Hashes move twice, as bytes: to be counted, and to the
    tasks that build the subtrees of their first digits; above those a group has at most 16**_STEM nodes.
    """
    row = F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    hashed = rows.select(*by, F.unhex(row).alias("h"))
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    depth = 0
    while most > leaf and most > 16**depth * leaf // 16:  # by then a node has leaf / 16 rows at the mean
        depth += 1
    stem = min(depth, _STEM)
    digits_of = lambda n: F.substring(F.lower(F.hex("h")), 1, n)
    counted = hashed.groupBy(*by, "h").agg(F.count("*").alias("n")).withColumn("stem_", digits_of(stem)).repartition(*by, "stem_")
    entries = F.array_sort(F.collect_list(F.concat(F.lower(F.hex("h")), F.lit(":"), F.col("n").cast("string"))))
    nodes = counted.groupBy(*by, "stem_", digits_of(depth).alias("prefix")).agg(F.count("*").alias("k"), F.sum("n").alias("n_rows"), entries.alias("entries")).withColumn("tree", F.lit(None).cast("string"))
    told = F.coalesce("tree", F.sha2(F.array_join("entries", ""), 256))
    for digits in range(depth - 1, -1, -1):
        held = [*by, "stem_"] if digits >= stem else by  # whole subtrees lie in one task
        above = nodes.groupBy(*held, F.substring("prefix", 1, digits).alias("up")).agg(F.sum("k").alias("k"), F.sum("n_rows").alias("n_rows"), F.flatten(F.collect_list("entries")).alias("entries"), F.array_sort(F.collect_list(F.concat("prefix", told))).alias("children"))
        small = F.col("k") <= leaf
        nodes = above.select(*held, F.col("up").alias("prefix"), "k", "n_rows", F.when(small, F.array_sort("entries")).otherwise(F.array().cast("array<string>")).alias("entries"), F.when(~small, F.sha2(F.array_join("children", ""), 256)).alias("tree"))
    return nodes.select(*by, told.alias("plan_hash"), "n_rows")


#: Digits by which the subtrees of a group are dealt over tasks.
_STEM = 3


def degradation_stats(items: DataFrame) -> DataFrame:
    return items.select(F.explode("degradations").alias("d")).groupBy(F.col("d.code").alias("code"), F.col("d.stage").alias("stage")).agg(F.count("*").alias("n"))


def shard_sizes(shards: DataFrame) -> DataFrame:
    return shards.groupBy("shard").agg(F.count("*").alias("n_entries"))


def unknown_states(items: DataFrame, state: str = "state") -> DataFrame:
    return items.filter(F.col(state).isNull() | ~F.col(state).isin(*FINAL_STATES, *RECOVERABLE_STATES)).select(state).distinct()


def merge_group_check(files: DataFrame) -> DataFrame:
    """Merge keys whose files disagree on stack or notebook."""
    places = files.select("merge_key", F.struct(F.col("stack"), F.col("notebook")).alias("place")).distinct()
    return places.groupBy("merge_key").agg(F.count("*").alias("n_places")).filter("n_places > 1")
