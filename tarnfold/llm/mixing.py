"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfold.llm.common import stored, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order of their names, repeating, null last.
WEIGHTS = (3, 1, 2)
_DIGITS = 3  # of the seeded key: 4096 buckets for each source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(doc_id: Column, seed: str) -> Column:
    """The place of a document in the seeded order of its source; rows with one id share it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def water_fill(sizes: DataFrame, share: float, epochs: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to the same with target: a common level times weight, at most epochs times the size.

    Clamping and resharing until none is above ends at the level below; each row's level takes all sources that clamp
    earlier as clamped, and the highest of these is the level reached. One row for each source, so the ordering is of sources only.
    """
    order = [F.col("source").isNull(), F.col("source")]
    place = F.row_number().over(W.orderBy(*order)) - 1
    cap = F.col("source_size") * epochs
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", cap)
    by = W.orderBy(F.col("cap") / F.col("weight"), *order)
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levelled = ranked.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - before) / rest)
    level = F.max("level").over(everything)
    return levelled.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "source_size", "target")


def plan_mix(sized: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each source: source, source_size, target, whole, last_key. sized: a stored table with source, key, size.

    Each document is taken `whole` times, and once more if its key is not after last_key. The seeded order is cut where
    the words missing to the target are nearest; sums per (source, bucket of keys) find the bucket of the cut, and only
    that bucket's documents are ordered, so a source of any size is no hot group.
    """
    sums = sized.withColumn("bucket", F.substring("key", 1, _DIGITS)).groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = stored(sums, "bucket-sums")
    targets = water_fill(sums.groupBy("source").agg(F.sum("n").alias("source_size")), share, epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = stored(targets.withColumn("whole", whole.cast("long")).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    running = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n"))
    of = targets.select(F.col("source").alias("s"), "missing")
    running = running.join(of, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cut = running.filter("missing > 0 and before < missing").groupBy("source").agg(F.max_by(F.struct("bucket", "before", "missing"), "bucket").alias("c")).select(F.col("source").alias("s"), "c.*")
    inside = sized.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.substring("key", 1, _DIGITS) == F.col("bucket")))
    by_key = inside.groupBy("source", "key", "before", "missing").agg(F.sum("size").alias("n"))
    upto = F.col("before") + F.sum("n").over(W.partitionBy("source").orderBy("key")) - F.col("n") / 2
    last = by_key.withColumn("middle", upto).filter("middle < missing").groupBy("source").agg(F.max("key").alias("k")).select(F.col("source").alias("s2"), "k")
    cut = cut.select("s", "bucket")
    return (
        targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").join(last, F.col("source").eqNullSafe(F.col("s2")), "left")
        .select("source", "source_size", "target", "whole", F.coalesce("k", "bucket").alias("last_key"))
    )


def _times(key: Column) -> Column:
    """How often a document is taken; a cut bucket none of whose documents is taken has the bucket alone as last_key."""
    return F.col("whole") + F.when(key <= F.col("last_key"), 1).otherwise(0)


def mix_report(docs: DataFrame, seed: str = "mix", share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken.

    A null text has size 0; null sources are one source, the last; rows with one id in one source are taken alike; a source
    without words has target 0. An empty table gives no rows; other columns are ignored. Reruns agree.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), seeded_key(F.col(id_col), seed).alias("key"), word_count(F.col(text_col)).alias("size"))
    sized = stored(sized, "sizes")
    plan = stored(plan_mix(sized, share, epochs, weights), "mix").withColumnRenamed("source", "s")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("key"))).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it. The plan has a row for each source, so texts aren't shuffled while Spark's broadcast threshold holds it."""
    of = unused(docs, "plan")
    key = seeded_key(F.col(id_col), seed)
    sized = stored(docs.select(F.col(source_col).alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size")), "sizes")
    plan = stored(plan_mix(sized, share, epochs, weights), "mix").select(F.struct("*").alias(of))
    joined = docs.join(plan, F.col(source_col).eqNullSafe(F.col(f"{of}.source")))
    times = F.col(f"{of}.whole") + F.when(key <= F.col(f"{of}.last_key"), 1).otherwise(0)
    return joined.withColumn(of, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).drop(of)


MIX_SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)] AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
k AS (SELECT source, key, sum(size) AS n FROM d GROUP BY source, key),
c AS (SELECT source, key, sum(n) OVER (PARTITION BY source ORDER BY key) - n / 2 AS middle FROM k)
SELECT d.doc_id, d.size, p.source_size, p.target,
    CAST(d.size * (p.whole + CASE WHEN p.target - p.whole * p.source_size > 0 AND c.middle < p.target - p.whole * p.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.key = c.key
"""
