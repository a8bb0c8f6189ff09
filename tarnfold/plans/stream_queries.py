"""Queries that run as streams over the given tables until all rows are read; their results equal the batch operators'."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.checkpoints import shared_dir
from tarnfold.functions.vocabulary import FINAL_STATES
from tarnfold.plans import views
from tarnfold.plans.state_queries import ORACLE_SQL as ORACLES
from tarnfold.plans.text_queries import ORACLE_SQL as TEXT_ORACLES
from tarnfold.sources.readers import read_state
from tarnfold.streaming import streams

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark: SparkSession, d: str, name: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The view that `read` makes of a table, as a stream: the view's session is one whose reader streams."""
    schema = views.table(spark, d, name).schema
    stream = spark.readStream.schema(schema)
    return read(SimpleNamespace(read=SimpleNamespace(parquet=lambda path: stream.parquet(f"{path}*"))), d)  # a pattern, as a stream can't read a single file by name


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _last_update(df: DataFrame, key: str) -> DataFrame:
    """What a stream in update mode says last of each key: each batch is written with its number, and of each key the last counts."""
    spark, root = df.sparkSession, _folder(df.sparkSession)

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch_", F.lit(n)).write.mode("overwrite").parquet(f"{root}/rows/n={n}")

    df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{root}/rows").drop("n")
    rest = [c for c in rows.columns if c not in (key, "batch_")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_").alias("r")).select(key, "r.*")


def r1_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    root = _folder(spark)
    out = streams.stream_dedup(_stream(spark, d, "events", views.attempts).select("item_id", "ts"), ["item_id"], delay="3650 days")
    out.select("item_id").writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("item_id long").parquet(f"{root}/rows")


def r2_stream_scan_state(spark: SparkSession, d: str) -> DataFrame:
    """Observations in four files of mixed rounds, a batch each, so keys are seen again in earlier rounds than before."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = _folder(spark)
    obs = views.attempts(spark, d).select(F.col("job_id").alias("source_id"), "round", F.col("item_id").alias("key"))
    obs.repartition(4, F.xxhash64("round", "key")).write.parquet(f"{root}/observations")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/observations")
    streams.stream_scan_state(stream, f"{root}/rounds", f"{root}/checkpoint", shards=4).awaitTermination()
    return streams.read_scan_state(spark, f"{root}/rounds")


def r3_stream_progress(spark: SparkSession, d: str) -> DataFrame:
    return _last_update(streams.stream_progress(_stream(spark, d, "events", views.attempts), "job_id", "status"), "job_id")


def r4_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Results in four files of mixed positions, a batch each, so most keys have rows that come late; all of them over one state table."""
    root = _folder(spark)
    results = views.attempts(spark, d).select("item_id", "status", F.col("reason").alias("quality"), "position")
    results.repartition(4, F.xxhash64("position")).write.parquet(f"{root}/results")
    stream = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/results")
    streams.stream_upsert(stream, root, "source_items", "item_id", ["status", "quality"], f"{root}/checkpoint", "position").awaitTermination()
    return read_state(spark, root, "source_items").select("item_id", "status", "quality")


def r5_stream_redacted_log(spark: SparkSession, d: str) -> DataFrame:
    root = _folder(spark)
    lines = _stream(spark, d, "documents", views.notes).select(F.col("ordinal").alias("doc_id"), F.col("body").alias("message"))
    streams.stream_redacted_log(lines, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id long, message string").json(f"{root}/rows")


QUERIES = {f.__name__: f for f in (r1_stream_dedup, r2_stream_scan_state, r3_stream_progress, r4_stream_upsert, r5_stream_redacted_log)}
#: The same rows by SQL over the whole tables.
ORACLE_SQL = {
    "r1_stream_dedup": "SELECT DISTINCT user_id AS item_id FROM events",
    "r2_stream_scan_state": ORACLES["w8_stop_point"].replace("SELECT s.job_id,", "SELECT s.job_id::VARCHAR AS source_id, (SELECT count(*) FROM v3 WHERE v3.job_id = s.job_id) AS observations, (SELECT count(DISTINCT item_id) FROM v3 WHERE v3.job_id = s.job_id) AS unique_items, (SELECT count(*) - count(DISTINCT item_id) FROM v3 WHERE v3.job_id = s.job_id) AS duplicates, (SELECT count(DISTINCT round) FROM v3 WHERE v3.job_id = s.job_id) AS rounds,").replace(", CAST(total AS BIGINT) AS unique_items", ""),
    "r3_stream_progress": f"WITH {views.ATTEMPTS} SELECT job_id, count(*) AS n_items, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in FINAL_STATES) + ", count(*) FILTER (status = 'interrupted') AS recoverable, count(*) FILTER (status <> 'interrupted') AS unknown FROM v3 GROUP BY 1",
    "r4_stream_upsert": f"WITH {views.ATTEMPTS} SELECT item_id, arg_max(status, position) AS status, arg_max(reason, position) AS quality FROM v3 GROUP BY 1",
    "r5_stream_redacted_log": TEXT_ORACLES["s10_redacted_log"],
}
