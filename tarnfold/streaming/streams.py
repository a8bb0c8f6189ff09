"""Streaming forms. Each gives what its batch operator gives over the same rows, however they are cut into batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tarnfold.functions.text import redact
from tarnfold.operators.aggregates import state_counts
from tarnfold.operators.windows import stop_of_rounds
from tarnfold.sources.versions import clean
from tarnfold.sources.writers import merge_ordered


def stream_dedup(obs: DataFrame, key: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; later repeats are beyond it and are dropped as late."""
    return obs.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


_ROUNDS = "source_id string, round long, n long, new long"


#: Keys of a shard lie on so many pages, each read and written whole: one call to the state for a page, not some for each key.
_PAGES = 1024
#: Keys of a batch that are held before they go to their pages.
_HELD = 100_000


class _FirstRounds(StatefulProcessor):
    """The first round of each key of a shard of a source. A batch emits what it changes: observations, and keys that are new in a round or have left it for an earlier one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page int", "keys array<string>, rounds array<long>")

    def _lay(self, first: dict[str, int], new: Counter[int]) -> None:
        """Keys with their first rounds over the state; what changes is counted in new."""
        paged: dict[int, list[str]] = {}
        for name in first:
            paged.setdefault(crc32(name.encode()) % _PAGES, []).append(name)
        for page, names in paged.items():
            held = dict(zip(*self.pages.getValue((page,)), strict=True)) if self.pages.containsKey((page,)) else {}
            changed = False
            for name in names:
                at, had = first[name], held.get(name)
                if had is None or at < had:
                    held[name], changed = at, True
                    new[at] += 1
                    if had is not None:
                        new[had] -= 1
            if changed:
                self.pages.updateValue((page,), (list(held), list(held.values())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen: Counter[int] = Counter()
        new: Counter[int] = Counter()
        first: dict[str, int] = {}
        for part in rows:
            seen.update({int(r): int(n) for r, n in part.groupby("round").size().items()})
            for item, at in part.groupby("key", dropna=False)["round"].min().items():
                name = "" if pd.isna(item) else f"={item}"  # the null key is one, too
                first[name] = min(int(at), first.get(name, int(at)))
            if len(first) > _HELD:
                self._lay(first, new)
                first = {}
        self._lay(first, new)
        changed = sorted(seen.keys() | new.keys())
        yield pd.DataFrame({"source_id": [key[0]] * len(changed), "round": changed, "n": [seen[r] for r in changed], "new": [new[r] for r in changed]})

    def close(self) -> None:
        pass


def stream_scan_rounds(obs: DataFrame, shards: int = 64) -> DataFrame:
    """Changes to the counts of each (source_id, round), for append mode: n observations more, new keys more or fewer. obs: source_id, round, key; rows without a round are left out. Needs the RocksDB state store.

    Keys are dealt over shards by their hash, so a source of any size is as many tasks as it has shards; the sums of the changes are a row for
    each round. A key costs its page, 1/1024 of a shard's keys, so a large source wants many shards. A checkpoint that held keys one by one can't go on.
    """
    typed = obs.select(F.col("source_id").cast("string").alias("source_id"), F.col("round").cast("long").alias("round"), F.col("key").cast("string").alias("key")).filter("round is not null")
    return typed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("source_id", "shard").transformWithStateInPandas(_FirstRounds(), _ROUNDS, "Append", "None")


def stream_scan_state(obs: DataFrame, root: str, checkpoint: str, shards: int = 64) -> StreamingQuery:
    """Observations into the scan state under root, by each batch's changes; read_scan_state reads it."""
    return stream_scan_rounds(obs, shards).writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def read_scan_state(spark: SparkSession, root: str, patience: int = 5, cap: int | None = None) -> DataFrame:
    """Per source_id: observations, unique items, duplicates, rounds, where the scan stops and why (as stop_point), of all batches so far."""
    rounds = spark.read.schema(_ROUNDS).parquet(root).groupBy("source_id", "round").agg(F.sum("n").alias("n"), F.sum("new").alias("new"))
    counts = rounds.groupBy("source_id").agg(F.sum("n").alias("observations"), F.sum("new").alias("unique_items"), (F.sum("n") - F.sum("new")).alias("duplicates"), F.count("*").alias("rounds"))
    return counts.join(stop_of_rounds(rounds, "source_id", patience, cap).select("source_id", "stop_round", "reason"), "source_id")


def stream_progress(events: DataFrame, by: str = "job_id", state: str = "state") -> DataFrame:
    """Running state counts of each job, for update mode."""
    return state_counts(events, [by], state)


def stream_upsert(results: DataFrame, root: str, name: str, key: str, value: list[str], checkpoint: str, order: str, buckets: int = 16, keep: int = 3) -> StreamingQuery:
    """Results go over the state table by key, the last of each value by order; see merge_ordered. Late, repeated and rerun batches give the same table. Of old versions the last `keep` stay."""

    def commit(batch: DataFrame, number: int) -> None:
        merge_ordered(batch, root, name, key, value, order, checkpoint, number, buckets)
        clean(batch.sparkSession, f"{root}/{name}", keep)

    return results.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_redacted_log(lines: DataFrame, path: str, checkpoint: str, column: str = "message") -> StreamingQuery:
    return lines.withColumn(column, redact(F.col(column))).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
