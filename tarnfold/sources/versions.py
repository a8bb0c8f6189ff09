"""Tables that change by numbered commits: a reader sees one commit or the next, never a part, and of two writers that touch the same rows one is refused.

A table is a folder of data folders, each written once, and a log with one file a commit: which data folders hold which bucket
of the rows. A commit stages its file beside the log and then moves it to the next number, which fails if the number is
taken. The newest number is the table. Rows are dealt over buckets by a hash of their key, so a merge writes the buckets
it touches again and names the others as they were.

The move must not replace a file: HDFS and ABFS rename so, a local folder gets a hard link. A plain object store needs a file system
over it that can.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.checkpoints import drop_folder, scratch_folder

#: In `touched`: all buckets, those of an older layout, too.
ALL = "*"


class CommitConflict(RuntimeError):
    """Another writer has changed the same buckets since the rows were read."""


@dataclass(frozen=True)
class Snapshot:
    """A commit: its number (0: none yet), the layout, the data folders of each bucket, and what writers have noted, such as the last batch of a stream."""

    version: int = 0
    buckets: int = 1
    keys: tuple[str, ...] = ()
    parts: dict[str, list[str]] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)
    touched: tuple[str, ...] = ()
    name: str = ""
    follows: str = ""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, time of change) of what lies in a folder; none if there is no such folder."""
    fs, where = _fs(spark, folder)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(where)] if fs.exists(where) else []


def _file(root: str, version: int) -> str:
    return f"{root}/_log/{version:020d}.json"


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n, _ in _names(spark, f"{root}/_log") if n.endswith(".json"))


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The newest commit, or the numbered one; version 0 with no rows where there is none."""
    if version is None:
        found = _versions(spark, root)
        if not found:
            return Snapshot()
        version = found[-1]
    fs, where = _fs(spark, _file(root, version))
    stream = fs.open(where)
    try:
        told = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Snapshot(**told | {"keys": tuple(told["keys"]), "touched": tuple(told["touched"])})


def rows(spark: SparkSession, root: str, at: Snapshot, schema, buckets: list[str] | None = None) -> DataFrame:
    """The rows of a commit, or of some of its buckets; columns that a data folder lacks are null."""
    folders = [f"{root}/{p}" for b, each in sorted(at.parts.items()) if buckets is None or b in buckets for p in each]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def bucket_of(keys: list[str] | tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_parts(df: DataFrame, root: str, keys: tuple[str, ...], buckets: int) -> dict[str, list[str]]:
    """df in a new data folder, one part for each bucket that has rows."""
    home = f"data/{uuid.uuid4().hex}"
    if buckets == 1:
        df.write.parquet(f"{root}/{home}/b-0")
        return {"0": [f"{home}/b-0"]}
    _dealt(df, keys, buckets).drop("share_").write.partitionBy("bucket_").parquet(f"{root}/{home}")
    return _parts(df.sparkSession, root, home)


def _stage(spark: SparkSession, root: str, at: Snapshot) -> str:
    """The commit's file beside the log, where no reader looks."""
    path = f"{root}/_log/.{uuid.uuid4().hex}.staged"
    fs, where = _fs(spark, path)
    stream = fs.create(where, False)
    try:
        stream.write(bytearray(json.dumps(at.__dict__).encode()))
    finally:
        stream.close()
    return path


def _publish(spark: SparkSession, root: str, staged: str, version: int) -> bool:
    """Moves a staged file to its number; false if the number is taken."""
    jvm = spark._jvm
    fs, source = _fs(spark, staged)
    _, to = _fs(spark, _file(root, version))
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(to), local(source))
        else:
            no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(source, to, no_options)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def commit(spark: SparkSession, root: str, base: Snapshot, parts: dict[str, list[str]], touched: list[str] | None = None, buckets: int | None = None, keys: tuple[str, ...] | None = None, notes: dict[str, str] | None = None) -> Snapshot:
    """The next commit: parts in place of the touched buckets of base (None: of all), other buckets as they are.

    Commits made since base are kept where they touched other buckets; if one touched the same, or the layout differs, this one is refused
    with CommitConflict and the table stays as it is.
    """
    mine, now = {ALL} if touched is None else set(touched), base
    while True:
        kept = {} if ALL in mine else {b: p for b, p in now.parts.items() if b not in mine}
        told = Snapshot(now.version + 1, buckets or now.buckets, tuple(now.keys if keys is None else keys), kept | parts, now.notes | (notes or {}), tuple(sorted(mine)), uuid.uuid4().hex, now.name)
        staged = _stage(spark, root, told)
        try:
            done = _publish(spark, root, staged, told.version)
        finally:
            fs, where = _fs(spark, staged)
            fs.delete(where, False)
        versions = _versions(spark, root)
        if done:
            later = told.version + 1
            if versions[-1] == told.version or later in versions and snapshot(spark, root, later).follows == told.name:
                return told
            fs, where = _fs(spark, _file(root, told.version))  # the number was free only because clean() had removed it
            fs.delete(where, False)
            raise CommitConflict(f"{root}: version {base.version} is too old to commit upon")
        for version in range(now.version + 1, versions[-1] + 1):
            if version not in versions:
                raise CommitConflict(f"{root}: version {base.version} is too old to commit upon")
            other = snapshot(spark, root, version)
            theirs = set(other.touched)
            if ALL in mine | theirs or mine & theirs or (other.buckets, other.keys) != (told.buckets, told.keys):
                raise CommitConflict(f"{root}: version {version} has changed rows that were read at version {base.version}")
            now = other


def _dealt(df: DataFrame, keys: list[str] | tuple[str, ...], buckets: int) -> DataFrame:
    """df with its bucket and a share of it, so that a bucket is as many tasks as it has shares; equal keys are together."""
    return df.withColumn("bucket_", bucket_of(keys, buckets)).withColumn("share_", F.pmod(F.hash(*keys), F.lit(SHARES))).repartition("bucket_", "share_")


#: Tasks that write a bucket at most.
SHARES = 16


def merge(new: DataFrame, root: str, schema, keys: list[str], buckets: int = 16, removed: DataFrame | None = None) -> Snapshot:
    """Rows of new in place of those of the same keys; rows with other keys stay. Only data folders that hold new or removed keys are written again; no such keys make no commit.

    Keys are compared null-safe; of rows of new with one key the greatest by the other columns counts. removed: keys whose rows go, where new has
    none. Which folders hold the keys is told by the keys alone. If none does and no key comes twice, new is added where it lies; else the rows of those
    folders and of new move once, dealt by bucket. A bucket of more than `PARTS` folders is written again whole. A table of another layout is dealt anew, once.
    """
    spark, base = new.sparkSession, snapshot(new.sparkSession, root)
    gone = new.select(*keys).limit(0) if removed is None else removed.select(*keys)
    asked = new.select(*keys, F.lit(1).alias("n_")).unionByName(gone.withColumn("n_", F.lit(0))).groupBy(*keys).agg(F.sum("n_").alias("n_"))
    path = scratch_folder(spark, "keys")
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    most = {str(r["b"]): r["n"] for r in asked.groupBy(bucket_of(keys, buckets).alias("b")).agg(F.max("n_").alias("n")).collect()}  # at most `buckets`
    touched = sorted(most)
    if not touched:
        drop_folder(spark, path)
        return base
    fresh = bool(base.version) and (base.buckets, base.keys) != (buckets, tuple(keys))
    kept = {} if fresh else {b: p for b, p in base.parts.items() if b in most}
    again = set() if fresh else _holding(rows(spark, root, base, schema, touched), asked, keys) if kept else set()
    again |= {p for each in kept.values() if len(each) >= PARTS for p in each}
    drop_folder(spark, path)
    old = rows(spark, root, base if fresh else replace(base, parts={b: [p for p in each if p in again] for b, each in kept.items()}), schema)
    kept = {b: [p for p in each if p not in again] for b, each in kept.items()}
    rest = [c for c in old.columns if c not in keys]
    ranked = lambda df, rank: df.select(*keys, F.struct(F.lit(rank).alias("rank"), *(F.col(c) for c in rest)).alias("row"))
    nothing = F.struct(F.lit(1).alias("rank"), *(F.lit(None).cast(old.schema[c].dataType).alias(c) for c in rest))
    all_ = ranked(old, 0).unionByName(gone.select(*keys, nothing.alias("row"))).unionByName(ranked(new, 2))
    if fresh or again or max(most.values()) > 1:
        last = _dealt(all_, keys, buckets).groupBy("bucket_", "share_", *keys).agg(F.max("row").alias("row")).filter("row.rank <> 1")
        last = last.select("bucket_", *(F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in old.columns))
    else:
        last = new.select(bucket_of(keys, buckets).alias("bucket_"), *(F.col(c).cast(old.schema[c].dataType).alias(c) for c in old.columns))
    home = f"data/{uuid.uuid4().hex}"
    last.write.option("compression", "zstd").partitionBy("bucket_").parquet(f"{root}/{home}")
    made = _parts(spark, root, home)
    parts = {b: each for b in touched if (each := kept.get(b, []) + made.get(b, []))} if not fresh else made
    return commit(spark, root, base, parts, touched if base.version and not fresh else None, buckets, tuple(keys))


#: Data folders of a bucket at which a merge writes it again whole.
PARTS = 16


def _holding(old: DataFrame, asked: DataFrame, keys: list[str]) -> set[str]:
    """Data folders in which a row has one of the keys."""
    keyed = old.select(*keys, F.regexp_extract("_metadata.file_path", "(data/[^/]+/[^/]+)/[^/]*$", 1).alias("part_"))
    to = asked.select(*(F.col(k).alias(f"{k}_") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return {r["part_"] for r in keyed.join(to, same, "left_semi").select("part_").distinct().collect()}  # at most PARTS for each bucket


def _parts(spark: SparkSession, root: str, home: str) -> dict[str, list[str]]:
    return {n.removeprefix("bucket_="): [f"{home}/{n}"] for n, _ in _names(spark, f"{root}/{home}") if n.startswith("bucket_=")}


def append(new: DataFrame, root: str, keys: list[str], buckets: int = 16) -> Snapshot:
    """Rows of new beside the ones that are there; nothing is written again. Refused if another commit touched the same buckets since the snapshot that is read here."""
    base = snapshot(new.sparkSession, root)
    if base.version and (base.buckets, base.keys) != (buckets, tuple(keys)):
        raise ValueError(f"{root} is dealt over {base.buckets} buckets by {base.keys}")
    parts = write_parts(new, root, tuple(keys), buckets)
    return commit(new.sparkSession, root, base, {b: base.parts.get(b, []) + p for b, p in parts.items()}, sorted(parts), buckets, tuple(keys)) if parts else base


def clean(spark: SparkSession, root: str, keep: int = 3, hours: float = 168) -> int:
    """Removes commits before the last `keep` and the data folders that only they name; also folders and staged files that no commit names once they are `hours` old, as their writer is then taken for dead. How many data folders went."""
    versions = _versions(spark, root)
    if not versions:
        return 0
    held, dropped = versions[-keep:], versions[:-keep]
    live = {p.split("/")[1] for v in held for each in snapshot(spark, root, v).parts.values() for p in each}
    named = {p.split("/")[1] for v in dropped for each in snapshot(spark, root, v).parts.values() for p in each}
    before = spark._jvm.java.lang.System.currentTimeMillis() - hours * 3_600_000
    for v in dropped:
        fs, where = _fs(spark, _file(root, v))
        fs.delete(where, False)
    for name, changed in _names(spark, f"{root}/_log"):
        if name.endswith(".staged") and changed < before:
            fs, where = _fs(spark, f"{root}/_log/{name}")
            fs.delete(where, False)
    gone = [name for name, changed in _names(spark, f"{root}/data") if name not in live and (name in named or changed < before)]
    for name in gone:
        fs, where = _fs(spark, f"{root}/data/{name}")
        fs.delete(where, True)
    return len(gone)
