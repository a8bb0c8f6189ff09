"""Writers: versioned state tables, CSV reports, summaries, notes, assets, redacted logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.checkpoints import drop_folder, scratch_folder
from tarnfold.functions.text import csv_guard, redact
from tarnfold.operators.windows import latest_values
from tarnfold.sources import versions
from tarnfold.sources.readers import NOTE_FILES, STATE_KEYS, STATE_TABLES, shaped


def write_state(df: DataFrame, root: str, name: str, base: int | None = None) -> int:
    """df as the whole state table, in one commit whose number is returned: readers see the old or the new table, never a part.

    base: the version that df was made from (state_version), by default the newest at the call. If another commit has followed it, this
    one is refused with CommitConflict.
    """
    spark, where = df.sparkSession, f"{root}/{name}"
    at = versions.snapshot(spark, where) if base is None else versions.snapshot(spark, where, base) if base else versions.Snapshot()
    return versions.commit(spark, where, at, versions.write_parts(shaped(df, name), where, at.keys, at.buckets)).version


def state_version(spark: SparkSession, root: str, name: str) -> int:
    """The number of the newest commit of a state table; 0 if there is none yet."""
    return versions.snapshot(spark, f"{root}/{name}").version


def upsert_state(df: DataFrame, root: str, name: str, buckets: int = 16) -> int:
    """Rows of df in place of the state table's rows of the same key (STATE_KEYS); only the buckets that they fall into are written again."""
    return versions.merge(shaped(df, name), f"{root}/{name}", STATE_TABLES[name], STATE_KEYS[name], buckets).version


def merge_ordered(batch: DataFrame, root: str, name: str, key: str, value: list[str], order: str, stream: str = "", number: int = -1, buckets: int = 16) -> int:
    """Lays results over a state table by key: of each value the last by order that isn't null counts, whichever batch it comes in.

    The order of each value is kept in the table, so rows that come late lose to later ones that are there already, and any cutting and
    order of batches gives what latest_values gives over all rows. Rows written without an order lose to any. Other
    columns stay; unknown keys become new rows. Only touched buckets are written again. number: the batch's; a batch that
    `stream` has committed is not laid again.
    """
    spark, where = batch.sparkSession, f"{root}/{name}"
    at = versions.snapshot(spark, where)
    if stream and int(at.notes.get(stream, -1)) >= number:
        return at.version
    kind = batch.schema[order].dataType
    stored = T.StructType([*STATE_TABLES[name].fields, *(T.StructField(f"order_{v}", kind) for v in value)])
    typed = batch.select(F.col(key).cast(STATE_TABLES[name][key].dataType).alias(key), *(F.col(v).cast(STATE_TABLES[name][v].dataType).alias(v) for v in value), order)
    last = latest_values(typed, key, value, order, keep_order=True)
    path = scratch_folder(spark, "upsert")
    last.write.parquet(path)  # read twice: for its buckets and for its rows
    last = spark.read.schema(last.schema).parquet(path)
    touched = sorted(str(r[0]) for r in last.select(versions.bucket_of([key], buckets)).distinct().collect())  # at most `buckets`
    fresh = not at.version or (at.buckets, at.keys) != (buckets, (key,))
    rest = [c for c in STATE_TABLES[name].names if c not in (key, *value)]
    held = lambda v: F.when(F.col(v).isNotNull(), F.struct(F.col(f"order_{v}").alias("at"), F.col(v).alias("v")))
    old = versions.rows(spark, where, at, stored, None if fresh else touched).select(key, *(held(v).alias(v) for v in value), F.struct(*rest).alias("rest"))
    both = old.unionByName(last.select(key, *(held(v).alias(v) for v in value)), allowMissingColumns=True)
    laid = both.groupBy(key).agg(*(F.max(v).alias(v) for v in value), F.max("rest").alias("rest"))
    out = laid.select(key, *(F.col(v)["v"].alias(v) for v in value), *(F.col("rest")[c].alias(c) for c in rest), *(F.col(v)["at"].alias(f"order_{v}") for v in value)).select(*stored.names)
    notes = {stream: str(number)} if stream else None
    parts = versions.write_parts(out, where, (key,), buckets) if touched else {}
    done = versions.commit(spark, where, at, parts, None if fresh else touched, buckets, (key,), notes).version
    drop_folder(spark, path)
    return done


def guarded(df: DataFrame) -> DataFrame:
    """All columns as text for CSV: nested ones as JSON, strings guarded against formulas."""
    def column(name: str, kind: str):
        c = F.col(f"`{name}`")
        return (csv_guard(c) if kind == "string" else csv_guard(F.to_json(c)) if kind.startswith(("struct", "array", "map")) else c.cast("string")).alias(name)

    return df.select(*(column(n, k) for n, k in df.dtypes))


def write_csv_report(df: DataFrame, path: str) -> None:
    """RFC 4180 with a header; no rows give empty files without one."""
    rows = guarded(df)
    rows.write.mode("overwrite").option("header", str(not rows.isEmpty()).lower()).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One row as JSON, nulls kept."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_notes(df: DataFrame, root: str, shard: str = "shard", removed: DataFrame | None = None, buckets: int = 16) -> int:
    """Files (relative_path, text, shard, and if there are any owner, kind, written_hash, job_id) into the store of notes, each in place of the file of the same path; all other files stay. The number of the commit.

    removed: paths (relative_path) of files that go. Of rows with one path the greatest by text is written. A null
    text is an empty file; rows without a path are left out.
    """
    given = [c for c in ("owner", "kind", "written_hash", "job_id") if c in df.columns]
    files = df.filter("relative_path is not null").select("relative_path", F.coalesce("text", F.lit("")).alias("text"), F.col(shard).cast("string").alias("shard"), *given).withColumn("content_hash", F.sha2("text", 256))
    shape = T.StructType.fromDDL(NOTE_FILES)
    whole = files.select(*(F.col(f.name) if f.name in files.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape.fields))
    return versions.merge(whole, root, shape, ["relative_path"], buckets, removed).version


def unique_assets(df: DataFrame) -> DataFrame:
    """One row for each content; who refers to it stays in the table of paths."""
    return df.groupBy("sha256").agg(F.max("size").alias("size"), F.count("*").alias("n_refs"))


#: A stored content.
ASSET_FILES = "sha256 string, size long, content binary"


def write_assets(df: DataFrame, root: str, buckets: int = 16) -> DataFrame:
    """Asset bytes (content) into the store, once for each content hash whatever earlier runs have stored. One row: n_refs, n_contents, n_new of this call.

    Hashes are taken from the bytes. Only hashes are compared with the store, bucket by bucket; then the new contents alone move and are
    added. Null contents are no assets.
    """
    spark = df.sparkSession
    found = df.filter("content is not null").select(F.sha2("content", 256).alias("sha256"), "content")
    path = scratch_folder(spark, "hashes")
    found.groupBy("sha256").agg(F.count("*").alias("n")).write.parquet(path)
    hashes = spark.read.schema("sha256 string, n long").parquet(path)
    at = versions.snapshot(spark, root)
    touched = sorted(str(r[0]) for r in hashes.select(versions.bucket_of(["sha256"], buckets)).distinct().collect())  # at most `buckets`
    new = hashes.join(versions.rows(spark, root, at, ASSET_FILES, touched).select("sha256"), "sha256", "left_anti")
    told = hashes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_refs"), F.count("*").alias("n_contents")).first()
    n_new = new.count()
    if n_new:
        one = found.join(new.select("sha256"), "sha256", "left_semi").groupBy("sha256").agg(F.first("content").alias("content"))  # rows of one hash have one content
        versions.append(one.select("sha256", F.octet_length("content").cast("long").alias("size"), "content"), root, ["sha256"], buckets)
    drop_folder(spark, path)
    return spark.createDataFrame([(told["n_refs"], told["n_contents"], n_new)], "n_refs long, n_contents long, n_new long")


def read_assets(spark: SparkSession, root: str) -> DataFrame:
    """(sha256, size, content) of the stored contents; none if nothing was stored yet."""
    return versions.rows(spark, root, versions.snapshot(spark, root), ASSET_FILES)


def redacted_log(df: DataFrame, column: str = "message") -> DataFrame:
    return df.withColumn(column, redact(F.col(column)))


def write_redacted_log(df: DataFrame, path: str, column: str = "message") -> None:
    redacted_log(df, column).write.mode("append").json(path)
