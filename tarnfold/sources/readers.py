"""Readers: note exports, HTML export folders, input inventories, saved lists, state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.functions.text import list_entries
from tarnfold.functions.urls import resolve_url
from tarnfold.operators.windows import order_ordinals
from tarnfold.sources import versions

_RESOURCE = "struct<data:string,mime:string,`resource-attributes`:struct<`file-name`:string,attachment:string>>"
_NOTE = f"struct<title:string,content:string,created:string,updated:string,tag:array<string>,guid:string,`note-attributes`:map<string,string>,resource:array<{_RESOURCE}>,_corrupt:string>"


def read_enex(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(notes, issues) of note exports. Files are split at </note>, so one file is read by many tasks and a damaged note harms no other.

    A note that doesn't parse, or whose piece holds no or several <note>, is an issue. Ordinals count all notes of a file, damaged ones too.
    """
    raw = spark.read.option("lineSep", "</note>").text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    pieces = order_ordinals(raw.filter(F.col("value").contains("<note>")), "path", ["nth"], "block").withColumnRenamed("note_no", "ordinal")
    xml = F.concat(F.regexp_extract("value", r"(?s)(<note>.*)$", 1), F.lit("</note>"))
    parsed = pieces.withColumn("n", F.from_xml(xml, _NOTE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "rowTag": "note"}))
    bad = F.col("n").isNull() | F.col("n._corrupt").isNotNull() | (F.regexp_count("value", F.lit("<note>")) != 1)
    notes = parsed.filter(~bad).select(
        "path", "ordinal", "n.title", "n.content", "n.created", "n.updated", F.coalesce("n.tag", F.array().cast("array<string>")).alias("tags"), "n.guid", F.col("n.note-attributes").alias("attributes"),
        F.coalesce(F.transform("n.resource", lambda r: F.struct(r["data"].alias("data"), r["mime"].alias("mime"), r["resource-attributes"]["file-name"].alias("file_name"), (r["resource-attributes"]["attachment"] == "true").alias("attachment"))), F.array().cast("array<struct<data:string,mime:string,file_name:string,attachment:boolean>>")).alias("resources"),
    )
    return notes, parsed.filter(bad).select("path", "ordinal", F.lit("damaged_note").alias("issue"))


def read_html_export(spark: SparkSession, root: str, names: str = "*.html") -> DataFrame:
    """One note for each .html file, or each file that names matches: title, notebook (the parent folder, or the root's name for a file in it), hash of the bytes, path relative to the root."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    home = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    relative = F.substring(F.col("path"), F.lit(len(home) + 2), F.lit(1 << 30))
    html = F.decode("content", "UTF-8")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.html$", "")
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), name)
    outside = files.filter(~F.col("path").rlike(r"\.resources/"))
    return outside.select(relative.alias("relative_path"), title.alias("title"), F.element_at(F.split("path", "/"), -2).alias("notebook"), F.sha2("content", 256).alias("file_sha256"), html.alias("html"), F.length("content").cast("long").alias("size"))


def inventory_inputs(spark: SparkSession, roots: list[str], include_html: bool = True) -> DataFrame:
    """path, size, modified, kind (enex, html, skipped) and reason of every file under the roots, each once.

    Only metadata is read. Dot-files and resource folders are skipped; a file in the refused format fails the run.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).dropDuplicates(["path"])
    name, ext = F.element_at(F.split("path", "/"), -1), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = (
        F.when(name.startswith("."), "dot_file").when(F.col("path").rlike(r"\.resources/"), "resource_folder").when(ext == "notes", "refused_format").when(ext == "enex", F.lit(None).cast("string"))
        .when(ext.isin("html", "htm") & F.lit(include_html), F.lit(None).cast("string")).otherwise("unknown_extension")
    )
    told = files.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isNotNull(), "skipped").when(ext == "enex", "enex").otherwise("html"))
    refused = told.filter("reason = 'refused_format'").limit(1).collect()
    if refused:
        raise ValueError(f"files in the proprietary note format can't be read: {refused[0]['path']}")
    return told


def read_observations(pages: DataFrame, key: str = "source_position", html: str = "html", url: str | None = None) -> DataFrame:
    """One row for each list entry of saved-list pages: position on the page, link, title, author, summary, cover, time, collection and id, null where an entry has none.

    Entries without a link are dropped. url: the column with the page's address, by which links and covers become absolute.
    """
    base = [F.col(url).alias("base")] if url else []
    rows = pages.select(F.col(key).alias("page"), *base, F.posexplode(list_entries(F.col(html))).alias("nth", "e"))
    whole = lambda name: resolve_url(F.col("base"), F.col(f"e.{name}")) if url else F.col(f"e.{name}")
    return rows.select("page", F.col("nth").cast("long").alias("nth"), whole("href").alias("href"), "e.title", "e.author", "e.summary", whole("cover").alias("cover"), "e.published", "e.collection", "e.external_id")


_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


#: The state tables with their columns.
STATE_TABLES = {
    "source_instances": _table(source_id=_S, kind=_S, display_name=_S, created_at=_S), "target_instances": _table(target_id=_S, kind=_S, root=_S, created_at=_S),
    "migration_jobs": _table(job_id=_S, source_id=_S, target_id=_S, status=_S, current_stage=_S, pause_reason=_S, scan_count=_L, verified_count=_L, degraded_count=_L, failed_count=_L, conflict_count=_L, skipped_count=_L, created_at=_S, updated_at=_S),
    "source_items": _table(item_id=_L, source_id=_S, fingerprint=_S, stable_key=_S, item_key=_S, short_id=_S, external_id=_S, canonical_url=_S, title=_S, kind=_S, status=_S, quality=_S, content_hash=_S, metadata_json=_S, updated_at=_S),
    "source_assets": _table(asset_id=_L, item_id=_L, url=_S, mime=_S, size=_L, sha256=_S, file_name=_S), "target_artifacts": _table(artifact_id=_L, target_id=_S, item_id=_L, job_id=_S, kind=_S, status=_S, relative_path=_S, written_hash=_S, created_at=_S),
    "migration_attempts": _table(attempt_id=_L, job_id=_S, item_id=_L, scope=_S, action=_S, attempt_no=_L, success=_B, error_code=_S, started_at=_S, finished_at=_S), "cleanup_plans": _table(plan_id=_S, source_id=_S, plan_hash=_S, n_candidates=_L, created_at=_S),
    "cleanup_jobs": _table(job_id=_S, plan_id=_S, status=_S, created_at=_S), "cleanup_items": _table(cleanup_item_id=_L, job_id=_S, item_id=_L, action_status=_S), "cleanup_attempts": _table(attempt_id=_L, cleanup_item_id=_L, attempt_no=_L, result=_S, audit_json=_S),
}


#: What a row of a state table is known by.
STATE_KEYS = {
    "source_instances": ["source_id"], "target_instances": ["target_id"], "migration_jobs": ["job_id"], "source_items": ["stable_key"], "source_assets": ["asset_id"], "target_artifacts": ["target_id", "relative_path"],
    "migration_attempts": ["attempt_id"], "cleanup_plans": ["plan_id"], "cleanup_jobs": ["job_id"], "cleanup_items": ["cleanup_item_id"], "cleanup_attempts": ["attempt_id"],
}

#: A file in the store of notes. owner: the item that a job wrote it for; written_hash: what that job wrote; both null in a user's file.
NOTE_FILES = "relative_path string, text string, content_hash string, shard string, owner string, kind string, written_hash string, job_id string"


def read_state(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The newest version of a state table, or a numbered one that clean() hasn't removed; empty if there is none yet."""
    where = f"{root}/{name}"
    return versions.rows(spark, where, versions.snapshot(spark, where, version), STATE_TABLES[name])


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """The files of a store of notes; none if nothing was written yet."""
    return versions.rows(spark, root, versions.snapshot(spark, root), NOTE_FILES)


def shaped(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns of a state table, in order; missing ones are null."""
    column = lambda f: (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
    return df.select(*(column(f) for f in STATE_TABLES[name].fields))


def first_line(c: Column, most: int = 60) -> Column:
    return F.substring(F.split(c, "\n").getItem(0), 1, most)
