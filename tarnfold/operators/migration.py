"""The whole way of a migration: scan, first observation, extraction, paths, decisions, notes, verification, index, state and reconciliation, as joins over tables.

PageSource, NoteExportSource and NoteFolder are sources and a target behind the protocols in adapters; migrate() runs any pair of them. A job touches
its own notes only: what it does with a path is decided by overwrite_decision from the hash that is found there and the one that was
last written. With state tables a job goes on where earlier ones ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfold.checkpoints import drop_folder, scratch_folder
from tarnfold.functions import arrays, identity, text, urls
from tarnfold.operators import aggregates, guards
from tarnfold.operators.adapters import Source, Target
from tarnfold.operators.html_job import html_job, rewrite_wikilinks
from tarnfold.operators.joins import commit_results, overwrite_decision, skip_verified, upsert_artifacts
from tarnfold.operators.windows import asset_names, assign_paths, first_observation, latest, next_attempt, spread_row_number
from tarnfold.sources import versions
from tarnfold.sources.readers import STATE_TABLES, read_enex, read_notes, read_state
from tarnfold.sources.writers import read_assets, upsert_state, write_assets, write_notes

#: What a job does to a file; the others leave it alone.
WRITES = ("write_canonical", "forced_overwrite", "update_metadata_only", "write_new_variant")
_KNOWN = "stable_key string, relative_path string, written_hash string"


class _Held:
    """Tables written once for several later steps, removed together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_folder(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_one(self, name: str) -> None:
        """Removes a table that no later step reads."""
        for path in [p for p in self.paths if f"/{name}-" in p]:
            drop_folder(self.spark, path)
            self.paths.remove(path)

    def drop(self, but: tuple[str, ...] = ()) -> None:
        for path in self.paths:
            if not any(f"/{name}-" in path for name in but):
                drop_folder(self.spark, path)
        self.paths = []


class PageSource:
    """Saved pages (source_instance_id, source_position, original_url, html); pages of one canonical address are one item."""

    def __init__(self, pages: DataFrame, hosts: tuple[str, ...]):
        self.pages, self.hosts = pages, hosts

    def scan(self, spark: SparkSession) -> DataFrame:
        address = urls.canonical_url(F.col("original_url"), self.hosts)
        keyed = self.pages.withColumn("stable_key", identity.stable_key(F.col("source_instance_id"), F.sha2(F.coalesce(address, F.lit("")), 256)))
        return first_observation(keyed, ["stable_key"], ["source_position"])

    def extract(self, items: DataFrame) -> DataFrame:
        titled = items.withColumn("title", text.page_title(F.col("html"), F.col("original_url")))
        body = html_job(titled, "stable_key", pick=True, carry=["source_instance_id", "source_position", "original_url", "title"])
        codes = F.filter(F.split("degradations", ","), lambda c: c != "")
        told = F.transform(codes, lambda c: F.struct(c.alias("code"), F.lit("normalize").alias("stage"), F.concat(F.lit("found while reading the page: "), c).alias("message")))
        return body.select("stable_key", "source_instance_id", "source_position", "original_url", "title", "markdown", "quality", told.alias("degradations"))


class NoteExportSource:
    """Notes of export files, with their attachments and links. attachments: the folder of the library that notes refer to.

    A note's identity is its GUID, else its place in its file; of notes with one identity the first by file and place counts. Damaged notes are
    no items (read_enex tells them). Media that a note's resources don't hold, encrypted parts and the like degrade it.
    """

    def __init__(self, exports: str | list[str], source_id: str = "notes", attachments: str = "Attachments"):
        self.exports, self.source_id, self.attachments = exports, source_id, attachments

    def scan(self, spark: SparkSession) -> DataFrame:
        notes, _ = read_enex(spark, self.exports)
        none = F.lit(None).cast("string")
        named = notes.select("path", "ordinal", "title", "content", "created", "updated", "tags", "guid", F.col("attributes")["source-url"].alias("original_url"), "resources", none.alias("app_link"), F.element_at(F.split("path", "/"), -1).alias("file_name"), none.alias("file_sha256"))
        keyed = identity.note_identity(named).withColumn("source_instance_id", F.lit(self.source_id))
        keyed = keyed.withColumn("stable_key", identity.stable_key(F.col("source_instance_id"), F.col("fingerprint"))).withColumnRenamed("ordinal", "source_position")
        return first_observation(keyed, ["stable_key"], ["path", "source_position"])

    def resources(self, items: DataFrame) -> DataFrame:
        """(stable_key, md5, sha256, content, relative_path) of every resource that decodes, one row for each content of a note."""
        each = items.select("stable_key", F.posexplode("resources").alias("position", "r")).select("stable_key", F.col("position").cast("long").alias("position"), "r.file_name", "r.mime", arrays.decode_base64(F.col("r.data"))["bytes"].alias("content")).filter("content is not null")
        typed = arrays.mime_columns(each.withColumn("sniffed", arrays.sniff_mime(F.col("content"))))
        sha = F.sha2("content", 256)
        named = typed.withColumn("sha256", sha).withColumn("md5", F.md5("content")).withColumn("file_name", F.coalesce(F.nullif(F.trim("file_name"), F.lit("")), F.concat(F.substring(sha, 1, 16), F.lit("."), "extension")))
        names = asset_names(named.select(F.col("stable_key").alias("note_id"), "sha256", "file_name", "position")).select(F.col("note_id").alias("stable_key"), "sha256", "name")
        one = named.groupBy("stable_key", "sha256", "md5").agg(F.min("content").alias("content"))
        path = text.asset_path(F.col("name"), F.lit(self.source_id), identity.short_id(F.col("stable_key")), self.attachments)
        return one.join(names, ["stable_key", "sha256"]).select("stable_key", "md5", "sha256", "content", path.alias("relative_path"))

    def extract(self, items: DataFrame) -> DataFrame:
        held = self.resources(items).groupBy("stable_key").agg(F.map_from_entries(F.collect_list(F.struct("md5", "relative_path"))).alias("names"))
        noted = items.join(held, "stable_key", "left")
        body = html_job(noted, "stable_key", "content", "names", carry=["source_instance_id", "source_position", "original_url", "title", "created", "updated", "guid"])
        linked = F.regexp_replace("markdown", r"\]\(<?evernote:///view/[^)>]*?([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[^)>]*>?\)", "](note:$1)")
        targets = items.filter("guid is not null").select(F.lower("guid").alias("guid"), text.safe_filename(F.col("title")).alias("file"))
        codes = F.filter(F.split("degradations", ","), lambda c: c != "")
        told = F.transform(codes, lambda c: F.struct(c.alias("code"), F.lit("normalize").alias("stage"), F.concat(F.lit("found while reading the note: "), c).alias("message")))
        about = ["source_instance_id", "source_position", "original_url", "title", "quality"]
        return rewrite_wikilinks(body.select(F.col("stable_key").alias("note_id"), *about, told.alias("degradations"), linked.alias("markdown")), targets, [*about, "degradations"]).select(F.col("note_id").alias("stable_key"), *about, "degradations", "markdown")


def _before(path: Column, end: Column) -> Column:
    """The path with `end` before its extension."""
    return F.concat(F.regexp_replace(path, r"\.md$", ""), end, F.lit(".md"))


class NoteFolder:
    """Notes in a store of files, among files of others. policy: what becomes of a file that someone else has written or changed (OVERWRITE_POLICIES). buckets: of the store; a job writes the data folders of buckets again that hold notes it replaces, so a large library wants many."""

    def __init__(self, root: str, shard: str = "source_instance_id", kind: str = "article", policy: str = "preserve", target_id: str = "notes", buckets: int = 16):
        self.root, self.shard, self.kind, self.policy, self.target_id, self.buckets = root, shard, kind, policy, target_id, buckets
        self._tables: list[_Held] = []

    def _held(self, df: DataFrame, name: str) -> DataFrame:
        self._tables.append(_Held(df.sparkSession))
        return self._tables[-1](df, name)

    def close(self) -> None:
        """Removes the tables of decisions that write and write_index have made; what they returned can't be read any more."""
        for held in self._tables:
            held.drop()
        self._tables = []

    def files(self, spark: SparkSession) -> DataFrame:
        """(relative_path, observed, size, owner, kind, shard, written_hash) of every file as it is now, by its text."""
        return read_notes(spark, self.root).select("relative_path", identity.target_hash(F.col("text")).alias("observed"), F.octet_length("text").alias("size"), "owner", "kind", "shard", "written_hash")

    def plan(self, content: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """content with relative_path, the note's whole text and the hash of its content in place of its body, and expected, the hash that was last written for the item.

        known: (stable_key, relative_path, written_hash) of earlier jobs' notes. An item keeps its path; a new item's is free for its key, and
        where an earlier note has it, the key's short id is added. A file that a job wrote before it could record it is known by its owner.
        """
        return self.texts(content).drop("target").join(self.paths(content, known), "stable_key")

    def paths(self, content: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """(stable_key, relative_path, expected) of a plan, found without its texts."""
        spark = content.sparkSession
        known = spark.createDataFrame([], _KNOWN) if known is None else known
        path = text.note_path(F.col("title"), F.col("source_instance_id"), F.lit(self.kind), None)
        new = content.select("stable_key", path.alias("path")).join(known, "stable_key", "left_anti")
        free = assign_paths(new).select("stable_key", F.col("free_path").alias("relative_path"))
        held = known.select("relative_path", F.lit(True).alias("held")).distinct()
        own = free.join(held, "relative_path", "left").select("stable_key", F.when(F.col("held"), _before(F.col("relative_path"), F.concat(F.lit("-"), identity.short_id(F.col("stable_key"))))).otherwise(F.col("relative_path")).alias("relative_path"))
        paths = own.withColumn("written_hash", F.lit(None).cast("string")).unionByName(known.join(content.select("stable_key"), "stable_key", "left_semi"))
        ours = self.files(spark).filter("owner is not null").select("relative_path", F.col("owner").alias("stable_key"), F.col("written_hash").alias("left_hash"))
        return paths.join(ours, ["relative_path", "stable_key"], "left").select("stable_key", "relative_path", F.coalesce("written_hash", "left_hash").alias("expected"))

    def texts(self, content: DataFrame) -> DataFrame:
        """content with the text of a plan and its hashes, content_hash and target, in place of its body."""
        none = F.array().cast("array<string>")
        note = text.render_note(F.col("source_instance_id"), F.col("markdown"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("original_url"), none)
        front = text.front_matter([("title", F.col("title")), ("source_url", F.col("original_url")), ("stable_key", F.col("stable_key"))])
        return content.withColumn("content_hash", identity.source_hash("title", "markdown")).withColumn("text", F.concat(front, F.lit("\n"), note)).withColumn("target", identity.target_hash(F.col("text"))).drop("markdown")

    def decide(self, plan: DataFrame) -> DataFrame:
        """(stable_key, relative_path, observed, expected, action, artifact_kind, needs_audit): what to do with each planned note; a variant's path is the first free one."""
        spark = plan.sparkSession
        files = self.files(spark)
        rows = plan.select("stable_key", "relative_path", F.lit(self.policy).alias("policy"), F.lit(False).alias("metadata_only"))
        found = files.join(rows.select("relative_path"), "relative_path", "left_semi").select("relative_path", "observed")
        out = overwrite_decision(rows, found, plan.select("relative_path", "expected"), "relative_path")
        variant = r"^(.*)\.imported-new(?:-([0-9]+))?\.md$"
        taken = files.select(F.concat(F.regexp_extract("relative_path", variant, 1), F.lit(".md")).alias("relative_path"), F.when(F.col("relative_path").rlike(variant), F.coalesce(F.nullif(F.regexp_extract("relative_path", variant, 2), F.lit("")), F.lit("1")).cast("long")).alias("n"))
        wanted = taken.filter("n is not null").join(out.filter("action = 'write_new_variant'").select("relative_path"), "relative_path", "left_semi").distinct()
        unbroken = wanted.withColumn("nth", F.row_number().over(W.partitionBy("relative_path").orderBy("n"))).groupBy("relative_path").agg(F.count_if(F.col("n") == F.col("nth")).alias("used"))  # -1, -2, ... without a gap
        end = F.concat(F.lit(".imported-new"), F.when(F.coalesce("used", F.lit(0)) > 0, F.concat(F.lit("-"), (F.col("used") + 1).cast("string"))).otherwise(F.lit("")))
        at = F.when(F.col("action") == "write_new_variant", _before(F.col("relative_path"), end)).otherwise(F.col("relative_path"))
        return out.join(unbroken, "relative_path", "left").select("stable_key", at.alias("relative_path"), "observed", "expected", "action", "artifact_kind", "needs_audit")

    def write(self, plan: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """(stable_key, relative_path, expected, action, artifact_kind, needs_audit): the files of the decisions that write, by hash; files of the others stay as they are.

        texts: of a plan that has target in place of text, what texts() gave; a text then moves once, to its decision.
        """
        told = self._held(self.decide(plan), "decisions")
        target = identity.target_hash(F.col("text")) if texts is None else F.col("target")
        files = (plan if texts is None else texts).select("stable_key", "text", F.col(self.shard).alias("shard")).join(told.filter(F.col("action").isin(*WRITES)), "stable_key")
        hashed = files.select("relative_path", "text", "shard", F.col("stable_key").alias("owner"), F.col("artifact_kind").alias("kind"), identity.target_hash(F.col("text")).alias("written_hash"))
        write_notes(hashed, self.root, buckets=self.buckets)
        return plan.select("stable_key", target.alias("expected")).join(told.drop("expected", "observed"), "stable_key").select("stable_key", "relative_path", "expected", "action", "artifact_kind", "needs_audit")

    def write_assets(self, assets: DataFrame) -> DataFrame:
        """Resources (sha256, content, relative_path) beside the notes: contents once whatever earlier jobs stored, and which content each path has. What write_assets tells."""
        versions.merge(assets.select("relative_path", "sha256"), f"{self.root}-asset-paths", "relative_path string, sha256 string", ["relative_path"])
        return write_assets(assets.select("content"), f"{self.root}-assets")

    def assets(self, spark: SparkSession) -> DataFrame:
        """(relative_path, sha256, size, content) of the stored assets."""
        root = f"{self.root}-asset-paths"
        paths = versions.rows(spark, root, versions.snapshot(spark, root), "relative_path string, sha256 string")
        return paths.join(read_assets(spark, f"{self.root}-assets"), "sha256").select("relative_path", "sha256", "size", "content")

    def verify(self, written: DataFrame) -> DataFrame:
        """(relative_path, outcome) by the texts that are read back."""
        return guards.verify_files(written, self.files(written.sparkSession).select("relative_path", "observed", "size"), "relative_path")

    def index(self, entries: DataFrame) -> DataFrame:
        """(shard, page, shard_file, n, body): notes for each shard that list its entries by path. Shards whose names clean to one file are refused by index_names."""
        named = index_names(entries.select(F.col(self.shard).alias("shard")).distinct())
        lines = entries.select(F.col(self.shard).alias("shard"), "relative_path", F.concat(F.lit("- "), text.file_link(F.col("relative_path"), "markdown")).alias("line"))
        listed = lines.groupBy("shard", F.substring(F.sha2("relative_path", 256), 1, 2).alias("page")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relative_path", "line"))), lambda x: x["line"]), "\n").alias("body"))
        return listed.join(named, "shard").select("shard", "page", "shard_file", "n", "body")

    def write_index(self, paths: DataFrame) -> DataFrame:
        """(shard, relative_path, action): index files of the notes at these paths; a file that someone else has written or changed is kept, one that is as it should be isn't written again."""
        files = self.files(paths.sparkSession)
        entries = files.join(paths.select("relative_path").distinct(), "relative_path", "left_semi").select(F.col("shard").alias(self.shard), "relative_path")
        at = _before(F.concat(F.lit("index/"), "shard_file"), F.concat(F.lit("-"), "page"))
        pages = self.index(entries).select("shard", at.alias("relative_path"), F.col("body").alias("text"), identity.target_hash(F.col("body")).alias("target"))
        met = pages.join(files.select("relative_path", "observed", F.when(F.col("kind") == "index", F.col("written_hash")).alias("recorded")), "relative_path", "left")
        edited = F.col("observed").isNotNull() & ~F.col("observed").eqNullSafe(F.col("recorded"))
        action = F.when(edited, "mark_conflict").when(F.col("observed") == F.col("target"), "unchanged").otherwise("write_canonical")
        told = self._held(met.withColumn("action", action), "index")
        write_notes(told.filter("action = 'write_canonical'").select("relative_path", "text", "shard", F.lit("index").alias("kind"), F.col("target").alias("written_hash")), self.root, buckets=self.buckets)
        return told.select("shard", "relative_path", "action")


def index_names(shards: DataFrame) -> DataFrame:
    """(shard, shard_file): the index file of each shard. Two shards with one file name raise an error that names the file, as one index would overwrite the other."""
    named = shards.select("shard", F.concat(text.safe_filename(F.coalesce("shard", F.lit("")), 80), F.lit(".md")).alias("shard_file"))
    shared = named.groupBy(F.lower("shard_file").alias("file_key")).agg(F.count("*").alias("n_shards"))
    clash = F.when(F.col("n_shards") > 1, F.raise_error(F.concat(F.lit("several shards want the index file "), "shard_file")).cast("string")).otherwise(F.col("shard_file"))
    return named.join(shared, F.lower("shard_file") == F.col("file_key")).select("shard", clash.alias("shard_file"))


# --- state of earlier jobs


def known_notes(artifacts: DataFrame, items: DataFrame, target_id: str) -> DataFrame:
    """(stable_key, relative_path, written_hash) of the newest verified note or variant of each item in a target."""
    notes = artifacts.filter((F.col("target_id") == target_id) & (F.col("status") == "verified") & F.col("kind").isin("note", "note_variant"))
    keyed = notes.join(items.select("item_id", "stable_key"), "item_id").select("stable_key", "created_at", "artifact_id", "relative_path", "written_hash")
    return latest(keyed, ["stable_key"], ["created_at", "artifact_id"]).select("stable_key", "relative_path", "written_hash")


def _numbered(new: DataFrame, old: DataFrame, number: str, order: str) -> DataFrame:
    """new with number, counting on from the greatest of old, in the order of a hexadecimal key."""
    start = old.agg(F.coalesce(F.max(number), F.lit(0))).first()[0]
    keyed = new.withColumn("one_", F.lit(1)).withColumn("bucket_", F.substring(order, 1, 2))
    return spread_row_number(keyed, ["one_"], "bucket_", [order], number).drop("one_", "bucket_").withColumn(number, (F.col(number) + start).cast("long"))


def _save(spark: SparkSession, held: _Held, state: str, job_id: str, target_id: str, now: str, done: DataFrame, old: dict[str, DataFrame]) -> None:
    """Items, artifacts and attempts of a job, each table in one commit. done: a row for each item with what came of it; old: the tables before."""
    unknown = _numbered(done.join(old["source_items"], "stable_key", "left_anti").select("stable_key"), old["source_items"], "item_id", "stable_key")
    ids = held(old["source_items"].select("stable_key", "item_id").unionByName(unknown.select("stable_key", "item_id")).join(done.select("stable_key"), "stable_key", "left_semi"), "ids")
    told = done.join(ids, "stable_key")
    value = ["item_id", "source_id", "short_id", "item_key", "canonical_url", "title", "status", "quality", "content_hash", "updated_at"]
    results = told.select("stable_key", "item_id", F.col("source_instance_id").alias("source_id"), identity.short_id(F.col("stable_key")).alias("short_id"), identity.item_key(F.col("stable_key")).alias("item_key"), F.col("original_url").alias("canonical_url"), "title", F.col("state").alias("status"), "quality", "content_hash", F.lit(now).alias("updated_at"))
    base = ids.select("stable_key").join(old["source_items"], "stable_key", "left")
    laid = commit_results(base, results, "stable_key", value).join(base.drop(*value), "stable_key")
    upsert_state(laid, state, "source_items")

    written = told.filter(F.col("file") == "ok").filter(F.col("action").isin(*WRITES))
    fresh = written.select(F.lit(target_id).alias("target_id"), "relative_path", "item_id", F.lit(job_id).alias("job_id"), F.col("artifact_kind").alias("kind"), F.lit("verified").alias("status"), F.col("expected").alias("written_hash"), F.lit(now).alias("created_at"), "stable_key")
    before = old["target_artifacts"].join(fresh.select("target_id", "relative_path"), ["target_id", "relative_path"], "left_semi")
    merged = upsert_artifacts(before, fresh.drop("stable_key"), ["target_id", "relative_path"], ["item_id", "job_id", "kind", "status", "written_hash", "created_at"])
    known = merged.join(before.select("target_id", "relative_path", "artifact_id"), ["target_id", "relative_path"])
    first = merged.join(before, ["target_id", "relative_path"], "left_anti").join(fresh.select("target_id", "relative_path", "stable_key"), ["target_id", "relative_path"])
    upsert_state(known.unionByName(_numbered(first, old["target_artifacts"], "artifact_id", "stable_key").drop("stable_key")), state, "target_artifacts")

    tried = told.filter("action is null or action <> 'skip_verified'")
    pairs = tried.select(F.lit(job_id).alias("job_id"), "item_id")
    nth = next_attempt(pairs, old["migration_attempts"])
    attempt = tried.join(nth, "item_id").select(
        F.lit(job_id).alias("job_id"), "item_id", F.lit("item").alias("scope"), F.when((F.col("was_quality") == "degraded") & (F.col("quality") == "full"), "quality_upgrade").otherwise("stage_attempt").alias("action"), F.col("next_attempt").cast("long").alias("attempt_no"),
        F.col("state").isin("verified", "degraded").alias("success"), F.when(F.col("action") == "mark_conflict", "CONFLICT_PRESERVED").when(F.col("quality").isNull(), "CONTENT_UNAVAILABLE").when(F.col("file") != "ok", "VERIFICATION_FAILED").alias("error_code"), F.lit(now).alias("started_at"), F.lit(now).alias("finished_at"), "stable_key",
    )
    upsert_state(_numbered(attempt, old["migration_attempts"], "attempt_id", "stable_key"), state, "migration_attempts")


def migrate(spark: SparkSession, source: Source, target: Target, job_id: str = "job", state: str | None = None, now: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """(states, report). states: (job_id, stable_key, relative_path, quality, action, state) of every scanned item; report: what reconciliation says of the job.

    An item ends verified or degraded where its file is as written, conflict where someone else's file was kept or the file differs or is
    missing, and blocked where nothing was extracted. A scan without items is a job that adds up to zero.

    state: the folder of the state tables. With it, an item that an earlier job verified is skipped while its file is there (skip_verified),
    other items go the whole way again under the path that they had, and items, artifacts, attempts and the job are recorded. A job
    that stopped can run again: files that it had written count as its own. now: the time that is recorded. The index lists the notes of all
    recorded jobs. What a job stores on the way is removed; states and report stay in the shared folder. Items of a source that says scans_again
    (its scan is cheap and gives the same rows again) are scanned twice in place of being stored.
    """
    held = _Held(spark)
    target_id = getattr(target, "target_id", "notes")
    old = {name: read_state(spark, state, name) if state else spark.createDataFrame([], STATE_TABLES[name]) for name in ("source_items", "target_artifacts", "migration_attempts")}
    items = source.scan(spark)
    items = items if getattr(source, "scans_again", False) else held(items, "items")
    keys = held(items.select("stable_key"), "keys")
    known = held(known_notes(old["target_artifacts"], old["source_items"], target_id), "known")
    were = old["source_items"].join(keys, "stable_key", "left_semi")
    if state:
        there = target.files(spark).select(F.col("relative_path").alias("path"))
        skipped = held(skip_verified(were.join(known.withColumnRenamed("relative_path", "path"), "stable_key"), there).select("stable_key", F.col("path").alias("relative_path"), "quality"), "skipped")
        todo = items.join(skipped, "stable_key", "left_anti")
    else:
        skipped, todo = spark.createDataFrame([], "stable_key string, relative_path string, quality string"), items
    content = held(source.extract(todo), "content")
    if hasattr(source, "resources") and hasattr(target, "write_assets"):  # before the notes that refer to them
        target.write_assets(held(source.resources(todo), "resources"))
    held.drop_one("items")
    todo = keys.join(skipped, "stable_key", "left_anti") if state else keys
    if hasattr(target, "texts"):  # plans and decisions without texts
        texts = target.texts(content)
        plan = held(texts.drop("text").join(target.paths(content, known if state else None), "stable_key"), "plan")
        written = held(target.write(plan, texts), "written")
        held.drop_one("content")
    else:
        plan = held(target.plan(content, known) if state else target.plan(content), "plan")
        held.drop_one("content")
        written = held(target.write(plan), "written")
    for column, kind in (("action", "write_canonical"), ("artifact_kind", "note")):
        written = written if column in written.columns else written.withColumn(column, F.lit(kind))
    outcome = target.verify(written.filter(F.col("action").isin(*WRITES))).withColumnRenamed("outcome", "file")
    met = todo.select("stable_key").join(plan.select("stable_key", "quality"), "stable_key", "left").join(written.select("stable_key", "relative_path", "expected", "action", "artifact_kind"), "stable_key", "left").join(outcome, "relative_path", "left")
    ended = F.when(F.col("quality").isNull(), "blocked").when((F.col("action") == "mark_conflict") | ~F.col("file").eqNullSafe(F.lit("ok")), "conflict").when(F.col("quality") == "full", "verified").otherwise("degraded")
    rows = met.withColumn("state", ended).unionByName(skipped.withColumn("action", F.lit("skip_verified")).withColumn("state", F.lit("verified")), allowMissingColumns=True)
    done = held(rows, "done")
    states = done.select(F.lit(job_id).alias("job_id"), "stable_key", "relative_path", "quality", "action", "state")

    counts = aggregates.failed_count(aggregates.state_counts(states, ["job_id"]))
    cached = {f"{c}_count": F.count_if(F.col("state") == c) for c in ("verified", "degraded", "conflict", "skipped")}
    job = states.agg(*(v.alias(k) for k, v in cached.items()), F.count_if(F.col("state").isin("blocked", "unsupported", "permanent_failed")).alias("failed_count"))
    scanned = keys.agg(F.count("*").alias("scan_count")).withColumn("job_id", F.lit(job_id))
    jobs = held(job.withColumn("job_id", F.lit(job_id)).join(scanned, "job_id").withColumn("recoverable_count", F.lit(0).cast("long")), "jobs")
    report = held(aggregates.reconcile(counts, jobs), "report")
    if state:
        about = [c for c in ("source_instance_id", "original_url", "title") if c in plan.columns]
        texts = plan.select("stable_key", *about, F.col("content_hash") if "content_hash" in plan.columns else F.lit(None).cast("string").alias("content_hash"))
        full = done.join(texts, "stable_key", "left").join(were.select("stable_key", F.col("quality").alias("was_quality")), "stable_key", "left")
        for c in ("source_instance_id", "original_url", "title"):
            full = full if c in about else full.withColumn(c, F.lit(None).cast("string"))
        _save(spark, held, state, job_id, target_id, now, held(full, "results"), old)
        status = F.when(F.col("ok"), "completed").otherwise("failed")
        upsert_state(jobs.join(report.select("job_id", "ok"), "job_id").select(*jobs.columns, F.lit(target_id).alias("target_id"), status.alias("status"), F.lit("finished").alias("current_stage"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at")), state, "migration_jobs")
    if hasattr(target, "write_index"):
        here = done.filter(F.col("state").isin("verified", "degraded")).select("relative_path")
        target.write_index(read_state(spark, state, "target_artifacts").filter((F.col("target_id") == target_id) & (F.col("status") == "verified")).select("relative_path") if state else here)
    if hasattr(target, "close"):
        target.close()
    held.drop(("done", "report"))
    return states, report
