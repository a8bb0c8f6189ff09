"""Joins: index entries, clean-up candidates, upserts, overwrite decisions, links, resources. All are equi-joins; small tables are broadcast only by Spark's own threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.vocabulary import OVERWRITE_POLICIES


def index_entries(artifacts: DataFrame, items: DataFrame) -> DataFrame:
    """Verified notes of a job with their item's title and kind."""
    notes = artifacts.filter("status = 'verified' and kind = 'note'").select("artifact_id", "item_id", "relative_path", "job_id")
    return notes.join(items.select("item_id", "title", F.col("kind").alias("content_kind"), "published"), "item_id")


def finished_cleanup_ids(items: DataFrame, jobs: DataFrame, plans: DataFrame, final: tuple[str, ...] = ("unfavorited_verified", "already_unfavorited")) -> DataFrame:
    """(source_id, item_id) in a final clean-up state, by way of job and plan."""
    done = items.filter(F.col("cleanup_status").isin(*final)).select("item_id", "job_id")
    return done.join(jobs.select("job_id", "plan_id"), "job_id").join(plans.select("plan_id", "source_id"), "plan_id").select("source_id", "item_id").distinct()


def cleanup_candidates(scope: DataFrame, done: DataFrame, limit: int = 200, key: str = "id", order: str = "id") -> DataFrame:
    return scope.join(done, key, "left_anti").orderBy(order).limit(limit)


def new_items(scan: DataFrame, items: DataFrame) -> DataFrame:
    """Scanned rows whose fingerprint and external id are both unknown. Two anti-joins: an OR in one would be a nested loop."""
    known = items.select("external_id").filter("external_id is not null")
    return scan.join(items.select("fingerprint"), "fingerprint", "left_anti").join(known, "external_id", "left_anti")


def skip_verified(items: DataFrame, files: DataFrame) -> DataFrame:
    """Verified items whose file still exists."""
    return items.filter("status = 'verified'").join(files, "path", "left_semi")


def upsert_artifacts(old: DataFrame, new: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Rows of new over rows of old; a null in new keeps what is there."""
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(*key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in value))


def commit_results(items: DataFrame, results: DataFrame, key: str, value: list[str]) -> DataFrame:
    """Items with results laid over; unknown results change nothing."""
    return items.alias("o").join(results.alias("n"), key, "left").select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in value))


def overwrite_action(policy: Column, exists: Column, modified: Column, metadata_only: Column, observed: Column, expected: Column) -> Column:
    """What to do with a planned note: two known hashes outweigh the modified flag; an unknown policy gives unknown_policy."""
    changed = F.when(observed.isNotNull() & expected.isNotNull(), observed != expected).otherwise(F.coalesce(modified, F.lit(False)))
    return (
        F.when(policy.isNull() | ~policy.isin(*OVERWRITE_POLICIES), "unknown_policy").when(~exists, "write_canonical")
        .when(~changed & ((policy == "metadata-only") | metadata_only), "update_metadata_only").when(~changed, "write_canonical")
        .when(policy == "replace", "forced_overwrite").when(policy == "write-new", "write_new_variant").otherwise("mark_conflict")
    )


def overwrite_decision(plan: DataFrame, observed: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """plan (key, policy, metadata_only) met with the hashes found in files and those last written."""
    met = plan.join(observed.select(key, "observed"), key, "left").join(expected.select(key, "expected"), key, "left")
    exists = F.col("observed").isNotNull()
    action = overwrite_action(F.col("policy"), exists, exists & F.col("expected").isNull(), F.col("metadata_only"), F.col("observed"), F.col("expected"))
    out = met.withColumn("action", action)
    return out.withColumn("artifact_kind", F.when(F.col("action") == "write_new_variant", "note_variant").otherwise("note")).withColumn("needs_audit", F.col("action") == "forced_overwrite")


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links with the target's title, null where there is none; of notes with one guid the least title."""
    return links.join(notes.groupBy(F.col("guid").alias("to_guid")).agg(F.min("title").alias("target_title")), "to_guid", "left")


def unresolved_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    return links.filter("kind = 'internal'").join(notes.select(F.col("guid").alias("to_guid")), "to_guid", "left_anti")


def resource_match(refs: DataFrame, resources: DataFrame) -> DataFrame:
    """(note_id, md5, outcome) for each distinct content of a note: matched, missing or unreferenced."""
    r = refs.select("note_id", "md5").distinct().withColumn("in_body", F.lit(True))
    s = resources.select("note_id", "md5").distinct().withColumn("in_file", F.lit(True))
    outcome = F.when(F.col("in_body").isNotNull() & F.col("in_file").isNotNull(), "matched").when(F.col("in_file").isNull(), "missing").otherwise("unreferenced")
    return r.join(s, ["note_id", "md5"], "full_outer").select("note_id", "md5", outcome.alias("outcome"))


def localize_assets(images: DataFrame, assets: DataFrame, key) -> DataFrame:
    """Body images with the local path of the asset of the same key. key: a function from URL column to key column."""
    local = assets.select(key(F.col("url")).alias("asset_key"), "local_path").groupBy("asset_key").agg(F.min("local_path").alias("local_path"))
    return images.withColumn("asset_key", key(F.col("url"))).join(local, "asset_key", "left")


def apply_mappings(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """files (name) with the user's stack and notebook: a mapping for the plain name goes before one with the suffix; of mappings with one name the least counts."""
    m = mappings.groupBy("name").agg(F.min(F.struct("stack", "notebook")).alias("to"))
    plain = F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "")
    met = files.withColumn("plain", plain).join(m.select(F.col("name").alias("plain"), F.col("to").alias("by_plain")), "plain", "left").join(m.select("name", F.col("to").alias("by_name")), "name", "left")
    to = F.coalesce("by_plain", "by_name")
    return met.withColumn("stack", F.coalesce(to["stack"], F.col("stack"))).withColumn("notebook", F.coalesce(to["notebook"], F.col("notebook"))).drop("plain", "by_plain", "by_name")


def unmatched_mappings(mappings: DataFrame, files: DataFrame) -> DataFrame:
    names = files.select("name").unionByName(files.select(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "").alias("name")))
    return mappings.join(names, "name", "left_anti")


def index_conflicts(shards: DataFrame, known: DataFrame, observed: DataFrame) -> DataFrame:
    """Shards whose file differs from what was last written: they are kept, not rewritten."""
    met = shards.select("shard").distinct().join(known.select("shard", "known_hash"), "shard").join(observed.select("shard", "file_hash"), "shard")
    return met.filter(F.col("known_hash") != F.col("file_hash"))


def rerun_set(items: DataFrame, artifacts: DataFrame, ids: list | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    """Verified items with a verified artifact; optionally only some ids, and the first few."""
    out = items.filter("status = 'verified'").join(artifacts.filter("status = 'verified'").select(key).distinct(), key, "left_semi")
    out = out if ids is None else out.filter(F.col(key).isin(*ids))
    return out if limit is None else out.orderBy(key).limit(limit)


def sample_coverage(wanted: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """Wanted ids that don't exist."""
    return wanted.join(items, key, "left_anti")
