"""Queries over jobs, items, attempts, artifacts and links: aggregates, windows, filters, joins, top-k, sets and guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.checkpoints import scratch_folder
from tarnfold.functions.arrays import shard_keys
from tarnfold.functions.vocabulary import ARTIFACT_STATES, FAILED_STATES, FINAL_STATES, RECOVERABLE_STATES
from tarnfold.operators import aggregates, filters, guards, joins, sets, windows
from tarnfold.plans import views
from tarnfold.plans.views import ARTIFACTS, ATTEMPTS, COUNTS, ITEM_STATES, JOBS, LINKED, QUALITY, RESOURCES
from tarnfold.sources import readers, writers
from tarnfold.sources.versions import CommitConflict

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.failed_count(aggregates.state_counts(views.item_states(spark, d), ["job_id"]))


# --- aggregates


@query(f"WITH {ITEM_STATES} SELECT job_id, count(*) AS n_items, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in FINAL_STATES) + f", count(*) FILTER (state IN ({quoted(RECOVERABLE_STATES)})) AS recoverable, count(*) FILTER (state NOT IN ({quoted(FINAL_STATES + RECOVERABLE_STATES)})) AS unknown FROM v4 GROUP BY job_id")
def a1_state_counts(spark, d):
    return aggregates.state_counts(views.item_states(spark, d), ["job_id"])


@query(f"WITH {ITEM_STATES} SELECT job_id, count(*) FILTER (state IN ({quoted(FAILED_STATES)})) AS failed FROM v4 GROUP BY job_id")
def a2_failed_count(spark, d):
    return _counts(spark, d).select("job_id", "failed")


@query(
    f"""WITH {ITEM_STATES}, {COUNTS}, {JOBS},
r AS (SELECT j4.*, coalesce(n_items, 0) - coalesce(recoverable, 0) - coalesce(unknown, 0) AS final_items, coalesce(recoverable, 0) AS rec, coalesce(unknown, 0) AS unk, coalesce(failed, 0) AS fail,
    coalesce(verified, 0) AS ver, coalesce(degraded, 0) AS deg, coalesce(conflict, 0) AS con, coalesce(skipped, 0) AS ski FROM j4 LEFT JOIN n4 USING (job_id)),
c AS (SELECT job_id, final_items, CASE WHEN recoverable_count <> rec THEN 'recoverable_desync' WHEN rec > 0 THEN 'recoverable_left' WHEN unk > 0 THEN 'unknown_states' WHEN final_items <> scan_count THEN 'sum_mismatch'
    WHEN failed_count <> fail THEN 'failed_mismatch' WHEN verified_count <> ver OR degraded_count <> deg OR conflict_count <> con OR skipped_count <> ski THEN 'cached_mismatch' ELSE 'ok' END AS reason FROM r)
SELECT job_id, reason = 'ok' AS ok, reason, CAST(final_items AS BIGINT) AS final_items FROM c"""
)
def a3_reconcile(spark, d):
    counts = _counts(spark, d)
    return aggregates.reconcile(counts, views.jobs(spark, d, counts))


@query("WITH k AS (SELECT l_suppkey AS source_id, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT source_id, CAST(sum(n) AS BIGINT) AS observations, count(*) AS unique_items, CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM k GROUP BY source_id")
def a4_scan_report(spark, d):
    return aggregates.scan_report(views.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "source_id"), ["source_id"], ["l_orderkey", "l_linenumber"])


@query("SELECT lang || '/' || source AS place, count(*) AS n_notes FROM documents GROUP BY 1")
def a5_count_by_notebook(spark, d):
    return aggregates.count_by_notebook(views.notes(spark, d))


@query("SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1")
def a6_reason_histogram(spark, d):
    return aggregates.reason_histogram(views.attempts(spark, d))


_MATCH = "m AS (SELECT coalesce(r.note_id, s.note_id) AS note_id, coalesce(r.md5, s.md5) AS md5, CASE WHEN s.md5 IS NULL THEN 'missing' WHEN r.md5 IS NULL THEN 'unreferenced' ELSE 'matched' END AS outcome FROM (SELECT DISTINCT * FROM refs) r FULL OUTER JOIN (SELECT DISTINCT note_id, md5 FROM res) s ON r.note_id = s.note_id AND r.md5 = s.md5)"


@query(f"WITH {RESOURCES}, {_MATCH} SELECT note_id, count(*) AS total, count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'unreferenced') AS unreferenced FROM m GROUP BY note_id")
def a7_resource_report(spark, d):
    return aggregates.resource_report(joins.resource_match(views.body_refs(spark, d), views.resources(spark, d)))


@query(f"WITH {ITEM_STATES} SELECT o_custkey AS source_id, count(*) AS total, count(*) FILTER (state = 'verified') AS verified FROM v4 JOIN orders ON o_orderkey = job_id GROUP BY 1")
def a8_progress(spark, d):
    source = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("source_id"))
    return aggregates.progress(views.item_states(spark, d).join(source, "job_id"), "source_id")


@query(f"WITH {ITEM_STATES}, {COUNTS} SELECT job_id, n_items, verified, degraded, failed, conflict, skipped FROM n4")
def a9_job_status(spark, d):
    return aggregates.job_status(_counts(spark, d))


@query(f"WITH {ATTEMPTS} SELECT CASE cleanup_status WHEN 'unfavorited_verified' THEN 'success' WHEN 'already_unfavorited' THEN 'skipped' WHEN 'verification_failed' THEN 'failed' WHEN 'state_unknown' THEN 'unknown' WHEN 'login_required' THEN 'paused' END AS bucket, count(*) AS n FROM v3 GROUP BY 1")
def a10_cleanup_summary(spark, d):
    return aggregates.cleanup_summary(views.attempts(spark, d))


def _tree_sql(rows: str, group: str, levels: int = 5, leaf: int = 64) -> str:
    """Hashes of groups by a tree over the digits of row hashes, for groups whose nodes at `levels` digits are leaves. rows: a query of (group, h)."""
    node = "coalesce(tree, sha256(array_to_string(entries, '')))"
    out = f"WITH c AS (SELECT {group} AS g, h, count(*) AS n FROM ({rows}) GROUP BY ALL), t{levels} AS (SELECT g, h[1:{levels}] AS p, count(*) AS k, sum(n) AS n_rows, list(h || ':' || n ORDER BY h || ':' || n) AS entries, CAST(NULL AS VARCHAR) AS tree FROM c GROUP BY ALL)"
    for d in range(levels - 1, -1, -1):
        out += f""", t{d} AS (SELECT g, p[1:{d}] AS p, sum(k) AS k, sum(n_rows) AS n_rows, CASE WHEN sum(k) <= {leaf} THEN list_sort(flatten(list(entries))) ELSE [] END AS entries, CASE WHEN sum(k) > {leaf} THEN sha256(string_agg(p || {node}, '' ORDER BY p)) END AS tree FROM t{d + 1} GROUP BY g, t{d + 1}.p[1:{d}])"""
    return f"{out} SELECT g AS {group}, {node} AS plan_hash, CAST(n_rows AS BIGINT) AS n_rows FROM t0"


@query(_tree_sql("SELECT l_returnflag, sha256(l_orderkey || chr(1) || l_linenumber || chr(1) || l_partkey) AS h FROM lineitem", "l_returnflag"))
def a11_plan_hash_of_flags(spark, d):
    """Three groups of all line items: trees of several levels."""
    return aggregates.plan_hash(views.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_returnflag"])


@query(f"WITH {ITEM_STATES}, h AS (SELECT job_id, sha256(job_id || chr(1) || item_no || chr(1) || state) AS h FROM v4), c AS (SELECT job_id, h, count(*) AS n FROM h GROUP BY ALL) SELECT job_id, sha256(string_agg(h || ':' || n, '' ORDER BY h)) AS plan_hash, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY 1")
def a11_plan_hash(spark, d):
    return aggregates.plan_hash(views.item_states(spark, d), ["job_id", "item_no", "state"], ["job_id"])


@query(f"WITH {QUALITY} SELECT code, stage, count(*) AS n FROM d5 GROUP BY 1, 2")
def a12_degradation_stats(spark, d):
    return aggregates.degradation_stats(views.quality(spark, d))


_SHARDS = "sh AS (SELECT id, kind, title, CASE WHEN regexp_matches(published, '^[0-9]{4}-(0[1-9]|1[0-2])') THEN published[1:7] ELSE 'unknown' END || '-' || kind || '-' || unnest(collections) AS shard FROM v8)"


def _shards(spark: SparkSession, d: str) -> DataFrame:
    return shard_keys(views.artifacts(spark, d).withColumn("saved", F.lit(None).cast("string")), ("month", "kind", "collection"))


@query(f"WITH {ARTIFACTS}, {_SHARDS} SELECT shard, count(*) AS n_entries FROM sh GROUP BY 1")
def a13_shard_sizes(spark, d):
    return aggregates.shard_sizes(_shards(spark, d))


@query(f"WITH {ITEM_STATES} SELECT DISTINCT state FROM v4 WHERE state NOT IN ({quoted(FINAL_STATES + RECOVERABLE_STATES)})")
def a14_unknown_states(spark, d):
    return aggregates.unknown_states(views.item_states(spark, d))


@query("SELECT key AS merge_key, n_places FROM (SELECT sha256(n_chars::VARCHAR) AS key, count(DISTINCT (lang, source)) AS n_places FROM documents GROUP BY 1) WHERE n_places > 1")
def a15_merge_group_check(spark, d):
    files = views.table(spark, d, "documents").select(F.sha2(F.col("n_chars").cast("string"), 256).alias("merge_key"), F.col("lang").alias("stack"), F.col("source").alias("notebook"))
    return aggregates.merge_group_check(files)


# --- windows


@query("SELECT sha256(text) AS file_sha256, min(doc_id) AS ordinal, arg_min(source, doc_id) AS notebook FROM documents GROUP BY 1")
def w1_first_observation(spark, d):
    return windows.first_observation(views.notes(spark, d), ["file_sha256"], ["ordinal"]).select("file_sha256", "ordinal", "notebook")


@query(f"WITH {ITEM_STATES} SELECT job_id, item_no, state FROM v4")
def w1_first_observation_items(spark, d):
    return views.item_states(spark, d).select("job_id", "item_no", "state")


@query(f"WITH {ARTIFACTS} SELECT sha256(id::VARCHAR) AS stable_key, 'web/' || title || '.md' AS path, 'web/' || title || CASE WHEN n = 1 THEN '' ELSE '-' || n END || '.md' AS free_path FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY sha256(id::VARCHAR)) AS n FROM v8)")
def w2_assign_paths(spark, d):
    plan = views.artifacts(spark, d).select(F.sha2(F.col("id").cast("string"), 256).alias("stable_key"), F.concat(F.lit("web/"), "title", F.lit(".md")).alias("path"))
    return windows.assign_paths(plan)


@query(
    f"""WITH {ARTIFACTS}, p AS (SELECT sha256(id::VARCHAR) AS k, 'web/' || title || CASE WHEN id % 4 = 0 THEN '-' || (2 + id % 7) ELSE '' END AS stem FROM v8),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY k) AS n, count(*) OVER (PARTITION BY stem) AS m FROM p),
w AS (SELECT stem, unnest(range(2, max(m) + 20)) AS j FROM n WHERE m > 1 GROUP BY stem),
f AS (SELECT w.stem, j, row_number() OVER (PARTITION BY w.stem ORDER BY j) + 1 AS n FROM w ANTI JOIN p ON p.stem = w.stem || '-' || w.j)
SELECT k AS stable_key, n.stem || '.md' AS path, n.stem || CASE WHEN n.n = 1 THEN '' ELSE '-' || f.j END || '.md' AS free_path FROM n LEFT JOIN f ON f.stem = n.stem AND f.n = n.n"""
)
def w2_taken_suffixes(spark, d):
    """Titles of which a fourth already end like a suffix."""
    own = F.when(F.col("id") % 4 == 0, F.concat(F.lit("-"), (2 + F.col("id") % 7).cast("string"))).otherwise("")
    plan = views.artifacts(spark, d).select(F.sha2(F.col("id").cast("string"), 256).alias("stable_key"), F.concat(F.lit("web/"), "title", own, F.lit(".md")).alias("path"))
    return windows.assign_paths(plan)


@query(
    f"""WITH {RESOURCES}, f AS (SELECT note_id, lower(file_name) AS low, sha256, min(position) AS position, arg_min(file_name, position) AS file_name FROM res GROUP BY 1, 2, 3)
SELECT note_id, sha256, file_name, file_name || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY note_id, low ORDER BY position, sha256) AS n FROM f)"""
)
def w3_asset_names(spark, d):
    return windows.asset_names(views.resources(spark, d))


@query(f"WITH {RESOURCES} SELECT note_id, sha256, min(position) AS position, arg_min(file_name, position) AS file_name, arg_min(md5, position) AS md5, arg_min(size, position) AS size, bool_or(attachment) AS attachment, count(*) AS copies FROM res GROUP BY 1, 2")
def w4_dedup_resources(spark, d):
    return windows.dedup_resources(views.resources(spark, d))


@query("SELECT o_custkey AS source_id, o_orderkey AS job_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w5_latest_job(spark, d):
    jobs = views.table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created"))
    return windows.latest(jobs, ["source_id"], ["created", "job_id"]).select("source_id", "job_id")


@query("SELECT user_id % 10 AS target_id, user_id AS item_id, max(event_id) AS artifact_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def w6_latest_artifact(spark, d):
    a = views.attempts(spark, d).select(F.col("job_id").alias("target_id"), "item_id", F.col("position").alias("artifact_id"), F.col("position").alias("created"), F.when(F.col("reason") == "purchase", "verified").otherwise("written").alias("status"), F.lit("note").alias("kind"))
    return windows.latest_artifact(a).select("target_id", "item_id", "artifact_id")


@query("WITH p AS (SELECT DISTINCT user_id % 10 AS job_id, user_id AS item_id FROM events), n AS (SELECT user_id AS item_id, count(*) AS most FROM events WHERE event_type = 'error' GROUP BY 1) SELECT job_id, item_id, coalesce(most, 0) + 1 AS next_attempt FROM p LEFT JOIN n USING (item_id)")
def w7_next_attempt(spark, d):
    a = views.attempts(spark, d)
    numbered = windows.order_ordinals(a.filter("reason = 'error'"), "item_id", ["position"]).withColumnRenamed("note_no", "attempt_no")
    return windows.next_attempt(a.select("job_id", "item_id").distinct(), numbered)


@query(
    f"""WITH {ATTEMPTS}, n AS (SELECT job_id, round, count(*) AS n FROM v3 GROUP BY 1, 2), f AS (SELECT job_id, item_id, min(round) AS round FROM v3 GROUP BY 1, 2), w AS (SELECT job_id, round, count(*) AS new FROM f GROUP BY 1, 2),
t AS (SELECT job_id, round, coalesce(new, 0) AS new, sum(coalesce(new, 0)) OVER (PARTITION BY job_id ORDER BY round) AS total, sum((coalesce(new, 0) > 0)::INT) OVER (PARTITION BY job_id ORDER BY round) AS run FROM n LEFT JOIN w USING (job_id, round)),
i AS (SELECT *, sum((new = 0)::INT) OVER (PARTITION BY job_id, run ORDER BY round) AS idle FROM t),
s AS (SELECT job_id, min(round) FILTER (idle >= 5) AS hit, max(round) AS last FROM i GROUP BY 1)
SELECT s.job_id, coalesce(hit, last) AS stop_round, CASE WHEN hit IS NULL THEN 'end_of_list' ELSE 'no_new_items' END AS reason, CAST(total AS BIGINT) AS unique_items FROM s JOIN i ON i.job_id = s.job_id AND i.round = coalesce(hit, last)"""
)
def w8_stop_point(spark, d):
    a = views.attempts(spark, d).select("job_id", "round", F.col("item_id").alias("key"))
    return windows.stop_point(a, "job_id")


@query(f"WITH {ATTEMPTS}, c AS (SELECT job_id, min(position) FILTER (http_status IN (429, 503)) AS cut FROM v3 GROUP BY 1) SELECT job_id, position, CASE WHEN position >= cut THEN 'interrupted' ELSE status END AS state FROM v3 JOIN c USING (job_id)")
def w9_pause_cutoff(spark, d):
    return windows.pause_cutoff(views.attempts(spark, d)).select("job_id", "position", "state")


@query(
    """WITH k AS (SELECT DISTINCT sha256(text) AS stable_key FROM documents),
a AS (SELECT stable_key FROM k WHERE EXISTS (SELECT 1 FROM k e WHERE e.stable_key[1:4] = k.stable_key[1:4] AND e.stable_key < k.stable_key)),
b AS (SELECT stable_key FROM a WHERE EXISTS (SELECT 1 FROM a e WHERE e.stable_key[1:8] = a.stable_key[1:8] AND e.stable_key < a.stable_key)),
l AS (SELECT stable_key, CAST(CASE WHEN stable_key IN (FROM b) THEN 64 WHEN stable_key IN (FROM a) THEN 8 ELSE 4 END AS BIGINT) AS length FROM k) SELECT stable_key, length, substring(stable_key, 1, length) AS prefix FROM l"""
)
def w10_prefix_length(spark, d):
    return windows.prefix_length(views.notes(spark, d).select(F.col("file_sha256").alias("stable_key")).distinct(), "stable_key", [], (4, 8, 64))


@query("SELECT event_type AS reason, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth, event_id AS position, user_id AS item_id FROM events QUALIFY nth <= 3")
def w11_reason_samples(spark, d):
    return windows.reason_samples(views.attempts(spark, d))


@query(
    f"""WITH {ATTEMPTS}, l AS (SELECT item_id, position, status, lag(status) OVER (PARTITION BY item_id ORDER BY ts, position) AS before FROM v3)
SELECT item_id, position, before, status FROM l WHERE before <> status AND before || '>' || status NOT IN ('created>running', 'created>failed', 'running>paused', 'running>interrupted', 'running>completed', 'running>failed', 'paused>running', 'paused>failed', 'interrupted>running', 'interrupted>failed')"""
)
def w12_status_history(spark, d):
    return windows.status_history_check(views.attempts(spark, d))


@query(
    f"""WITH {ATTEMPTS}, n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY position) AS nth FROM v3 QUALIFY nth <= 3), e AS (SELECT *, min(nth) FILTER (http_status < 400 OR http_status IN (403, 404, 410)) OVER (PARTITION BY item_id) AS stop FROM n),
g AS (SELECT item_id, count(*) AS tries, CAST(sum(CASE nth WHEN 2 THEN 3000 WHEN 3 THEN 10000 ELSE 0 END) AS BIGINT) AS waited_ms, arg_max(http_status, nth) AS last_status FROM e WHERE stop IS NULL OR nth <= stop GROUP BY 1)
SELECT *, last_status < 400 AS ok, last_status >= 400 AND last_status NOT IN (403, 404, 410) AND tries < 3 AS may_retry FROM g"""
)
def w13_retry_outcome(spark, d):
    return windows.retry_outcome(views.attempts(spark, d), ["item_id"])


@query("SELECT conv_id AS file_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS note_no FROM conversations")
def w14_order_ordinals(spark, d):
    turns = views.table(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), "turn")
    return windows.order_ordinals(turns, "file_id", ["turn"])


# --- filters


@query(f"WITH {ARTIFACTS} SELECT id, title, kind FROM v8 WHERE kind <> 'video'")
def p1_migratable(spark, d):
    return filters.migratable(views.artifacts(spark, d)).select("id", "title", "kind")


@query(f"WITH {ARTIFACTS} SELECT id, kind FROM v8 WHERE status = 'verified' AND kind NOT IN ('video', 'external-link')")
def p2_cleanup_scope(spark, d):
    return filters.cleanup_scope(views.artifacts(spark, d)).select("id", "kind")


@query(f"WITH {ITEM_STATES} SELECT job_id, item_no, state FROM v4 WHERE state IN ({quoted(FAILED_STATES)})")
def p3_status_slice(spark, d):
    return filters.status_slice(views.item_states(spark, d), "failed").select("job_id", "item_no", "state")


@query(f"WITH {ARTIFACTS}, h AS (SELECT id, title, count(*) OVER () AS n_matches FROM v8 WHERE contains(lower(title), 'ring')) SELECT id, title, n_matches FROM h ORDER BY title, id LIMIT 100")
def p4_title_search(spark, d):
    return filters.title_search(views.artifacts(spark, d).select("id", "title"), " RING ")


@query("SELECT event_id AS position, user_id AS item_id FROM events WHERE event_type = 'error'")
def p5_log_filter(spark, d):
    return filters.log_filter(views.attempts(spark, d), "error", "reason").select("position", "item_id")


@query("SELECT page_id AS source_position, CAST(NULL AS VARCHAR) AS special FROM pages WHERE contains(html, '<article>')")
def p6_special_page(spark, d):
    return filters.special_page(views.pages(spark, d)).select("source_position", "special")


@query(
    f"""WITH {ITEM_STATES}, f AS (SELECT job_id, item_no, [(item_no <> 7, 'not_note_kind'), (state = 'verified', 'not_verified'), (state <> 'degraded', 'not_full_quality'), (l_partkey % 5 <> 0, 'note_missing'), (l_partkey % 7 <> 0, 'note_zero_bytes'), (l_partkey % 11 <> 0, 'yaml_unparseable'),
    (item_no > 0, 'no_source_id_or_url'), (l_partkey % 13 <> 0, 'db_target_inconsistent'), (state <> 'conflict', 'unresolved_conflict'), (state <> 'interrupted', 'transitional_state'), (l_partkey % 17 <> 0, 'already_unfavorited')] AS r FROM v4),
g AS (SELECT job_id, item_no, array_to_string(list_transform(list_filter(r, lambda x: NOT x[1]), lambda x: x[2]), ',') AS reasons FROM f) SELECT job_id, item_no, reasons, reasons = '' AS eligible FROM g"""
)
def p7_cleanup_eligible(spark, d):
    p, s, n = F.col("l_partkey"), F.col("state"), F.col("item_no")
    held = {"is_note": n != 7, "is_verified": s == "verified", "is_full": s != "degraded", "note_exists": p % 5 != 0, "note_non_zero": p % 7 != 0, "yaml_parseable": p % 11 != 0, "has_id_or_url": n > 0, "db_consistent": p % 13 != 0, "no_conflict": s != "conflict", "not_transitional": s != "interrupted", "not_unfavorited": p % 17 != 0}
    return filters.cleanup_eligible(views.item_states(spark, d).withColumns(held)).select("job_id", "item_no", "reasons", "eligible")


@query(f"WITH {QUALITY} SELECT doc_id FROM q5 WHERE quality = 'full' AND previous_quality = 'degraded' AND toxic = 0")
def p8_upgrade_candidates(spark, d):
    return filters.upgrade_candidates(views.quality(spark, d)).select("doc_id")


@query(f"WITH {ATTEMPTS}, l AS (SELECT * FROM v3 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, position DESC) = 1) SELECT item_id, status FROM l WHERE status IN ('paused', 'interrupted') OR status = 'running' AND ts < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 5 MINUTE")
def p9_resumable(spark, d):
    return filters.resumable(views.attempts(spark, d), F.lit("2024-02-01 00:00:00").cast("timestamp"), "item_id").select("item_id", "status")


@query("WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN 'soon' END AS heartbeat FROM events) SELECT event_id AS position FROM e WHERE try_cast(heartbeat AS TIMESTAMP) IS NULL OR abs(epoch_us(TIMESTAMP '2024-01-10 00:00:00') - epoch_us(try_cast(heartbeat AS TIMESTAMP))) > 60000000")
def p10_stale_holders(spark, d):
    beat = F.when(F.col("position") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("position") % 3 == 1, "soon")
    return filters.stale_holders(views.attempts(spark, d).withColumn("heartbeat", beat), F.lit("2024-01-10 00:00:00").cast("timestamp")).select("position")


@query("WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'java' || chr(9) || 'script:' || url WHEN 2 THEN 'DATA:' || url ELSE '/rel' END AS url FROM pages) SELECT page_id, url FROM u WHERE page_id % 4 IN (1, 2)")
def p11_unsafe_urls(spark, d):
    n = F.col("page_id") % 4
    u = views.table(spark, d, "pages").select("page_id", F.when(n == 0, F.col("url")).when(n == 1, F.concat(F.lit("java\tscript:"), "url")).when(n == 2, F.concat(F.lit("DATA:"), "url")).otherwise("/rel").alias("url"))
    return filters.unsafe_urls(u)


@query("SELECT page_id FROM pages WHERE starts_with(url, 'http') AND page_id % 2 = 0")
def p12_remote_images_left(spark, d):
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("text ![x]("), "url", F.lit(") more"))).otherwise(F.lit("![[local.png]]"))
    return filters.remote_images_left(views.table(spark, d, "pages").withColumn("body", body)).select("page_id")


# --- joins


@query(f"WITH {ARTIFACTS} SELECT a.id AS artifact_id, a.id AS item_id, a.title || '.md' AS relative_path, a.job_id, a.title, a.kind AS content_kind, a.published FROM v8 a WHERE status = 'verified'")
def j1_index_entries(spark, d):
    a = views.artifacts(spark, d)
    notes = a.select(F.col("id").alias("artifact_id"), F.col("id").alias("item_id"), F.concat("title", F.lit(".md")).alias("relative_path"), "job_id", "status", F.lit("note").alias("kind"))
    return joins.index_entries(notes, a.select(F.col("id").alias("item_id"), "title", "kind", "published"))


@query("SELECT DISTINCT s_nationkey::BIGINT AS source_id, user_id AS item_id FROM events JOIN supplier ON s_suppkey = user_id % 10 WHERE event_type IN ('purchase', 'signup')")
def j2_finished_cleanup_ids(spark, d):
    plans = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("plan_id"), F.col("s_nationkey").cast("long").alias("source_id"))
    jobs = plans.select(F.col("plan_id").alias("job_id"), "plan_id")
    return joins.finished_cleanup_ids(views.attempts(spark, d), jobs, plans)


@query(f"WITH {ARTIFACTS} SELECT id, title FROM v8 WHERE status = 'verified' AND kind NOT IN ('video', 'external-link') AND id % 3 <> 0 ORDER BY id LIMIT 200")
def j3_cleanup_candidates(spark, d):
    a = views.artifacts(spark, d)
    return joins.cleanup_candidates(filters.cleanup_scope(a), a.filter("id % 3 = 0").select("id")).select("id", "title")


@query("WITH d AS (SELECT doc_id, sha256(text) AS fingerprint, CASE WHEN doc_id % 2 = 0 THEN source || '-' || n_chars END AS external_id FROM documents), k AS (SELECT * FROM d WHERE doc_id % 4 = 1 OR doc_id % 10 = 0) SELECT doc_id FROM d WHERE fingerprint NOT IN (SELECT fingerprint FROM k) AND (external_id IS NULL OR external_id NOT IN (SELECT external_id FROM k WHERE external_id IS NOT NULL))")
def j4_new_items(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"), F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("-"), F.col("n_chars").cast("string"))).alias("external_id"))
    return joins.new_items(docs, docs.filter("doc_id % 4 = 1 or doc_id % 10 = 0")).select("doc_id")


@query(f"WITH {ARTIFACTS} SELECT id FROM v8 WHERE status = 'verified' AND title || id IN (SELECT title || id FROM v8 WHERE id % 2 = 0)")
def j5_skip_verified(spark, d):
    a = views.artifacts(spark, d).withColumn("path", F.concat("title", F.col("id").cast("string")))
    return joins.skip_verified(a, a.filter("id % 2 = 0").select("path")).select("id")


@query(f"WITH {ARTIFACTS}, o AS (SELECT id, status, observed AS hash FROM v8 WHERE id % 3 <> 1), n AS (SELECT id, 'written' AS status, CASE WHEN id % 2 = 0 THEN expected END AS hash FROM v8 WHERE id % 3 <> 2) SELECT coalesce(n.id, o.id) AS id, coalesce(n.status, o.status) AS status, coalesce(n.hash, o.hash) AS hash FROM o FULL OUTER JOIN n ON o.id = n.id")
def j6_upsert_artifacts(spark, d):
    a = views.artifacts(spark, d)
    old = a.filter("id % 3 <> 1").select("id", "status", F.col("observed").alias("hash"))
    new = a.filter("id % 3 <> 2").select("id", F.lit("written").alias("status"), F.when(F.col("id") % 2 == 0, F.col("expected")).alias("hash"))
    return joins.upsert_artifacts(old, new, ["id"], ["status", "hash"])


@query(f"WITH {QUALITY} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality ELSE previous_quality END AS quality, CASE WHEN doc_id % 4 = 0 THEN 'verified' ELSE 'queued' END AS status FROM q5")
def j7_commit_results(spark, d):
    q = views.quality(spark, d)
    items = q.select("doc_id", F.col("previous_quality").alias("quality"), F.lit("queued").alias("status"))
    results = q.filter("doc_id % 2 = 0").select("doc_id", "quality", F.when(F.col("doc_id") % 4 == 0, "verified").alias("status"))
    return joins.commit_results(items, results, "doc_id", ["quality", "status"])


@query(
    f"""WITH {ARTIFACTS}, p AS (SELECT id, observed, expected, ['preserve', 'replace', 'write-new', 'metadata-only', 'preservee'][id % 5 + 1] AS policy, id % 6 = 0 AS metadata_only FROM v8),
a AS (SELECT id, CASE WHEN policy = 'preservee' THEN 'unknown_policy' WHEN observed IS NULL THEN 'write_canonical' WHEN observed = expected AND (policy = 'metadata-only' OR metadata_only) THEN 'update_metadata_only' WHEN observed = expected THEN 'write_canonical'
    WHEN policy = 'replace' THEN 'forced_overwrite' WHEN policy = 'write-new' THEN 'write_new_variant' ELSE 'mark_conflict' END AS action FROM p)
SELECT id, action, CASE WHEN action = 'write_new_variant' THEN 'note_variant' ELSE 'note' END AS artifact_kind, action = 'forced_overwrite' AS needs_audit FROM a"""
)
def j8_overwrite_decision(spark, d):
    a = views.artifacts(spark, d)
    policy = F.element_at(F.array(*map(F.lit, ("preserve", "replace", "write-new", "metadata-only", "preservee"))), (F.col("id") % 5 + 1).cast("int"))
    plan = a.select("id", policy.alias("policy"), (F.col("id") % 6 == 0).alias("metadata_only"))
    return joins.overwrite_decision(plan, a.select("id", "observed"), a.select("id", "expected")).select("id", "action", "artifact_kind", "needs_audit")


@query(f"WITH {LINKED} SELECT l.from_guid, l.to_guid, v.title AS target_title FROM l6 l LEFT JOIN v6 v ON v.guid = l.to_guid")
def j9_resolve_links(spark, d):
    notes, links = views.linked_notes(spark, d)
    return joins.resolve_links(links, notes).select("from_guid", "to_guid", "target_title")


@query(f"WITH {LINKED} SELECT from_guid, to_guid FROM l6 WHERE to_guid NOT IN (SELECT guid FROM v6)")
def j10_unresolved_links(spark, d):
    notes, links = views.linked_notes(spark, d)
    return joins.unresolved_links(links, notes).select("from_guid", "to_guid")


@query(f"WITH {RESOURCES}, {_MATCH} SELECT note_id, md5, outcome FROM m")
def j11_resource_match(spark, d):
    return joins.resource_match(views.body_refs(spark, d), views.resources(spark, d))


@query(
    r"""WITH i AS (SELECT page_id, url || '&again=1' AS url, string_split(url, '?')[1] AS asset_key FROM pages WHERE contains(url, '?') UNION ALL SELECT page_id, url, url FROM pages WHERE NOT contains(url, '?')),
a AS (SELECT string_split(url, '?')[1] AS asset_key, min('assets/' || page_id) AS local_path FROM pages WHERE page_id % 2 = 0 GROUP BY 1) SELECT page_id, asset_key, local_path FROM i LEFT JOIN a USING (asset_key)"""
)
def j12_localize_assets(spark, d):
    from tarnfold.functions.urls import asset_key

    p = views.table(spark, d, "pages").select("page_id", "url")
    images = p.withColumn("url", F.when(F.col("url").contains("?"), F.concat("url", F.lit("&again=1"))).otherwise(F.col("url")))
    assets = p.filter("page_id % 2 = 0").select("url", F.concat(F.lit("assets/"), F.col("page_id").cast("string")).alias("local_path"))
    return joins.localize_assets(images, assets, asset_key).select("page_id", "asset_key", "local_path")


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = views.table(spark, d, "documents").select("doc_id", F.concat("source", F.when(F.col("doc_id") % 2 == 0, ".enex").otherwise("")).alias("name"), F.col("lang").alias("stack"), F.col("source").alias("notebook"))
    s = views.table(spark, d, "documents").select("source").distinct()
    plain = s.filter("source < 'src15'").select(F.col("source").alias("name"), F.lit("by plain").alias("stack"), F.col("source").alias("notebook"))
    suffixed = s.select(F.concat("source", F.lit(".enex")).alias("name"), F.lit(None).cast("string").alias("stack"), F.lit("by suffix").alias("notebook"))
    return files, plain.unionByName(suffixed).unionByName(spark.range(3).select(F.concat(F.lit("absent"), F.col("id").cast("string")).alias("name"), F.lit("x").alias("stack"), F.lit("y").alias("notebook")))


@query("SELECT doc_id, CASE WHEN source < 'src15' THEN 'by plain' ELSE lang END AS stack, CASE WHEN source < 'src15' THEN source WHEN doc_id % 2 = 0 THEN 'by suffix' ELSE source END AS notebook FROM documents")
def j13_apply_mappings(spark, d):
    return joins.apply_mappings(*_files(spark, d)).select("doc_id", "stack", "notebook")


@query("SELECT 'absent' || i AS name FROM range(3) r(i) UNION ALL SELECT source || '.enex' FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 2 = 0) = 0")
def j14_unmatched_mappings(spark, d):
    files, mappings = _files(spark, d)
    return joins.unmatched_mappings(mappings, files).select("name")


@query(f"WITH {ARTIFACTS}, {_SHARDS}, g AS (SELECT shard, count(*) AS n, min(id) AS a FROM sh GROUP BY 1) SELECT shard FROM g WHERE n % 2 = 0 AND a % 3 <> 0")
def j15_index_conflicts(spark, d):
    g = _shards(spark, d).groupBy("shard").agg(F.count("*").alias("n"), F.min("id").alias("a"))
    known = g.filter("a % 3 <> 0").select("shard", F.sha2("shard", 256).alias("known_hash"))
    observed = g.select("shard", F.when(F.col("n") % 2 == 0, F.sha2(F.concat("shard", F.lit("!")), 256)).otherwise(F.sha2("shard", 256)).alias("file_hash"))
    return joins.index_conflicts(g, known, observed).select("shard")


@query(f"WITH {ARTIFACTS} SELECT id FROM v8 WHERE status = 'verified' AND id % 3 = 0 AND id % 5 <> 0 ORDER BY id LIMIT 50")
def j16_rerun_set(spark, d):
    a = views.artifacts(spark, d).select("id", "status")
    return joins.rerun_set(a.filter("id % 3 = 0"), a.filter("id % 5 <> 0"), None, 50).select("id")


@query("SELECT p_partkey * 2 AS id FROM part WHERE p_partkey * 2 NOT IN (SELECT p_partkey FROM part)")
def j17_sample_coverage(spark, d):
    ids = views.artifacts(spark, d).select("id")
    return joins.sample_coverage(ids.select((F.col("id") * 2).alias("id")), ids)


# --- sorts, limits, sets


@query("SELECT page_id AS source_position, url AS original_url FROM pages ORDER BY 1 LIMIT 200")
def t1_take_by_position(spark, d):
    return sets.take_by_position(views.pages(spark, d).select("source_position", "original_url"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, min(l_shipdate)::DATE AS seen FROM lineitem GROUP BY 1, 2 ORDER BY min(l_shipdate), 1, 2 LIMIT 500")
def t2_scan_cap(spark, d):
    obs = views.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_shipdate")
    return sets.scan_cap(obs, ["l_orderkey", "l_linenumber"], ["l_shipdate"], 500).select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("seen"))


@query("SELECT user_id AS job_id FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 8")
def t3_recent_jobs(spark, d):
    return sets.recent_jobs(views.attempts(spark, d).select(F.col("item_id").alias("job_id"), "ts")).select("job_id")


@query("SELECT event_id AS position, event_type AS reason FROM events ORDER BY 1 DESC LIMIT 200")
def t4_log_tail(spark, d):
    return sets.log_tail(views.attempts(spark, d).select("position", "reason"))


@query(f"WITH {ARTIFACTS} SELECT id, title, status FROM v8 ORDER BY title, id")
def t5_ordered_listing(spark, d):
    return sets.ordered_listing(views.artifacts(spark, d).select("id", "title", "status"), ["title", "id"])


@query("WITH e AS (SELECT source AS place, doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT source, doc_id FROM documents WHERE doc_id % 3 = 0 UNION SELECT source, doc_id FROM documents WHERE n_chars > 5000) SELECT * FROM e")
def u1_union_observations(spark, d):
    docs = views.table(spark, d, "documents")
    parts = [docs.filter(c).select(F.col("source").alias("place"), "doc_id") for c in ("doc_id % 2 = 0", "doc_id % 3 = 0", "n_chars > 5000")]
    return sets.union_observations(*parts, key=["place", "doc_id"])


@query("SELECT doc_id AS id, source AS title, CAST(NULL AS VARCHAR) AS role FROM documents UNION ALL SELECT conv_id, NULL, role FROM conversations")
def u2_union_report_rows(spark, d):
    a = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"))
    return sets.union_report_rows(a, views.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "role"))


@query(f"WITH {ITEM_STATES} SELECT DISTINCT job_id, item_no FROM v4 WHERE state = 'verified' AND job_id % 3 <> 0")
def u3_excluded_in_snapshot(spark, d):
    s = views.item_states(spark, d)
    return sets.excluded_in_snapshot(s.filter("state = 'verified'").select("job_id", "item_no"), s.filter("job_id % 3 <> 0").select("job_id", "item_no"))


@query(f"WITH {ITEM_STATES} SELECT job_id, item_no, state FROM v4 WHERE state <> 'verified'")
def u4_pending(spark, d):
    return sets.pending(views.item_states(spark, d)).select("job_id", "item_no", "state")


# --- guards


@query(f"WITH {ITEM_STATES} SELECT job_id, item_no, CASE WHEN state NOT IN ({quoted(FINAL_STATES + RECOVERABLE_STATES)}) THEN 'state' ELSE 'item_no_below_7' END AS violation FROM v4 WHERE state NOT IN ({quoted(FINAL_STATES + RECOVERABLE_STATES)}) OR item_no >= 7")
def g1_vocabulary_violations(spark, d):
    found = guards.vocabulary_violations(views.item_states(spark, d), {"state": FINAL_STATES + RECOVERABLE_STATES}, {"item_no_below_7": F.col("item_no") < 7}, None)
    return found.select("job_id", "item_no", "violation")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def g2_unique_violations(spark, d):
    return guards.unique_violations(views.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def g3_fk_violations(spark, d):
    return guards.fk_violations(views.table(spark, d, "orders").select("o_orderkey"), views.table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query(f"WITH {QUALITY} SELECT doc_id, CASE WHEN quality = 'full' AND toxic = 1 THEN 'full_with_degradations' END AS error_code FROM q5")
def g4_quality_contract(spark, d):
    return guards.quality_contract(views.quality(spark, d)).select("doc_id", "error_code")


_ERRORS = "er AS (SELECT event_id AS position, event_type = 'error' AND event_id % 2 = 0 AS retryable, CASE WHEN event_type = 'view' THEN 'job' ELSE 'item' END AS scope, CASE event_type WHEN 'click' THEN 'blocked' WHEN 'signup' THEN 'unsupported' WHEN 'purchase' THEN 'lost' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'blocked' END END AS disposition FROM events)"


def _errors(spark: SparkSession, d: str) -> DataFrame:
    e, n = F.col("reason"), F.col("position")
    fate = F.when(e == "click", "blocked").when(e == "signup", "unsupported").when(e == "purchase", "lost").when((e == "error") & (n % 3 == 0), "blocked")
    return views.attempts(spark, d).withColumn("retryable", (e == "error") & (n % 2 == 0)).withColumn("scope", F.when(e == "view", "job").otherwise("item")).withColumn("disposition", fate)


@query(f"WITH {_ERRORS} SELECT position, CASE WHEN retryable AND disposition IS NOT NULL THEN 'retryable_with_disposition' WHEN scope = 'job' AND disposition IS NOT NULL THEN 'job_with_disposition' WHEN disposition = 'lost' THEN 'unknown_disposition' WHEN NOT retryable AND scope = 'item' AND disposition IS NULL THEN 'disposition_missing' END AS error_code FROM er")
def g5_disposition_contract(spark, d):
    return guards.disposition_contract(_errors(spark, d)).select("position", "error_code")


@query(f"WITH {ATTEMPTS}, {_ERRORS} SELECT position, CASE WHEN position % 29 = 0 THEN 'skipped' WHEN disposition = 'unsupported' THEN 'unsupported' WHEN disposition = 'blocked' THEN 'blocked' WHEN position % 31 = 0 THEN 'conflict' WHEN http_status IN (429, 503) THEN 'paused' ELSE 'permanent_failed' END AS item_state FROM v3 JOIN er USING (position)")
def g6_final_state(spark, d):
    n = F.col("position")
    e = _errors(spark, d).withColumn("aborted", n % 29 == 0).withColumn("code", F.when(n % 31 == 0, "SQL_CONSTRAINT_UNIQUE"))
    return guards.final_state(e).select("position", "item_state")


@query(f"WITH {ARTIFACTS} SELECT id, CASE WHEN observed IS NULL THEN 'missing' WHEN id % 7 = 0 THEN 'empty' WHEN observed <> expected THEN 'hash_mismatch' ELSE 'ok' END AS outcome FROM v8")
def g7_verify_files(spark, d):
    a = views.artifacts(spark, d)
    return guards.verify_files(a.select("id", "expected"), a.filter("observed is not null").select("id", "observed", F.when(F.col("id") % 7 == 0, 0).otherwise(1).alias("size")))


@query(f"WITH {ARTIFACTS} SELECT id, status FROM v8 WHERE status NOT IN ({quoted(ARTIFACT_STATES[2:])})")
def s5_state_tables(spark, d):
    """Artifacts through a state table: the even ones as a first version, all of them over it by key, and a writer from before that, which is refused; read again, those that aren't verified or later."""
    root = scratch_folder(spark, "state")
    rows = views.artifacts(spark, d).select(F.col("id").alias("artifact_id"), F.lit("t").alias("target_id"), F.concat(F.lit("notes/"), "id").alias("relative_path"), "status")
    base = writers.write_state(rows.filter("artifact_id % 2 = 0").withColumn("status", F.lit("invalid")), root, "target_artifacts")
    writers.upsert_state(rows, root, "target_artifacts")
    try:
        writers.write_state(rows.limit(0), root, "target_artifacts", base)
    except CommitConflict:
        pass
    return readers.read_state(spark, root, "target_artifacts").filter(~F.col("status").isin(*ARTIFACT_STATES[2:])).select(F.col("artifact_id").alias("id"), "status")


