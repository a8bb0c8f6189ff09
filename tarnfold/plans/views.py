"""Test views over the driver's tables: each once in Spark and once in SQL. See FIXTURES.md for what they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators.windows import first_observation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.lit("web").alias("source_instance_id"), F.col("page_id").alias("source_position"), F.col("url").alias("original_url"), "html")


PAGES = "v1 AS (SELECT 'web' AS source_instance_id, page_id AS source_position, url AS original_url, html FROM pages)"


def notes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    title = F.substring(F.split("text", "\n").getItem(0), 1, 60)
    return docs.select(F.col("doc_id").alias("ordinal"), F.col("source").alias("notebook"), F.col("lang").alias("stack"), title.alias("title"), F.col("text").alias("body"), F.sha2("text", 256).alias("file_sha256"))


NOTES = "v2 AS (SELECT doc_id AS ordinal, source AS notebook, lang AS stack, substring(string_split(text, chr(10))[1], 1, 60) AS title, text AS body, sha256(text) AS file_sha256 FROM documents)"


def body_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("doc_id % 3 <> 0").select(F.col("lang").alias("note_id"), F.md5("text").alias("md5"))


def resources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("doc_id % 5 <> 0")
    return docs.select(F.col("lang").alias("note_id"), F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("position"), F.col("source").alias("file_name"), (F.col("doc_id") % 2 == 0).alias("attachment"), F.octet_length("text").cast("long").alias("size"))


RESOURCES = (
    "refs AS (SELECT lang AS note_id, md5(text) AS md5 FROM documents WHERE doc_id % 3 <> 0), "
    "res AS (SELECT lang AS note_id, md5(text) AS md5, sha256(text) AS sha256, doc_id AS position, source AS file_name, doc_id % 2 = 0 AS attachment, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE doc_id % 5 <> 0)"
)

_STATUS = {"signup": "created", "view": "running", "click": "paused", "error": "interrupted", "purchase": "completed"}
_CLEANUP = {"purchase": "unfavorited_verified", "signup": "already_unfavorited", "error": "verification_failed", "click": "state_unknown", "view": "login_required"}
_HTTP = (429, 503, 404, 500)


def _mapped(column: Column, pairs: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in pairs.items():
        out = out.when(column == k, v)
    return out


def _mapped_sql(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    http = F.when(e == "error", F.element_at(F.array(*map(F.lit, _HTTP)), (F.col("event_id") % 4 + 1).cast("int"))).otherwise(200)
    return table(spark, d, "events").select(
        (F.col("user_id") % 10).alias("job_id"), F.col("user_id").alias("item_id"), F.col("event_id").alias("position"), e.alias("reason"), http.cast("long").alias("http_status"),
        _mapped(e, _STATUS).alias("status"), _mapped(e, _CLEANUP).alias("cleanup_status"), F.floor(F.col("event_id") / 50).alias("round"), F.col("ts").cast("timestamp").alias("ts"), "props", "value",
    )


ATTEMPTS = (
    "v3 AS (SELECT user_id % 10 AS job_id, user_id AS item_id, event_id AS position, event_type AS reason, CAST(CASE WHEN event_type = 'error' THEN [429, 503, 404, 500][event_id % 4 + 1] ELSE 200 END AS BIGINT) AS http_status, "
    f"{_mapped_sql('event_type', _STATUS)} AS status, {_mapped_sql('event_type', _CLEANUP)} AS cleanup_status, event_id // 50 AS round, ts, props, value FROM events)"
)


def item_states(spark: SparkSession, d: str) -> DataFrame:
    """(job_id, item_no, state): items out of repeated observations."""
    line = table(spark, d, "lineitem")
    first = first_observation(line, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    two = F.concat("l_returnflag", "l_linestatus")
    q = F.col("l_quantity")
    state = (
        F.when(two == "AF", "verified").when(two == "AO", "degraded").when(two == "NF", "skipped").when(two == "NO", "conflict").when(two == "RF", "permanent_failed")
        .when(q < 45, "unsupported").when(q < 50, "interrupted").otherwise("weird")
    )
    return first.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("item_no"), state.alias("state"), "l_partkey", F.col("l_shipdate").alias("seen"))


ITEM_STATES = """first_line AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1),
v4 AS (SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS item_no, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'verified' WHEN 'AO' THEN 'degraded' WHEN 'NF' THEN 'skipped' WHEN 'NO' THEN 'conflict' WHEN 'RF' THEN 'permanent_failed'
    ELSE CASE WHEN l_quantity < 45 THEN 'unsupported' WHEN l_quantity < 50 THEN 'interrupted' ELSE 'weird' END END AS state, l_partkey, l_shipdate AS seen FROM first_line)"""


def jobs(spark: SparkSession, d: str, counts: DataFrame) -> DataFrame:
    """Job rows with cached counts, some wrong on purpose. counts: true counts by job_id."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), "o_orderstatus", "o_orderpriority", F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("created"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    plus = lambda cond: F.when(cond, 1).otherwise(0)
    return orders.join(counts, "job_id", "left").select(
        "job_id", "source_id", "created", (n("n_items") + plus(F.col("o_orderstatus") == "O")).alias("scan_count"),
        (n("verified") + plus((F.col("o_orderstatus") == "P") & urgent)).alias("verified_count"), n("degraded").alias("degraded_count"), (n("failed") + plus((F.col("o_orderstatus") == "P") & ~urgent)).alias("failed_count"),
        n("conflict").alias("conflict_count"), n("skipped").alias("skipped_count"), (n("recoverable") + plus(F.col("job_id") % 97 == 0)).alias("recoverable_count"),
    )


COUNTS = """n4 AS (SELECT job_id, count(*) AS n_items, count(*) FILTER (state = 'verified') AS verified, count(*) FILTER (state = 'degraded') AS degraded, count(*) FILTER (state IN ('permanent_failed', 'unsupported', 'blocked')) AS failed,
    count(*) FILTER (state = 'conflict') AS conflict, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state IN ('interrupted', 'retryable_failed')) AS recoverable,
    count(*) FILTER (state NOT IN ('verified', 'degraded', 'permanent_failed', 'unsupported', 'blocked', 'conflict', 'skipped', 'interrupted', 'retryable_failed')) AS unknown FROM v4 GROUP BY job_id)"""
JOBS = """j4 AS (SELECT o_orderkey AS job_id, o_custkey AS source_id, o_orderdate AS created, coalesce(n_items, 0) + (o_orderstatus = 'O')::INT AS scan_count, coalesce(verified, 0) + (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')::INT AS verified_count,
    coalesce(degraded, 0) AS degraded_count, coalesce(failed, 0) + (o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT')::INT AS failed_count, coalesce(conflict, 0) AS conflict_count, coalesce(skipped, 0) AS skipped_count,
    coalesce(recoverable, 0) + (o_orderkey % 97 = 0)::INT AS recoverable_count FROM orders LEFT JOIN n4 ON job_id = o_orderkey)"""


def quality(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, quality, previous_quality, degradations)."""
    one = lambda code, stage: F.array(F.struct(F.lit(code).alias("code"), F.lit(stage).alias("stage"), F.concat(F.lit(code + " in "), F.col("lang")).alias("message")))
    none = F.array().cast("array<struct<code:string,stage:string,message:string>>")
    both = F.concat(F.when(F.col("quality") == 0, one("body-missing", "normalize")).otherwise(none), F.when(F.col("toxic") == 1, one("partial-visibility", "extract")).otherwise(none))
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return joined.select("doc_id", F.when(F.col("quality") == 1, "full").otherwise("degraded").alias("quality"), F.when(F.col("doc_id") % 2 == 0, "degraded").otherwise("full").alias("previous_quality"), both.alias("degradations"))


QUALITY = """q5 AS (SELECT doc_id, lang, toxic, CASE WHEN quality = 1 THEN 'full' ELSE 'degraded' END AS quality, CASE WHEN doc_id % 2 = 0 THEN 'degraded' ELSE 'full' END AS previous_quality FROM labels JOIN documents USING (doc_id)),
d5 AS (SELECT doc_id, 'body-missing' AS code, 'normalize' AS stage, 'body-missing in ' || lang AS message FROM q5 WHERE quality = 'degraded' UNION ALL SELECT doc_id, 'partial-visibility', 'extract', 'partial-visibility in ' || lang FROM q5 WHERE toxic = 1)"""


def linked_notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(notes, links): each turn of a conversation is a note that links to the next one."""
    turns = table(spark, d, "conversations")

    def guid(turn: Column) -> Column:
        h = F.md5(F.concat_ws(":", "conv_id", turn))
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))

    noted = turns.select(guid(F.col("turn")).alias("guid"), F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("ordinal"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("title"), "text")
    links = turns.select(guid(F.col("turn")).alias("from_guid"), guid(F.col("turn") + 1).alias("to_guid"), F.lit("internal").alias("kind"))
    return noted, links


def _guid_sql(turn: str) -> str:
    h = f"md5(conv_id || ':' || ({turn}))"
    return f"{h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32]"


LINKED = f"v6 AS (SELECT {_guid_sql('turn')} AS guid, conv_id AS file_id, turn + 1 AS ordinal, role || ' ' || turn AS title, text FROM conversations), l6 AS (SELECT {_guid_sql('turn')} AS from_guid, {_guid_sql('turn + 1')} AS to_guid, 'internal' AS kind FROM conversations)"

_KIND = {"STANDARD": "article", "PROMO": "video", "ECONOMY": "short-post", "MEDIUM": "gallery", "SMALL": "note", "LARGE": "external-link"}


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, d, "part").select(
        p.alias("id"), F.col("p_name").alias("title"), _mapped(F.col("p_type"), _KIND).alias("kind"), F.when(F.col("p_size") % 2 == 0, "verified").otherwise("planned").alias("status"), F.array("p_brand", F.concat(F.lit("size-"), F.col("p_size").cast("string"))).alias("collections"),
        F.concat(F.lit("2024-"), F.lpad((p % 14).cast("string"), 2, "0")).alias("published"), F.when(p % 3 != 0, F.sha2("p_name", 256)).alias("observed"), F.when(p % 4 != 0, F.sha2("p_name", 256)).otherwise(F.sha2(F.concat("p_name", F.lit("!")), 256)).alias("expected"),
        (p % 50).alias("job_id"),
    )


ARTIFACTS = (
    f"v8 AS (SELECT p_partkey AS id, p_name AS title, {_mapped_sql('p_type', _KIND)} AS kind, CASE WHEN p_size % 2 = 0 THEN 'verified' ELSE 'planned' END AS status, [p_brand, 'size-' || p_size] AS collections, "
    "'2024-' || lpad(CAST(p_partkey % 14 AS VARCHAR), 2, '0') AS published, CASE WHEN p_partkey % 3 <> 0 THEN sha256(p_name) END AS observed, CASE WHEN p_partkey % 4 <> 0 THEN sha256(p_name) ELSE sha256(p_name || '!') END AS expected, p_partkey % 50 AS job_id FROM part)"
)
