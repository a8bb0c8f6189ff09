"""Row predicates: what is migrated, cleaned up, shown, resumed or refused."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.vocabulary import FAILED_STATES, UNCLEANABLE_KINDS, UNMIGRATABLE_KINDS
from tarnfold.operators.windows import latest


def migratable(df: DataFrame, kind: str = "kind") -> DataFrame:
    return df.filter(F.col(kind).isNull() | ~F.col(kind).isin(*UNMIGRATABLE_KINDS))


def cleanup_scope(df: DataFrame, kind: str = "kind") -> DataFrame:
    return df.filter((F.col("status") == "verified") & (F.col(kind).isNull() | ~F.col(kind).isin(*UNCLEANABLE_KINDS)))


def status_slice(df: DataFrame, slice_: str, state: str = "state") -> DataFrame:
    """The failed, degraded or conflict part of the item report."""
    return df.filter(F.col(state).isin(*{"failed": FAILED_STATES, "degraded": ("degraded",), "conflict": ("conflict",)}[slice_]))


def title_search(df: DataFrame, text: str, cap: int = 100, title: str = "title", order: str = "id") -> DataFrame:
    """The first matches and, with each, the count of all."""
    hits = df.filter(F.lower(title).contains(text.strip().lower()))
    counted = hits.agg(F.count("*").alias("n_matches")).withColumn("one_", F.lit(1))  # one row
    return hits.orderBy(title, order).limit(cap).withColumn("one_", F.lit(1)).join(counted, "one_").drop("one_")


def log_filter(df: DataFrame, level: str, column: str = "level") -> DataFrame:
    return df.filter(F.col(column) == level)


def special_page(df: DataFrame, html: str = "html") -> DataFrame:
    """df with special: deleted, login_required or challenge, only where the page has no body container. Null html is no special page."""
    h = F.lower(html)
    body = h.rlike(r'<article[\s>]|class="[^"]*(article-content|post-content)')
    told = F.when(body, F.lit(None).cast("string")).when(h.rlike(r'class="[^"]*(error-404|content-deleted|not-found)'), "deleted").when(h.rlike(r'class="[^"]*(login-required|login-modal|login-wall)'), "login_required").when(h.rlike(r'class="[^"]*(captcha|challenge|verify-page)|id="(captcha|challenge)'), "challenge")
    return df.withColumn("special", told)


#: Rules of clean-up eligibility in their order: a column that must hold, and the reason if it doesn't.
ELIGIBILITY = (
    ("is_note", "not_note_kind"), ("is_verified", "not_verified"), ("is_full", "not_full_quality"), ("note_exists", "note_missing"), ("note_non_zero", "note_zero_bytes"), ("yaml_parseable", "yaml_unparseable"),
    ("has_id_or_url", "no_source_id_or_url"), ("db_consistent", "db_target_inconsistent"), ("no_conflict", "unresolved_conflict"), ("not_transitional", "transitional_state"), ("not_unfavorited", "already_unfavorited"),
)


def cleanup_eligible(df: DataFrame) -> DataFrame:
    """df with reasons (joined by commas, in order of the rules) and eligible; an unknown counts as not held."""
    failed = F.array(*(F.when(~F.coalesce(F.col(c), F.lit(False)), reason) for c, reason in ELIGIBILITY))
    return df.withColumn("reasons", F.array_join(failed, ",")).withColumn("eligible", F.col("reasons") == "")


def upgrade_candidates(df: DataFrame) -> DataFrame:
    return df.filter((F.col("previous_quality") == "degraded") & (F.col("quality") == "full") & (F.size("degradations") == 0))


def resumable(jobs: DataFrame, now: Column, key: str = "source_id", idle_minutes: int = 5) -> DataFrame:
    """The latest job of each source if it is paused, interrupted, or running without an update for five minutes."""
    last = latest(jobs, [key], ["ts", "position"])
    idle = F.col("ts") < now - F.expr(f"interval {idle_minutes} minutes")
    return last.filter(F.col("status").isin("paused", "interrupted") | ((F.col("status") == "running") & idle))


def stale_holders(locks: DataFrame, now: Column, column: str = "heartbeat", seconds: int = 60) -> DataFrame:
    """Locks whose heartbeat is missing, unreadable, older than a minute, or more than a minute ahead."""
    at = F.try_to_timestamp(column)
    far = F.abs(F.unix_micros(now) - F.unix_micros(at)) > seconds * 1_000_000
    return locks.filter(at.isNull() | far)


def unsafe_urls(df: DataFrame, url: str = "url", srcset: str | None = None) -> DataFrame:
    """Rows with a URL, or a candidate in srcset, whose scheme isn't http, https or mailto; relative ones are safe."""
    scheme = lambda c: F.regexp_extract(F.regexp_replace(c, r"[\x00-\x20]+", ""), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    bad = lambda c: ~F.lower(scheme(c)).isin("", "http", "https", "mailto")
    out = bad(F.col(url))
    if srcset:
        out = out | F.coalesce(F.exists(F.split(srcset, r"\s*,\s+"), lambda x: bad(F.trim(x))), F.lit(False))
    return df.filter(out)


def remote_images_left(df: DataFrame, body: str = "body") -> DataFrame:
    return df.filter(F.col(body).rlike(r"!\[[^\]]*\]\(<?https?://"))
