"""Closed vocabularies. All are fixed values."""

FINAL_STATES = ("verified", "degraded", "permanent_failed", "unsupported", "blocked", "conflict", "skipped")
FAILED_STATES = ("permanent_failed", "unsupported", "blocked")
RECOVERABLE_STATES = ("retryable_failed", "interrupted")
PROCESSING_STATES = ("discovered", "queued", "extracting", "extracted", "normalized", "assets_ready", "writing", "written", "verified")
JOB_STATES = ("created", "running", "paused", "interrupted", "completed", "failed")
#: Allowed changes of a job's status.
JOB_TRANSITIONS = (
    ("created", "running"), ("created", "failed"), ("running", "paused"), ("running", "interrupted"), ("running", "completed"), ("running", "failed"),
    ("paused", "running"), ("paused", "failed"), ("interrupted", "running"), ("interrupted", "failed"),
)
ARTIFACT_STATES = ("planned", "written", "verified", "conflict", "superseded", "invalid")
ARTIFACT_KINDS = ("note", "note_variant", "index", "report", "manifest")
CONTENT_KINDS = ("article", "short-post", "gallery", "question-answer", "video", "note", "external-link", "unknown")
DEGRADATION_CODES = ("content-unavailable", "body-missing", "partial-visibility", "metadata-only", "unsupported-structure", "asset-incomplete", "unresolved-embedded-content", "unknown")
DEGRADATION_STAGES = ("extract", "normalize", "assets")
DISPOSITIONS = ("permanent_failed", "unsupported", "blocked")
#: Buckets of clean-up results in the report.
CLEANUP_BUCKETS = {
    "unfavorited_verified": "success", "already_unfavorited": "skipped", "skipped": "skipped", "permanent_failed": "failed", "verification_failed": "failed",
    "state_unknown": "unknown", "login_required": "paused", "challenge_required": "paused",
}
#: Kinds without a note of their own: dropped from migration; and from clean-up, too.
UNMIGRATABLE_KINDS = ("video",)
UNCLEANABLE_KINDS = ("video", "external-link")
RATE_LIMITED = (429, 503)
PERMANENT_HTTP = (403, 404, 410)
OVERWRITE_POLICIES = ("preserve", "replace", "write-new", "metadata-only")
