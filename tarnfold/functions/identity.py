"""Stable identities and content hashes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\0"
#: What counts as white space at the ends of a field: ASCII white space, no-break space, ideographic space, byte order mark.
_ENDS = "^[\\s\u00a0\u3000\ufeff]+|[\\s\u00a0\u3000\ufeff]+$"
_GUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
FIELDS = ("external_id", "canonical_url", "original_url", "title", "author", "published_at", "raw")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), _ENDS, "")


def fingerprint(**fields: Column) -> Column:
    """sha256: and the hash of the seven trimmed fields, parted by NUL."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(NUL, *(trimmed(fields[f]) if f in fields else F.lit("") for f in FIELDS)), 256))


def fingerprint_error(**fields: Column) -> Column:
    """all_empty, nul_in_field (raw may hold NUL), or null."""
    parts = {f: trimmed(c) for f, c in fields.items()}
    empty, nul = F.lit(True), F.lit(False)
    for f, c in parts.items():
        empty = empty & (c == "")
        nul = nul | (F.instr(c, NUL) > 0 if f != "raw" else F.lit(False))
    return F.when(empty, "all_empty").when(nul, "nul_in_field")


def item_identity(df: DataFrame) -> DataFrame:
    """df with fingerprint and identity_level: content id, canonical URL, title/author/time, original URL; a higher level hides those below."""
    has = lambda c: trimmed(F.col(c)) != ""
    by_text = has("title") | has("author") | has("published_at")
    level = F.when(has("content_id"), 1).when(has("canonical_url"), 2).when(by_text, 3).when(has("original_url"), 4)
    at = lambda n, c: F.when(level == n, F.col(c))
    value = fingerprint(external_id=at(1, "content_id"), canonical_url=at(2, "canonical_url"), title=at(3, "title"), author=at(3, "author"), published_at=at(3, "published_at"), raw=at(4, "original_url"))
    return df.withColumn("identity_level", level.cast("long")).withColumn("fingerprint", F.when(level.isNotNull(), value))


def note_identity(df: DataFrame) -> DataFrame:
    """df (guid, app_link, file_name, ordinal, title, created, file_sha256) with external_id and fingerprint: GUID, app link that holds one, or place in the file."""
    guid = F.lower(F.regexp_replace(F.regexp_replace(trimmed(F.col("guid")), r"^\{|\}$", ""), "(?i)^urn:uuid:", ""))
    link = F.lower(trimmed(F.col("app_link")))
    by_guid, by_link = guid.rlike(f"^{_GUID}$"), link.rlike(f"^[a-z]+:///?(.*/)?{_GUID}(/.*)?$")
    place = F.concat(F.lit("enex:"), F.replace("file_name", F.lit("#"), F.lit("%23")), F.lit("#"), F.col("ordinal").cast("string"))
    raw = F.concat_ws(NUL, F.coalesce("file_sha256", F.lit("")), F.col("ordinal").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("created", F.lit("")))
    told = F.when(by_guid, F.concat(F.lit("guid:"), guid)).when(by_link, F.concat(F.lit("link:"), link)).otherwise(raw)
    external = F.when(by_guid, F.concat(F.lit("note-guid:"), guid)).when(by_link, F.concat(F.lit("note-link:"), link)).otherwise(place)
    return df.withColumn("external_id", external).withColumn("fingerprint", fingerprint(raw=told))


def stable_key(instance: Column, fingerprint_: Column) -> Column:
    """Null where either part is empty or holds NUL."""
    good = (instance != "") & (fingerprint_ != "") & (F.instr(instance, NUL) == 0) & (F.instr(fingerprint_, NUL) == 0)
    return F.when(good, F.sha2(F.concat_ws(NUL, instance, fingerprint_), 256))


def item_key(key: Column, length: int = 16) -> Column:
    return F.concat(F.lit("im-"), F.substring(key, 1, length))


def short_id(key: Column, length: int = 10) -> Column:
    return F.substring(key, 1, length)


def full_id(instance: Column, key: Column) -> Column:
    return F.concat(F.lit("im:"), instance, F.lit(":"), key)


def notebook_key(file_sha256: Column, stack: Column, notebook: Column) -> Column:
    return F.sha2(F.concat_ws(NUL, F.coalesce(file_sha256, F.lit("")), F.coalesce(stack, F.lit("")), F.coalesce(notebook, F.lit(""))), 256)


def merge_key(group: Column) -> Column:
    return F.sha2(F.concat(F.lit("merge" + NUL), group), 256)


def source_hash(*columns: str) -> Column:
    """Of the extracted content: JSON of the columns in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def target_hash(text: Column) -> Column:
    """Of the rendered note."""
    return F.sha2(text, 256)


def file_hash(content: Column) -> Column:
    """Of a file's bytes."""
    return F.sha2(content, 256)


def config_hash(json: Column) -> Column:
    """Of a JSON text, whatever the order of its keys; null where it is missing or broken."""
    return F.sha2(F.to_json(F.try_parse_json(json)), 256)
