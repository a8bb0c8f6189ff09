"""Arrays, JSON and binary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.times import month_key

#: MIME aliases, kinds by prefix, and extensions.
MIME_ALIASES = {"image/jpg": "image/jpeg", "image/pjpeg": "image/jpeg", "image/x-png": "image/png"}
OFFICE_PREFIXES = ("application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/vnd.openxmlformats-officedocument", "application/vnd.oasis.opendocument")
EXTENSIONS = {
    "image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "application/pdf": "pdf", "audio/mpeg": "mp3", "audio/mp4": "m4a", "audio/wav": "wav", "audio/amr": "amr",
    "video/mp4": "mp4", "video/quicktime": "mov", "application/msword": "doc", "application/vnd.ms-excel": "xls", "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "application/zip": "zip",
}
#: Hexadecimal prefixes of file types; .. stands for any byte.
MAGIC = (("^FFD8FF", "image/jpeg"), ("^89504E470D0A1A0A", "image/png"), ("^47494638", "image/gif"), ("^25504446", "application/pdf"), ("^52494646.{8}57454250", "image/webp"))


def shard_keys(entries: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """entries with a row for each shard: the product of its month, kind and collections, joined by -; no dimensions give all."""
    values = {"month": lambda: F.array(month_key(F.col("saved"), F.col("published"))), "kind": lambda: F.array(F.col("kind")), "collection": lambda: F.when(F.size("collections") > 0, F.col("collections")).otherwise(F.array(F.lit("ungrouped")))}
    out = entries
    for i, dim in enumerate(dims):
        out = out.withColumn(f"dim_{i}", F.explode(values[dim]()))
    names = [f"dim_{i}" for i in range(len(dims))]
    return out.withColumn("shard", F.concat_ws("-", *names) if dims else F.lit("all")).drop(*names)


def clean_tags(tags: Column) -> Column:
    """Trimmed, without a leading #; empty ones and those with white space are dropped."""
    return F.filter(F.transform(tags, lambda t: F.regexp_replace(F.trim(t), "^#", "")), lambda t: (t != "") & ~t.rlike(r"\s"))


def collections_of(json: Column) -> Column:
    """The collections field of a JSON text, a string or an array of strings, as an array; anything else is empty."""
    v = F.try_variant_get(F.try_parse_json(json), "$.collections", "array<string>")
    one = F.try_variant_get(F.try_parse_json(json), "$.collections", "string")
    single = F.get_json_object(json, "$.collections")
    return F.coalesce(F.filter(v, lambda x: x.isNotNull()), F.when(one.isNotNull() & ~F.coalesce(single.startswith("["), F.lit(False)), F.array(one)), F.array().cast("array<string>"))


def split_stack(name: Column, separator: str) -> Column:
    """Struct (stack, notebook): parted at the first separator with text on both sides, else no stack."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in separator)
    pattern = rf"(?s)^(.*?\S.*?)\s*{quoted}\s*(.*\S.*)$"
    hit = name.rlike(pattern)
    return F.struct(F.when(hit, F.trim(F.regexp_extract(name, pattern, 1))).alias("stack"), F.when(hit, F.trim(F.regexp_extract(name, pattern, 2))).otherwise(F.trim(name)).alias("notebook"))


def decode_base64(c: Column) -> Column:
    """Struct (bytes, error) by strict rules; white space doesn't count."""
    compact = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    decoded = F.try_to_binary(compact, F.lit("base64"))
    expected = F.length(compact) / 4 * 3 - F.when(compact.endswith("=="), 2).when(compact.endswith("="), 1).otherwise(0)
    error = (
        F.when(compact == "", "empty").when(~compact.rlike("^[A-Za-z0-9+/]*={0,2}$"), "illegal_characters").when(F.length(compact) % 4 != 0, "bad_length")
        .when(decoded.isNull() | (F.length(decoded) != expected), "size_mismatch")
    )
    return F.struct(F.when(error.isNull(), decoded).alias("bytes"), error.alias("error"))


def sniff_mime(content: Column) -> Column:
    """The type told by a file's first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    return reduce(lambda c, m: c.when(head.rlike(m[0]), m[1]), MAGIC, F.when(F.lit(False), ""))


def mime_columns(df: DataFrame, declared: str = "mime", sniffed: str = "sniffed") -> DataFrame:
    """df with actual_mime, mime_mismatch, asset_kind and extension; the sniffed type goes before the declared one."""
    pick = lambda c, table, default: reduce(lambda x, kv: x.when(c == kv[0], kv[1]), table.items(), F.when(F.lit(False), "")).otherwise(default)
    lower = F.lower(F.trim(F.coalesce(F.col(declared), F.lit(""))))
    base = F.when(lower == "", "application/octet-stream").otherwise(lower)
    out = df.withColumn("canonical_mime", pick(base, MIME_ALIASES, base))
    out = out.withColumn("actual_mime", F.coalesce(F.col(sniffed), F.col("canonical_mime"))).withColumn("mime_mismatch", F.col(sniffed).isNotNull() & (F.col(sniffed) != F.col("canonical_mime")))
    a = F.col("actual_mime")
    office = reduce(lambda x, p: x | a.startswith(p), OFFICE_PREFIXES, F.lit(False))
    kind = F.when(a == "application/pdf", "pdf").when(a.startswith("image/"), "image").when(a.startswith("audio/"), "audio").when(a.startswith("video/"), "video").when(office, "office").otherwise("other")
    return out.withColumn("asset_kind", kind).withColumn("extension", pick(a, EXTENSIONS, F.lit("bin")))
