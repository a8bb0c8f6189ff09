"""Secret scans: credential patterns in whole texts, told apart by how many owners and repositories hold the same value.

The owner of a document is its source, and its repository its source and language, unless the caller names other columns. Built from SQL functions only. A pattern's matches come from regexp_extract_all and the text between them from split, so
running sums of their lengths give each match's place in code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfold.llm.common import salted_join, stored, unused

#: Base kinds in their fixed order: pattern, group that holds the value, least length of the value.
BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Kinds the operator adds: public formats of vendors' credentials. They count as secrets only where their value is owner-specific.
ADDED = {
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "google": (r"AIza[A-Za-z0-9_-]+", 0, 39),
    "payment": (r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
}
KINDS = BASE | ADDED
#: A text without this has no match of any kind. Runs of hex digits shorter than 16 can't pass, so the run is asked for whole.
_ANY = r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]|AKIA|[0-9a-f]{16}|gh[pousr]_|xox[abprs]-|AIza|k_live_|eyJ|PRIVATE KEY"


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, nth, gap, length, hash): every match of the pattern, and hash only of those whose value is long enough."""
    pattern, group, least = KINDS[kind]
    pattern = pattern if kind != "hex" else "[0-9a-f]{16,}"  # a run is maximal, so the same matches pass
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(found.alias("found"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"))
    value = lambda x: F.regexp_extract(x, pattern, group) if group else x
    return F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("length"), F.when(F.length(value(x["found"])) >= least, F.sha2(value(x["found"]), 256)).alias("hash")
        ),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row for each document: doc_id, key (of rows with a possible secret: a hash of id and text), repository, owner, matches."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if repository is None else repository
    text = F.col("text_")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(repository, F.lit("")).alias("repository"), F.coalesce(owner, F.lit("")).alias("owner"), F.col(text_col).alias("text_"))
    hit = F.coalesce(text.rlike(_ANY), F.lit(False))
    return rows.select("doc_id", "repository", "owner", F.when(hit, row_key(F.col("doc_id"), text)).alias("key"), F.when(hit, F.concat(*(_matches(text, k) for k in KINDS))).alias("matches"))


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by what the scan sees of it; rows with equal id and text have equal results."""
    return F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text), 256)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners, n (matches). Counts of each (hash, repository, owner) first, so a value copied into a third of all rows is a few rows before its holders are counted."""
    seen = found.filter("hash is not null").groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"))
    return seen.groupBy("hash").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"), F.sum("n").alias("n"))


def copied(owners: Column, repositories: Column, wide: int, spread: int) -> Column:
    """Whether a value is a widely copied example: held by `wide` owners, or by more than one and in `spread` repositories. In many repositories of one owner it is still the owner's."""
    return (owners >= wide) | ((owners > 1) & (repositories >= spread))


def classified_spans(scanned: DataFrame, wide: int = 3, spread: int = 4) -> DataFrame:
    """(key, kind, start, end, live, n_owners, n_repositories) of every span that counts. live: its value isn't a widely copied example; added kinds count only if live."""
    found = scanned.filter("key is not null").select("key", "repository", "owner", F.explode("matches").alias("m")).select("key", "repository", "owner", "m.*")
    order = W.partitionBy("key", "kind").orderBy("nth")
    placed = found.dropDuplicates(["key", "kind", "nth"]).withColumn("end", F.sum(F.col("gap") + F.col("length")).over(order))
    placed = placed.filter("hash is not null").select("key", "kind", (F.col("end") - F.col("length")).alias("start"), "end", "hash")
    holders = stored(ownership(found), "holders")
    total = holders.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = salted_join(placed, holders, ["hash"], F.col("key"), total).withColumn("live", ~copied(F.col("n_owners"), F.col("n_repositories"), wide, spread))
    return counted.filter(F.col("live") | F.col("kind").isin(*BASE)).select("key", "kind", "start", "end", "live", "n_owners", "n_repositories")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_report(docs: DataFrame, wide: int = 3, spread: int = 4, **columns) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, live_spans, and the most owners and repositories that hold a value of either class.

    n_live and n_shared part the spans into owner-specific ones and widely copied examples; live_spans are the former. Null texts count as empty, and
    so have no spans; null owners are one owner; repeated rows have a row each but count once; an empty table gives no rows.
    """
    scanned = stored(scan(docs, **columns), "secrets")
    spans = classified_spans(scanned, wide, spread)
    rank = reduce(lambda c, x: c.when(F.col("kind") == x[1], x[0]), enumerate(KINDS), F.when(F.lit(False), 0))
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    most = [F.max(F.when(F.col("live") if name == "live" else ~F.col("live"), F.col(f"n_{of}"))).alias(f"{name}_{of}") for name in ("live", "shared") for of in ("owners", "repositories")]
    of = spans.groupBy("key").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE), F.collect_list(F.when(F.col("kind").isin(*BASE), span)).alias("base"), F.collect_list(span).alias("all"),
        F.collect_list(F.when(F.col("live"), span)).alias("live"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_shared"), *most,
    )
    numbers = ["n_live", "n_shared", "live_owners", "live_repositories", "shared_owners", "shared_repositories"]
    of = of.select("key", *(f"n_{k}" for k in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), _joined(F.col("live")).alias("live_spans"), *numbers)
    zero = F.lit(0).cast("long")
    none = [*(zero.alias(f"n_{k}") for k in BASE), F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit("").alias("live_spans"), *(zero.alias(n) for n in numbers)]
    hits = scanned.filter("key is not null").select("doc_id", "key").join(of, "key", "left")
    filled = [F.coalesce(F.col(c), z).alias(c) for c, z in zip(of.columns[1:], none, strict=True)]
    return hits.select("doc_id", *filled).unionByName(scanned.filter("key is null").select("doc_id", *none))


def redact(docs: DataFrame, mark: str = "[SECRET]", wide: int = 3, spread: int = 4, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """docs with owner-specific secrets in its texts replaced by mark; overlapping spans are one. Widely copied examples and other texts stay."""
    scanned = stored(scan(docs, id_col, text_col, **columns), "secrets")
    live = classified_spans(scanned, wide, spread).filter("live")
    by = W.partitionBy("key").orderBy("start", "end")
    runs = live.withColumn("upto", F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("start") < F.col("upto"), 0).otherwise(1)).over(by))
    cuts = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    row, found = unused(docs, "row_of_text"), unused(docs, "cuts_of_text")
    cuts = stored(cuts, "cuts").select(F.col("key").alias(row), F.col("cuts").alias(found))
    text = F.col(text_col)
    hit = F.coalesce(text.rlike(_ANY), F.lit(False))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(found), i - 1)["end"])
    parts = F.transform(found, lambda c, i: F.concat(text.substr(before(i).cast("int") + 1, (c["start"] - before(i)).cast("int")), F.lit(mark)))
    tail = text.substr(F.element_at(found, -1)["end"].cast("int") + 1, F.length(text))
    some = docs.filter(hit).withColumn(row, row_key(F.col(id_col), text)).join(cuts, row, "left")
    some = some.withColumn(text_col, F.when(F.col(found).isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail)))
    return some.drop(row, found).unionByName(docs.filter(~hit))


def _sql() -> str:
    quoted = lambda s: s.replace("'", "''")
    scans = " UNION ALL ".join(
        f"SELECT r, doc_id, repository, owner, '{kind}' AS kind, {rank} AS rank, {least} AS least, "
        f"regexp_extract_all(text, '{quoted(pattern)}') AS found, regexp_extract_all(text, '{quoted(pattern)}', {group}) AS value, string_split_regex(text, '{quoted(pattern)}') AS gap FROM d"
        for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items())
    )
    base = ", ".join(f"'{k}'" for k in BASE)
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') || '/' || coalesce(lang, '') AS repository, coalesce(source, '') AS owner FROM documents),
m AS ({scans}),
e AS (SELECT * EXCLUDE (found, value, gap), unnest(found) AS found, unnest(value) AS value, unnest(gap[1:len(found)]) AS gap, unnest(range(len(found))) AS nth FROM m WHERE len(found) > 0),
p AS (SELECT *, CAST(sum(length(gap) + length(found)) OVER (PARTITION BY r, kind ORDER BY nth) AS BIGINT) AS stop FROM e),
s AS (SELECT *, stop - length(found) AS start FROM p WHERE length(value) >= least),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM s GROUP BY value),
k AS (SELECT s.*, owners, repositories, owners < 3 AND (owners = 1 OR repositories < 4) AS live FROM s JOIN o USING (value) WHERE (owners < 3 AND (owners = 1 OR repositories < 4)) OR kind IN ({base})),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    {text} FILTER (kind IN ({base})) AS base, {text} AS spans, {text} FILTER (live) AS live_spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_shared,
    max(owners) FILTER (live) AS live_owners, max(repositories) FILTER (live) AS live_repositories, max(owners) FILTER (NOT live) AS shared_owners, max(repositories) FILTER (NOT live) AS shared_repositories FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(live_spans, '') AS live_spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(live_owners, 0) AS live_owners,
    coalesce(live_repositories, 0) AS live_repositories, coalesce(shared_owners, 0) AS shared_owners, coalesce(shared_repositories, 0) AS shared_repositories FROM d LEFT JOIN g USING (r)
"""


SECRET_SQL = _sql()
