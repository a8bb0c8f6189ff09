"""Operators that mean a window: first and latest rows, name clashes, run lengths, status histories, retries.

Where a first or last row is taken, the order columns are followed by all other columns, so no result depends on how rows arrive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfold.functions.vocabulary import JOB_TRANSITIONS, PERMANENT_HTTP, RATE_LIMITED


def _outermost(df: DataFrame, key: list[str], order: list[str], pick) -> DataFrame:
    """The row of each key with the least or greatest (order, other columns): an aggregate with map-side combine, so a key with very many rows is no hot task."""
    rest = [c for c in df.columns if c not in key and c not in order]
    if any(kind.startswith(("map", "variant")) for c, kind in df.dtypes if c in rest):
        raise ValueError("columns of maps have no order; leave them out or make them arrays first")
    kept = df.groupBy(*key).agg(pick(F.struct(*order, *rest)).alias("row_"))
    return kept.select(*(F.col(c) if c in key else F.col(f"row_.`{c}`").alias(c) for c in df.columns))


def first_observation(obs: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; all other columns break ties, nulls first."""
    return _outermost(obs, key, order, F.min)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in order; nulls are earliest."""
    return _outermost(df, key, order, F.max)


def latest_values(df: DataFrame, key: str, value: list[str], order: str, keep_order: bool = False) -> DataFrame:
    """Of each key and each value column the last value by order that isn't null; rows without an order are earliest, of equal orders the greatest value counts.

    A greatest struct a column, so partial results combine in any order. keep_order adds order_<value> columns.
    """
    last = lambda v: F.max(F.when(F.col(v).isNotNull(), F.struct(F.col(order).alias("at"), F.col(v).alias("v"))))
    out = df.groupBy(key).agg(*(last(v).alias(f"last_{v}") for v in value))
    return out.select(key, *(F.col(f"last_{v}")["v"].alias(v) for v in value), *(F.col(f"last_{v}")["at"].alias(f"order_{v}") for v in value if keep_order))


def latest_artifact(artifacts: DataFrame) -> DataFrame:
    """The newest verified note of each item and target."""
    return latest(artifacts.filter("status = 'verified' and kind = 'note'"), ["target_id", "item_id"], ["created", "artifact_id"])


def spread_row_number(df: DataFrame, by: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """df with the number of each row in its group, counted bucket by bucket: rows are ordered inside a bucket only, and the counts of the buckets before are added.

    bucket is a column that rises with the order. A group of a third of all rows is as many tasks as it has buckets. Keys aren't null.
    """
    counts = df.groupBy(*by, bucket).agg(F.count("*").alias("n_"))
    before = counts.select(*by, bucket, (F.sum("n_").over(W.partitionBy(*by).orderBy(bucket)) - F.col("n_")).alias("before_"))
    own = F.row_number().over(W.partitionBy(*by, bucket).orderBy(*order))
    return df.withColumn(name, own).join(before, [*by, bucket]).withColumn(name, F.col(name) + F.col("before_")).drop("before_")


def assign_paths(plan: DataFrame, path: str = "path", key: str = "stable_key", block: int = 4096) -> DataFrame:
    """A free path for each stable key: the first key of a path keeps it, the next get -2, -3 and so on before the extension, in order of keys.

    A suffix that makes another planned path is passed over: that path's first key has it. Suffixed paths of different paths never meet, so one pass
    settles all. Taken suffixes become steps (from which key on, how many are passed over), and a key's suffix is its number and the sum of the steps before it. Keys and steps are
    summed by blocks of numbers, so no task holds a path that very many keys want; keys are hexadecimal hashes, whose first two digits deal them for the numbers themselves.
    """
    parts = r"(?s)^(.*?)(\.[^./]*)?$"
    stem, ext = F.regexp_extract(F.col(path), parts, 1), F.regexp_extract(F.col(path), parts, 2)
    keyed = plan.select(key, path).distinct().withColumn("bucket_", F.substring(key, 1, 2))
    named = spread_row_number(keyed, [path], "bucket_", [key], "nth_").select(key, path, F.col("nth_").cast("long").alias("at_"))

    suffix = F.regexp_extract(stem, r"(?s)^.*-([1-9][0-9]{0,17})$", 1)
    taken = plan.select(path).distinct().withColumn("taken_", suffix.try_cast("long")).filter("taken_ > 1")
    taken = taken.select(F.concat(F.regexp_extract(stem, r"(?s)^(.*)-[0-9]+$", 1), ext).alias(path), "taken_", F.floor(F.col("taken_") / block).alias("bucket_"))
    taken = spread_row_number(taken, [path], "bucket_", ["taken_"], "nth_")
    steps = taken.groupBy(path, (F.col("taken_") - F.col("nth_") + 1).alias("at_")).agg(F.count("*").alias("step_"))

    both = named.withColumn("step_", F.lit(0).cast("long")).unionByName(steps.withColumn(key, F.lit(None).cast(plan.schema[key].dataType)))
    both = both.withColumn("block_", F.floor(F.col("at_") / block))
    blocks = both.groupBy(path, "block_").agg(F.sum("step_").alias("sum_"))
    before = blocks.select(path, "block_", (F.sum("sum_").over(W.partitionBy(path).orderBy("block_")) - F.col("sum_")).alias("before_"))
    within = F.sum("step_").over(W.partitionBy(path, "block_").orderBy("at_").rangeBetween(W.unboundedPreceding, 0))
    placed = both.withColumn("within_", within).filter(F.col(key).isNotNull()).join(before, [path, "block_"])
    number = F.col("at_") + F.col("within_") + F.col("before_")
    return placed.select(key, path, F.when(F.col("at_") == 1, F.col(path)).otherwise(F.concat(stem, F.lit("-"), number.cast("string"), ext)).alias("free_path"))


def asset_names(assets: DataFrame, stretch: int = 10_000) -> DataFrame:
    """(note_id, sha256, file_name, name): within a note, one content keeps one name; other contents of that name get -2, -3.

    Contents are numbered by stretches of positions, so a name that one note uses very often is no hot task.
    """
    first = assets.groupBy("note_id", F.lower("file_name").alias("lower_name"), "sha256").agg(F.min(F.struct("position", "file_name")).alias("first"))
    # a struct is never null itself, so notes and names that are null are numbered too
    keyed = first.select(F.struct("note_id", "lower_name").alias("group_"), "sha256", "first", F.coalesce(F.floor(F.col("first.position") / stretch), F.lit(-(1 << 62))).alias("bucket_"))
    named = spread_row_number(keyed, ["group_"], "bucket_", ["first.position", "sha256"], "nth")
    stem, ext = F.regexp_extract("first.file_name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("first.file_name", r"^(.*?)(\.[^.]*)?$", 2)
    return named.select("group_.note_id", "sha256", F.col("first.file_name").alias("file_name"), F.when(F.col("nth") == 1, F.col("first.file_name")).otherwise(F.concat(stem, F.lit("-"), F.col("nth").cast("string"), ext)).alias("name"))


def dedup_resources(assets: DataFrame) -> DataFrame:
    """The first copy of each content of a note; it is an attachment if any copy is. An aggregate: no ordering of a note's rows is needed."""
    first = F.min(F.struct("position", "file_name", "md5", "size"))
    kept = assets.groupBy("note_id", "sha256").agg(first.alias("f"), F.bool_or("attachment").alias("attachment"), F.count("*").alias("copies"))
    return kept.select("note_id", "sha256", F.col("f.position").alias("position"), F.col("f.file_name").alias("file_name"), F.col("f.md5").alias("md5"), F.col("f.size").alias("size"), "attachment", "copies")


def next_attempt(pairs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Highest attempt number + 1 of each (job, item); 1 where there is none."""
    most = attempts.groupBy("job_id", "item_id").agg(F.max("attempt_no").alias("most"))
    return pairs.join(most, ["job_id", "item_id"], "left").select("job_id", "item_id", (F.coalesce("most", F.lit(0)) + 1).alias("next_attempt"))


def stop_point(rounds: DataFrame, source: str = "source_id", patience: int = 5, cap: int | None = None) -> DataFrame:
    """Per source, the round where a scan ends: after `patience` rounds in a row without a new key, at the item cap, or at its end.

    rounds: source, round, key. Keys collapse to their first round before anything is ordered, so windows run over rounds, not observations.
    """
    seen = rounds.groupBy(source, "round").agg(F.count("*").alias("n"))
    new = rounds.groupBy(source, "key").agg(F.min("round").alias("round")).groupBy(source, "round").agg(F.count("*").alias("new"))
    return stop_of_rounds(seen.join(new, [source, "round"], "left").withColumn("new", F.coalesce("new", F.lit(0))), source, patience, cap)


def stop_of_rounds(told: DataFrame, source: str = "source_id", patience: int = 5, cap: int | None = None) -> DataFrame:
    """stop_point of (source, round, new): a row for each round with the number of keys first seen in it."""
    by = W.partitionBy(source).orderBy("round")
    told = told.withColumn("total", F.sum("new").over(by)).withColumn("run", F.sum(F.when(F.col("new") > 0, 1).otherwise(0)).over(by))
    told = told.withColumn("idle", F.sum(F.when(F.col("new") == 0, 1).otherwise(0)).over(W.partitionBy(source, "run").orderBy("round")))
    stopped = F.when(F.col("idle") >= patience, "no_new_items")
    if cap is not None:
        stopped = F.when(F.col("total") >= cap, "item_cap").when(F.col("idle") >= patience, "no_new_items")
    told = told.withColumn("why", stopped)
    ends = told.groupBy(source).agg(F.min_by(F.struct("round", "why", "total"), F.when(F.col("why").isNotNull(), F.col("round"))).alias("hit"), F.max_by(F.struct("round", "total"), "round").alias("last"))
    return ends.select(source, F.coalesce("hit.round", "last.round").alias("stop_round"), F.coalesce("hit.why", F.lit("end_of_list")).alias("reason"), F.coalesce("hit.total", "last.total").alias("unique_items"))


def pause_cutoff(attempts: DataFrame, states: Column | None = None) -> DataFrame:
    """The first rate-limited position of a job and all later ones are interrupted; earlier ones keep their state."""
    first = F.min(F.when(F.col("http_status").isin(*RATE_LIMITED), F.col("position")))
    cut = attempts.groupBy("job_id").agg(first.alias("cut"))
    return attempts.join(cut, "job_id").withColumn("state", F.when(F.col("position") >= F.col("cut"), "interrupted").otherwise(F.col("status") if states is None else states)).drop("cut")


def prefix_length(items: DataFrame, key: str, order: list[str], ladder: tuple[int, ...]) -> DataFrame:
    """The shortest prefix on the ladder that no earlier item took; the last rung, the whole key, always fits.

    An item is earlier by order and key. It takes one rung only, so at each rung the first of those that lost the rungs before takes the prefix, and the others go on.
    """
    out = items.withColumn("length", F.lit(None).cast("long"))
    for n in ladder[:-1]:
        first = F.row_number().over(W.partitionBy(F.col("length").isNull(), F.substring(key, 1, n)).orderBy(*order, key))
        out = out.withColumn("nth_", first).withColumn("length", F.coalesce("length", F.when(F.col("nth_") == 1, F.lit(n).cast("long")))).drop("nth_")
    return out.withColumn("length", F.coalesce("length", F.lit(ladder[-1]).cast("long"))).withColumn("prefix", F.expr(f"substring({key}, 1, cast(length as int))"))


def reason_samples(attempts: DataFrame, n: int = 3) -> DataFrame:
    """The first n attempts of each reason by position."""
    rank = F.row_number().over(W.partitionBy("reason").orderBy("position"))
    return attempts.withColumn("nth", rank.cast("long")).filter(F.col("nth") <= n).select("reason", "nth", "position", "item_id")


def status_history_check(events: DataFrame, key: str = "item_id", order: tuple[str, ...] = ("ts", "position")) -> DataFrame:
    """Changes of status that aren't allowed; staying in a status is no change. The table of allowed changes is a literal of ten pairs."""
    before = F.lag("status").over(W.partitionBy(key).orderBy(*order))
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, b in JOB_TRANSITIONS))
    changed = events.withColumn("before", before).filter("before is not null and before != status")
    return changed.filter(~F.array_contains(allowed, F.concat_ws(">", "before", "status"))).select(key, "position", "before", "status")


def retry_outcome(attempts: DataFrame, key: list[str], max_tries: int = 3, backoff_ms: tuple[int, ...] = (3000, 10000)) -> DataFrame:
    """Per key: tries used, sum of base waits, last HTTP status, whether it ended well and whether another try is allowed.

    Tries are the attempts by position up to the first success, the first permanent error or the limit.
    """
    nth = F.row_number().over(W.partitionBy(*key).orderBy("position"))
    http = F.col("http_status")
    ended = F.when((http < 400) | http.isin(*PERMANENT_HTTP), F.col("nth"))
    tried = attempts.withColumn("nth", nth).filter(F.col("nth") <= max_tries)
    tried = tried.withColumn("end", F.min(ended).over(W.partitionBy(*key))).filter("end is null or nth <= end")
    waits = F.when(F.col("nth") > 1, F.element_at(F.array(*map(F.lit, backoff_ms)), (F.col("nth") - 1).cast("int"))).otherwise(0)
    out = tried.groupBy(*key).agg(F.count("*").alias("tries"), F.sum(waits).cast("long").alias("waited_ms"), F.max_by("http_status", "nth").alias("last_status"))
    last = F.col("last_status")
    return out.withColumn("ok", last < 400).withColumn("may_retry", (last >= 400) & ~last.isin(*PERMANENT_HTTP) & (F.col("tries") < max_tries))


def order_ordinals(notes: DataFrame, file: str, order: list[str], bucket: str | None = None) -> DataFrame:
    """1-based number of each note in its file. bucket: a column that rises with the order, such as the block of a large file, by which the count is dealt out."""
    if bucket is not None:
        return spread_row_number(notes, [file], bucket, order, "note_no")
    return notes.withColumn("note_no", F.row_number().over(W.partitionBy(file).orderBy(*order)).cast("long"))
