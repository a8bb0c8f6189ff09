"""SpotSigs fingerprints: chains of content words behind common-word anchors, compared by Jaccard likeness of their sets.

SQL functions only. Anchors cut the text into runs of content words; each run with words begins a chain of the next three
content words, over further anchors where the run is short. A long run begins a further chain every six words, so that no stretch of a text is
left out where anchors are rare. A text without any anchor begins a chain at every word.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "the a an of to and in is that it was for on are as with his they at be this from have or by "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de du et un une est en que qui dans pour pas au sur par "
    "el los las y con por no su para es al lo como"
).split()
CHAIN = 3
#: Words of a run that one chain stands for.
STRETCH = 6
_CUT = "\u0001"
_SPACES = r"[^\p{L}\p{N}]+"
_ANCHOR = f" (?:{'|'.join(dict.fromkeys(ANCHORS))}) "
_STRETCH = f"[^ ]+(?: [^ ]+){{0,{STRETCH - 1}}}"
_RUN = f" *{_CUT}[ {_CUT}]*"


def _runs(text: Column) -> Column:
    """The text's runs of content words, long ones in stretches; its words where it has no anchor."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _SPACES, " "), " ")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(*ANCHORS), F.lit(_CUT)).otherwise(w)), " ")
    parted = F.split(F.when(F.instr(marked, _CUT) > 0, marked).otherwise(F.replace(marked, F.lit(" "), F.lit(_CUT))), _CUT, -1)
    return F.flatten(F.transform(parted, lambda r: F.regexp_extract_all(r, F.lit(_STRETCH), F.lit(0))))


def with_chains(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df and the sorted set of chains of a text as an array of strings. A null text counts as empty; a text without words has no chains."""
    heads = F.transform(_runs(text), lambda r: F.substring_index(r, " ", CHAIN))
    chain = lambda r, i: F.substring_index(F.concat_ws(" ", r, *(F.get(F.col("heads_"), i + k) for k in range(1, CHAIN))), " ", CHAIN)
    out = df.withColumn("heads_", heads)
    return out.withColumn(name, F.sort_array(F.array_distinct(F.transform("heads_", chain)))).drop("heads_")


def fingerprint(chains: Column) -> Column:
    return F.sha2(F.array_join(chains, "\n"), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets; two empty ones are alike. Sets with nothing in common are told from equal ones without a union."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def spotsigs_pairs(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of all distinct sets with likeness of at least `least`; sets: (set_id, sig), sig an array of long, one row a set.

    Sets are partitioned by length: ranges grow by 1 / least, so a set meets its own range and the next one. Within them,
    two sets that are near share one of the rarest signatures of each (those beyond the first n - ceil(least n) + 1 in order
    of frequency can't be all that they share), and a pair is met once, at the first they share. Lengths outside the bound and then the
    exact likeness decide. Empty sets have no pairs. Frequency order keeps common signatures out of the index.
    """
    sized = sets.withColumn("n", F.size("sig")).filter("n > 0")
    flat = sized.select("set_id", "n", F.explode("sig").alias("s"))
    counts = flat.groupBy("s").agg(F.count("*").alias("f"))
    ranked = flat.join(counts, "s").withColumn("r", F.row_number().over(W.partitionBy("set_id").orderBy("f", "s")))
    head = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / least)).cast("int")
    head = head.select("set_id", "n", "s", band.alias("band"))
    left = head.select(F.col("set_id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    right = head.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), "s", "band")
    met = left.join(right, ["s", "band"]).filter((F.col("nb") >= F.col("na")) & (F.col("nb") * least <= F.col("na")) & ((F.col("nb") > F.col("na")) | (F.col("a") < F.col("b"))))
    met = met.select("a", "b").distinct()
    sig = lambda side: sets.select(F.col("set_id").alias(side), F.col("sig").alias(f"sig_{side}"))
    told = met.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", likeness(F.col("sig_a"), F.col("sig_b")).alias("likeness"))
    return told.filter(F.col("likeness") >= least)


def _cuts(ids: DataFrame, share: int) -> list[int]:
    """The first ids of about `share` ranges of like size, ascending. Spark samples the ranges; each range's least id is exact. One long for each range."""
    ranges = ids.filter("doc_id is not null").repartitionByRange(share, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in ranges.select("first").collect())


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_a_bucket: int | None = None) -> DataFrame:
    """(doc_id, text, next_text, ghost): each row with the text that follows in order of id; null ids come last, among them by hash of the text; ties go by text.

    Ids are cut into ranges of about rows_a_bucket rows (of 4,000 to 100,000, by the number of rows, if not given), rows without id into ranges of their texts' hashes, and each
    range is ordered by itself. The first rows of a range also stand, as ghosts, at the end of the range before it (of the first range: the last), so
    ranges need no more of each other. A row's range comes from a binary search; the table of ranges has a row for each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, n_null = docs.agg(F.count("*"), F.count_if(F.col(id_col).isNull())).first()
    each = rows_a_bucket or min(100_000, max(4000, n // 1000))
    share = lambda n: max(1, -(-n // each))
    cuts = _cuts(docs.select(F.col(id_col).cast("long").alias("doc_id")), share(n - n_null)) if n > n_null else []
    splits = sorted({float(c) for c in cuts[1:]})
    if splits:  # by double precision: ids that it can't tell apart are in one range
        found = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="id_", outputCol="range_", handleInvalid="keep").transform(rows.withColumn("id_", F.col("doc_id").cast("double"))).drop("id_")
    else:
        found = rows.withColumn("range_", F.lit(0.0))
    last = len(splits) + 1
    tail = F.floor((F.shiftright(hashed(), 32) + F.lit(1 << 31)) * F.lit(float(share(n_null))) / F.lit(float(1 << 32)))
    rows = found.withColumn("bucket", F.when(F.col("doc_id").isNull(), last + tail).otherwise(F.col("range_")).cast("long")).drop("range_")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", hashed().alias("h")))
    thin = rows.groupBy("bucket").agg(first.alias("first")).select("bucket", "first.doc_id", "first.h").orderBy("bucket").collect()  # a row for each range
    table = spark.createDataFrame([(r["bucket"], r["doc_id"], r["h"], thin[i - 1]["bucket"]) for i, r in enumerate(thin)], "bucket long, first long, first_h long, before long")
    rows = rows.join(F.broadcast(table) if len(thin) <= 1_000_000 else table, "bucket")
    # every row with a range's first id goes along: ties of that id are ordered where they arrive
    heads = F.when(F.col("doc_id").isNull(), F.col("first").isNull() & (hashed() == F.col("first_h"))).otherwise(F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False)))
    to = lambda ghost, bucket: F.struct(F.lit(ghost).alias("ghost"), F.col(bucket).alias("b"))
    twice = F.when(heads, F.array(to(False, "bucket"), to(True, "before"))).otherwise(F.array(to(False, "bucket")))
    dealt = rows.withColumn("to", F.explode(twice)).select("doc_id", "text", F.col("to.ghost").alias("ghost"), F.col("to.b").alias("bucket"))
    return dealt.withColumn("next_text", F.lead("text").over(_order()))


def hashed() -> Column:
    return F.xxhash64("text")


def _order():
    return W.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_last(), F.when(F.col("doc_id").isNull(), hashed()), "text")


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's,
    in order of id, null ids last and among themselves by XXH64 of the text, ties by text; after the last comes the first, and a table of one row follows itself. A null text counts as empty. A fingerprint
    is the SHA-256 of the sorted chains. Repeated rows keep a row each; an empty table gives none; other columns are ignored.
    """
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")
    own = with_next(docs, id_col, text_col).withColumn("n_chars", n_chars.cast("long"))
    own = with_chains(own, F.col("text"), "own").withColumn("next", F.lead("own").over(_order())).filter("not ghost")
    own = own.withColumn("edited", F.concat(F.substring("text", F.lit(1), n_chars - half), F.substring("next_text", F.lit(1), half)))
    out = with_chains(own.select("doc_id", "n_chars", "own", "next", "edited"), F.col("edited"), "changed")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def _sql() -> str:
    def chains(text: str) -> str:
        words = rf"'  ' || replace(regexp_replace(lower({text}), '{_SPACES}', ' ', 'g'), ' ', '  ') || '  '"
        cut, run = "chr(1)", r" *\x01[ \x01]*"
        marked = f"regexp_replace(regexp_replace({words}, '{_ANCHOR}', {cut}, 'g'), '{run}', {cut}, 'g')"
        plain = f"trim(replace({marked}, '  ', ' '), ' ')"
        parted = f"string_split(CASE WHEN contains({plain}, {cut}) THEN {plain} ELSE replace({plain}, ' ', {cut}) END, {cut})"
        return f"flatten(list_transform({parted}, lambda r: regexp_extract_all(r, '{_STRETCH}')))"

    chain = lambda runs: f"list_sort(list_distinct(list_transform(range(1, len({runs}) + 1), lambda i: array_to_string(list_slice(string_split(array_to_string({runs}[i:i + {CHAIN - 1}], ' '), ' '), 1, {CHAIN}), ' '))))"
    near = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id NULLS LAST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, length(text) AS n_chars, substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited FROM n),
r AS (SELECT doc_id, n_chars, edited, {chains("text")} AS r0, {chains("edited")} AS r1, {chains("next_text")} AS r2 FROM e),
c AS (SELECT doc_id, n_chars, edited, {chain("r0")} AS own, {chain("r1")} AS changed, {chain("r2")} AS next FROM r)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(own, chr(10))) AS fingerprint, sha256(array_to_string(changed, chr(10))) AS edited_fingerprint,
    {near("own", "changed")} AS near_edited, {near("own", "next")} AS near_next FROM c
"""


SPOTSIGS_SQL = _sql()
