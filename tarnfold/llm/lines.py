"""Line deduplication: hashes of lines are range-partitioned, sorted by document and position, and streamed; what comes back are keep bitmaps, not text.

A line's key is the line without white space at both ends, A-Z lower-cased; keys are told apart by 128 bits. Each line is one
small row. Rows are dealt out by ranges of (hash, slice) and sorted within a range by hash, slice, document and position, so one
forward pass meets every key's first document before its others and marks the rows of the others. A window over (hash, slice)
needs no exchange of its own on such ranges.

Slices keep a hot line from being one group: keys that a sample of the documents shows to be frequent are cut by a hash of the
row. A slice's later documents are marked at once; its first document meets those of the other slices afterwards, which is one
row set for each slice. The sample moves work only: any choice of hot keys gives the same marks.

Marks become words of 64 lines, one long each; words without a mark are left out, so a bitmap's size follows the lines that go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfold.llm.common import stored

#: White space that is stripped, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of white space, A-Z lower-cased; other letters stay. Lines of ASCII alone take the quicker way to the same."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once even where body uses it within a lambda."""
    return F.transform(F.array(value), body)[0]


def _row_of(text: Column) -> Column:
    """What tells rows of one document id apart: equal texts have equal bitmaps."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(doc, row, pos, h1, h2) of every line whose key is long enough to count."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    each = docs.select(F.col(f"`{id_col}`").alias("doc"), _row_of(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = each.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    return keyed.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


def _hot(docs: DataFrame, id_col: str, text_col: str, least_chars: int, share: int, rows_a_slice: int, most: int) -> DataFrame:
    """(h1, h2, slices) of keys that fill more than one slice, as far as one document in `share` shows; `most` keys at the most by their size."""
    counts = stored(_lines(docs.sample(1 / share, seed=11), id_col, text_col, least_chars).groupBy("h1", "h2").agg(F.count("*").alias("n")), "line-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    part = max(rows_a_slice, share * total // most)
    return counts.filter(F.col("n") * share > part).select("h1", "h2", F.ceil(F.col("n") * share / part).cast("int").alias("slices"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, share: int = 64, rows_a_slice: int = 2048, most: int = 20_000) -> DataFrame:
    """(doc, row, n_dropped, keep) for every document that loses a line, as a stored table.

    keep: structs (word, bits), ascending; bit i of bits tells whether line 64 * word + i stays. All lines of absent words stay.
    doc is the document's id and row a hash of its text: rows of one id with equal texts share a bitmap, rows of one id are one
    document. A null id is one document after all others; null text is one empty line; no documents give no rows.
    """
    lines = _lines(docs, id_col, text_col, least_chars)
    hot = _hot(docs, id_col, text_col, least_chars, share, rows_a_slice, most)
    cut = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("slice", F.when(F.col("slices").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("doc", "row", "pos"), F.col("slices")).cast("int")))
    ranges = cut.drop("slices").repartitionByRange("h1", "h2", "slice")
    streamed = W.partitionBy("h1", "h2", "slice").orderBy(F.col("doc").asc_nulls_last(), "row", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = ranges.withColumn("first", F.first("doc").over(streamed)).withColumn("later", ~F.col("doc").eqNullSafe(F.col("first")))
    key = lambda name: F.when(~F.col("later"), F.col(name)).alias(name)
    marks = stored(seen.filter(F.col("later") | (F.col("slice") > 0)).select("doc", "row", "pos", "later", key("h1"), key("h2")), "line-marks")

    heads = marks.filter(~F.col("later"))
    least = heads.groupBy("h1", "h2").agg(F.min("doc").alias("least"))  # a row for each hot key: at most `most` and a few
    behind = heads.join(F.broadcast(least), ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("least")))
    gone = marks.filter("later").select("doc", "row", "pos").unionByName(behind.select("doc", "row", "pos"))

    bits = gone.groupBy("doc", "row", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    maps = bits.groupBy("doc", "row").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"))
    return stored(maps, "line-bitmaps")


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of text that keep lets stay, joined by \\n; the text as it is where keep is null. Work is linear in the lines."""
    gap = lambda x, i: F.array_repeat(F.lit(-1).cast("long"), x["word"] - F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1)) - 1)
    dense = F.flatten(F.transform(keep, lambda x, i: F.concat(gap(x, i), F.array(x["bits"]))))
    stays = lambda words, i: F.coalesce(F.getbit(F.get(words, (i / 64).cast("int")), i % 64) == 1, F.lit(True))
    return F.when(keep.isNull(), text).otherwise(_let(dense, lambda words: F.array_join(F.filter(F.split(text, "\n"), lambda _, i: stays(words, i)), "\n")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
    """Every row of docs with all its columns, and (lines before dropping, lines dropped, text that stays) under the names in out, which replace columns of these names.

    Bitmaps that outgrow Spark's broadcast threshold make texts shuffle once.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    left = docs.select(F.struct("*").alias("whole"), F.col(f"`{id_col}`").alias("of"), _row_of(text).alias("at"), text.alias("said"))
    both = left.join(bitmaps, left["of"].eqNullSafe(bitmaps["doc"]) & (left["at"] == bitmaps["row"]), "left")
    n_lines = F.char_length("said") - F.char_length(F.replace("said", F.lit("\n"), F.lit(""))) + 1
    found = (n_lines.cast("long"), F.coalesce(bitmaps["n_dropped"], F.lit(0)).cast("long"), kept_text(F.col("said"), bitmaps["keep"]))
    return both.select(*(F.col("whole")[c].alias(c) for c in docs.columns if c not in out), *(c.alias(n) for c, n in zip(found, out, strict=True)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10) -> DataFrame:
    """Every row of docs with all its columns and n_lines, n_dropped, kept: keys of least_chars code points or more that two documents hold stay in the smallest id alone. Edge cases as in keep_bitmaps."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, least_chars), id_col, text_col)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


LINES_SQL = """
with lines as (
  select doc_id, p.pos, p.line, translate(trim(p.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'pos': i, 'line': x})) as p from documents)
), firsts as (select key, min(doc_id) as least from lines where length(key) >= 10 group by key)
, told as (select lines.*, coalesce(doc_id > least, false) as gone from lines left join firsts using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from told group by doc_id
"""
