"""Preference formatting: the longest common turn prefix once as prompt, then paired completions with loss masks. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import salted_join, stored


def escaped(text: Column) -> Column:
    """The text with no control string of the format in it; `<\\\\` and `<\\|` are read back as `<\\` and `<|`."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), escaped(role), F.lit("|>\n"))


def body(text: Column) -> Column:
    return F.concat(escaped(text), F.lit("<|end|>\n"))


def _sides(chosen: DataFrame, rejected: DataFrame, pair_col: str, turns_a_row: int) -> DataFrame:
    """(pair_id, part, turn, side, role, text, digest) of both sides; digest tells contents apart and orders repeated turns."""
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))

    def one(turns: DataFrame, side: str) -> DataFrame:
        rows = turns.filter(F.col(pair_col).isNotNull() & F.col("turn").isNotNull()).select(F.col(pair_col).alias("pair_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
        return rows.select("pair_id", F.floor(F.col("turn") / turns_a_row).alias("part"), "turn", F.lit(side).alias("side"), "role", "text", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("digest"))

    return one(chosen, "c").unionByName(one(rejected, "r"))


def boundaries(sides: DataFrame) -> DataFrame:
    """(pair_id, part, first) for each part of a pair: the first turn that differs or is missing on a side, null where none does. Moves digests only, no texts."""
    least = lambda side: F.min(F.when(F.col("side") == side, F.col("digest")))
    turns = sides.select("pair_id", "part", "turn", "side", "digest").groupBy("pair_id", "part", "turn").agg(least("c").alias("c"), least("r").alias("r"))
    parts = stored(turns.groupBy("pair_id", "part").agg(F.min(F.when(~F.coalesce(F.col("c") == F.col("r"), F.lit(False)), F.col("turn"))).alias("own")), "parts")
    first = parts.groupBy("pair_id").agg(F.min("own").alias("first"), F.count("*").alias("n"))
    return salted_join(parts, first, ["pair_id"], F.col("part"), parts.count()).select("pair_id", "part", "first")


def preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", trained: str = "assistant", turns_a_row: int = 64) -> DataFrame:
    """Rows (pair_id, part, n_prompt, prompt, chosen, chosen_trained, rejected, rejected_trained): a pair's prompt, rendered once, and its two completions.

    Both tables have pair, turn, role, text. Turns before the first one that differs or is missing on a side are the prompt; from there
    on each side's turns are its completion. *_trained are the spans start:end of the completion, comma-joined and in code points,
    where the loss counts: bodies and end marks of turns of the `trained` role; all else is masked. Control strings inside texts and roles are escaped.
    n_prompt is the number of turns in prompt. A pair of up to turns_a_row turns is one row, of part 0. A longer one has a row for each turns_a_row turns, in order of
    part, and joined they make up its prompt and completions, so no task gathers a long conversation; spans count from the row's start.

    Rows without pair or turn are left out; a null role is user, a null text empty; of rows with one pair, turn and side the one
    with the least digest counts; a pair on one side only has no prompt; empty tables give no rows.
    """
    sides = _sides(chosen, rejected, pair_col, turns_a_row)
    told = sides.repartition("pair_id", "part").join(boundaries(sides), ["pair_id", "part"])
    said = lambda side: F.min(F.when(F.col("side") == side, F.struct("digest", "role", "text"))).alias(side)
    turns = told.groupBy("pair_id", "part", "turn").agg(F.min("first").alias("first"), said("c"), said("r"))
    shared = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    held = turns.groupBy("pair_id", "part").agg(
        F.collect_list(F.when(shared, F.struct("turn", F.col("c.role"), F.col("c.text")))).alias("p"),
        *(F.collect_list(F.when(~shared & F.col(s).isNotNull(), F.struct("turn", F.col(f"{s}.role"), F.col(f"{s}.text")))).alias(s) for s in ("c", "r")),
    )
    joined = lambda turns: F.array_join(F.transform(F.array_sort(turns), lambda x: F.concat(header(x["role"]), body(x["text"]))), "")

    def spans(turns: Column) -> Column:
        upto = lambda a, x: a["at"] + F.length(header(x["role"])) + F.length(body(x["text"]))
        span = lambda a, x: F.concat_ws(":", a["at"] + F.length(header(x["role"])), upto(a, x))
        step = lambda a, x: F.struct(upto(a, x).alias("at"), F.when(x["role"] == trained, F.array_append(a["spans"], span(a, x))).otherwise(a["spans"]).alias("spans"))
        return F.array_join(F.aggregate(F.array_sort(turns), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")), step)["spans"], ",")

    return held.select(
        "pair_id", "part", F.size("p").cast("long").alias("n_prompt"), joined(F.col("p")).alias("prompt"),
        joined(F.col("c")).alias("chosen"), spans(F.col("c")).alias("chosen_trained"), joined(F.col("r")).alias("rejected"), spans(F.col("r")).alias("rejected_trained"),
    )


def branches(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs out of plain conversations: chosen is a conversation; rejected has its first half of turns, rounded up, and then those of the next larger id by one, where there is such a conversation.

    Rows without id or turn are left out; an empty table gives no pairs.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text").filter("pair_id is not null and turn is not null")
    half = stored(turns.groupBy("pair_id").agg(F.ceil((F.max("turn") + 1) / 2).alias("half"), F.count("*").alias("n")), "halves")
    total = half.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    other = half.alias("own").join(half.select(F.col("pair_id").alias("after"), F.col("n").alias("n_after")), F.col("pair_id") + 1 == F.col("after")).select("pair_id", "half", F.col("n_after").alias("n"))
    own = salted_join(turns, half, ["pair_id"], F.col("turn"), total).filter("turn < half")
    after = salted_join(turns.withColumn("pair_id", F.col("pair_id") - 1), other, ["pair_id"], F.col("turn"), total).filter("turn >= half")
    return turns, own.unionByName(after).drop("half")


def _sql() -> str:
    safe = lambda x: rf"replace(replace({x}, '<\', '<\\'), '<|', '<\|')"
    head, rest = f"'<|' || {safe('role')} || '|>' || chr(10)", f"{safe('text')} || '<|end|>' || chr(10)"
    side = lambda s: f"coalesce(string_agg(head || rest, '' ORDER BY turn) FILTER (side = '{s}'), '')"
    spans = lambda s: f"coalesce(string_agg((upto - length(rest)) || ':' || upto, ',' ORDER BY turn) FILTER (side = '{s}' AND role = 'assistant'), '')"
    return f"""
WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
h AS (SELECT pair_id, ceil((max(turn) + 1) / 2) AS half FROM t GROUP BY pair_id),
x AS (SELECT 'c' AS side, * FROM t UNION ALL SELECT 'r', t.* FROM t JOIN h USING (pair_id) WHERE turn < half
    UNION ALL SELECT 'r', t.pair_id - 1, turn, role, text FROM t JOIN h ON t.pair_id - 1 = h.pair_id WHERE turn >= half),
d AS (SELECT side, pair_id, turn, role, text FROM x QUALIFY row_number() OVER (PARTITION BY side, pair_id, turn ORDER BY sha256(length(role) || ':' || role || text)) = 1),
b AS (SELECT c.pair_id, c.turn FROM d c JOIN d r ON c.pair_id = r.pair_id AND c.turn = r.turn AND c.role = r.role AND c.text = r.text WHERE c.side = 'c' AND r.side = 'r'),
f AS (SELECT pair_id, min(turn) AS first FROM d ANTI JOIN b USING (pair_id, turn) GROUP BY pair_id),
s AS (SELECT CASE WHEN first IS NOT NULL AND turn >= first THEN side WHEN side = 'c' THEN 'p' END AS side, d.pair_id, turn, turn // 64 AS part, role, {head} AS head, {rest} AS rest FROM d LEFT JOIN f USING (pair_id)),
u AS (SELECT *, sum(length(head) + length(rest)) OVER (PARTITION BY pair_id, part, side ORDER BY turn)::BIGINT AS upto FROM s WHERE side IS NOT NULL)
SELECT pair_id, part, count(*) FILTER (side = 'p') AS n_prompt, {side('p')} AS prompt, {side('c')} AS chosen, {spans('c')} AS chosen_trained, {side('r')} AS rejected, {spans('r')} AS rejected_trained FROM u GROUP BY pair_id, part
"""


CHAT_SQL = _sql()
