"""Best-fit-decreasing packing of token sequences, planned on the histogram of lengths.

Pieces of one length are alike to best-fit decreasing, so the whole corpus is planned from at most `capacity` counts,
whatever its size: pieces by falling length, each into the tightest open bin, which a segment tree over remaining
capacities finds in logarithmic time. Bins of equal remaining room are kept as runs of bin numbers, and a plan row
places a run of equal pieces at once. Each piece then finds its place from its rank among the pieces of its length;
ranks come from counts per (length, bucket) and a row number inside a bucket, so a frequent length is no hot group.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfold.llm.common import map_columns, stored
from tarnfold.llm.tokens import library, word_encoder


class RoomTree:
    """A segment tree over remaining capacities 0..capacity; a leaf tells whether an open bin has exactly that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, there: bool) -> None:
        i = room + self.size
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least room of at least need."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan_bins(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces a bin, offset) that place all pieces as best-fit decreasing does, one piece after another.

    Piece number x of a length stands in bin `first bin + (x - first rank) // pieces` at `offset + (x - first rank) % pieces * length`.
    At most three runs begin for each length and a run's room at least halves when it is filled further, so there are O(capacity log capacity) rows.
    """
    tree, rooms, rows, bins = RoomTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                each = room // length
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and 0 < left < each:
                rows.append((length, rank, first + whole, left, capacity - room))
                put(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(room, first + whole, n - whole)
    return np.array(rows, np.int64).reshape(-1, 5)


def id_bytes(json_path: str) -> int:
    """Bytes that hold any id of the vocabulary: two or four."""
    return 2 if library(json_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def token_pieces(docs: DataFrame, json_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's ids, then end_id, cut from its end into pieces of `capacity` tokens; the first piece may be shorter. with_ids: and the ids themselves, little-endian, of id_bytes each; and part and own, the piece's task and its number among those of its length there."""
    kind, numbers = f"<u{id_bytes(json_path)}", _Numbers()

    def run(rows: dict) -> dict:
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, found in zip(rows[id_col], word_encoder(json_path)(rows[text_col]), strict=True):
            ids = np.append(found, np.array([end_id], "<u4"))
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for name, value in (("doc_id", doc), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(ids[a:b].tobytes())), ("ids", ids[a:b].astype(kind).tobytes() if with_ids else None)):
                    out[name].append(value)
        kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
        columns = {k: pa.array(out[k], v) for k, v in kinds.items()}
        if with_ids:
            columns["part"], columns["own"] = map(pa.array, numbers(np.array(out["length"], np.int64), capacity))
        return columns

    return map_columns(docs, [id_col, text_col], "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary, part int, own long" * with_ids, run)


def pack(pieces: DataFrame, capacity: int, rows_a_bucket: int = 100_000) -> DataFrame:
    """pieces with two more columns, sequence_id and offset. pieces: a stored table with doc_id, piece, start, length and any others.

    Lengths are 1 to capacity. Repeated rows are pieces of their own. The result is the same on each run, but for which of wholly equal rows stands where.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_bins(histogram, capacity)
    buckets = max(64, sum(histogram.values()) // rows_a_bucket)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("bucket", "own", "before")
    names = [f.name for f in pieces.schema.fields]
    return _placed(ranked.select(*names, "rank"), plan, names)


def _placed(ranked: DataFrame, plan: np.ndarray, names: list[str]) -> DataFrame:
    """The named columns of ranked, sequence_id and offset: where the plan puts the piece of a length and rank. The plan's rows, of which a length has few, are joined by broadcast, so ids don't go to Python again."""
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    last = np.append(plan[1:, 0] != plan[:-1, 0], True)[: len(plan)]
    upto = np.where(last, np.iinfo(np.int64).max, np.roll(plan[:, 1], -1))
    rows = ranked.sparkSession.createDataFrame(np.column_stack([plan, upto]).tolist(), "length_ long, first_ long, bin_ long, each_ long, room_ long, upto_ long")
    met = ranked.join(F.broadcast(rows), F.expr("length = length_ AND rank >= first_ AND rank < upto_"))
    return met.select(*names, F.expr("bin_ + (rank - first_) div each_").alias("sequence_id"), F.expr("room_ + (rank - first_) % each_ * length").alias("offset"))


class _Numbers:
    """part, the task, and own, how many pieces of the same length came before in it, for the pieces of one task after the other."""

    def __init__(self):
        self.task, self.seen = None, None

    def __call__(self, length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
        from pyspark import TaskContext

        task = TaskContext.get()
        if self.task != task.taskAttemptId():
            self.task, self.seen = task.taskAttemptId(), np.zeros(capacity + 1, np.int64)
        order = np.argsort(length, kind="stable")
        ranked = length[order]
        own = np.empty(len(length), np.int64)
        own[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked) + self.seen[ranked]
        self.seen += np.bincount(length, minlength=capacity + 1)
        return np.full(len(length), task.partitionId(), np.int32), own


def pack_with_ids(pieces: DataFrame, capacity: int, numbers: int = 1 << 22) -> DataFrame:
    """pieces of token_pieces with sequence_id and offset. A piece is numbered among those of its length in the task that makes it and stored with that number, so
    its ids needn't move: what a task's numbers begin at for each length is broadcast as one map a task while these hold at most so many `numbers` (capacity times tasks), and joined by (task, length) beyond.
    """
    names = [c for c in pieces.columns if c not in ("part", "own")]
    held = stored(pieces, "pieces")  # numbers stay as they are once written
    counts = stored(held.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    plan = plan_bins({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # at most `capacity` rows
    before = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    if counts.count() <= numbers:
        begins = F.map_from_entries(F.collect_list(F.struct(F.col("length").cast("int"), "before"))).alias("begins")
        ranked = held.join(F.broadcast(stored(before.groupBy("part").agg(begins), "before")), "part").withColumn("before", F.col("begins")[F.col("length").cast("int")])
    else:
        ranked = held.join(stored(before, "before"), ["length", "part"])
    return _placed(ranked.select(*names, (F.col("own") + F.col("before")).alias("rank")), plan, names)


def pack_documents(docs: DataFrame, json_path: str, capacity: int = 2048, with_ids: bool = False, **columns) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]. With ids, which of the pieces of one length stands where follows the tasks that made them.

    A null or empty text is its end token alone. Repeated rows are packed as often as they come; an empty table gives no rows; other columns are ignored.
    """
    pieces = token_pieces(docs, json_path, capacity, with_ids=with_ids, **columns)
    return pack_with_ids(pieces, capacity) if with_ids else pack(stored(pieces, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, little-endian, of id_bytes each, pieces joined in order of offset; a sequence holds at most `capacity` tokens. Needs with_ids."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return held.select("sequence_id", F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
