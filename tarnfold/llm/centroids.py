"""Centroid clustering in integers by scalar lookup tables.

Components become integers once. Vectors are stored in blocks of a few thousand, in which every dimension is a list of its
occurring values and a code for each vector. A round tabulates, for every dimension, occurring value and centroid, the squared
difference; a vector's distances are then gathered from these tables by its codes and summed, and so are the sums of the new
centroids: the number of a cluster's vectors with each code, times the value. A block's tables are bounded by its rows, so no
list of values is gathered anywhere; the driver sees `clusters` rows of sums a round.

All arithmetic is exact. Blocks whose values could pass 64 bits are reckoned in Python's integers, and sums travel in limbs of
32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import stored

#: Up to this size of values and centroids, squares over 64 dimensions stay below 2 ** 63.
_PLAIN = 1 << 27
_BLOCK = "ids binary, no_id binary, sizes binary, levels binary, codes binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    """(vec_id, v) of vectors with exactly `dimension` components, none null or non-finite, in double precision."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == dimension) & fine)


def whole(level: float, scale: int) -> int:
    """floor(scale * level), exactly."""
    return (Fraction(level) * scale).__floor__()


def _blocks(vectors: DataFrame, dimension: int, scale: int, rows: int) -> DataFrame:
    """The vectors in blocks: ids, and for each dimension its occurring values (as doubles times 1 / scale, floored to a whole) and a code for each vector."""

    def block(ids: pa.Array, v: np.ndarray) -> dict:
        v = np.where(np.abs(v) < 2.0**53, np.floor(v * scale) / scale, v)  # beyond, a double is whole already, and scale is a power of two
        parts = [np.unique(column, return_inverse=True) for column in v.T]
        known = np.asarray(ids.fill_null(0), np.int64)
        return {
            "ids": known.tobytes(), "no_id": np.asarray(ids.is_null()).tobytes(), "sizes": np.array([len(u) for u, _ in parts], np.int32).tobytes(),
            "levels": np.concatenate([u for u, _ in parts]).tobytes(), "codes": np.stack([c for _, c in parts]).astype(np.uint16).tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                held.append(batch.slice(at, rows))
                n += held[-1].num_rows
                if n >= rows:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        v = table.column("v").chunk(0)
        out = block(table.column("vec_id").chunk(0), np.asarray(v.flatten()).reshape(len(v), dimension))
        return pa.RecordBatch.from_pydict({k: pa.array([x], pa.binary()) for k, x in out.items()})

    return vectors.mapInArrow(run, _BLOCK)


def _read(row: dict, scale: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(ids, which ids are null, whole values of each dimension, codes of each dimension) of a stored block."""
    ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int32)
    levels = np.frombuffer(row["levels"], np.float64)
    values = (levels * scale).astype(np.int64) if np.abs(levels).max(initial=0) * scale <= _PLAIN else np.array([whole(x, scale) for x in levels.tolist()], object)
    return ids, np.frombuffer(row["no_id"], np.bool_), np.split(values, np.cumsum(sizes)[:-1]), np.frombuffer(row["codes"], np.uint16).reshape(len(sizes), len(ids))


def tables(values: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """For each dimension the squared differences of its occurring values (rows) to each centroid (columns); at: centroids in rows."""
    return [np.subtract.outer(v, c) ** 2 for v, c in zip(values, at.T, strict=True)]


def assign(values: list[np.ndarray], codes: np.ndarray, at: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance to it) of every vector of a block; ties to the smaller number."""
    plain = values[0].dtype != object and all(abs(x) <= _PLAIN for c in at for x in c)
    at = np.array(at, np.int64 if plain else object)
    if not plain:
        values = [v.astype(object) for v in values]
    far = np.zeros((codes.shape[1], len(at)), at.dtype)
    for table, code in zip(tables(values, at), codes, strict=True):
        far += table[code]
    own = far.argmin(axis=1)
    return own, far[np.arange(len(own)), own]


def limbs(x: int) -> list[int]:
    """x in base 2 ** 32, lowest first; the last limb carries the sign."""
    out = []
    while not -(1 << 31) <= x < 1 << 31:
        out.append(x & 0xFFFFFFFF)
        x >>= 32
    return [*out, x]


def _moved(blocks: DataFrame, at: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one round: componentwise floor of the mean of their vectors; empty ones stay."""
    dimension = len(at[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(at), dimension), object)
        n = np.zeros(len(at), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, _, values, codes = _read(row, scale)
                own, _ = assign(values, codes, at)
                n += np.bincount(own, minlength=len(at))
                for d, (v, code) in enumerate(zip(values, codes, strict=True)):
                    met = np.bincount(own * len(v) + code, minlength=len(at) * len(v)).reshape(len(at), len(v))
                    sums[:, d] += met.astype(v.dtype) @ v
        told = [(c, d, i, limb) for c in np.flatnonzero(n).tolist() for d in range(dimension) for i, limb in enumerate(limbs(int(sums[c, d])))] + [(c, -1, 0, k) for c, k in enumerate(n.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*told, strict=True)], ["c", "d", "i", "total"])

    totals = blocks.mapInArrow(run, "c long, d long, i long, total long").groupBy("c", "d", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # clusters times dimensions
    n, sums = [0] * len(at), [[0] * dimension for _ in at]
    for r in totals:
        if r["d"] < 0:
            n[r["c"]] = int(r["total"])
        else:
            sums[r["c"]][r["d"]] += int(r["total"]) << 32 * r["i"]
    return [[s // k for s in total] if k else c for c, total, k in zip(at, sums, n, strict=True)]


def _first(vectors: DataFrame, clusters: int, scale: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of `seed:vec_id`, as whole numbers; ties by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(order, "v").limit(clusters).collect()
    return [[whole(x, scale) for x in r["v"]] for r in rows]


def _long(x: Column) -> Column:
    """x as a long, null beyond 64 bits."""
    return x.try_cast("long")


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", rows_a_block: int = 4096) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every usable vector, as a stored table, and the final centroids.

    scale is a power of two. Centroids start as the `clusters` vectors with the smallest sha256 of `seed:vec_id` (all, if fewer; a null
    id counts as empty); each round moves non-empty ones to the floor of their vectors' mean. Repeated rows are vectors of
    their own; a distance beyond 64 bits is null; no usable vectors give no rows. Columns other than the two named take no part.
    """
    rows = usable(vectors, id_col, vector_col, dimension)
    blocks = stored(_blocks(rows, dimension, scale, min(rows_a_block, 1 << 16)), "vector-blocks")
    at = _first(rows, clusters, scale, seed)
    for _ in range(rounds if at else 0):
        at = _moved(blocks, at, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, no_id, values, codes = _read(row, scale)
                own, far = assign(values, codes, at)
                far = [x if x < 1 << 63 else None for x in far.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=no_id), pa.array(own.astype(np.int32)), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return stored(blocks.mapInArrow(run, "vec_id long, cluster int, distance long"), "vector-clusters"), at


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector; a sum beyond 64 bits or over a distance beyond them is null."""
    rows, at = cluster(vectors, **options)
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    own = {r["cluster"]: r["own"] for r in rows.groupBy("cluster").agg(total.alias("own")).collect()}  # a row for each cluster
    overall = None if None in own.values() else sum(own.values())
    told = [(c, own[c], overall, sha256(",".join(map(str, at[c])).encode()).hexdigest()) for c in own]
    small = vectors.sparkSession.createDataFrame(told, "cluster int, own decimal(38,0), all decimal(38,0), centroid_sha256 string")
    return rows.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", _long(F.col("own")).alias("cluster_inertia"), _long(F.col("all")).alias("inertia"), "centroid_sha256")


def cluster_sql(clusters: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in SQL, one pair of steps a round."""
    steps = [f"""with kept as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = {dimension} and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), q as materialized (select vec_id, unnest(v) as x, unnest(range({dimension})) as d from kept)
, c0 as materialized (
  select c, unnest(v) as x, unnest(range({dimension})) as d
  from (select v, row_number() over (order by sha256('{seed}:' || cast(vec_id as varchar))) - 1 as c from kept qualify c < {clusters}))"""]
    for r in range(rounds + 1):
        steps.append(f""", far{r} as materialized (select vec_id, c, sum((q.x - k.x) * (q.x - k.x)) as far from q join c{r} k using (d) group by vec_id, c)
, own{r} as materialized (select vec_id, c, far from far{r} qualify row_number() over (partition by vec_id order by far, c) = 1)""")
        if r < rounds:
            steps.append(f""", m{r} as (select c, d, sum(x) as s, count(*) as n from own{r} join q using (vec_id) group by c, d)
, c{r + 1} as materialized (
  select c, d, cast(coalesce(case when s % n < 0 then (s - s % n) // n - 1 else (s - s % n) // n end, k.x) as bigint) as x from c{r} k left join m{r} using (c, d))""")
    steps.append(f"""select vec_id, cast(c as integer) as cluster, cast(far as bigint) as distance, cast(sum(far) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(far) over () as bigint) as inertia, h as centroid_sha256
from own{rounds} join (select c, sha256(string_agg(cast(x as varchar), ',' order by d)) as h from c{rounds} group by c) using (c)""")
    return "\n".join(steps)
