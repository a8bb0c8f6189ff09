"""Approximate nearest neighbours by an adaptive dimension scan inside inverted lists.

Vectors are turned by a random rotation, so any leading block of columns is a fair sample of a distance. A query meets the
vectors of its probed lists block by block; after each block a hypothesis test holds the partial distance, scaled to all
columns, against the tenth-best distance so far, and drops the candidates that are beyond it with near certainty. The
survivors' exact distances on the original vectors decide.

The rotation's size is the dimension and the centroids are fitted on a bounded sample; every row is indexed. How many lists a
query probes is measured, not guessed: a bounded number of queries is held against all rows by brute force, and as many
lists are probed as hold the wanted share of their true neighbours, and more by a query whose lists hold too few rows. A long list
is dealt over several groups by a hash of the id, and so are the queries of a list that very many probe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfold.llm.common import stored


def rotation(dimension: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from distinct rows of the sample; an empty list keeps its place."""
    unique = np.unique(sample, axis=0)
    lists = min(lists, len(unique))
    at = unique[np.random.default_rng(seed).permutation(len(unique))[:lists]].copy()
    for _ in range(rounds):
        own = nearest_lists(sample, at, 1)[:, 0]
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(at))
        at[n > 0] = sums[n > 0] / n[n > 0, None]
    return at


def nearest_lists(vectors: np.ndarray, at: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the nearest centroids of each row, nearest first, in blocks."""
    out = []
    for i in range(0, len(vectors), 4096):
        far = (at * at).sum(1) - 2 * vectors[i : i + 4096] @ at.T
        if probes == 1:
            out.append(far.argmin(axis=1)[:, None])
            continue
        near = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes < len(at) else np.broadcast_to(np.arange(len(at)), far.shape)
        out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, probes), np.int64)


def adaptive_scan(query: np.ndarray, turned_query: np.ndarray, vectors: np.ndarray, turned: np.ndarray, ids: np.ndarray, own: int, k: int, block: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of up to k rows nearest to the query, ties to smaller ids; own is the query's id, which takes no part.

    slack: standard deviations of the test; a candidate goes after d of D columns if D / d times its partial squared distance is above
    (1 + slack / sqrt(d)) ** 2 times the square of the k-th distance so far, which the first rows of the list start.
    """
    n, dimension = turned.shape
    exact = lambda rows: np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
    held = np.flatnonzero(ids[: 4 * k] != own)
    best = exact(held)
    for start in range(4 * k, n, 1024):
        alive = np.arange(start, min(n, start + 1024))
        alive = alive[ids[alive] != own]
        limit = np.partition(best, k - 1)[k - 1] ** 2 if len(best) >= k else np.inf
        part = np.zeros(len(alive))
        for d in range(0, dimension, block):
            part += ((turned[alive, d : d + block] - turned_query[d : d + block]) ** 2).sum(axis=1)
            seen = min(dimension, d + block)
            widened = limit * (1 + (slack / np.sqrt(seen) if seen < dimension else 0)) ** 2 * seen / dimension
            keep = part <= widened + 1e-9 * (1 + widened)
            if not keep.all():
                alive, part = alive[keep], part[keep]
            if not len(alive):
                break
        if len(alive):
            held, best = np.concatenate((held, alive)), np.concatenate((best, exact(alive)))
            order = np.lexsort((ids[held], best))[:k]
            held, best = held[order], best[order]
    order = np.lexsort((ids[held], best))[:k]
    return ids[held[order]], best[order]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of vectors that aren't null, empty, zero or holding null or non-finite components, in double precision."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    return rows.filter(F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _probes(index: DataFrame, trial: DataFrame, fitted, k: int, recall: float) -> int:
    """The number of nearest lists that hold the share `recall` of the true k nearest of the trial's queries, by brute force in one pass over all rows."""
    told = trial.select("vec_id", "v").toArrow()  # at most `trials` rows
    if not told.num_rows:
        return 1
    ids, q = told.column("vec_id").to_numpy(), _matrix(told.column("v").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.empty((len(q), 0))
        lists = np.empty((len(q), 0), np.int64)
        for batch in batches:
            x, own = _matrix(batch.column("v")), np.asarray(batch.column("vec_id"))
            far = (x * x).sum(1) - 2 * q @ x.T
            far[ids[:, None] == own] = np.inf
            best = np.concatenate((best, far), axis=1)
            lists = np.concatenate((lists, np.broadcast_to(np.asarray(batch.column("list")), far.shape)), axis=1)
            top = np.argsort(best, axis=1)[:, :k]
            best, lists = np.take_along_axis(best, top, 1), np.take_along_axis(lists, top, 1)
        if best.shape[1]:
            yield pa.RecordBatch.from_pydict({"q": pa.array(np.repeat(np.arange(len(q)), best.shape[1])), "far": pa.array(best.ravel()), "list": pa.array(lists.ravel().astype(np.int32))})

    nearest = F.row_number().over(W.partitionBy("q").orderBy("far"))
    held = index.mapInArrow(run, "q long, far double, list int").filter("far < double('Infinity')").withColumn("n", nearest).filter(F.col("n") <= k).select("q", "list").collect()  # trials times k rows
    if not held:
        return 1
    at = fitted.value[0]
    order = np.argsort(nearest_lists(q, at, len(at)), axis=1)
    places = sorted(int(order[r["q"], r["list"]]) for r in held)
    return places[min(len(places) - 1, int(np.ceil(recall * len(places))))] + 1


def search(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", rows_a_list: int = 500, sample: int = 20_000, recall: float = 0.96, trials: int = 200, block: int = 16, slack: float = 2.5, group_rows: int | None = None, group_queries: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest found among all rows but its own; queries are the rows whose id `every` divides.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id. Vectors that
    are null, zero or hold null or non-finite components take no part, nor do those of another dimension than the largest there is;
    rows with a repeated id are candidates of their own, but not of queries with that id. group_rows and group_queries bound what a task holds of a list and of its queries; if not given, by 64 and 32 MB of vectors, so that a list is
    read once for very many queries. Fewer than k candidates are all returned; an empty table gives no rows.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not seen["n"]:
        return spark.createDataFrame([], schema)
    rows, dimension = rows.filter(F.size("v") == seen["d"]), seen["d"]
    group_rows, group_queries = group_rows or max(1, (64 << 20) // (8 * dimension)), group_queries or max(1, (32 << 20) // (8 * dimension))
    lists = int(np.clip(seen["n"] // rows_a_list, 1, sample // 4))
    picked = rows.orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "vec_id").limit(sample).select("v").toArrow()  # at most `sample` rows
    at = centroids(_matrix(picked.column("v").combine_chunks()), lists)
    fitted = spark.sparkContext.broadcast((at, rotation(dimension)))

    def assigned(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = nearest_lists(_matrix(batch.column("v")), fitted.value[0], n)
                    rep = pa.array(np.repeat(np.arange(batch.num_rows), n))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rep), batch.column("v").take(rep), pa.array(own.ravel().astype(np.int32))], ["vec_id", "v", "list"])

        return run

    kept = "vec_id long, v array<double>, list int"
    index = stored(rows.mapInArrow(assigned(1), kept), "lists")
    asked = rows.filter(F.col("vec_id") % every == 0)
    probes = _probes(index, asked.orderBy(F.xxhash64(F.lit("trial"), "vec_id"), "vec_id").limit(trials), fitted, k, recall)
    held = np.zeros(len(at), np.int64)
    for r in index.groupBy("list").count().collect():  # a row for each list
        held[r["list"]] = r["count"]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest `probes` lists, and further ones until they hold k rows besides the query's own id."""
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                near = nearest_lists(_matrix(batch.column("v")), fitted.value[0], len(held))
                need = k + np.asarray(batch.column("own"))[:, None]
                take = np.minimum(len(held), np.maximum(probes, 1 + (np.cumsum(held[near], axis=1) < need).sum(axis=1)))
                rep = np.repeat(np.arange(len(take)), take)
                own = near[rep, np.arange(len(rep)) - np.repeat(np.cumsum(take) - take, take)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rep)), batch.column("v").take(pa.array(rep)), pa.array(own.astype(np.int32))], ["vec_id", "v", "list"])

    repeats = asked.groupBy("vec_id").agg(F.count("*").alias("own"))
    queries = stored(asked.join(repeats, "vec_id").select("vec_id", "v", "own").mapInArrow(probed, kept), "probes")
    salts = index.groupBy("list").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("salts"))
    parts = queries.groupBy("list").agg(F.ceil(F.count("*") / group_queries).cast("int").alias("parts"))
    sizes = stored(salts.join(parts, "list"), "list-sizes")
    spread = lambda n, c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = index.join(sizes, "list").select("list", own("salts").alias("salt"), spread("parts", "part"), "vec_id", "v")
    right = queries.join(sizes, "list").select("list", own("parts").alias("part"), spread("salts", "salt"), "vec_id", "v")

    def scan(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if candidates.num_rows and asked.num_rows:
            turn = fitted.value[1]
            x, q = _matrix(candidates.column("v").combine_chunks()), _matrix(asked.column("v").combine_chunks())
            ids, query_ids = candidates.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
            turned, turned_q = x @ turn, q @ turn
            for i, query in enumerate(query_ids):
                found, far = adaptive_scan(q[i], turned_q[i], x, turned, ids, query, k, block, slack)
                out["query_id"] += [query] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += far.tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["list", "salt", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
