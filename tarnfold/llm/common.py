"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.checkpoints import shared_dir
from tarnfold.functions.slices import slices

#: Tables written inside each open scratch().
_OPEN: list[list[str]] = []


@contextmanager
def arrow_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What is written inside goes to Python in Arrow batches of about this size, where the session allows 64 MB; Python works on bounded parts anyway."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written once as Parquet in the shared folder and read again, and where it lies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with arrow_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: no lineage, one computation, exact sizes. Inside scratch() the table lives as long as that."""
    out, path = written(df, name)
    if _OPEN:
        _OPEN[-1].append(path)
    return out


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at its end, so what follows from them has to be written before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            deleted(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in either case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def given_back(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """function for mapInArrow; at a task's end Arrow gives back what it keeps for later use, as workers stay while other stages run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return run


def map_columns(df: DataFrame, columns: list[str], schema: str, function: Callable[..., dict]) -> DataFrame:
    """mapInArrow over the named columns; function takes a dict of Python lists and returns a dict of columns. It gets a bounded number of bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out = function({n: batch.column(i).to_pylist() for i, n in enumerate(columns)})
                yield pa.RecordBatch.from_pydict(out)

    return df.select(*columns).mapInArrow(given_back(run), schema)


def small_side(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if it has so few rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def flagged(big: DataFrame, number: Column, keys: DataFrame, name: str, most: int = 1 << 29) -> DataFrame:
    """big with a column of this name: true where number is among those of keys, and for about one other row in 32.

    keys has one column of hashes. Each gets a place among 32 bits a key (`most` at most; beyond, more other rows are true), and maps of 32,768 bits are broadcast, so no row of big moves.
    """
    bits = min(most, 32 * max(1, keys.count()))
    at, page, held = (unused(big, n) for n in ("at_", "page_", "held_"))
    place, byte = F.pmod(F.col(keys.columns[0]), F.lit(bits)), F.expr(f"cast(conv(hex(substring({held}, cast({at} % 32768 div 8 as int) + 1, 1)), 16, 10) as int)")
    maps = keys.select(place.alias(at)).withColumn(page, F.expr(f"{at} div 32768")).repartition(page).groupBy(page).agg(F.bitmap_construct_agg(F.expr(f"{at} % 32768")).alias(held))
    met = big.withColumn(at, F.pmod(number, F.lit(bits))).withColumn(page, F.expr(f"{at} div 32768")).join(F.broadcast(maps), page, "left")
    bit = byte.bitwiseAND(F.expr(f"shiftleft(1, cast({at} % 8 as int))")) != 0
    return met.withColumn(name, F.coalesce(bit, F.lit(False))).drop(at, page, held)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], by: Column, total: int, size: str = "n", least: int = 1 << 14, hot: int = 20_000) -> DataFrame:
    """big joined with small on keys, no task getting more than a bounded share of a hot key's rows.

    small has one row for each key and in `size` the rows that big has of it, about `total` in all. Keys of more than max(least, total / hot)
    rows are hot: about `hot` keys at most whatever the input, so they are broadcast to big, whose rows of a hot
    key are dealt over salts by a hash of `by`; small has a row for each salt.
    """
    part = max(least, total // hot)
    salts = F.ceil(F.col(size) / part).cast("int")
    hottest = small.filter(F.col(size) > part).select(*(F.col(k).alias(f"hot_{k}") for k in keys), salts.alias("salts_"))
    same = [F.col(k) == F.col(f"hot_{k}") for k in keys]
    dealt = big.join(F.broadcast(hottest), same, "left")
    dealt = dealt.withColumn("salt_", F.when(F.col("salts_").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("salts_")).cast("int"))).drop(*(f"hot_{k}" for k in keys), "salts_")
    spread = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(spread.drop(size), [*keys, "salt_"]).drop("salt_")
