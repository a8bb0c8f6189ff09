"""SimHash near-duplicates: fingerprints of word shingles, compared in bit planes.

64-bit fingerprints within `radius` bits agree wholly on two of six blocks of bits (radius 4, by the pigeonhole principle),
so one of 15 block pairs puts both into one bucket and no link is lost. With a similarity, shingle sets link by their exact
Jaccard likeness: 128-bit fingerprints of the sets find candidates in tables of sampled bits, within a radius and in as many tables as
miss one in a hundred pairs of likeness `similarity` at most, whatever the number of rows; the sets of candidates decide. A bucket's fingerprints are laid out as bit planes of 64 lanes; a
query updates 64 distances at a time with carry-save counters and a block is abandoned once all its lanes are beyond
the radius. Equal fingerprints are compared once. Buckets above `tile` rows are cut into tiles, so that no task gets
more than two tiles' rows of a hot bucket and yet each pair of its rows meets in one of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import flagged, given_back, map_columns, salted_join, slices, small_side, stored, unused
from tarnfold.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 17


def shingle_hashes(text: str | None, width: int, digest, seed: int) -> Iterator[np.ndarray]:
    """The digest of each shingle as a row of big-endian bytes, a bounded chunk at a time."""
    joined = b" ".join((text or "").encode().translate(LOWER).split())
    if not joined:
        return
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], at + 1)), np.concatenate((at, [len(joined)]))
    if len(starts) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    for i in range(0, len(starts), _CHUNK):
        found = [digest(joined[s:e], seed) for s, e in zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist(), strict=True)]
        yield np.frombuffer(b"".join(found), np.uint8).reshape(len(found), -1)


def fingerprint_of(text: str | None, width: int = 4, bits: int = 64, seed: int = 42) -> list[int]:
    """The fingerprint as signed 64-bit integers, bits / 64 of them; no words give 0. 64 bits: XXH64; 128: XXH3."""
    from xxhash import xxh3_128_digest, xxh64_digest

    counts, n = np.zeros(bits, np.int64), 0
    for hashes in shingle_hashes(text, width, xxh64_digest if bits == 64 else xxh3_128_digest, seed):
        counts += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return np.packbits(counts * 2 > n).view(">i8").tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 64) -> DataFrame:
    """(doc_id, fp[, fp2]) for every row; a null text counts as empty, repeated ids keep a row each."""

    def run(rows: dict) -> dict:
        parts = zip(*(fingerprint_of(t, width, bits) for t in rows[text_col]), strict=True)
        return {"doc_id": pa.array(rows[id_col], pa.int64())} | {name: pa.array(part, pa.int64()) for name, part in zip(_parts(bits), parts, strict=True)}

    return map_columns(docs, [id_col, text_col], "doc_id long" + "".join(f", {name} long" for name in _parts(bits)), run)


def shingle_set(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """The 128-bit digests of the distinct shingles as rows of two numbers, in order of the first, which tells them apart."""
    from xxhash import xxh3_128_digest

    found = np.empty((0, 2), ">u8")
    for hashes in shingle_hashes(text, width, xxh3_128_digest, seed):
        found = np.concatenate((found, hashes.view(">u8")))
        found = found[np.unique(found[:, 0], return_index=True)[1]]
    return found


def set_fingerprint(shingles: np.ndarray) -> list[int]:
    """The 128-bit fingerprint of a shingle set as two signed integers; none gives 0."""
    counts = np.zeros(128, np.int64)
    for i in range(0, len(shingles), _CHUNK):
        counts += np.unpackbits(np.ascontiguousarray(shingles[i : i + _CHUNK]).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(shingles)).view(">i8").tolist()


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a distinct shingle set, as two numbers."""
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(np.ascontiguousarray(shingles).tobytes()), ">i8").tolist())


def set_prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, at, fp, fp2, set1, set2, size) for every row of (doc_id, at, text): fingerprint, name and size of its shingle set."""
    names = ["doc_id", "at", "fp", "fp2", "set1", "set2", "size"]

    def run(rows: dict) -> dict:
        sets = [shingle_set(t, width) for t in rows["text"]]
        (fp, fp2), (set1, set2) = (zip(*map(of, sets), strict=True) for of in (set_fingerprint, set_name))
        return {k: pa.array(v, pa.int64()) for k, v in zip(names, (rows["doc_id"], rows["at"], fp, fp2, set1, set2, list(map(len, sets))), strict=True)}

    return map_columns(docs, ["doc_id", "at", "text"], ", ".join(f"{n} long" for n in names), run)


def _parts(bits: int) -> list[str]:
    return ["fp", "fp2"][: bits // 64]


def band_keys(fp: Column, radius: int) -> Column:
    """One key for each choice of two blocks out of radius + 2: two fingerprints within the radius share at least one."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    widths = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = [F.lit(k << 48) + blocks[i] * F.lit(1 << widths[j]) + blocks[j] for k, (i, j) in enumerate(combinations(range(n), 2))]
    return F.array(*keys)


def sampled_keys(fps: DataFrame, key_bits: int, tables: int, seed: int = 11) -> DataFrame:
    """fps with a row and a key for each table: a table's key is key_bits bits of the 128, sampled without replacement."""
    rng = np.random.default_rng(seed)
    chosen = np.stack([rng.permutation(128)[:key_bits] for _ in range(tables)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits([np.asarray(batch.column(n)).view(np.uint64) for n in ("fp", "fp2")])
            keys = np.concatenate([(np.int64(t) << 48) + bits[:, at].astype(np.int64) @ (1 << np.arange(key_bits)) for t, at in enumerate(chosen)])
            again = pa.array(np.tile(np.arange(batch.num_rows), tables))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(n).take(again) for n in ("node", "fp", "fp2"))], ["key", "node", "fp", "fp2"])

    return fps.select("node", "fp", "fp2").mapInArrow(given_back(run), "key long, node long, fp long, fp2 long")


def _bits(words: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each fingerprint."""
    return np.concatenate([np.unpackbits(np.ascontiguousarray(w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for w in words], axis=1)


def linked_pairs(words: list[np.ndarray], first: np.ndarray, radius: int, step: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of one bucket within the radius. words: the fingerprints' unsigned 64-bit parts. first[j]: where the bucket of j starts; buckets lie one after another.

    Lanes are 64 neighbours of the sorted order, a plane holds one bit of each. Row q meets the blocks of lanes from its
    bucket's start to itself.
    """
    n = len(first)
    n_blocks = -(-n // 64)
    bits = np.zeros((n_blocks * 64, 64 * len(words)), np.uint8)
    bits[:n] = _bits(words)
    planes = np.ascontiguousarray(np.packbits(bits.T.reshape(-1, n_blocks, 64), axis=2, bitorder="little")).view(np.uint64).reshape(-1, n_blocks)
    del bits
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    where = np.arange(n)
    b0, b1 = first // 64, where // 64
    per = b1 - b0 + 1
    ends = np.cumsum(per)
    done = 0
    while done < n:
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + step, "right")))
        rows = where[done:upto]
        reps = per[done:upto]
        q = np.repeat(rows, reps)
        block = np.repeat(b0[done:upto], reps) + (np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps))
        low = np.clip(first[q] - block * 64, 0, 64).astype(np.uint64)
        high = np.clip(q - block * 64, 0, 64).astype(np.uint64)
        lanes = np.where(high == 64, full, (np.uint64(1) << (high % np.uint64(64))) - np.uint64(1)) & ~np.where(low == 64, full, (np.uint64(1) << (low % np.uint64(64))) - np.uint64(1))
        keep = lanes != 0
        q, block, lanes = q[keep], block[keep], lanes[keep]
        c = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length() + 1)]
        for k in range(len(planes)):
            if not len(q):
                break
            carry = planes[k, block] ^ np.where((words[k // 64][q] >> np.uint64(k % 64)) & np.uint64(1), full, np.uint64(0))
            for i in range(len(c) - 1):
                c[i], carry = c[i] ^ carry, c[i] & carry
            c[-1] |= carry  # sticky: a count of 2 ** (len(c) - 1) and more
            if k % 8 == 7:
                over = c[-1].copy()  # counts above the radius
                equal = np.full(len(q), full)
                for i in range(len(c) - 2, -1, -1):
                    if radius >> i & 1:
                        equal &= c[i]
                    else:
                        over |= equal & c[i]
                        equal &= ~c[i]
                lanes = lanes & ~over
                keep = lanes != 0
                if not keep.all():
                    q, block, lanes = q[keep], block[keep], lanes[keep]
                    c = [x[keep] for x in c]
        if len(q):
            hits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(hits)
            yield block[row] * 64 + lane, q[row]
        done = upto


def _hang(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites i and j in a forest whose roots are the smallest members."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _firsts(keys: list[np.ndarray]) -> np.ndarray:
    """Where the bucket of each row starts; rows are sorted by the keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _forest(nodes: np.ndarray, parent: np.ndarray) -> pa.RecordBatch:
    hung = np.flatnonzero(parent != np.arange(len(nodes)))
    return pa.RecordBatch.from_pydict({"a": pa.array(nodes[hung]), "b": pa.array(nodes[parent[hung]])})


def _compare(radius: int):
    def edges(keys: list[np.ndarray], nodes: np.ndarray, words: list[np.ndarray]) -> pa.RecordBatch:
        first, parent = _firsts(keys), np.arange(len(nodes))
        for i, j in linked_pairs([w.view(np.uint64) for w in words], first, radius):
            _hang(parent, i, j)
        return _forest(nodes, parent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and tile; whole buckets are compared, many at once."""
        kept: list[np.ndarray] | None = None
        for batch in batches:
            rows = [np.asarray(batch.column(i)) for i in range(batch.num_columns)]
            kept = rows if kept is None else [np.concatenate(x) for x in zip(kept, rows, strict=True)]
            if len(kept[0]) >= 50_000:
                last = (kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1])
                cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if cut:
                    yield edges([kept[0][:cut], kept[1][:cut]], kept[2][:cut], [x[:cut] for x in kept[3:]])
                    kept = [x[cut:] for x in kept]
        if kept is not None and len(kept[0]):
            yield edges(kept[:2], kept[2], kept[3:])

    return run


def _decide(radius: int, similarity: float):
    """Like _compare, but a pair within the radius links only if its shingle sets are of the Jaccard likeness or more; pairs that links join already aren't asked."""

    def alike(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= similarity * (len(a) + len(b) - both) - 1e-9

    def edges(keys: list[np.ndarray], nodes: np.ndarray, words: list[np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
        first, parent = _firsts(keys), np.arange(len(nodes))
        sizes = np.array([len(x) for x in sets])
        for i, j in linked_pairs([w.view(np.uint64) for w in words], first, radius):
            near = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
            i, j = i[near], j[near]
            while len(i):
                apart = parent[i] != parent[j]
                i, j = i[apart], j[apart]
                asked = np.unique(j, return_index=True)[1]
                a, b = i[asked], j[asked]
                yes = np.array([alike(sets[x], sets[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
                _hang(parent, a[yes], b[yes])
                i, j = np.delete(i, asked), np.delete(j, asked)
        return _forest(nodes, parent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and tile; small groups are compared together."""
        kept, sets, held = None, [], 0
        for batch in batches:
            rows = [np.asarray(batch.column(i)) for i in range(5)]
            kept = rows if kept is None else [np.concatenate(x) for x in zip(kept, rows, strict=True)]
            sets += [np.frombuffer(x, np.uint64) for x in batch.column(5).to_pylist()]
            held += batch.column(5).nbytes
            if held >= 1 << 25:
                last = (kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1])
                cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if cut:
                    yield edges([kept[0][:cut], kept[1][:cut]], kept[2][:cut], [x[:cut] for x in kept[3:]], sets[:cut])
                    kept, sets = [x[cut:] for x in kept], sets[cut:]
                    held = sum(x.nbytes for x in sets)
        if kept is not None and len(kept[0]):
            yield edges(kept[:2], kept[2], kept[3:], sets)

    return run


def _dealt(entries: DataFrame, tiles: Column) -> DataFrame:
    """entries (key, node, more, tiles' columns) sorted by key and tile: a key's rows are cut into `tiles` parts by node, and each pair of parts is a tile of its own."""
    counted = entries.withColumn("m", tiles.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    other = F.explode(F.when(F.col("m") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("m") - 1), F.col("own"))))
    parts = [c for c in ("fp", "fp2", "shingles") if c in entries.columns]
    dealt = counted.withColumn("other", other).select("key", (F.least("own", "other") * F.lit(1 << 20) + F.greatest("own", "other")).cast("long").alias("tile"), "node", *parts)
    return dealt.repartition("key", "tile").sortWithinPartitions("key", "tile")


def bucket_links(entries: DataFrame, radius: int, tile: int, lone: bool) -> DataFrame:
    """Edges (a, b) between nodes of one bucket within the radius; entries: key, node and the fingerprint's parts.

    Links come as a forest, each node with the smallest linked one, never as all pairs. A bucket of over `tile` rows is cut
    into parts, and each pair of parts is a tile of its own. lone: most buckets hold one row, which is dropped before the comparison.
    """
    counts = entries.groupBy("key").agg(F.count("*").alias("n"))
    if lone:
        counted = entries.join(counts.filter("n > 1"), "key")
    else:
        counted = entries.join(small_side(stored(counts.filter(F.col("n") > tile), "hot-buckets")), "key", "left")
    return _dealt(counted, F.ceil(F.coalesce("n", F.lit(1)) / tile)).mapInArrow(given_back(_compare(radius)), "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = 4, tile: int = 8192) -> DataFrame:
    """Edges (a, b) that join all pairs of 64-bit fingerprints within the radius; fps has node and fp, one row for each distinct value."""
    return bucket_links(fps.select("node", "fp", F.explode(band_keys(F.col("fp"), radius)).alias("key")), radius, tile, True)


def table_plan(n: int, similarity: float = 0.8, missed: float = 0.01) -> tuple[int, int, int]:
    """(radius, bits of a key, tables) that miss the share `missed` of pairs of Jaccard likeness `similarity` at most, for any n.

    Two such sets of like size have the least cosine, and their differing bits are binomial. Half of `missed` may lie beyond the radius; the tables
    are so many that these and the pairs within it that share no key, averaged over the differing bits, are `missed` together.
    A key has as many bits as keep a bucket of chance meetings at about a thousand rows: with fewer the comparisons, with more the tables would outgrow the input.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    share = np.array([math.comb(128, d) * p**d * (1 - p) ** (128 - d) for d in range(129)])
    radius = next(r for r in range(129) if share[r + 1 :].sum() <= missed / 2)
    key_bits = max(12, round(math.log2(max(n, 2))) - 10)
    apart = np.array([1 - math.comb(128 - d, key_bits) / math.comb(128, key_bits) for d in range(radius + 1)])
    low, high = 1, 1 << 20
    while low < high:
        tables = (low + high) // 2
        if share[: radius + 1] @ apart**tables + share[radius + 1 :].sum() <= missed:
            high = tables
        else:
            low = tables + 1
    return radius, key_bits, low


def similar_links(docs: DataFrame, nodes: DataFrame, n: int, width: int, similarity: float = 0.8, missed: float = 0.01, tile: int = 8192, set_tile: int = 2048, few: int = 200_000) -> DataFrame:
    """Edges (a, b) that join shingle sets of Jaccard likeness `similarity` or more; nodes has node (any number), set1, set2, fp, fp2, size and at, n rows, one for each distinct set, and docs a text for each at.

    Tables join candidates into loose groups; only their members' sets are made again and compared, each pair of a group within the radius.
    A group above set_tile rows or set_tile * 1024 shingles is cut into tiles like a hot bucket. Members are broadcast to docs while they are `few`; beyond, only texts that may be theirs move.
    """
    radius, key_bits, tables = table_plan(n, similarity, missed)
    loose = components(bucket_links(sampled_keys(nodes, key_bits, tables), radius, tile, False))
    found = stored(nodes.join(loose.distinct(), "node").withColumnRenamed("root", "key"), "candidates")
    weights = found.groupBy("key").agg(F.ceil(F.greatest(F.count("*"), F.sum("size") / 1024) / set_tile).alias("tiles")).filter("tiles > 1")
    weights = small_side(stored(weights, "hot-groups"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            same = pa.array([set_name(x) == name for x, name in zip(sets, zip(*(batch.column(c).to_pylist() for c in ("set1", "set2")), strict=True), strict=True)], pa.bool_())
            sets = pa.array([x[:, 0].astype(np.uint64).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "node", "fp", "fp2")), sets], ["key", "node", "fp", "fp2", "shingles"]).filter(same)

    texts, members = docs.select("at", "text"), found.select("at", "key", "node", "set1", "set2", "fp", "fp2")
    if found.count() > few:
        texts = flagged(texts, F.col("at"), found.select("at"), "maybe").filter("maybe").drop("maybe")
    held = texts.join(small_side(members, few), "at").dropDuplicates(["at"])
    sets = held.select("key", "node", "set1", "set2", "fp", "fp2", "text").mapInArrow(given_back(run), "key long, node long, fp long, fp2 long, shingles binary")
    dealt = _dealt(sets.join(weights, "key", "left"), F.coalesce("tiles", F.lit(1)))
    return dealt.mapInArrow(given_back(_decide(radius, similarity)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, similarity: float | None = None, tile: int = 8192) -> DataFrame:
    """One row for each document: doc_id, fp (long)[, fp2], component_id, the smallest doc_id that its links reach.

    Fingerprints of 64 bits link within the radius; with a similarity, they have 128 bits and texts link by the exact Jaccard likeness of their shingle sets instead.
    Null and empty texts have fingerprint 0 and link like others. Repeated ids keep a row each. If every id of a component
    is null, component_id is null. An empty table gives no rows; other columns of docs are ignored.
    """
    if similarity is not None:
        return _similar(docs, id_col, text_col, width, similarity, tile).drop("at")
    prints = stored(fingerprints(docs, id_col, text_col, width), "fingerprints").withColumn("node", F.col("fp"))
    least = prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.count("*").alias("n"))
    named = _named(least, fingerprint_links(least, radius, tile), ["node"], prints.count())
    return salted_join(prints, named, ["node"], F.coalesce("doc_id", F.lit(0)), prints.count()).select("doc_id", "fp", "component_id")


def _named(least: DataFrame, links: DataFrame, names: list[str], total: int) -> DataFrame:
    """names, n and component_id, the smallest id of its class, for each node; a class of any size is no hot key."""
    of = least.select("node", "least", "n", *(c for c in names if c != "node")).join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    return salted_join(of, classes, ["root"], F.col("node"), total, "nodes").select(*names, "n", "component_id")


def _at(id_col: str, text_col: str) -> Column:
    """A number for a row's id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), text_col)


def _similar(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, tile: int) -> DataFrame:
    """doc_id, at, fp, fp2, component_id by likeness."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _at(id_col, text_col).alias("at"), F.col(text_col).alias("text"))
    prints = stored(set_prints(rows, width), "fingerprints")
    least = prints.groupBy("set1", "set2").agg(F.min("doc_id").alias("least"), F.min("at").alias("at"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("fp", "fp2", "size")))
    least = stored(least.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers stay as they are once written
    links = similar_links(rows, least, least.count(), width, similarity, tile=tile)
    total = prints.count()
    named = _named(least, links, ["set1", "set2"], total)
    return salted_join(prints, named, ["set1", "set2"], F.col("at"), total).select("doc_id", "at", "fp", "fp2", "component_id")


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, tile: int = 8192, few: int = 200_000) -> DataFrame:
    """The document with the smallest id of each group of near copies; columns as in docs. Rows without id stay; a repeated id stays in the groups whose smallest it is and goes from others.

    While at most `few` documents go, they are broadcast; beyond, only rows that may be theirs are shuffled, and those that surely stay don't move.
    """
    found = _similar(docs, id_col, text_col, width, similarity, tile)
    gone = stored(found.filter("doc_id != component_id").select("doc_id", "at").distinct(), "copies")
    of = (F.col(f"docs.{id_col}").cast("long") == F.col("gone.doc_id")) & (_at(f"docs.{id_col}", f"docs.{text_col}") == F.col("gone.at"))
    left = lambda some: some.alias("docs").join(small_side(gone, few).alias("gone"), of, "left_anti").select(*docs.columns)
    if gone.count() <= few:
        return left(docs)
    maybe = unused(docs, "maybe")
    dealt = flagged(docs, _at(id_col, text_col), gone.select("at"), maybe)
    return dealt.filter(~F.col(maybe)).select(*docs.columns).unionByName(left(dealt.filter(F.col(maybe))))
