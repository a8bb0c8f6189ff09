"""Phrase collocations by Toivonen's sampling: a sample proposes frequent phrases, full passes count them and their negative border exactly.

The negative border of a set of phrases is every phrase outside it whose two parts, without the last and without the first
word, are inside. A pass counts each phrase whose parts are both in the set, which is the set and its border, wherever it
occurs; border phrases that never occur need no row. A border phrase that turns out frequent is a failure of the sample: it
joins the set, and another pass counts what its joining has opened, until no failure is left. Then every frequent phrase has been
counted, whatever the sample held. The sample itself is mined by the same loop, from the empty set, at a lower threshold.

The set goes to the tasks as a Bloom filter of bounded size. A false hit makes a pass count a phrase more, exactly; it can't
change a result. Passes only add bits, so what an earlier pass counted is known from its filter. Beyond some
thirty million phrases (`filter_bits`) the filter fills up and passes shuffle more rows than they need.

Texts never move: a task numbers the words of a few megabytes by their text, numbers phrases by pairs of such numbers, and
emits each counted phrase once with its count; Spark sums them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfold.llm.common import small_side, stored

_SPACES, _ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_SPACES)], _KIND[list(_ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# --- hashes and the filter


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last and of the last."""
    x = (first * _MIX) ^ last
    x ^= x >> np.uint64(32)
    x *= _STEP
    return x ^ (x >> np.uint64(29))


def _bits(hashes: np.ndarray, size: int, which: tuple[int, ...] = (0, 1, 2, 3)) -> list[np.ndarray]:
    """Positions of each hash in a filter of `size` bits, a power of two: four, or some of them."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & np.uint64(size - 1) for i in which]


def inside(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds; each position is looked at only where the ones before were set."""
    at = np.arange(len(hashes))
    for i in range(4):
        bit = _bits(hashes[at], 64 * len(held), (i,))[0]
        at = at[(held[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(np.bool_)]
    out = np.zeros(len(hashes), np.bool_)
    out[at] = True
    return out


# --- counting within a task


def segments(texts: list[bytes], most: int) -> Iterator[bytes]:
    """The texts, joined by line ends, in parts of about `most` bytes; long texts are cut behind an end of a piece, which no phrase crosses."""
    held, n = [], 0
    for text in texts:
        start = 0
        while len(text) - start > most:
            end = next((i + 1 for i in range(start + most, len(text)) if text[i] in _ENDS), len(text))
            yield text[start:end]
            start = end
        held.append(text[start:])
        n += len(held[-1])
        if n >= most:
            yield b"\n".join(held)
            held, n = [], 0
    if held:
        yield b"\n".join(held)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, distinct keys)."""
    coded = pa.array(keys).dictionary_encode()
    return np.asarray(coded.indices, np.int64), np.asarray(coded.dictionary)


def count_segment(lang: str, data: bytes, now: np.ndarray | None, before: np.ndarray | None, longest: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, phrases, counts) of each length: single words and phrases whose parts the filter `now` holds, without those that `before` had counted. A length of 0 tells the number of words."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    word = np.concatenate(([False], kind == 0, [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[kind == 0]])]).dictionary_encode()
    at, words = np.asarray(coded.indices, np.int64), coded.dictionary
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    if before is None:
        yield 0, pa.array([""]), np.array([len(at)])
        yield 1, words, np.bincount(at, minlength=len(words))
    if now is None:
        return
    single = word_hashes(lang, words.to_pylist())
    #: For each place: the hash of the phrase that starts there, and whether `now` holds it and `before` had counted with it.
    of_word = single[at]
    hashes, held = of_word, inside(now, single)[at]
    known = inside(before, single)[at] if before is not None else np.zeros(len(at), np.bool_)
    for length in range(2, longest + 1):
        last = len(at) - length + 1
        if last <= 0:
            return
        open_ = held[:last] & held[1 : last + 1]
        if length == 2:
            open_ &= piece[:-1] == piece[1:]
        places = np.flatnonzero(open_)
        if not len(places):
            return
        counted = known[places] & known[places + 1]
        fresh = places[~counted]
        if len(fresh):
            number, parts = at[fresh], [np.arange(len(words))]
            for more in range(1, length):  # phrases by their words, pair by pair: exact at any length
                number, keys = _numbered(number * len(words) + at[fresh + more])
                first, final = np.divmod(keys, len(words))
                parts = [p[first] for p in parts] + [final]
            yield length, pc.binary_join_element_wise(*(words.take(pa.array(p)) for p in parts), " "), np.bincount(number, minlength=len(keys))
        if length == longest:
            return
        hashes = _at(last, places, joined(hashes[places], of_word[places + length - 1]))
        held = _at(last, places, inside(now, hashes[places]))
        known = _at(last, places, counted if before is None else counted & inside(before, hashes[places]))


def _at(n: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values at these places of n, nothing elsewhere."""
    out = np.zeros(n, values.dtype)
    out[places] = values
    return out


def _counted(docs: DataFrame, now: Broadcast | None, before: Broadcast | None, longest: int, segment: int) -> DataFrame:
    """(lang, k, phrase, f): summed counts over docs(lang, text). Tasks have summed their segments, so rows are dealt out before they are summed on: most phrases of a task are new to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for data in segments(texts, segment):
                    for k, phrases, counts in count_segment(lang, data, now and now.value, before and before.value, longest):
                        n = len(phrases)
                        yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.array(np.full(n, k, np.int32)), phrases, pa.array(counts, pa.int64())], ["lang", "k", "phrase", "f"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                data = text.as_buffer().to_pybytes()
                held.setdefault(lang, []).append(data)
                size += len(data)
                if size >= segment:
                    yield from emit()
                    held, size = {}, 0
        yield from emit()

    return docs.mapInArrow(run, "lang string, k int, phrase string, f long").repartition("lang", "k", "phrase").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


# --- passes


@dataclass
class Held:
    """A filter on the driver and, for the tasks, its broadcast form."""

    bits: np.ndarray
    sent: Broadcast


def _phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hash of each (lang, phrase)."""
    out = np.empty(batch.num_rows, np.uint64)
    for i, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)):
        each = word_hashes(lang, phrase.split(" "))
        h = each[:1]
        for j in range(1, len(each)):
            h = joined(h, each[j : j + 1])
        out[i] = h[0]
    return out


def _added(phrases: DataFrame, held: Held | None, size: int) -> Held:
    """The filter with the phrases' bits: at most size / 64 words come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_bits(_phrase_hashes(batch), size)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["place", "bits"])

    new = phrases.select("lang", "phrase").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = held.bits.copy() if held else np.zeros(size // 64, np.uint64)
    bits[new.column("place").to_numpy()] |= new.column("bits").to_numpy().view(np.uint64)
    return Held(bits, phrases.sparkSession.sparkContext.broadcast(bits))


def _outside(phrases: DataFrame, held: Held | None) -> DataFrame:
    """The phrases that the filter doesn't hold."""
    if held is None:
        return phrases
    sent = held.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~inside(sent.value, _phrase_hashes(batch))))

    return phrases.mapInArrow(run, phrases.schema)


def closure(docs: DataFrame, held: Held | None, least: int, longest: int, size: int, segment: int) -> tuple[DataFrame, int]:
    """(stored (lang, k, phrase, f) of every phrase of up to `longest` words with f >= least and of the number of words (k = 0), passes made)."""
    before, found, passes = None, None, 0
    while True:
        new = stored(_counted(docs, held and held.sent, before and before.sent, longest, segment).filter((F.col("f") >= least) | (F.col("k") == 0)), "phrase-counts")
        found, passes = new if found is None else found.unionByName(new), passes + 1
        failures = stored(_outside(new.filter(F.col("k").between(1, longest - 1)), held), "phrase-failures")
        if failures.isEmpty():
            return found, passes
        # From the empty set everything that isn't a single word is still open; its filter holds nothing.
        before = held or Held(np.zeros(size // 64, np.uint64), docs.sparkSession.sparkContext.broadcast(np.zeros(size // 64, np.uint64)))
        held = _added(failures, held, size)


def frequent(docs: DataFrame, least: int = 30, longest: int = 4, share: int = 8, lowered: float = 0.7, filter_bits: int = 1 << 28, segment: int = 8 << 20) -> tuple[DataFrame, int]:
    """(lang, k, phrase, f) of every phrase of docs(lang, text) with f >= least, stored, and the number of full passes; rows with k = 0 hold a language's number of words.

    One document in `share` proposes; its threshold is least / share, lowered. Both shift work between passes only.
    """
    sample = stored(docs.sample(1 / share, seed=5), "phrase-sample")
    top = longest - 1
    proposed = closure(sample, None, max(2, math.floor(least / share * lowered)), top, 1 << 24, segment)[0].filter("k > 0")
    size = min(filter_bits, max(1 << 20, 1 << (16 * proposed.count()).bit_length()))
    return closure(docs, _added(proposed, None, size), least, longest, size, segment)


# --- scores


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, share: int = 8, lang_col: str = "lang", text_col: str = "text", segment: int = 8 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` collocations by score, frequency and phrase.

    Null text is empty, a null language is `und`; repeated rows count again; no frequent phrase gives no rows. Columns other than the two named take no part.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter(F.length("text") > 0)
    found, _ = frequent(texts, least, longest, share, segment=segment)
    phrases = found.filter("k > 0").select("lang", "phrase", "f")
    candidates = found.filter("k > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right"))
    of = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("(2000000 * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")

    shorter = candidates.filter(F.size("w") > 2).withColumn("k", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("start", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)))
    covers = shorter.select("lang", part(F.col("start"), F.col("k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    free = scored.join(covers, ["lang", "phrase"], "left").filter(F.expr("cover is null or 100 * cast(cover as decimal(19,0)) < 80 * cast(a as decimal(19,0))"))

    # The best of many small parts of a language first, then of those: no task orders a whole language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = max(1, found.count() // 10_000)
    best = free.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "dealt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    words = found.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(small_side(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = """
with pieces as (
  select lang, row_number() over () as piece, x from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as x from documents)
), split_words as (select lang, piece, list_filter(string_split_regex(x, '[\\x20\\x09]+'), lambda w: w <> '') as w from pieces)
, grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from split_words, (select unnest([1, 2, 3, 4]) as k))
), f as materialized (select lang, k, phrase, count(*) as f from grams group by all)
, n as (select lang, sum(f) as n from f where k = 1 group by lang)
, cand as materialized (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 30)
, cuts as (select lang, k, phrase, a, w, unnest(range(1, k)) as cut from cand)
, scored as (
  select c.lang, c.phrase, c.a, c.cut, l.f as l, r.f as r, cast(2000000::hugeint * c.a // (l.f::hugeint + r.f) as bigint) as score
  from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.cut], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
  qualify row_number() over (partition by c.lang, c.phrase order by score, c.cut) = 1
), covers as (
  select lang, sub, max(a) as cover from (select lang, a, array_to_string(w[i:i + m - 1], ' ') as sub
    from (select lang, a, w, m, unnest(range(1, k - m + 2)) as i from cand, (select unnest([2, 3]) as m) where m < k)) group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, score
from scored join n using (lang) left join covers on covers.lang = scored.lang and covers.sub = scored.phrase
where cover is null or 100 * cover::hugeint < 80 * a::hugeint
qualify rank <= 2000
"""
