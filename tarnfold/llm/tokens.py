"""Token counts of whole texts, and the encoders that other operators use; every id comes from the tokenizers library.

Short texts are encoded by their pre-tokens, each different one once (word_encoder). A text above one chunk is encoded in overlapping chunks with offsets; neighbours are spliced
at a boundary between pre-tokens that both chunks have and that is proven stable: it lies further from the left chunk's end
than any look-ahead of the splitter or any special string reaches, so cutting the text there changed nothing before it,
and from a common boundary on both scans go through the same states. Where chunks have no such boundary in common, the
right one starts earlier, by overlaps four times as wide, at last at the splice before it, which is a proven boundary itself. A left chunk
without any stable boundary (one long run of white space, say) grows to twice its length, so work stays in proportion to the text.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarnfold.llm.common import map_columns


def vocabulary(name: str) -> str:
    """Where the public vocabulary file of this name is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def library(json_path: str):
    """The tokenizer of a vocabulary file; one thread, as a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


#: Pre-tokens that word_encoder remembers, each of at most so many characters.
_MEMORY, _WORD = 1 << 19, 64
#: Characters whose classes no version of Unicode has changed; of them, a field with its space that Arrow may part.
_PLAIN = "[!-~\u00c0-\u024f]"
_SIMPLE = rf"^(?: ?{_PLAIN}+(?:\n{_PLAIN}+)*)?$"


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each, one after the other."""
    ends = np.cumsum(lengths)
    kind = np.int32 if max(len(values), lengths.sum()) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + lengths).astype(kind), lengths)
    at += np.arange(len(at), dtype=kind)
    return values[at]


@lru_cache(4)
def word_encoder(json_path: str) -> Callable[[list[str | None]], list[np.ndarray]]:
    """A function from whole texts to their ids as the library gives them, each different pre-token encoded once.

    Byte-level BPE encodes pre-tokens one by one. In the vocabulary's public pattern a space begins a pre-token or stands inside a run of white
    space, and only such a run looks ahead; so at a single space between two other characters, neither of them white space, a pre-token begins
    whatever stands around, and the field from that space to the next has the ids that it has alone. Arrow finds the different fields of the
    texts, parts plain ones by the pattern (alone in its field, a line end is a pre-token) and finds the different pre-tokens; only those
    that the bounded memory doesn't hold go to the library. Texts with other white space at a space, or with special strings, are cut
    at these and parted by the pattern as a whole. Tests hold the ids equal to those of whole texts.
    """
    import public_tokenizers
    import regex

    tokenizer = library(json_path)
    words = regex.compile(public_tokenizers.PATTERN)
    plain = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", "")
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    parts = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    (line_end,) = tokenizer.encode("\n", add_special_tokens=False).ids
    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}  # what was known when half of the memory was full; what isn't asked for again goes

    def ids(different: list[str]) -> list[bytes]:
        """Ids of pre-tokens. New ones go to the library by lines, as a line end between them is a pre-token, too."""
        out = list(map(known.get, different))
        at = [i for i, held in enumerate(out) if held is None]
        new = []
        for i in at:
            out[i] = before.get(different[i])
            if out[i] is None:
                new.append(i)
        line = [i for i in new if different[i][-1:].strip()]  # not white space
        lines = [line[k : k + 256] for k in range(0, len(line), 256)]
        for few, e in zip(lines, tokenizer.encode_batch_fast(["\n".join(different[i] for i in few) for few in lines], add_special_tokens=False), strict=True):
            got = np.array(e.ids, "<u4")
            ends = np.flatnonzero(got == line_end) * 4
            raw = got.tobytes()
            for i, x, y in zip(few, [0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)], strict=True):
                out[i] = raw[x:y]
        rest = [i for i in new if out[i] is None]
        for i, e in zip(rest, tokenizer.encode_batch_fast([different[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        known.update((different[i], out[i]) for i in at if len(different[i]) <= _WORD)
        if len(known) > _MEMORY // 2:
            before.clear()
            before.update(known)
            known.clear()
        return out

    def whole(text: str) -> np.ndarray:
        found = [w for part in (parts.split(text) if parts else (text,)) for w in ((part,) if part in special else words.findall(part))]
        different = list(set(found))
        of = dict(zip(different, ids(different), strict=True))
        return np.frombuffer(b"".join(map(of.__getitem__, found)), "<u4")

    def run(texts: list[str | None]) -> list[np.ndarray]:
        if not texts:
            return []
        texts = [t or "" for t in texts]
        apart = np.array([any(s in t for s in special) for t in texts])
        fields = pc.split_pattern(pa.array(["" if a else t for t, a in zip(texts, apart, strict=True)], pa.large_string()), " ")
        offsets, dealt = np.asarray(fields.offsets, np.int64), fields.values.dictionary_encode()
        unit_of, n = np.asarray(dealt.indices).astype(np.int64), len(dealt.dictionary)
        unit_of[offsets[:-1]] = n + np.arange(len(texts))  # the first field of a text has no space before it
        units = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), dealt.dictionary, pa.scalar("", pa.large_string())), fields.values.take(pa.array(offsets[:-1]))])
        simple = np.asarray(pc.match_substring_regex(units, _SIMPLE))
        others = np.flatnonzero(~simple)
        spaced = np.zeros(len(units), bool)
        cut = []
        for k, u in zip(others, units.take(pa.array(others)).to_pylist(), strict=True):
            spaced[k] = u[-1:].isspace() or k < n and u[1:2].isspace()
            cut.append([] if spaced[k] else words.findall(u))
        apart |= np.logical_or.reduceat(spaced[unit_of], offsets[:-1])

        marked = pc.split_pattern(pc.replace_substring_regex(units.filter(pa.array(simple)), plain, "\\0\x01"), "\x01")
        sizes = np.empty(len(units), np.int64)
        sizes[simple], sizes[others] = np.diff(np.asarray(marked.offsets)), [len(c) for c in cut]
        place = np.empty(len(units), np.int64)  # of a unit's first pre-token, those of plain ones first
        order = np.concatenate([np.flatnonzero(simple), others])
        place[order] = np.cumsum(sizes[order]) - sizes[order]
        found = pa.concat_arrays([marked.values, pa.array([w for c in cut for w in c], pa.large_string())]).dictionary_encode()
        held = ids(found.dictionary.to_pylist())
        length = np.fromiter(map(len, held), np.int64, len(held)) // 4
        word = np.asarray(found.indices)
        tokens = _gathered(np.frombuffer(b"".join(held), "<u4"), (np.cumsum(length) - length)[word], length[word])  # of all units
        upto = np.concatenate([[0], np.cumsum(length[word])])
        first, size = upto[place], upto[place + sizes] - upto[place]
        ends = np.concatenate([[0], np.cumsum(size[unit_of])])[offsets]
        all_ = _gathered(tokens, first[unit_of], size[unit_of])
        return [whole(t) if a else all_[i:j] for t, a, i, j in zip(texts, apart, ends, ends[1:], strict=False)]

    return run


class Chunk:
    """A part of a text as the library encodes it, with offsets: text[at:upto]."""

    def __init__(self, tokenizer, text: str, at: int, upto: int):
        self.at, self.found = at, tokenizer.encode(text[at:upto], add_special_tokens=False)
        self.n = len(self.found)

    def start(self, i: int) -> int:
        return self.at + self.found.token_to_chars(i)[0]

    def first(self, i: int) -> bool:
        """Whether a pre-token or a special string begins here."""
        word = self.found.token_to_word(i)
        return i == 0 or word is None or word != self.found.token_to_word(i - 1)

    def token(self, place: int) -> int:
        """The first token that starts at the place or beyond."""
        return bisect_left(range(self.n), place, key=self.start)

    def boundaries(self, low: int, high: int) -> dict[int, int]:
        """Place to token of every pre-token that starts from low to high."""
        return {self.start(i): i for i in range(self.token(low), self.token(high + 1)) if self.first(i)}

    def any_boundary(self, low: int, high: int) -> bool:
        """Whether a pre-token starts from low to high."""
        i, least = self.token(high + 1) - 1, self.token(low)
        if i < least:
            return False
        word = self.found.token_to_word(i)
        return word is None or self.found.word_to_tokens(word)[0] >= least


def spliced(tokenizer, text: str, chunk: int = 1 << 13, overlap: int = 128) -> Iterator[tuple[Chunk, int, int]]:
    """Chunks and their ranges of tokens that make up the whole text, in order."""
    margin = 2 + max([0, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])  # beyond it a cut can't be seen
    splice, from_token, end = 0, 0, min(chunk, len(text))
    left = Chunk(tokenizer, text, 0, end)
    while end < len(text):
        if not left.any_boundary(splice + 1, end - margin):
            after = min(len(text), end + max(chunk, end - splice))
            left, from_token, end = Chunk(tokenizer, text, splice, after), 0, after
            continue
        after, lap, common = min(len(text), end + chunk), overlap, set()
        while not common:  # an overlap back to the splice has every stable boundary in common
            begin = max(splice, end - lap)
            right = Chunk(tokenizer, text, begin, after)
            low = max(begin, splice + 1)
            mine, theirs = left.boundaries(low, end - margin), right.boundaries(low, end - margin)
            common = mine.keys() & theirs.keys()
            lap *= 4
        splice = max(common)
        yield left, from_token, mine[splice]
        left, from_token, end = right, theirs[splice], after
    yield left, from_token, left.n


def spliced_ids(tokenizer, text: str, chunk: int = 1 << 13, overlap: int = 128) -> np.ndarray:
    return np.array([i for part, a, b in spliced(tokenizer, text, chunk, overlap) for i in part.found.ids[a:b]], np.uint32)


def count_tokens(docs: DataFrame, json_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = 1 << 13) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit, spliced (went by overlapping chunks) for each row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids keep a row each; an empty table gives none;
    other columns are ignored. Texts above `chunk` characters go by overlapping chunks.
    """

    def run(rows: dict) -> dict:
        texts, tokenizer = [t or "" for t in rows[text_col]], library(json_path)
        short = iter(word_encoder(json_path)([t for t in texts if len(t) <= chunk]))
        n = [len(next(short)) if len(t) <= chunk else sum(b - a for _, a, b in spliced(tokenizer, t, chunk)) for t in texts]
        return {
            "doc_id": pa.array(rows[id_col], pa.int64()), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()),
            "over_limit": pa.array([x > limit for x in n], pa.bool_()), "spliced": pa.array([len(t) > chunk for t in texts], pa.bool_()),
        }

    return map_columns(docs, [id_col, text_col], "doc_id long, n_bytes long, n_tokens long, over_limit boolean, spliced boolean", run)
