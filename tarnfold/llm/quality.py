"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's terms are trigrams of the shapes of its characters, its words (hashed), and how its words repeat; they are weighted by inverse document
frequency and projected on the leading singular directions of a bounded labelled sample. Every document's vector is
held against all labelled vectors in blocks of exact cosine products, and its nearest neighbours vote, weighted by likeness.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import given_back, map_columns, slices

TERMS = 1280
_EXTRA = 64  # of them for the repetition of words
_SHAPED = 960
_WORDED = TERMS - _EXTRA - _SHAPED
#: What words weigh beside shapes.
WORD_WEIGHT = 0.1
#: Shape of each byte: lower case, upper case, digit, space, line end and byte beyond ASCII are one each, and each sign is its own.
_SHAPES = bytes(
    1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b == 32 else 5 if b in (10, 13) else 6 if b >= 128 else 7 if b < 33 or b == 127 else 8 + sorted(set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123))).index(b)
    for b in range(256)
)
_N = 40
_TABLE = ((np.arange(_N**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % _SHAPED


def term_counts(text: str | None) -> np.ndarray:
    """Relative frequencies of terms over the whole text; no words give zeros."""
    raw = (text or "").encode()
    words = raw.split()
    out = np.zeros(TERMS, np.float32)
    if not words:
        return out
    shape = np.frombuffer(raw.translate(_SHAPES), np.uint8).astype(np.int32)
    for i in range(0, max(1, len(shape) - 2), 1 << 20):
        part = shape[i : i + (1 << 20) + 2]
        if len(part) > 2:
            out[:_SHAPED] += np.bincount(_TABLE[(part[:-2] * _N + part[1:-1]) * _N + part[2:]], minlength=_SHAPED)
    out /= max(1.0, out.sum())
    n = len(words)
    each = Counter(words)
    at = np.fromiter(map(zlib.crc32, each), np.int64, len(each)) % _WORDED
    out[_SHAPED : _SHAPED + _WORDED] = np.bincount(at, np.fromiter(each.values(), np.float64, len(each)), _WORDED) * (WORD_WEIGHT / n)
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    again = 1 - len(each) / n
    pairs = 1 - len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    twice = 1 - len(set(lines)) / len(lines)
    upper = sum(map(bytes.isupper, words)) / n
    alone = sum(len(w) == 1 for w in words) / n
    size = min(20, int(np.log2(n))) if n else 0
    at = TERMS - _EXTRA
    for k, (value, weight) in enumerate(((same, 1.0), (again * again, 0.3), (pairs, 1.0), (twice, 0.5), (upper, 0.5), (alone, 0.3))):
        out[at + k] = value * weight
    out[at + 16 + size] = 0.02
    return out


@dataclass
class Model:
    """idf of terms, projection to the latent space, and the labelled vectors with their labels."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        latent = np.sqrt(counts) * self.idf @ self.projection
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int) -> Model:
    """A model from the sample's term counts, a row each; labels 0 and 1."""
    seen = (counts > 0).sum(axis=0)
    idf = (np.log((1 + len(counts)) / (1 + seen)) + 0.3).astype(np.float32)
    weighted = np.sqrt(counts) * idf
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
    values, directions = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    projection = np.ascontiguousarray(directions[:, np.argsort(-values)[:dimensions]]).astype(np.float32)
    model = Model(idf, projection, np.empty((0, dimensions), np.float32), labels.astype(np.float32))
    model.vectors = model.project(counts)
    return model


def vote(model: Model, counts: np.ndarray, neighbours: int, power: float, block: int = 2048) -> np.ndarray:
    """Scores of rows of counts: the labels of the nearest labelled vectors, weighted by a power of the cosine. No words, or no labels, give 0."""
    latent = model.project(counts)
    k = min(neighbours, len(model.labels))
    scores = np.zeros(len(counts))
    if not k:
        return scores
    best = np.full((len(counts), k), -np.inf, np.float32)
    label = np.zeros((len(counts), k), np.float32)
    for i in range(0, len(model.labels), block):
        near = latent @ model.vectors[i : i + block].T
        held = np.concatenate((best, near), axis=1)
        labels = np.concatenate((label, np.broadcast_to(model.labels[i : i + block], near.shape)), axis=1)
        top = np.argpartition(-held, k - 1, axis=1)[:, :k]
        best, label = np.take_along_axis(held, top, 1), np.take_along_axis(labels, top, 1)
    weight = np.maximum(best, 0).astype(np.float64) ** power
    total = weight.sum(axis=1)
    some = (total > 0) & (counts.sum(axis=1) > 0)
    scores[some] = (weight * label).sum(axis=1)[some] / total[some]
    return np.clip(scores, 0, 1)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 4000, dimensions: int = 64, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most `sample` labelled documents, half of them of each label where there are as many.

    Only ids whose crc32 as text isn't divisible by 5 are learned from. Of the texts of a repeated id the least counts. The sample is the labelled ids with the smallest
    seeded hashes, so its size and what the driver and each task hold are bounded by `sample`, whatever the input.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    one = usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("label"))
    order = [F.xxhash64(F.lit("quality"), "doc_id"), F.col("doc_id")]
    picked = {r["doc_id"]: r["label"] for v in (0, 1) for r in one.filter(F.col("label") == v).orderBy(*order).limit(sample // 2).collect()}
    spark = docs.sparkSession
    if not picked:
        return fit(np.zeros((0, TERMS), np.float32), np.zeros(0), dimensions)
    ids = spark.createDataFrame(list(picked.items()), "doc_id long, label int")  # at most `sample` rows
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(rows: dict) -> dict:
        return {"doc_id": pa.array(rows["doc_id"], pa.int64()), "counts": pa.array([term_counts(t).tobytes() for t in rows["text"]], pa.binary())}

    found = sorted((r["doc_id"], r["counts"]) for r in map_columns(texts, ["doc_id", "text"], "doc_id long, counts binary", run).collect())
    counts = np.frombuffer(b"".join(c for _, c in found), np.float32).reshape(-1, TERMS)
    return fit(counts, np.array([picked[d] for d, _ in found]), dimensions)


def score(docs: DataFrame, model: Model, neighbours: int = 10, power: float = 8.0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null and empty texts have score 0, as do all texts where nothing was labelled; repeated rows and null ids (held_out
    is then null) keep a row each; an empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict) -> dict:
        scores = np.concatenate([vote(held.value, np.stack([term_counts(t) for t in rows[text_col][i : i + 256]]), neighbours, power) for i in range(0, len(rows[text_col]), 256)])
        return {
            "doc_id": pa.array(rows[id_col], pa.int64()), "held_out": pa.array([None if d is None else zlib.crc32(str(d).encode()) % 5 == 0 for d in rows[id_col]], pa.bool_()),
            "score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= threshold).astype(np.int32), pa.int32()),
        }

    return map_columns(docs, [id_col, text_col], "doc_id long, held_out boolean, score double, predicted int", run)


def keep_good(docs: DataFrame, labels: DataFrame, neighbours: int = 10, power: float = 8.0, threshold: float = 0.3, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns; one pass, and no row leaves its partition."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, **options))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 256):
                good = vote(held.value, np.stack([term_counts(t) for t in batch.column(text_col).to_pylist()]), neighbours, power) >= threshold
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(given_back(run), docs.schema)
