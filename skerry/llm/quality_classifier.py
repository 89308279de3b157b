"""Operator 1: a supervised subword-embedding classifier of document quality.

Every document is the average of learned vectors, one for each of its hashed features (words, pairs of neighbouring
words, character n-grams inside words); a softmax over two classes reads that average. Training is plain numpy
stochastic gradient descent on a bounded sample of labelled rows. Since averaging and the output layer are linear, the
model that scores is one number per hash bucket, a table of fixed size, and scoring is a map over whole texts.

Defined results: null and empty texts score as the bias alone; a null doc_id is not held out; null or other labels than
0 and 1 are ignored; conflicting labels of one document count as its smallest; with no usable label every score is 0.5.
Extra columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import materialize, table
from skerry.llm.workers import free, tidy

NGRAM_MIN, NGRAM_MAX = 3, 4
#: Words kept in a worker's feature cache before it starts afresh.
CACHE_WORDS = 400_000
#: The same while the sample's features are made.
TRAIN_WORDS = 20_000
SAME = zlib.crc32(b"\x00 same word again")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Settings:
    """sample_rows and sample_bytes (of features) bound what training reads of the labelled documents; everything else scores all rows."""

    sample_rows: int = 4000
    sample_bytes: int = 64 << 20
    bits: int = 18
    dim: int = 8
    epochs: int = 5
    rate: float = 0.5
    seed: int = 7


def word_features(word: bytes, mask: int) -> list[int]:
    """Buckets of a word and of the character n-grams of <word>."""
    framed = b"<" + word + b">"
    out = [zlib.crc32(framed) & mask]
    for n in range(NGRAM_MIN, NGRAM_MAX + 1):
        out += [zlib.crc32(framed[i : i + n], n) & mask for i in range(len(framed) - n + 1)]
    return out


def _pairs(ids: np.ndarray, mask: int) -> np.ndarray:
    """Buckets of neighbouring words; a word that repeats its neighbour has one bucket, whatever the word."""
    mixed = (ids[:-1] * _M1) ^ (ids[1:] * _M2)
    buckets = ((mixed ^ (mixed >> np.uint64(31))) & np.uint64(mask)).astype(np.int64)
    buckets[ids[:-1] == ids[1:]] = SAME & mask
    return buckets


def document_features(text: bytes, mask: int, cache: dict[bytes, tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and how often each occurs, in few bytes, as training holds all of its sample."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.uint16)
    if len(cache) > TRAIN_WORDS:
        cache.clear()
    for w in set(words):
        if w not in cache:
            cache[w] = (zlib.crc32(w), np.array(word_features(w, mask), np.int32))
    known = [cache[w] for w in words]
    ids = np.array([x[0] for x in known], np.uint64)
    buckets, counts = np.unique(np.concatenate([*(x[1] for x in known), _pairs(ids, mask).astype(np.int32)]), return_counts=True)
    return buckets, counts.astype(np.uint16 if counts.max() < 2**16 else np.uint32)


def train(texts: list[bytes], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, output layer and bias by SGD on averaged vectors with a softmax output.

    A document's gradient of a vector is its bucket's share of the document's features times that of the average. The step
    along it is normalised by the sum of squared shares, so that one step moves the average alike for short and long texts."""
    cache: dict = {}
    return descend([document_features(t, (1 << s.bits) - 1, cache) for t in texts], labels, s)


def descend(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """train() for documents given as their distinct buckets and counts."""
    rng = np.random.default_rng(s.seed)
    vectors = (rng.random((1 << s.bits, s.dim), np.float32) - 0.5) / s.dim
    out, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, s.epochs * len(docs)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(docs)):
            buckets, counts = docs[i]
            rate = s.rate * (1 - done / steps)
            done += 1
            share = (counts / max(1, int(counts.sum()))).astype(np.float32)
            hidden = share @ vectors[buckets] if len(buckets) else np.zeros(s.dim, np.float32)
            error = softmax(out @ hidden + bias)
            error[labels[i]] -= 1
            back = out.T @ error
            out -= rate * np.outer(error, hidden)
            bias -= rate * error * 0.1
            if len(buckets):
                vectors[buckets] -= np.float32(rate / (share @ share)) * share[:, None] * back
    return vectors, out, bias


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint16) if not len(counts) or counts.max() < 2**16 else counts


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max())
    return p / p.sum()


def folded(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, float]:
    """What scoring needs of a model: the difference of the classes' logits per bucket, and of the biases."""
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


class _Scores(dict):
    """word -> slot, filled on first sight; a slot has the word's id, the sum of its features' weights and their number."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.mask = weights, len(weights) - 1
        self.ids, self.sums = np.zeros(1024, np.uint64), np.zeros((1024, 2))

    def __missing__(self, word: bytes) -> int:
        slot = len(self)
        if slot == len(self.ids):
            self.ids, self.sums = np.concatenate([self.ids, self.ids]), np.concatenate([self.sums, self.sums])
        f = word_features(word, self.mask)
        self.ids[slot], self.sums[slot] = zlib.crc32(word), (self.weights[f].sum(dtype=np.float64), len(f))
        self[word] = slot
        return slot


def score_text(text: bytes, known: _Scores, bias: float) -> float:
    words = text.split()
    if not words:
        z = bias
    else:
        slots = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        pairs = _pairs(known.ids[slots], known.mask)
        total, size = known.sums[slots].sum(axis=0)
        z = (total + known.weights[pairs].sum(dtype=np.float64)) / (size + len(pairs)) + bias
    return float(1 / (1 + np.exp(-z)))


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_hash, quality, buckets, counts) of at most s.sample_rows labelled rows outside the held-out fold, chosen by a hash of the id.

    Tasks make the features of whole texts, so that no text leaves them; stored, as the driver asks for sizes first."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            found = [document_features(t or b"", (1 << s.bits) - 1, cache) for t in b.column("text").cast(pa.binary()).to_pylist()]
            parts = [pa.array([x.tobytes() for x in part], pa.binary()) for part in ([f[0].astype(np.int32) for f in found], [f[1].astype(np.uint32) for f in found])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("quality"), *parts], ["doc_id", "text_hash", "quality", "buckets", "counts"])

    # broadcast is bounded by sample_rows; repeated ids in docs are cut back to that bound as well
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text_hash", "quality", "text")
    made = rows.mapInArrow(tidy(run), "doc_id long, text_hash long, quality int, buckets binary, counts binary")
    return materialize(made.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(s.sample_rows), "sample")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> tuple[np.ndarray, float]:
    s = settings or Settings()
    if not s.sample_rows:
        return np.zeros(1 << s.bits, np.float32), 0.0
    sample = labelled_sample(docs, labels, s).withColumn("place", F.xxhash64("doc_id"))
    sizes = sample.select("place", "doc_id", "text_hash", (F.length("buckets") + F.length("counts")).alias("size")).toPandas().sort_values(["place", "doc_id", "text_hash"])  # at most sample_rows
    sizes = sizes[sizes["size"].cumsum() <= s.sample_bytes]
    if not len(sizes):
        return np.zeros(1 << s.bits, np.float32), 0.0
    last = tuple(int(sizes.iloc[-1][c]) for c in ("place", "doc_id", "text_hash"))
    within = F.struct("place", "doc_id", "text_hash") <= F.struct(*(F.lit(x).cast("long").alias(c) for x, c in zip(last, ("place", "doc_id", "text_hash"), strict=True)))
    rows = sample.where(within).select("doc_id", "text_hash", "quality", "buckets", "counts").toPandas().sort_values(["doc_id", "text_hash"])
    features = [(np.frombuffer(b, np.int32), _small(np.frombuffer(c, np.uint32))) for b, c in zip(rows["buckets"], rows["counts"], strict=True)]
    labels_ = rows["quality"].to_numpy(np.int64)
    del rows
    model = folded(*descend(features, labels_, s))
    free()  # the sample's features
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """Every row's doc_id, held_out, score and predicted; one pass, no shuffle."""
    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(tidy(_scorer(docs, model)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all their columns, that the model predicts to be of quality; one pass, no shuffle and no join."""
    weights = docs.sparkSession.sparkContext.broadcast(model[0])
    bias = model[1]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(weights.value)
        for b in batches:
            if len(known) > CACHE_WORDS:
                known.clear()
            kept = [score_text(t or b"", known, bias) >= threshold for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def _scorer(docs: DataFrame, model: tuple[np.ndarray, float]):
    weights = docs.sparkSession.sparkContext.broadcast(model[0])
    bias = model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(weights.value)
        for b in batches:
            if len(known) > CACHE_WORDS:
                known.clear()
            scores = [score_text(t or b"", known, bias) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    return score(docs, fit(docs, labels, settings))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
