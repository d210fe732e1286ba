"""Text quality: random-indexing word vectors, pooled, and a small calibrated network.

Words (runs of letters and digits, and each other printed character) fall into
hash buckets. A bucket has a sparse random index vector; its word vector is the
sum of the index vectors found within two words of it, over the whole corpus.
A document is the mean, rarity-weighted mean and spread of its words' vectors.
A two-layer network turns that into a probability; its temperature is fitted on
labelled rows kept out of the training.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.tables import carried, id_remainder, utf8

BUCKETS = 1 << 13
DIMENSIONS = 64
NONZERO = 4
WINDOW = 2
# Labelled rows the network is fitted on, at most: those with the smallest hashed ids.
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 40
# Bytes of text looked at together.
STRETCH = 1 << 20

_BYTE = np.arange(256)
_SPACE = (_BYTE <= 32) | (_BYTE == 127)
_WORD = (
    ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
)
_POWERS = np.cumprod(np.full(64, 0x01000193, np.uint32), dtype=np.uint32)


def word_buckets(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each word of a UTF-8 text, in order."""
    data = np.frombuffer(text, np.uint8)
    word = _WORD[data]
    begins = ~_SPACE[data]
    begins[1:] &= ~(word[1:] & word[:-1])
    (starts,) = np.nonzero(begins)
    if not len(starts):
        return np.empty(0, np.int32)
    lengths = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    value = np.where(_SPACE[data], 0, data + 1).astype(np.uint32)[starts[0] :] * _POWERS[place & 63]
    hashed = np.add.reduceat(value, starts - starts[0], dtype=np.uint32)
    hashed = (hashed ^ (hashed >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (hashed >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int32)


def stretches(texts: list[bytes], limit: int = STRETCH) -> Iterator[tuple[int, bytes]]:
    """(number, text) of each text; long ones in parts cut at white space where there is any."""
    for i, text in enumerate(texts):
        a = 0
        while len(text) - a > limit:
            cut = max(text.rfind(b" ", a + 1, a + limit), text.rfind(b"\n", a + 1, a + limit))
            cut = cut if cut > a else a + limit
            yield i, text[a:cut]
            a = cut
        yield i, text[a:]


@functools.lru_cache(maxsize=2)
def index_vectors(buckets: int = BUCKETS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector; the last row, for no word, is empty."""
    random = np.random.default_rng(seed)
    places = random.integers(0, DIMENSIONS, (buckets + 1, NONZERO))
    signs = random.choice([-1.0, 1.0], (buckets + 1, NONZERO))
    signs[buckets] = 0
    return places, signs


@dataclass
class WordVectors:
    vectors: np.ndarray  # buckets x dimensions, unit length
    weights: np.ndarray  # small for frequent buckets


def word_vectors(docs: DataFrame, buckets: int = BUCKETS) -> WordVectors:
    """Random-indexing vectors from every word of every text. At most ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(buckets)
        total = np.zeros((buckets + 1) * DIMENSIONS)
        seen = np.zeros(buckets + 1, np.int64)

        def add(rows: list[np.ndarray]) -> None:
            ids = np.concatenate(rows)
            np.add(seen, np.bincount(ids, minlength=buckets + 1), out=seen)
            for off in range(1, WINDOW + 1):
                for own, other in ((ids[off:], ids[:-off]), (ids[:-off], ids[off:])):
                    for j in range(NONZERO):
                        spot = own * DIMENSIONS + places[other, j]
                        np.add(total, np.bincount(spot, signs[other, j], len(total)), out=total)

        gap = np.full(WINDOW, buckets, np.int32)
        rows, size = [gap], 0
        for batch in batches:
            for _, part in stretches(batch["text"].to_pylist()):
                rows += [word_buckets(part, buckets), gap]
                size += len(part)
                if size >= 4 * STRETCH:
                    add(rows)
                    rows, size = [gap], 0
        add(rows)
        (used,) = np.nonzero(seen[:buckets])
        vectors = total.reshape(buckets + 1, DIMENSIONS)[used].astype(np.int64)
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(used.astype(np.int32)),
                "n": pa.array(seen[used]),
                **{f"v{k}": pa.array(vectors[:, k]) for k in range(DIMENSIONS)},
            }
        )

    numbers = ["n", *[f"v{k}" for k in range(DIMENSIONS)]]
    fields = "bucket int, " + ", ".join(f"{c} long" for c in numbers)
    summed = (
        docs.select(utf8().alias("text"))
        .mapInArrow(count, fields)
        .groupBy("bucket")
        .agg(*[F.sum(c).alias(c) for c in numbers])
    )
    table = np.zeros((buckets, DIMENSIONS + 1))
    for r in summed.collect():
        table[r[0]] = r[1:]
    n, context = table[:, 0], table[:, 1:]
    share = n / max(n.sum(), 1)
    # The direction all words share tells none apart.
    length = np.linalg.norm(context, axis=1, keepdims=True)
    unit = context / np.maximum(length, 1)
    common = share @ unit
    unit = unit - common
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    return WordVectors(unit.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32))


def pooled(texts: list[bytes], words: WordVectors) -> np.ndarray:
    """A row per text: mean, weighted mean and spread of its words' vectors; zeros where it has no word."""
    buckets = len(words.vectors)
    sums = np.zeros((len(texts), 3, DIMENSIONS))
    count, weight = np.zeros(len(texts)), np.zeros(len(texts))
    for i, part in stretches(texts, STRETCH // 4):
        ids = word_buckets(part, buckets)
        if len(ids):
            vectors, w = words.vectors[ids], words.weights[ids]
            sums[i] += vectors.sum(axis=0), w @ vectors, np.einsum("ij,ij->j", vectors, vectors)
            count[i] += len(ids)
            weight[i] += w.sum()
    n = np.maximum(count, 1)[:, None]
    mean = sums[:, 0] / n
    spread = np.sqrt(np.maximum(sums[:, 2] / n - mean**2, 0))
    return np.hstack([mean, sums[:, 1] / np.maximum(weight, 1e-9)[:, None], spread]).astype(np.float32)


@dataclass
class Network:
    """Two layers over standardised inputs, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> Network:
    """Trained by Adam on four fifths of the rows; the temperature fits the last fifth.

    Without rows the probability is one half everywhere.
    """
    random = np.random.default_rng(seed)
    width = x.shape[1]
    layers = [
        random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())
    ]
    if not len(x):
        return Network(np.zeros(width), np.ones(width), [np.zeros_like(p) for p in layers])
    x = x.astype(np.float64)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, layers)
    order = random.permutation(len(x))
    kept, train = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - net.mean) / net.scale
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    step = 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        random.shuffle(train)
        for a in range(0, len(train), 128):
            own = train[a : a + 128]
            hidden = np.tanh(z[own] @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-(hidden @ layers[2] + layers[3]))) - y[own]) / len(own)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            slopes = [z[own].T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ error + 1e-4 * layers[2], error.sum()]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                layers[k] = layers[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    if len(kept):
        logits = net.logits(x[kept])
        net.temperature = min((_loss(logits / t, y[kept]), t) for t in np.geomspace(0.25, 8, 60))[1]
    return net


@dataclass
class QualityModel:
    words: WordVectors
    network: Network

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.network.probability(pooled(texts, self.words))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Word vectors from all ``docs``; the network from ``labels`` (doc_id, quality), ``sample`` rows at most.

    Rows with a null id or quality, or an id that ``docs`` lacks, teach nothing.
    """
    words = word_vectors(docs)
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna()
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(rows), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch["text"].to_pylist(), sent.value)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [r.tobytes() for r in x]}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(features, f"doc_id {kind}, quality int, x binary")
    # One row for each of the labels, however often the table of documents repeats an id.
    found = found.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id", "quality").collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in found]).reshape(-1, 3 * DIMENSIONS)
    return QualityModel(words, fit_network(x, np.array([float(r.quality == 1) for r in found])))


def score(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """Add the probability of good quality, from the text alone, to every row.

    Null and empty texts get what the network gives a text without words.
    Other columns pass through, a column of this name is replaced, and
    repeated rows are kept.
    """
    docs = docs.drop(column)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch["text"].to_pylist()]
            columns = {n: batch[n] for n in names} | {column: pa.array(sent.value.score(texts))}
            yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(scores, f"{fields}, {column} double")


def accepted(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    scored = score(carried(docs, "text"), model)
    return scored.filter(F.col("score") >= least).select("kept.*")


def held_out() -> Column:
    """Documents whose labels nothing is learned from: a third, by their id."""
    return id_remainder("doc_id", 3) == 1


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out and score every document."""
    model = fit(docs, labels.filter(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
