"""Language of texts: multinomial naive Bayes over hashed character n-grams.

Counts per language and bucket are taken over all documents that may be learned
from; the matrix of log-probabilities (languages x buckets) goes to every task
and scores batches of documents as sparse rows: the buckets that a text uses and
how often. More languages than one matrix holds are scored in blocks of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.tables import id_remainder, stored

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
# The matrix sent to every task has at most so many rows of BUCKETS 4-byte numbers; more languages go in blocks.
MOST_LANGUAGES = 512
SMOOTHING = 0.5
UNKNOWN = "und"
# Characters looked at together; longer texts are read in such stretches.
STRETCH = 1 << 19


def gram_buckets(text: str, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the lower-cased text, stretch by stretch."""
    text = text.lower()
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for a in range(0, len(text), STRETCH):
        piece = text[a : a + STRETCH + max(sizes) - 1]
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        hashed = np.zeros(len(points), np.uint32)
        for n in range(1, max(sizes) + 1):
            hashed = (hashed[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(2654435761)
            if n in sizes and len(hashed):
                yield ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(2246822519 + 2 * n) >> shift)[:STRETCH]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def stretches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts to be scored together."""
    a = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= STRETCH or i + 1 == len(texts):
            yield a, i + 1
            a, size = i + 1, 0


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, log-probabilities
    prior: np.ndarray

    def logs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each language, and whether the text has a letter."""
        logs = np.tile(self.prior.astype(np.float64), (len(texts), 1))
        known = np.array([bool(self.languages) and has_letter(t) for t in texts], bool)
        for i in np.flatnonzero(known):
            counts = np.zeros(len(self.weights), np.int64)
            for part in gram_buckets(texts[i], len(self.weights)):
                counts += np.bincount(part, minlength=len(self.weights))
            used = np.flatnonzero(counts)
            logs[i] += counts[used] @ self.weights[used]
        return logs, known

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Likeliest language and its posterior; without a letter ``und`` and 0."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logs, known = self.logs(texts)
        best = logs.argmax(axis=1)
        posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, np.where(known, posterior, 0.0)


@dataclass
class LanguageBlocks:
    """More languages than one matrix holds: counts stay a table (lang, bucket, n), models are made block by block."""

    counted: DataFrame
    documents: dict[str, int]
    buckets: int
    most: int

    def models(self) -> Iterator[LanguageModel]:
        """Models of ``most`` languages each, in order of name; priors are those of all."""
        languages, every = sorted(self.documents), sum(self.documents.values())
        for a in range(0, len(languages), self.most):
            own = languages[a : a + self.most]
            within = F.col("lang").between(own[0], own[-1])
            # One row a language; each holds at most as many counts as there are buckets.
            listed = F.collect_list(F.struct("bucket", "n")).alias("counts")
            found = {r.lang: r.counts for r in self.counted.filter(within & (F.col("bucket") >= 0)).groupBy("lang").agg(listed).collect()}
            weights = np.full((self.buckets, len(own)), SMOOTHING)
            for k, lang in enumerate(own):
                for bucket, n in found.get(lang, []):
                    weights[bucket, k] += n
            weights = np.log(weights / weights.sum(axis=0)).astype(np.float32)
            yield LanguageModel(own, weights, np.log(np.array([self.documents[x] for x in own], float) / every))


def fit(labelled: DataFrame, buckets: int = BUCKETS, most: int = MOST_LANGUAGES) -> LanguageModel | LanguageBlocks:
    """Model from text and lang of all rows; rows where either is null teach nothing.

    More than ``most`` languages give a model by blocks. The driver sees the
    languages' names and the counts of one block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                (used,) = np.nonzero(counts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang] * (len(used) + 1), pa.string()),
                        "bucket": pa.array(np.append(used, -1).astype(np.int32)),
                        "n": pa.array(np.append(counts[used], docs[lang])),
                    }
                )
            found.clear()
            docs.clear()

        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                if lang not in found:
                    if len(found) == most:
                        yield from emptied()
                    found[lang], docs[lang] = np.zeros(buckets, np.int64), 0
                docs[lang] += 1
                for part in gram_buckets(text, buckets):
                    found[lang] += np.bincount(part, minlength=buckets)
        yield from emptied()

    rows = labelled.select("text", "lang").dropna()
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = stored(counted, "langid-counts")
    documents = {r.lang: r.n for r in counted.filter("bucket < 0").collect()}
    blocks = LanguageBlocks(counted, documents, buckets, most)
    if len(documents) > most:
        return blocks
    return next(blocks.models(), LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0)))


def _mapped(rows: DataFrame, model: LanguageModel, make: Callable, fields: str) -> DataFrame:
    """Rows with what ``make`` gives for stretches of texts."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in stretches(batch["text"].to_pylist()):
                yield pa.RecordBatch.from_pydict(make(sent.value, batch.slice(a, b - a)))

    return rows.mapInArrow(score, fields)


def _scored(model: LanguageModel, batch: pa.RecordBatch) -> dict:
    names, scores = model.score(batch["text"].to_pylist())
    return {"doc_id": batch["doc_id"], "lang_pred": pa.array(names, pa.string()), "score": scores}


def _bettered(model: LanguageModel, batch: pa.RecordBatch) -> dict:
    """The best language so far, its logarithm and that of the sum over all so far."""
    logs, known = model.logs(batch["text"].to_pylist())
    best, top = logs.argmax(axis=1), batch["top"].to_numpy()
    highest = logs.max(axis=1)
    summed = highest + np.log(np.exp(logs - highest[:, None]).sum(axis=1))
    names = [
        model.languages[b] if k and h > t else old
        for b, k, h, t, old in zip(best, known, highest, top, batch["lang_pred"].to_pylist())
    ]
    return {
        "doc_id": batch["doc_id"],
        "text": batch["text"],
        "lang_pred": pa.array(names, pa.string()),
        "top": np.maximum(top, highest),
        "every": np.logaddexp(batch["every"].to_numpy(), summed),
    }


def predict(docs: DataFrame, model: LanguageModel | LanguageBlocks) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone.

    Null, empty and letterless texts are ``und`` with score 0, as is
    everything when the model knows no language. Ties go to the language first
    by name. Repeated rows are kept. A model by blocks reads the texts once a
    block and keeps the best language and the sum over all as it goes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if isinstance(model, LanguageModel):
        return _mapped(docs.select("doc_id", "text"), model, _scored, f"doc_id {kind}, lang_pred string, score double")
    least = F.lit(float("-inf"))
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang_pred"), least.alias("top"), least.alias("every"))
    for block in model.models():
        fields = f"doc_id {kind}, text string, lang_pred string, top double, every double"
        rows = stored(_mapped(rows, block, _bettered, fields), "langid-best")
    known = F.col("lang_pred").isNotNull()
    return rows.select(
        "doc_id",
        F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(known, F.exp(F.col("top") - F.col("every"))).otherwise(0.0).alias("score"),
    )


def held_out() -> Column:
    """Documents that nothing is learned from: a fifth, by their id."""
    return id_remainder("doc_id", 5) == 0


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and predict every one."""
    model = fit(docs.filter(~held_out()).select("text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
