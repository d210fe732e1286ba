"""Mixing documents to target weights by soft domain membership.

A classifier learned from a labelled table gives every document a posterior over
the domains. Document i then brings p(i, d) of its tokens to domain d, and the
mix asks for rates r(i) from 0 to ``most`` (which may be infinite) such that the expected totals, the sums of
r(i) tokens(i) p(i, d), are the target shares of the budget. The rates minimise the squared
miss, weighted by the inverse of the domains' overlap matrix
sum of tokens(i) p(i) p(i)', by projected gradient steps, in which documents weigh
by their tokens; with that metric the step of length 1 is safe, and it is exact
at once where no rate meets its bounds. A step needs one sum over all documents
and moves a vector with an entry per domain; a document finds its rate again
from the steps so far, so no step writes anything.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.tables import carried, stored, utf8

BUCKETS = 2048
# Labelled documents the classifier is fitted on, at most: those with the smallest hashed ids.
SAMPLE = 6000
EPOCHS = 150
# Steps at most, and the relative move of the totals in a step at which they have settled; a miss left then is reported.
STEPS = 60
SETTLED = 1e-6
# Relative miss at which the steps stop.
CLOSE = 1e-4
STRETCH = 1 << 20
# Shares asked of the query and the pipeline.
TARGETS = {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.14}


def features(text: bytes) -> tuple[np.ndarray, int]:
    """Hashed byte-pair profile of unit length, and the number of words between white space."""
    counts, words, last = np.zeros(BUCKETS, np.int64), 0, 32
    for a in range(0, len(text), STRETCH):
        data = np.frombuffer(text, np.uint8, min(STRETCH, len(text) - a), a)
        before = np.concatenate([np.array([last], np.uint8), data[:-1]])
        pair = (before.astype(np.uint32) << np.uint32(8) | data) * np.uint32(2654435761)
        counts += np.bincount(pair >> np.uint32(21), minlength=BUCKETS)
        space, was = data <= 32, before <= 32
        words += int(np.count_nonzero(~space & was))
        last = data[-1]
    profile = np.sqrt(counts)
    return (profile / max(np.linalg.norm(profile), 1)).astype(np.float32), words


@dataclass
class DomainModel:
    """Softmax regression; ``temperature`` is fitted on labelled rows kept aside."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def posterior(self, x: np.ndarray) -> np.ndarray:
        logits = (x @ self.weights + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit_domains(labelled: DataFrame, domains: list[str]) -> DomainModel:
    """Learn from text and domain of a bounded sample; other domains and nulls teach nothing.

    Without any such row all domains are equally likely everywhere.
    """
    rows = labelled.filter(F.col("domain").isin(domains)).select(utf8().alias("text"), "domain")

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py())[0].tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_pydict({"domain": batch["domain"], "x": pa.array(x, pa.binary())})

    found = rows.mapInArrow(profile, "domain string, x binary").collect()
    weights, bias = np.zeros((BUCKETS, len(domains))), np.zeros(len(domains))
    model = DomainModel(domains, weights, bias)
    if not found:
        return model
    found.sort(key=lambda r: (r.domain, r.x))
    order = np.random.default_rng(5).permutation(len(found))
    x = np.array([np.frombuffer(found[i].x, np.float32) for i in order])
    y = np.array([[found[i].domain == d for d in domains] for i in order], np.float32)
    del found
    cut = max(1, len(x) * 4 // 5)
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(EPOCHS):  # profiles have unit length: steps of this size with momentum settle
        error = (model.posterior(x[:cut]) - y[:cut]) / cut
        speed_w, speed_b = 0.9 * speed_w + x[:cut].T @ error, 0.9 * speed_b + error.sum(axis=0)
        weights -= 2.0 * speed_w
        bias -= 2.0 * speed_b
    if cut < len(x):

        def loss(t: float) -> float:
            p = DomainModel(domains, weights, bias, t).posterior(x[cut:])
            return -float(np.log(np.maximum((p * y[cut:]).sum(axis=1), 1e-300)).mean())

        model.temperature = min(np.geomspace(0.2, 5, 40), key=loss)
    return model


def memberships(docs: DataFrame, model: DomainModel, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``kept``, tokens (words) and p (posterior over the model's domains) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                own = batch.slice(a, 512)
                seen = [features(t.as_py()) for t in own["_bytes"]]
                p = sent.value.posterior(np.array([x for x, _ in seen], np.float64))
                columns = {c: own[c] for c in kept} | {
                    "tokens": pa.array([n for _, n in seen], pa.int64()),
                    "p": pa.array(list(p), pa.list_(pa.float64())),
                }
                yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept, utf8().alias("_bytes")).mapInArrow(read, f"{fields}, tokens long, p array<double>")


@dataclass
class Mix:
    domains: list[str]
    wanted: np.ndarray  # tokens of each domain
    start: float  # rate that all documents begin with
    most: float
    steps: list[np.ndarray]  # what each step takes off a document: its posterior times this, clipped
    miss: np.ndarray | None = None  # tokens of each domain above what is wanted, at the last step

    def rate(self, p: Column) -> Column:
        """A document's rate, by the steps in turn."""
        rate = F.lit(self.start)
        if not self.steps:
            return rate
        rows = F.from_json(F.lit(str([s.tolist() for s in self.steps])), "array<array<double>>")

        def step(r: Column, g: Column) -> Column:
            down = F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            return F.least(F.lit(self.most), F.greatest(F.lit(0.0), r - down))

        return F.aggregate(rows, rate, step)


# The least part of the tokens that a scarce domain may hold the mix to.
FLOOR = 0.5


def _totals(members: DataFrame, rate: Column, n: int) -> np.ndarray:
    sums = [F.sum(rate * F.col("tokens") * F.get("p", F.lit(i))).alias(f"t{i}") for i in range(n)]
    return np.array([x or 0.0 for x in members.agg(*sums).first()])


def _reachable(domains: list[str], share: np.ndarray, have: np.ndarray, most: float, floor: float) -> np.ndarray:
    """Tokens per domain: as many as the scarcest one allows, but for those that would hold the mix below ``floor``.

    Such domains are served with all they have, and the others keep their
    shares among themselves.
    """
    every, scarce = float(have.sum() * min(most, 1.0)), np.zeros(len(share), bool)
    while True:
        given = np.where(scarce, have * min(most, 1.0), 0.0)
        rest, left = np.where(scarce, 0.0, share), every - given.sum()
        if not rest.sum():
            return given
        rest = rest / rest.sum()
        reach = np.full(len(have), np.inf)
        some = (rest > 0) & (have > 0)
        reach[some] = most * have[some] / rest[some]
        if floor:
            reach[(rest > 0) & (have <= 0)] = 0.0
        new = reach < floor * left
        if not new.any():
            break
        warnings.warn(
            f"mix: {', '.join(repr(domains[i]) for i in np.flatnonzero(new))} would hold the mix below {floor:g} of the tokens "
            "and gives what it has",
            stacklevel=3,
        )
        scarce |= new
    budget = min(left, float(reach.min()))
    if budget < left * (1 - CLOSE):
        warnings.warn(
            f"mix: {domains[int(reach.argmin())]!r} holds the mix at {budget / left:.4f} of the tokens, as no rate is above {most:g}",
            stacklevel=3,
        )
    return given + budget * rest


def solve(
    members: DataFrame, targets: dict[str, float], budget: float | None = None, most: float = 1.0, floor: float = 0.0
) -> Mix:
    """Rates for ``members`` (tokens, p over the targets' domains in their order).

    The default budget is the largest that the scarcest domain allows without
    any rate above ``most``, and all tokens at most where ``most`` is above 1; a
    warning names the domain when it holds the mix below all tokens. A domain
    that would hold it below ``floor`` of them, such as one that is missing,
    gives all it has, and the others keep their shares. A target of
    0 needs nothing; targets are scaled to sum to 1. What cannot be reached is
    missed by as little as can be, and a warning tells the miss. Without tokens
    all rates are the lesser of ``most`` and 1.
    """
    domains = list(targets)
    share = np.array([targets[d] for d in domains], float)
    if (share < 0).any() or not share.sum():
        raise ValueError("targets are not negative, and not all 0")
    share /= share.sum()
    n = len(domains)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    overlap = members.agg(
        *[F.sum(F.col("tokens") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))).alias(f"o{i}_{j}") for i, j in pairs]
    ).first()
    matrix = np.zeros((n, n))
    for (i, j), x in zip(pairs, overlap):
        matrix[i, j] = matrix[j, i] = x or 0.0
    have = matrix.sum(axis=1)  # posteriors sum to 1
    if not have.sum():
        return Mix(domains, np.zeros(n), min(most, 1.0), most, [])
    if budget is None:
        wanted = _reachable(domains, share, have, most, floor)
        budget = float(wanted.sum())
    else:
        wanted = budget * share
    inverse = np.linalg.pinv(matrix, rcond=1e-9, hermitian=True)
    mix = Mix(domains, wanted, min(most, budget / have.sum()), most, [])
    while True:
        before, mix.miss = mix.miss, _totals(members, mix.rate(F.col("p")), n) - wanted
        if np.abs(mix.miss).max() <= CLOSE * budget:
            break
        stays = before is not None and np.abs(mix.miss - before).max() <= SETTLED * budget
        if stays or len(mix.steps) == STEPS:
            shares = ", ".join(f"{d} {x / budget:+.2g}" for d, x in zip(domains, mix.miss))
            warnings.warn(f"mix: after {len(mix.steps)} steps targets are missed by {shares} of the budget", stacklevel=2)
            break
        mix.steps.append(inverse @ mix.miss)
    return mix


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a document: the rate rounded up or down by a draw that its key decides."""
    draw = (F.xxhash64(key, F.lit("mix")).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def sampled_labels(
    docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE, domain: str = "lang"
) -> DataFrame:
    """doc_id, text and domain of documents that the table of labels names: ``sample`` rows at most, one an id.

    The ids are those with the smallest hashes among documents of ``domains``;
    of rows that repeat one, that with the smallest text hash stands for it.
    Labels meet the documents' ids alone; the texts are picked by the list of
    ids, and only picked ones are shuffled, one an id from each task.
    """
    rows = docs.select("doc_id", "text", F.col(domain).alias("domain")).filter(F.col("domain").isin(domains))
    ids = rows.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_semi").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = rows.join(F.broadcast(ids), "doc_id", "left_semi")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "domain", "text")).alias("least")
    return picked.groupBy("doc_id").agg(least).select("doc_id", "least.text", "least.domain")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """doc_id, tokens, p_<domain>, rate and copies of every row.

    Rates have no upper bound unless ``most`` is given: scarce domains are
    repeated rather than the others dropped, and as many tokens stay as there are.
    Null and empty texts have no tokens, so any rate is right for them; they
    get that of their posterior. Rows that repeat a doc_id share their draw.
    """
    targets = targets or TARGETS
    model = fit_domains(sampled_labels(docs, labels, list(targets)), list(targets))
    members = stored(memberships(docs, model), "mixing")
    mix = solve(members, targets, **{"most": float("inf")} | options)
    rate = mix.rate(F.col("p"))
    return (
        members.withColumn("rate", rate)
        .select(
            "doc_id",
            "tokens",
            *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(targets)],
            "rate",
            copies(F.col("rate"), F.col("doc_id")).alias("copies"),
        )
    )


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of ``docs`` in as many copies as the mix gives them; all columns pass through.

    Without ``most`` no rate is above 1: rows stay or go by their draw, none is
    repeated, and a warning tells when a scarce domain makes others go for it;
    one that would leave less than ``FLOOR`` of the tokens does not.
    """
    targets = targets or TARGETS
    model = fit_domains(sampled_labels(docs, labels, list(targets)), list(targets))
    mix = solve(stored(memberships(docs, model), "mixing"), targets, **{"floor": FLOOR} | options)
    rows = memberships(carried(docs, "doc_id", "text"), model, ("kept", "doc_id"))
    rows = rows.select("kept", copies(mix.rate(F.col("p")), F.col("doc_id")).alias("copies")).filter("copies > 0")
    if mix.most > 1:
        rows = rows.select("kept", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return rows.select("kept.*")
