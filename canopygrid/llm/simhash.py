"""Near-duplicates by SimHash: fingerprints within a few bits of each other, linked and grouped.

Links come from a generalised pigeonhole. The 64 bits are dealt into
partitions, correlated bits together; partition i gets its own threshold t(i),
-1 for none, so that the sum of t(i) + 1 is one more than the distance allowed:
two fingerprints within it then differ by at most t(i) bits in some partition.
Dynamic programming picks the thresholds with the fewest candidate pairs, as
estimated from the values and bit statistics of all fingerprints. Fingerprints
are looked up by partition value (all values within t(i) bits are probed) and
candidates are checked on all 64 bits.

Buckets above ``HOT`` fingerprints are not paired. Everything that probes one
goes by midpoints instead: two fingerprints are within two bits exactly if some
value is within one bit of both, so each is written under its 65 neighbours,
and those under one neighbour, at most 65, are linked. That loses no link and
takes work in proportion to the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.components import components
from canopygrid.llm.tables import carried, stored, utf8

BITS = 64
SEED = 42
WORDS = 3
DISTANCE = 2
HOT = 64
# Shingles counted at a time.
STRETCH = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned SimHash over the shingles of ``words`` words, repeats included; 0 without words."""
    import xxhash

    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: -min(words, len(found))]]
    ends = ends[min(words, len(found)) - 1 :]
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for k in range(0, len(starts), STRETCH):
        hashes = b"".join(
            [digest(joined[a : b - 1], SEED) for a, b in zip(starts[k : k + STRETCH], ends[k : k + STRETCH])]
        )
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int = WORDS, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``kept`` and fp (the fingerprint as a signed long) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py(), words)) for t in batch["_bytes"]]
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in kept} | {"fp": pa.array(fps, pa.int64())})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept, utf8().alias("_bytes")).mapInArrow(read, f"{fields}, fp long")


# Plan ----------------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Fingerprints and, for each pair of bits, those that have both: 64 rows from the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch["fp"].to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_pydict(
            {
                "bit": pa.array(range(BITS), pa.int32()),
                "n": pa.array([n] * BITS, pa.int64()),
                **{f"b{k}": pa.array(both[:, k].astype(np.int64)) for k in range(BITS)},
            }
        )

    numbers = ["n", *[f"b{k}" for k in range(BITS)]]
    summed = (
        fps.select("fp")
        .mapInArrow(count, "bit int, " + ", ".join(f"{c} long" for c in numbers))
        .groupBy("bit")
        .agg(*[F.sum(c).alias(c) for c in numbers])
        .collect()
    )
    both = np.zeros((BITS, BITS))
    for r in summed:
        both[r.bit] = r[2:]
    return (summed[0].n if summed else 0), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; each grows by the bit most correlated with it."""
    share = np.diag(both) / max(n, 1)
    apart = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tied = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(apart, apart))
    np.fill_diagonal(tied, 0)
    free, groups = list(range(BITS)), []
    for i in range(parts):
        size = len(free) // (parts - i)
        own = [max(free, key=lambda b: (tied[b, free].sum(), -b))]
        while len(own) < size:
            own.append(max((b for b in free if b not in own), key=lambda b: (tied[b, own].sum(), -b)))
        groups.append(sorted(own))
        free = [b for b in free if b not in own]
    return groups


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds from -1 up, one more than ``distance`` in all when 1 is added to each, of least total cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1 - used):
                step = (cost + (row[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t + 1 not in after or step < after[used + t + 1]:
                    after[used + t + 1] = step
        best = after
    return best[distance + 1][1]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _part(bits: list[int]) -> Column:
    return F.col("fp").bitwiseAND(F.lit(_mask(bits)))


def plan(fps: DataFrame, parts: int | None = None, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe."""
    n, both = bit_statistics(fps)
    if parts is None:  # as many as leave a handful of fingerprints to a value
        parts = next((p for p in (4, 3) if n <= 8 << (BITS // p)), 2)
    groups = group_bits(n, both, parts)
    keys = F.array(*[F.struct(F.lit(i).alias("i"), _part(g).alias("v")) for i, g in enumerate(groups)])
    sizes = fps.select(F.inline(keys)).groupBy("i", "v").agg(F.count("*").alias("n"))
    same = dict(sizes.groupBy("i").agg(F.sum(F.col("n").cast("double") * F.col("n"))).collect())
    share = np.diag(both) / max(n, 1)
    unlike = 2 * share * (1 - share)
    odds = unlike / np.maximum(1 - unlike, 1e-9)
    costs = []
    for i, g in enumerate(groups):
        one = odds[g].sum()
        two = (one**2 - (odds[g] ** 2).sum()) / 2
        pairs, probes = same.get(i, 0.0), [1, 1 + len(g), 1 + len(g) + len(g) * (len(g) - 1) // 2]
        costs.append([pairs * f + n * p for f, p in zip((1, 1 + one, 1 + one + two), probes)])
    return [(g, t) for g, t in zip(groups, allocate(costs, distance)) if t >= 0]


# Links ---------------------------------------------------------------------


def links(fps: DataFrame, parts: int | None = None, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all of the distinct fingerprints ``fp`` within two bits.

    Every edge is such a pair. Pairs that meet in buckets of up to ``hot`` are
    all given; of those that meet in larger ones, enough to connect them.
    """
    chosen = plan(fps, parts)
    held = F.array(*[F.struct(F.lit(i).alias("i"), _part(g).alias("v")) for i, (g, _) in enumerate(chosen)])
    probes = F.array(
        *[
            F.struct(F.lit(i).alias("i"), _part(g).bitwiseXOR(F.lit(_mask(f))).alias("v"))
            for i, (g, t) in enumerate(chosen)
            for size in range(t + 1)
            for f in combinations(g, size)
        ]
    )
    data = fps.select("fp", F.inline(held))
    probing = fps.select("fp", F.inline(probes)) if any(t for _, t in chosen) else data
    large = stored(data.groupBy("i", "v").agg(F.count("*").alias("n")).filter(F.col("n") > hot), "simhash-hot")
    cold, asked = (d.join(large, ["i", "v"], "left_anti").select("fp", "i", "v") for d in (data, probing))
    paired = (
        asked.select(F.col("fp").alias("a"), "i", "v")
        .join(cold.select(F.col("fp").alias("b"), F.col("i").alias("j"), F.col("v").alias("w")), _meet())
        .select("a", "b")
    )
    crowd = probing.join(large, ["i", "v"], "left_semi").select("fp").distinct()
    middles = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_mask([b]))) for b in range(BITS))]
    under = crowd.select("fp", F.explode(F.array(*middles)).alias("middle"))
    starred = under.withColumn("b", F.expr("min(fp) OVER (PARTITION BY middle)")).filter("fp > b")
    return paired.union(starred.select(F.col("fp").alias("a"), "b")).distinct()


def _meet() -> Column:
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return (F.col("i") == F.col("j")) & (F.col("v") == F.col("w")) & (F.col("a") < F.col("b")) & near


def near_duplicates(
    docs: DataFrame, words: int = WORDS, parts: int | None = None, hot: int = HOT
) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, group (a number per component) and fp of every row.

    Documents are linked whose fingerprints differ in at most two bits;
    component_id is the smallest doc_id reachable. Null, empty and
    wordless texts have fingerprint zero and are linked like any other. Equal
    fingerprints are one class throughout, so copies cost nothing beyond their
    own row. A null doc_id is nobody's smallest. No row gives no row.
    """
    found = stored(fingerprints(docs, words), "simhash-fingerprints")
    classes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes.select("fp"), parts, hot))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("group")
    )
    rooted = stored(rooted, "simhash-rooted")
    least = stored(rooted.groupBy("group").agg(F.min("first").alias("component_id")), "simhash-least")
    named = stored(rooted.select("fp", "group").join(least, "group"), "simhash-named")
    return found.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group", "fp"
    )


def keep_one(docs: DataFrame, words: int = WORDS, **options) -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates: that with the smallest doc_id.

    Of rows that repeat that id within the group one stays, and a group
    without any doc_id keeps one. All columns pass through.
    """
    grouped = stored(near_duplicates(docs, words, **options), "simhash-groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    firsts = grouped.filter(first).groupBy("group", "doc_id").agg(F.min("fp").alias("fp"))
    firsts = firsts.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"))
    if not grouped.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["_id"]), "left_semi")
    rows = fingerprints(carried(docs, "doc_id", "text"), words, ("kept", "doc_id"))
    rows = rows.dropDuplicates(["doc_id", "fp"])
    same = rows["doc_id"].eqNullSafe(firsts["_id"]) & (rows["fp"] == firsts["_fp"])
    return rows.join(firsts, same, "left_semi").select("kept.*")
