"""Exact top-k by inner product: columnar branch and bound.

Candidates lie in blocks, stored vertically: one row of a block's array holds
one dimension of all its candidates. Queries go in blocks to every candidate
block. A query's scores grow a group of dimensions at a time; what the
dimensions left can still add is at most the product of the two vectors'
remaining lengths (Cauchy-Schwarz). Candidates whose bound stays below the
query's k-th best score so far are dropped and the survivors moved together.
Each pair of blocks gives k rows a query, and the best of all of them remain.

Components are whole numbers, floor(256 x). All sums are exact: 64-bit floating
point while they stay below 2^53, Python integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.tables import stored

K = 5
SCALE = 256
EVERY = 50
# Rows of a candidate and of a query block: they bound what a task holds.
CANDIDATES = 4096
QUERIES = 512
# Dimensions added between two looks at the bounds.
STEP = 8
# The first candidates of a block, scored in full to begin with a threshold.
FIRST = 256
EXACT = 2.0**53


def usable(vector: Column) -> Column:
    """Vectors that take part: not null and all components finite numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        (some,) = np.nonzero(scores >= bound)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int = K
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate ids, scores) of a block's k best for each query; ``block`` is dimensions x candidates.

    A candidate with the query's own id is not one.
    """
    dimensions, n = block.shape
    cuts = [*range(0, dimensions, STEP), dimensions]
    # Lengths of what is left after each cut, a little above the truth.
    grown = 1 + 1e-9
    left = [np.sqrt((block[c:] ** 2).sum(axis=0)) * grown for c in cuts]
    mine = [np.sqrt((queries[:, c:] ** 2).sum(axis=1)) * grown for c in cuts]
    first = np.arange(min(n, max(FIRST, 2 * k)))
    begun = queries @ block[:, first]
    for q, own in enumerate(query_ids):
        others = first[ids[first] != own]
        seed = begun[q, others]
        threshold = np.partition(seed, len(seed) - k)[len(seed) - k] if len(seed) >= k else -np.inf
        alive = np.flatnonzero(ids != own)
        partial = np.zeros(len(alive))
        for step, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
            columns = block[a:b] if len(alive) == n else block[a:b][:, alive]
            partial += queries[q, a:b] @ columns
            if b < dimensions:
                keep = partial + mine[step][q] * left[step][alive] >= threshold
                if keep.sum() < 0.8 * len(alive):
                    alive, partial = alive[keep], partial[keep]
        best = _top(partial, ids[alive], k)
        yield q, ids[alive][best], partial[best]


def _exact_block(query_ids, queries, ids, block, k):
    """As ``search_block`` for numbers too large for floating point."""
    for q, own in enumerate(query_ids):
        scores = [(-sum(int(x) * int(y) for x, y in zip(queries[q], block[:, c])), int(i)) for c, i in enumerate(ids) if i != own]
        best = sorted(scores)[:k]
        yield q, np.array([i for _, i in best], np.int64), [-s for s, _ in best]


def _packed(vectors: np.ndarray) -> bytes:
    """Row by row, 16 bits a component where that is enough and else 64-bit floating point."""
    small = np.abs(vectors).max(initial=0) < 1 << 15
    return vectors.astype("<i2" if small else "<f8").tobytes()


def _unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    kind = "<i2" if len(data) == 2 * rows * dim else "<f8"
    return np.frombuffer(data, kind).reshape(rows, dim).astype(np.float64)


def _blocks(df: DataFrame, rows: int, prefix: str) -> DataFrame:
    """Vectors packed into numbered blocks of at most ``rows`` of equal length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vectors = zip(*waiting.pop(dim))
            return pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim], pa.int32()),
                    f"{prefix}_ids": [np.array(ids, np.int64).tobytes()],
                    f"{prefix}_data": [_packed(np.array(vectors, np.float64))],
                }
            )

        for batch in batches:
            values = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(batch["n"].to_numpy(zero_copy_only=False))
            for i, end, n in zip(batch["id"].to_pylist(), ends, batch["n"].to_pylist()):
                waiting.setdefault(n, []).append((i, np.floor(SCALE * values[end - n : end])))
                if len(waiting[n]) == rows:
                    yield block(n)
        for dim in list(waiting):
            yield block(dim)

    packed = df.mapInArrow(pack, f"dim int, {prefix}_ids binary, {prefix}_data binary")
    return packed.withColumn(f"{prefix}_number", F.monotonically_increasing_id())


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best among all other rows of the table.

    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id; vectors of different length are not compared;
    rows with the query's id are not its candidates, and repeated rows count as
    often as they occur; queries that share an id get a list each. An empty
    table gives no row.

    Every query block meets every candidate block. The candidates stay where
    they are packed; the queries, a stated small part of the table, are copied
    to each of their blocks.
    """
    usable_rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")
    ).filter(F.col("id").isNotNull() & usable(F.col("v")))
    usable_rows = usable_rows.withColumn("n", F.size("v"))
    spread = vectors.sparkSession.sparkContext.defaultParallelism
    candidates = stored(_blocks(usable_rows.select("id", "v", "n"), CANDIDATES, "c"), "topk-candidates")
    asked = usable_rows.filter("q").select("id", "v", "n").repartition(spread)
    queries = stored(_blocks(asked, QUERIES, "q"), "topk-queries")
    pairs = queries.join(candidates.select("dim", "c_number"), "dim").join(candidates.drop("dim"), "c_number")

    def search(pair: pa.Table) -> pa.Table:
        one = pair.to_pylist()[0]
        query_ids, ids = (np.frombuffer(one[c], np.int64) for c in ("q_ids", "c_ids"))
        own = _unpacked(one["q_data"], len(query_ids), one["dim"])
        block = np.ascontiguousarray(_unpacked(one["c_data"], len(ids), one["dim"]).T)
        most = np.abs(own).max(initial=0) * np.abs(block).max(initial=0) * max(1, one["dim"])
        find = search_block if most < EXACT else _exact_block
        found = list(find(query_ids, own, ids, block, k))
        return pa.table(
            {
                "query_id": np.repeat(query_ids, [len(s) for _, s, _ in found]),
                "q_number": np.full(sum(len(s) for _, s, _ in found), one["q_number"], np.int64),
                "place": np.repeat(np.arange(len(query_ids), dtype=np.int32), [len(s) for _, s, _ in found]),
                "vec_id": np.concatenate([i for _, i, _ in found]),
                "score": pa.array([int(x) for _, _, s in found for x in s], pa.int64()),
            }
        )

    # The pairs of a candidate block are together already: a group is one pair, and so is what a task holds.
    best = pairs.groupBy("c_number", "q_number").applyInArrow(
        search, "query_id long, q_number long, place int, vec_id long, score long"
    )
    # A list for each query row, also where rows share an id.
    order = "row_number() OVER (PARTITION BY q_number, place ORDER BY score DESC, vec_id)"
    return best.withColumn("rank", F.expr(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(embeddings: DataFrame) -> DataFrame:
    """The search with every row as query whose id is divisible by 50."""
    return top_k(embeddings, F.col("vec_id") % EVERY == 0)
