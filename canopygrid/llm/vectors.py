"""Near-duplicate vectors by cosine: a subspace pigeonhole join.

Vectors of unit length have a cosine of t or more exactly if their squared
distance is 2 - 2t or less. All are turned by one random rotation and their
coordinates dealt into blocks of a few dimensions, each with a share of the
squared distance in proportion to its width: two vectors that near are within
its share in some block. Each block is joined by range in its own space, the
union of what the blocks find is checked on the whole vectors, and a pair
counts in the first block that allows it, so in one place.

The range join of a block cuts its space by a tree of planes. A row on the low
side of a plane and within the block's radius of it visits the high side too,
so every pair in range meets in a leaf; of several meetings only the one counts
to which the two have not crossed a plane together. The tree is fitted to a
bounded sample and cuts where few rows visit; it decides cost, never results.
Leaves are dealt into chunks of at most some ``CHUNK`` rows, and a task
compares two chunks, in strips. Blocks whose space no plane is worth cutting
would all meet the same chunks: a chunk goes once for all of these.

Vectors without structure leave as many comparisons as there are pairs, and
each chunk meets every other. Pairs of chunks are therefore dealt into rounds,
none of which moves more than ``SHARE`` times the rows; what a round moved goes
from the disks before the next. So disk grows with the rows, as time with pairs.

Equal vectors are one class throughout. Crowds of near copies, too, are not
compared among themselves: members of a ball so small that any two of its
members are linked are counted by its size. Balls are placed by the sample.

Rotated coordinates are whole numbers small enough for exact sums in floating
point, so all tasks agree on every distance in a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.components import components
from canopygrid.llm.tables import scratch, sent, stored

LEAST = 0.9
WIDTH = 16
# Rows of a chunk and of a strip of one.
CHUNK = 4096
STRIP = 512
# Rows that a round moves: as many times all rows, but some in any case.
SHARE = 2
ROUND = 1 << 18
# The number that stands for all blocks without planes.
REST = -1
# Vectors that trees and balls are fitted to; depth of a tree; balls at most, and members that make one in the sample.
SAMPLE = 2048
DEPTH = 8
BALLS = 64
CROWD = 8
# A plane is worth it where at most this share of the rows visits.
VISITORS = 0.2
SEED = 7
# A unit length in whole numbers, and what rounding them may add to a squared distance, a dimension.
UNIT = float(1 << 20)
SLACK = 2e-6


def rotation(dim: int) -> np.ndarray:
    """The same near-orthogonal matrix of whole numbers everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return np.rint(q * np.sign(np.diag(r)) * UNIT)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; their largest component is brought to 1 first, so that no square is lost."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def rotated(units: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Whole coordinates: the products' sums stay below 2^53, so they are exact in any order."""
    return np.rint(np.rint(units * UNIT) @ turn / UNIT)


def blocks_of(dim: int, width: int = WIDTH) -> list[slice]:
    count = max(1, dim // width)
    ends = [dim * i // count for i in range(count + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def budgets(blocks: list[slice], least: float) -> list[float]:
    """Squared distance, in whole coordinates, that each block allows."""
    dim = blocks[-1].stop
    return [(2 - 2 * least + SLACK * max(64, dim)) * UNIT * UNIT * (b.stop - b.start) / dim for b in blocks]


# Fitting: cost only -----------------------------------------------------------


@dataclass
class Plane:
    axis: int
    at: float
    low: Plane | int
    high: Plane | int


def fit_tree(points: np.ndarray, radius: float, depth: int = DEPTH) -> Plane | int:
    """Planes across a block's space, or the number of a leaf."""
    leaves = iter(range(1 << depth))

    def grow(own: np.ndarray, depth: int) -> Plane | int:
        best = None
        if depth and len(own) >= 32:
            for axis in range(own.shape[1]):
                z = np.sort(own[:, axis])
                cuts = z[np.linspace(len(z) // 4, 3 * len(z) // 4, 11).astype(int)]
                visit = np.searchsorted(z, cuts) - np.searchsorted(z, cuts - radius)
                i = int(visit.argmin())
                if best is None or visit[i] < best[0]:
                    best = (visit[i], axis, cuts[i])
        if best is None or best[0] > VISITORS * len(own):
            return next(leaves)
        _, axis, at = best
        side = own[:, axis] < at
        if side.all() or not side.any():
            return next(leaves)
        return Plane(axis, float(at), grow(own[side], depth - 1), grow(own[~side], depth - 1))

    return grow(points, depth)


def route(tree: Plane | int, points: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, the planes each of them crossed as bits of the depth) for all rows at home in or visiting a leaf."""

    def down(node, rows, crossed, depth):
        if isinstance(node, int):
            if len(rows):
                yield node, rows, crossed
            return
        z = points[rows, node.axis]
        low, near = z < node.at, (z < node.at) & (z >= node.at - radius)
        yield from down(node.low, rows[low], crossed[low], depth + 1)
        over = crossed | np.where(near, np.int64(1) << np.int64(depth), np.int64(0))
        high = ~low | near
        yield from down(node.high, rows[high], over[high], depth + 1)

    yield from down(tree, np.arange(len(points)), np.zeros(len(points), np.int64), 0)


def ball_radius(least: float) -> float:
    """Any two unit vectors this near to one point are linked."""
    return np.sqrt(max(0.0, 2 - 2 * least - 1e-6)) / 2


def fit_balls(units: np.ndarray, least: float) -> np.ndarray:
    """Middles of the sample's crowds."""
    left, found, radius = np.arange(len(units)), [], ball_radius(least)
    while len(left) >= CROWD and len(found) < BALLS:
        near = units[left] @ units[left].T >= least
        most = int(near.sum(axis=1).argmax())
        if near[most].sum() < CROWD:
            break
        middle = units[left][near[most]].mean(axis=0)
        middle /= np.linalg.norm(middle)
        if (np.linalg.norm(units[left][near[most]] - middle, axis=1) <= radius).sum() >= CROWD:
            found.append(middle)
        left = left[~near[most]]
    return np.array(found).reshape(len(found), units.shape[1])


@dataclass
class Plan:
    """How vectors of one length are dealt out."""

    balls: np.ndarray
    trees: list[Plane | int]


def fit(sample: list[np.ndarray], least: float, width: int) -> dict[int, Plan]:
    """Plans by length of vector, for the lengths in the sample; others go undivided."""
    plans = {}
    for dim in {len(v) for v in sample}:
        units = unit(np.array([v for v in sample if len(v) == dim]))
        turned = rotated(units, rotation(dim))
        blocks = blocks_of(dim, width)
        trees = [fit_tree(turned[:, b], np.sqrt(most)) for b, most in zip(blocks, budgets(blocks, least))]
        plans[dim] = Plan(fit_balls(units, least), trees)
    return plans


# Rows ---------------------------------------------------------------------


def _lengths(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of a batch whose vectors are whole."""
    values = batch[column].flatten().to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    for dim in np.unique(size[size > 0]):
        (rows,) = np.nonzero(size == dim)
        yield int(dim), rows, values[(ends[rows] - dim)[:, None] + np.arange(dim)]


def _usable(df: DataFrame, vector: str) -> DataFrame:
    """Vectors that link with nothing become null."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), v))


def _keyed(df: DataFrame) -> DataFrame:
    """id, key (of the vector's bytes; null for none) and v."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = [None] * batch.num_rows
            for _, rows, vectors in _lengths(batch, "v"):
                whole = np.ascontiguousarray(vectors + 0.0)  # no negative zero
                for i, v in zip(rows, whole):
                    keys[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "key": pa.array(keys, pa.binary()), "v": batch["v"]})

    kind = df.schema["v"].dataType.simpleString()
    return df.select("id", "v").mapInArrow(read, f"id long, key binary, v {kind}")


def cut_blocks(plans: dict[int, Plan], dim: int) -> list[int]:
    """Blocks that have planes."""
    return [i for i, tree in enumerate(plans[dim].trees) if isinstance(tree, Plane)] if dim in plans else []


def _dealt(classes: DataFrame, plans: dict[int, Plan], least: float, width: int) -> DataFrame:
    """A row per class, block with planes and leaf it is in, and one for all blocks without.

    Columns beside the class's are dim, block, leaf, ball (-1 for none), the
    planes crossed, and home, which is true once a class.
    """
    known = classes.sparkSession.sparkContext.broadcast(plans)
    radius = ball_radius(least)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rows, vectors in _lengths(batch, "v"):
                if dim not in turns:
                    turns[dim] = rotation(dim)
                units, blocks = unit(vectors), blocks_of(dim, width)
                turned, plan = rotated(units, turns[dim]), known.value.get(dim)
                ball = np.full(len(rows), -1, np.int32)
                if plan and len(plan.balls):
                    far = np.sqrt(np.maximum(0, 2 - 2 * (units @ plan.balls.T)))
                    nearest = far.argmin(axis=1)
                    within = far[np.arange(len(rows)), nearest] <= radius
                    ball[within] = nearest[within]
                cut, most = cut_blocks(known.value, dim), budgets(blocks, least)
                for i in [*cut, REST] if len(cut) < len(blocks) else cut:
                    whole = [(0, np.arange(len(rows)), np.zeros(len(rows), np.int64))]
                    routed = whole if i == REST else route(plan.trees[i], turned[:, blocks[i]], np.sqrt(most[i]))
                    for leaf, some, crossed in routed:
                        taken = pa.array(rows[some])
                        yield pa.RecordBatch.from_pydict(
                            {
                                "node": batch["node"].take(taken),
                                "copies": batch["copies"].take(taken),
                                "v": batch["v"].take(taken),
                                "dim": np.full(len(some), dim, np.int32),
                                "block": np.full(len(some), i, np.int32),
                                "leaf": np.full(len(some), leaf, np.int32),
                                "ball": ball[some],
                                "crossed": crossed,
                                "home": (crossed == 0) & (i == (cut[0] if cut else REST)),
                            }
                        )

    kind = classes.schema["v"].dataType.simpleString()
    fields = f"node long, copies long, v {kind}, dim int, block int, leaf int, ball int, crossed long, home boolean"
    return classes.select("node", "copies", "v").mapInArrow(deal, fields)


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links of a strip, given as rows by columns, that connect what all of its links connect."""
    rows, columns, links = near.any(axis=1), near.any(axis=0), []
    for first in np.flatnonzero(rows):
        if not rows[first]:
            continue
        rows[first] = False
        reached = [(first, True)]
        while reached:
            x, is_row = reached.pop()
            new = np.flatnonzero((near[x] & columns) if is_row else (near[:, x] & rows))
            (columns if is_row else rows)[new] = False
            links += [(left[x], right[y]) if is_row else (left[y], right[x]) for y in new]
            reached.extend((y, not is_row) for y in new)
    return links


def compare(group: pa.Table, least: float, width: int, plans: dict[int, Plan]) -> pa.Table:
    """Links between two chunks, or within one: (a, null, n) adds n to a's number, (a, b, null) are links that connect all."""
    dim, block = group["dim"][0].as_py(), group["block"][0].as_py()
    blocks, cut = blocks_of(dim, width), cut_blocks(plans, dim)
    most = budgets(blocks, least)
    # A pair counts in the first block that allows it; those without planes come last, and together.
    allowing = [i for i in range(len(blocks)) if i not in cut] if block == REST else [block]
    before = [i for i in cut if block == REST or i < block]
    vectors = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    units = unit(vectors)
    turned = rotated(units, rotation(dim))
    # Squared distances are one product each: of -2x, |x|^2 and 1 with y, 1 and |y|^2; all whole, so exact.
    ones = np.ones((len(turned), 1))
    squares = [(turned[:, b] ** 2).sum(axis=1, keepdims=True) for b in blocks]
    rights = [np.hstack([turned[:, b], ones, s]) for b, s in zip(blocks, squares)]
    lefts = [np.hstack([-2 * turned[:, b], s, ones]) for b, s in zip(blocks, squares)]
    node, copies, crossed, ball, side = (group[c].to_numpy() for c in ("node", "copies", "crossed", "ball", "side"))
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1)
    alone = not len(two)
    two = one if alone else two

    def within(i: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return lefts[i][p] @ rights[i][q].T <= most[i]

    total, links = np.zeros(len(node), np.int64), []
    for a in range(0, len(one), STRIP):
        p, q = one[a : a + STRIP], two[a:] if alone else two
        near = within(allowing[0], p, q)
        for i in allowing[1:]:
            near |= within(i, p, q)
        if alone:
            near &= np.arange(len(q)) > np.arange(len(p))[:, None]
        some_p, some_q = near.any(axis=1), near.any(axis=0)
        if not some_p.any():
            continue
        p, q, near = p[some_p], q[some_q], near[np.ix_(some_p, some_q)]
        near &= units[p] @ units[q].T >= least
        near &= (ball[p][:, None] != ball[q]) | (ball[q] < 0)
        near &= (crossed[p][:, None] & crossed[q]) == 0
        for i in before:
            if near.any():
                near &= ~within(i, p, q)
        total[p] += near @ copies[q]
        total[q] += copies[p] @ near
        links += _spanning(near, node[p], node[q])
    (met,) = np.nonzero(total)
    none = len(links)
    return pa.table(
        {
            "a": pa.array([*node[met].tolist(), *(int(a) for a, _ in links)], pa.int64()),
            "b": pa.array([*[None] * len(met), *(int(b) for _, b in links)], pa.int64()),
            "n": pa.array([*total[met].tolist(), *[None] * none], pa.int64()),
        }
    )


def _pairs(dealt: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their chunk, and the pairs of chunks to compare, with the rows that go for each."""
    cell = ["dim", "block", "leaf", "ball"]
    sizes = dealt.groupBy(*cell).agg(F.count("*").alias("rows"), F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
    sizes = stored(sizes, "vectors-cells")
    rows = dealt.join(sent(sizes.drop("rows")), cell).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    chunks = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("rows", F.col("rows") / F.col("chunks"))
    x, y = (chunks.select("dim", "block", "leaf", *[F.col(c).alias(f"{c}_{s}") for c in ("ball", "chunk", "rows")]) for s in "xy")
    in_order = F.struct("ball_x", "chunk_x") <= F.struct("ball_y", "chunk_y")
    # Within a ball all is known.
    open_pair = (F.col("ball_x") < 0) | (F.col("ball_x") != F.col("ball_y"))
    same = (F.col("ball_x") == F.col("ball_y")) & (F.col("chunk_x") == F.col("chunk_y"))
    moved = F.col("rows_x") + F.when(same, 0).otherwise(F.col("rows_y"))
    pairs = x.join(y, ["dim", "block", "leaf"]).filter(in_order & open_pair).withColumns({"same": same, "moved": moved})
    return rows.drop("chunks"), pairs.drop("rows_x", "rows_y")


def rounds_of(rows: int, moved: float) -> int:
    """Rounds for pairs of chunks that move so many rows of a table of ``rows``."""
    return max(1, int(np.ceil(moved / max(ROUND, SHARE * rows))))


def links(dealt: DataFrame, plans: dict[int, Plan], least: float, width: int, chunk: int) -> DataFrame:
    """What ``compare`` finds in all pairs of chunks, a round of them at a time."""
    rows, pairs = _pairs(dealt, chunk)
    pairs = stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "vectors-pairs")
    rounds = rounds_of(dealt.count(), pairs.agg(F.sum("moved")).first()[0] or 0)
    at = ["dim", "block", "leaf", "ball", "chunk"]
    end = lambda s: [F.col(f"ball_{s}").alias("ball"), F.col(f"chunk_{s}").alias("chunk")]
    known = dealt.sparkSession.sparkContext.broadcast(plans)
    found = []
    for i in range(rounds):
        now = pairs.filter(F.pmod(F.xxhash64("pair"), F.lit(rounds)) == i)
        asks = now.select("pair", "dim", "block", "leaf", *end("x"), F.lit(0).alias("side")).union(
            now.filter(~F.col("same")).select("pair", "dim", "block", "leaf", *end("y"), F.lit(1).alias("side"))
        )
        both = rows.join(sent(asks), at).select("pair", "side", "dim", "block", "node", "copies", "ball", "crossed", "v")
        met = both.groupBy("pair").applyInArrow(lambda g: compare(g, least, width, known.value), "a long, b long, n long")
        found.append(stored(met, "vectors-found"))
    return found[0] if rounds == 1 else stored(reduce(DataFrame.union, found), "vectors-found")


def near_duplicates(
    vectors: DataFrame,
    least: float = LEAST,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    width: int = WIDTH,
    chunk: int = CHUNK,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows are linked at a cosine of ``least`` or more (below 1, above 0), taken
    in double precision. n_links counts other rows, copies too; component_id
    is the smallest vec_id among all rows reachable, itself included; kept
    tells whether that is the row's own. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of
    different length. A null vec_id is nobody's smallest; repeated rows are
    linked as other copies are. An empty table gives no row.
    """
    source = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("own"))
    keyed = _keyed(_usable(source, "own"))
    rows = stored(keyed.select("id", "key"), "vectors-rows")
    with scratch(vectors.sparkSession):
        linked = stored(_linked(keyed, least, width, chunk), "vectors-linked", keep=True)
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (
        rows.join(linked, "key", "left")
        .select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))
    )


def _linked(keyed: DataFrame, least: float, width: int, chunk: int) -> DataFrame:
    """key, n_links and component_id of the classes that have links."""
    with scratch(keyed.sparkSession):  # whole vectors lie on the disks once: those of the classes go when they are dealt
        classes = keyed.filter("key IS NOT NULL").groupBy("key").agg(
            F.count("*").alias("copies"), F.min("id").alias("least_id"), F.first("v").alias("v")
        )
        whole = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectors-whole")
        sample = [np.array(r.v) for r in whole.orderBy("key").limit(SAMPLE).select("v").collect()]
        plans = fit(sample, least, width)
        dealt = stored(_dealt(whole, plans, least, width), "vectors-dealt", keep=True)
        classes = stored(whole.drop("v"), "vectors-classes", keep=True)
    found = links(dealt, plans, least, width, chunk)
    members = dealt.filter("home AND ball >= 0").select("dim", "ball", "node", "copies")
    balls = members.groupBy("dim", "ball").agg(F.sum("copies").alias("members"), F.min("node").alias("first"))
    held = stored(members.join(stored(balls, "vectors-balls"), ["dim", "ball"]), "vectors-held")
    edges = found.filter("b IS NOT NULL").select("a", "b").union(held.select(F.col("node").alias("a"), F.col("first").alias("b")))
    roots = components(edges)
    counts = (
        found.filter("n IS NOT NULL").select(F.col("a").alias("node"), "n")
        .union(held.select("node", F.col("members") - F.col("copies")))
        .union(classes.filter("copies > 1").select("node", F.col("copies") - 1))
        .groupBy("node").agg(F.sum("n").alias("n_links"))
    )
    named = stored(
        classes.select("node", "key", "least_id")
        .join(counts, "node")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node")),
        "vectors-named",
    )
    firsts = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return named.join(firsts, "root").select("key", "n_links", "component_id")
