"""Best-fit packing of documents into sequences of a fixed capacity.

Bulk-synchronous best fit. Pieces are range-sorted by length over the cluster.
Lengths and gaps are whole numbers up to the capacity, so the two sorted lines
are known from their runs: how many pieces there are of each length, and which
sequences have each gap. A step sweeps one length, longest first, over the gaps
from its successor (the smallest gap that fits) upwards; pieces that want the
same gap are told apart by rank, the gaps are updated, and the next length
follows. A step places a whole run at once and leaves what one-by-one best-fit
decreasing would leave. The steps' outcome is a list of segments (so many
ranks of a length go to such sequences) whose size depends on the capacity and
not on the number of pieces; each task then finds its pieces' places by rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.tables import carried, stored, utf8
from canopygrid.llm.tokens import encode_all, vocabulary_path

CAPACITY = 2048
_RANKS = 1 << 40  # ranks of one length stay below


def sweep(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Segments of best-fit decreasing over ``counts`` pieces of each length, and the number of sequences.

    A segment: length, first rank, pieces, first sequence, pieces per sequence,
    place of the first in each.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
    gaps: list[int] = []  # those with runs, ascending
    segments, opened = [], 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, last = 0, counts[length]

        def fill(gap: int, first: int, number: int) -> int:
            """Fill sequences of this gap in turn; how many are touched."""
            nonlocal rank
            each = gap // length
            whole = min(number, (last - rank) // each)
            if whole:
                segments.append((length, rank, whole * each, first, each, capacity - gap))
                rank += whole * each
                leave(gap - each * length, first, whole)
            if whole < number and rank < last:
                rest = last - rank
                segments.append((length, rank, rest, first + whole, rest, capacity - gap))
                rank = last
                leave(gap - rest * length, first + whole, 1)
                whole += 1
            return whole

        for gap in gaps[bisect_left(gaps, length) :]:
            while rank < last and runs[gap]:
                first, number = runs[gap].pop()
                used = fill(gap, first, number)
                if used < number:
                    runs[gap].append((first + used, number - used))
            if not runs[gap]:
                del runs[gap]
                gaps.remove(gap)
            if rank == last:
                break
        if rank < last:
            opened += fill(capacity, opened, -(-(last - rank) // (capacity // length)))
    return np.array(segments, np.int64).reshape(-1, 6), opened


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    ``order`` names columns that tell pieces of equal length apart; rows equal
    in these too are placed in any order, each once. Other columns pass
    through; a sequence_id or offset they had is replaced. A length of 0 or null takes no place: sequence and offset are
    null. A length above the capacity is an error. No row gives no row.
    """
    rows = carried(
        pieces.drop("sequence_id", "offset"),
        F.col("length").cast("long").alias("length"),
        F.struct(*order).alias("order"),
    )
    in_order = (F.desc("length"), "order")
    ranked = stored(
        rows.repartitionByRange(*in_order)
        .sortWithinPartitions(*in_order)
        .select("kept", "length", F.monotonically_increasing_id().alias("at")),
        "packing-ranked",
    )
    # Sorted, so a part meets few lengths: rows here are at most lengths plus parts.
    parts = (
        ranked.filter("length > 0")
        .groupBy(F.shiftright("at", 33).alias("part"), "length")
        .agg(F.count("*").alias("n"), F.min("at").alias("first"))
        .collect()
    )
    parts.sort(key=lambda r: (r.length, r.part))
    counts: dict[int, int] = {}
    before = []
    for r in parts:
        if r.length > capacity:
            raise ValueError(f"a piece of {r.length} does not fit in {capacity}")
        before.append(counts.get(r.length, 0))
        counts[r.length] = counts.get(r.length, 0) + r.n
    segments, _ = sweep(counts, capacity)
    keys = segments[:, 0] * _RANKS + segments[:, 1]
    by_key = np.argsort(keys)
    segments, keys = segments[by_key], keys[by_key]
    part_keys = np.array([r.part * (capacity + 1) + r.length for r in parts], np.int64)
    by_part = np.argsort(part_keys)
    part_keys = part_keys[by_part]
    shift = np.array([b - r.first for b, r in zip(before, parts)], np.int64)[by_part]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch["length"].fill_null(0).to_numpy(zero_copy_only=False)
            where = batch["at"].to_numpy(zero_copy_only=False)
            empty = length <= 0
            sequence = np.zeros(len(length), np.int64)
            offset = np.zeros(len(length), np.int64)
            some = np.flatnonzero(~empty)
            if len(some):
                size, spot = length[some], where[some]
                rank = spot + shift[np.searchsorted(part_keys, (spot >> 33) * (capacity + 1) + size)]
                own = segments[np.searchsorted(keys, size * _RANKS + rank, side="right") - 1]
                nth = rank - own[:, 1]
                sequence[some] = own[:, 3] + nth // own[:, 4]
                offset[some] = own[:, 5] + nth % own[:, 4] * size
            yield pa.RecordBatch.from_pydict(
                {
                    "kept": batch["kept"],
                    "sequence_id": pa.array(sequence, mask=empty),
                    "offset": pa.array(offset, mask=empty),
                }
            )

    kept = ranked.schema["kept"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"kept {kept}, sequence_id long, offset long")
    return placed.select("kept.*", "sequence_id", "offset")


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0
) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    A document's ids end with ``end_id``, so an empty or null text has one
    piece of one token. Only documents longer than the capacity are cut, at its
    multiples. Repeated rows give repeated pieces.
    """
    path = vocabulary or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()
    step = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, packed in zip(batch["doc_id"].to_pylist(), encode_all(batch["text"].to_pylist(), path)):
                packed += end
                for k, a in enumerate(range(0, len(packed), step)):
                    part = packed[a : a + step]
                    rows.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part)))
            doc_id, k, start, length, crc = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(doc_id, pa.int64()),
                    "piece": pa.array(k, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return best_fit(stored(token_pieces(docs, capacity, vocabulary), "packing-pieces"), capacity)
