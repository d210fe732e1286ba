"""Fill-in-the-middle: texts cut in three and put together in another order.

Where a text may be cut is a set of byte offsets, kept as a Roaring bitmap
keeps its numbers: one container for every 65,536 offsets, which is a sorted
array, a bitmap or a list of runs, whichever is smallest, and the cumulative
cardinalities of the containers. The offset of the k-th place is found by a
search for its container and a select within it; both cuts of a text are looked
up so, and its bytes are copied in three slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.tables import utf8

CHUNK = 1 << 16
# Bytes of a bitmap container; an array has 2 for each number, a run 4.
BITMAP = CHUNK // 8
SEED = 1
# Percent of texts that are cut, and of those the percent that begin with the suffix.
CUT = 90
SUFFIX_FIRST = 20
MARKS = ("<P>", "<S>", "<M>")
# Bytes of text handed on at a time.
STRETCH = 16 << 20


class Array:
    """Numbers of a container in order."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Runs:
    """First number of each run, and how many numbers come before it."""

    def __init__(self, first: np.ndarray, before: np.ndarray):
        self.first, self.before = first, before

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


class Bitmap:
    """A bit for each number, and how many are set before each 64-bit word."""

    def __init__(self, present: np.ndarray):
        bits = np.zeros(CHUNK, bool)
        bits[: len(present)] = present
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        rest = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            rest &= rest - 1
        return 64 * word + (rest & -rest).bit_length() - 1


def container(present: np.ndarray) -> tuple[object, int]:
    """The smallest container for the numbers whose place is true, and how many they are."""
    n = int(np.count_nonzero(present))
    if n == len(present):
        return Runs(np.zeros(1, np.int64), np.zeros(1, np.int64)), n
    begins = present.copy()
    begins[1:] &= ~present[:-1]
    runs = int(np.count_nonzero(begins))
    if 4 * runs < min(2 * n, BITMAP):
        first = np.flatnonzero(begins)
        return Runs(first, np.cumsum(present)[first] - 1), n
    return (Array(np.flatnonzero(present)) if 2 * n <= BITMAP else Bitmap(present)), n


class BoundarySet:
    """Offsets at which a text may be cut, ranked from 0."""

    def __init__(self, present: np.ndarray):
        self.keys, self.containers, sizes = [], [], [0]
        for at in range(0, len(present), CHUNK):
            held, n = container(present[at : at + CHUNK])
            if n:
                self.keys.append(at)
                self.containers.append(held)
                sizes.append(n)
        # How many numbers lie before each container, and in all.
        self.cumulative = np.cumsum(sizes)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: int) -> int:
        """The offset of rank ``k``."""
        c = int(np.searchsorted(self.cumulative, k, "right")) - 1
        return self.keys[c] + self.containers[c].select(k - int(self.cumulative[c]))


def characters(data: bytes) -> np.ndarray:
    """Cuts between code points: before each and at the end."""
    present = np.ones(len(data) + 1, bool)
    present[:-1] = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return present


def lines(data: bytes) -> np.ndarray:
    """Cuts between lines: before the first, after each line feed and at the end."""
    present = np.zeros(len(data) + 1, bool)
    present[1:] = np.frombuffer(data, np.uint8) == 10
    present[[0, -1]] = True
    return present


UNITS = {"characters": characters, "lines": lines}


def transform(data: bytes, digest: str, unit: str, cut: int, suffix_first: int, marks: tuple[bytes, ...]) -> tuple:
    """n, form, prefix units, middle units and output of a text whose random numbers are the hexadecimal ``digest``."""
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    places = BoundarySet(UNITS[unit](data))
    n = len(places) - 1
    if not data or h3 % 100 >= cut or any(m in data for m in marks):
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = places.select(low), places.select(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = marks
    if h4 % 100 < suffix_first:
        return n, "spm", low, high - low, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", low, high - low, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    *,
    seed: int = SEED,
    unit: str = "characters",
    cut: int = CUT,
    suffix_first: int = SUFFIX_FIRST,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """Columns ``keep``, n (units of the text), form, prefix_units, middle_units and output of every row.

    Both cuts and the form follow from ``seed`` and doc_id, so a rerun gives
    the same. Form ``psm`` is prefix, suffix, middle, each behind its mark,
    ``spm`` suffix, prefix, middle. A text that is empty or null, holds a mark
    or is not among the ``cut`` percent is ``plain``: itself, without cuts.
    Very short texts may have empty parts. A null doc_id counts as the empty
    text; rows that repeat an id are cut by the same numbers. Other columns
    are left behind, an empty table gives no row.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    raw = tuple(m.encode() for m in marks)
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), own).cast("binary"), 256), 1, 32)
    rows = docs.select(F.struct(*keep).alias("kept"), utf8().alias("bytes"), digest.alias("digest"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, a, size = [], 0, 0
            for i, (data, digest) in enumerate(zip(batch["bytes"], batch["digest"])):
                made.append(transform(data.as_py(), digest.as_py(), unit, cut, suffix_first, raw))
                size += len(made[-1][-1])
                if size >= STRETCH or i + 1 == batch.num_rows:
                    n, form, prefix, middle, output = zip(*made)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "kept": batch["kept"].slice(a, len(made)),
                            "n": pa.array(n, pa.int64()),
                            "form": pa.array(form, pa.string()),
                            "prefix_units": pa.array(prefix, pa.int64()),
                            "middle_units": pa.array(middle, pa.int64()),
                            "output": pa.array(output, pa.binary()),
                        }
                    )
                    made, a, size = [], i + 1, 0

    kind = rows.schema["kept"].dataType.simpleString()
    cut_up = rows.mapInArrow(write, f"kept {kind}, n long, form string, prefix_units long, middle_units long, output binary")
    return cut_up.select("kept.*", "n", "form", "prefix_units", "middle_units", F.col("output").cast("string").alias("output"))


def restore(made: DataFrame, marks: tuple[str, str, str] = MARKS, column: str = "restored") -> DataFrame:
    """Add the text that ``output`` and ``form`` came from; nulls give null."""
    p, s, m = (F.lit(x) for x in marks)
    out, psm = F.col("output"), F.col("form") == "psm"
    first, second = F.when(psm, p).otherwise(s), F.when(psm, s).otherwise(p)
    up_to = lambda text, mark: F.call_function("substring_index", text, mark, F.lit(1))
    behind = lambda text, *before: F.substring(text, sum(map(F.length, before), F.lit(1)), F.length(out))
    # Texts with a mark are plain, so the first one found is the one put in.
    body = behind(out, first)
    one = up_to(body, second)
    rest = behind(body, one, second)
    two = up_to(rest, m)
    middle = behind(rest, two, m)
    joined = F.when(psm, F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return made.withColumn(column, F.when(F.col("form") == "plain", out).otherwise(joined))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and restored text of every row."""
    made = restore(fill_in_middle(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest("output"), digest("restored"),
    )
