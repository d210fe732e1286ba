"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: at every word the word and those that
follow it in its piece, ``WINDOW`` in all, padded at the piece's end. Spark's
ROLLUP over the window's columns then sums them to every shorter prefix, and as
each occurrence of a phrase begins exactly one window, the sum of a prefix is
the phrase's frequency; the sum over all of a language's windows is its number
of words. Nothing is counted for each length by itself.

A window ends early where no phrase can go on: at a word, or behind two or
three neighbours, seen fewer times than a candidate must be. Which those are
tells a table of bits addressed by hash: a first pass counts hashes of up to
three words, and a bit is set where a count is high enough. Hashes may meet, so
some rare ones stay in the windows, which costs rows and changes nothing; no
frequent one is ever cut. The hashes of a stretch of text travel sorted, as
their distances, in a row per range of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.tables import stored

WINDOW = 5
LEAST = 100
TOP = 2000
SHARE = 100
UNKNOWN = "und"
SEED = 42
# Bytes of text worked on at a time in a task.
STRETCH = 8 << 20
# The same where windows are counted: what the stretches of a task have in common, Spark's partial aggregate combines.
WINDOWS = 1 << 18
# The table has a bit for so many bytes of text, and at most 2^28 bits, so that 32 MB are sent; a range of it has 2^16.
BYTES_A_BIT = 16
MOST_BITS = 28
RANGE = 16

# A-Z to small letters, marks that end a piece to the line feed, tab to blank.
_TABLE = bytearray(range(256))
for _b in range(65, 91):
    _TABLE[_b] = _b + 32
for _b in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_b] = 10
_TABLE[9] = 32
TABLE = bytes(_TABLE)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Words of some texts as codes, the distinct words behind the codes, and each word's piece and text."""
    texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = data[int(offsets[0]) : int(offsets[-1])].to_pybytes().translate(TABLE) if data else b""
    begins = pa.py_buffer((offsets - offsets[0]).astype(np.int32))
    pieces = pc.split_pattern(pa.Array.from_buffers(pa.binary(), len(texts), [None, begins, pa.py_buffer(data)]), b"\n")
    of_piece = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(pieces.offsets.to_numpy()))
    words = pc.split_pattern(pieces.flatten(), b" ")
    piece = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(words.offsets.to_numpy()))
    words = words.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    piece = piece[real.to_numpy(zero_copy_only=False)]
    return coded.indices.to_numpy(), coded.dictionary, piece, of_piece[piece]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hashes(codes: np.ndarray, words: pa.Array, piece: np.ndarray, lang: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2 and 3 words from each word on, their hash and whether they are of one piece; ``lang`` is a hash per word."""
    import xxhash

    each = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words.to_pylist()], np.uint64)[codes]
    h, found = _mix(each ^ lang), [(_mix(each ^ lang), np.ones(len(codes), bool))]
    for k in (1, 2):
        h = _mix(h[:-1] * np.uint64(3) + each[k:])
        found.append((h, piece[k:] == piece[:-k]))
    return found


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that small numbers shrink when shuffled."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _stretches(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, pa.DictionaryArray]]:
    """Words of a batch a stretch at a time, the language's hash of each word and the languages of texts."""
    import xxhash

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["bytes"]), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        before = sizes[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, before + size)))
        own = batch.slice(a, b - a)
        codes, words, piece, text = split_words(own["bytes"])
        langs = own["lang"].dictionary_encode()
        lang = np.array([xxhash.xxh64_intdigest(x, SEED) for x in langs.dictionary.to_pylist()], np.uint64)
        of = langs.indices.to_numpy()[text]
        yield codes, words, piece, of, lang[of], langs.dictionary
        a = b


def frequent_bits(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """Table of 2^bits bits, set where the hashes of one, two and three words number ``least`` or more."""
    shift, span = np.uint64(64 - bits), 1 << RANGE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, words, piece, _, lang, _ in _stretches(batch, STRETCH):
                if not len(codes):
                    continue
                places = np.concatenate([h[same] >> shift for h, same in hashes(codes, words, piece, lang)])
                place, n = np.unique(places.astype(np.uint32), return_counts=True)
                part, starts = np.unique(place >> np.uint32(RANGE), return_index=True)
                ends = [*starts[1:].tolist(), len(place)]
                apart = np.diff(place, prepend=np.uint32(0))
                apart[starts] = place[starts] & np.uint32(span - 1)
                apart, n = apart.astype("<u2"), n.astype("<u4")
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": part.astype(np.int32),
                        "apart": pa.array([_planes(apart[a:b]) for a, b in zip(starts, ends)], pa.binary()),
                        "n": pa.array([_planes(n[a:b]) for a, b in zip(starts, ends)], pa.binary()),
                    }
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(span, np.int64), None
        for batch in batches:
            for own, apart, n in zip(batch["part"], batch["apart"], batch["n"]):
                part = own.as_py()
                total[np.cumsum(_numbers(apart.as_py(), "<u2"), dtype=np.int64)] += _numbers(n.as_py(), "<u4")
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "bits": [np.packbits(total >= least, bitorder="little").tobytes()]}
        )

    counted = rows.mapInArrow(count, "part int, apart binary, n binary")
    packed = counted.groupBy("part").applyInArrow(add, "part int, bits binary")
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in packed.collect():
        table[r.part * span // 8 : (r.part + 1) * span // 8] = np.frombuffer(r.bits, np.uint8)
    return table


def count_windows(rows: DataFrame, table: np.ndarray, window: int = WINDOW) -> DataFrame:
    """lang, w1, w2, ... and n: how often each padded window occurs; its pads are empty.

    Every word begins one window, an empty one where the word itself is rare.
    """
    sent = rows.sparkSession.sparkContext.broadcast(table)
    names = [f"w{k}" for k in range(1, window + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        shift = np.uint64(64 - (8 * len(table)).bit_length() + 1)

        def is_set(h: np.ndarray) -> np.ndarray:
            place = (h >> shift).astype(np.int64)
            return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            for codes, words, piece, of, lang, langs in _stretches(batch, WINDOWS):
                if not len(codes):
                    continue
                one, two, three = (is_set(h) & same for h, same in hashes(codes, words, piece, lang))
                two &= one[:-1] & one[1:]
                three &= two[:-1] & two[1:]
                goes, columns, lead = one, {"lang": pa.array(of.astype(np.int32))}, codes
                for k, name in enumerate(names):
                    if k:
                        # The k-th word goes on from the two before it, the second from the first.
                        on = two if k == 1 else three[k - 2 :]
                        goes = goes & np.append(on, np.zeros(len(goes) - len(on), bool))
                        lead = np.append(lead[1:], -1)
                    columns[name] = np.where(goes, lead, -1).astype(np.int32)
                met = pa.table(columns).group_by(["lang", *names]).aggregate([([], "count_all")])
                words = pa.concat_arrays([words.view(pa.string()), pa.array([""])])
                taken = {}
                for name in names:
                    code = met[name].to_numpy()
                    taken[name] = words.take(pa.array(np.where(code < 0, len(words) - 1, code)))
                yield pa.RecordBatch.from_pydict(
                    {"lang": langs.take(met["lang"].combine_chunks()), **taken, "n": met["count_all"].to_numpy()}
                )

    fields = ", ".join(f"{n} string" for n in ("lang", *names))
    counted = rows.mapInArrow(count, f"{fields}, n long")
    return counted.groupBy("lang", *names).agg(F.sum("n").alias("n"))


def phrase_counts(windows: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, k, phrase and f for every phrase of k words seen ``least`` times or more, and k = 0 with each language's words."""
    names = [c for c in windows.columns if c not in ("lang", "n")]
    rolled = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("__rolled"))
    k = F.lit(len(names)) - F.bit_count("__rolled")
    # Of columns rolled up nothing is joined on.
    rolled = rolled.withColumn("k", k).filter("k >= 0").withColumn("phrase", F.concat_ws(" ", *names))
    last = F.get(F.array(*names), F.col("k") - 1)
    full = (F.col("k") == 0) | ((last != "") & (F.col("f") >= least))
    return rolled.filter(full).select("lang", "k", "phrase", "f")



def score(a: str, n: str, l: str, r: str) -> Column:
    """floor(1000 a n / (l r)); exact while a and l stay below 10^15, and n and r below 10^18."""
    return F.expr(
        f"(CAST(1000 AS DECIMAL(4, 0)) * (CAST({a} AS DECIMAL(15, 0)) * CAST({n} AS DECIMAL(18, 0)))) "
        f"div (CAST({l} AS DECIMAL(15, 0)) * CAST({r} AS DECIMAL(18, 0)))"
    )


def collocations(
    docs: DataFrame,
    *,
    least: int = LEAST,
    top: int = TOP,
    share: int = SHARE,
    window: int = WINDOW,
    bits: int | None = None,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to ``window`` words.

    a is the phrase's frequency, l and r those of its parts at the cut with
    the lowest score floor(1000 a n / (l r)), n the language's words. Phrases
    with a below ``least`` are no candidates; those within a longer candidate
    that has ``share`` percent of their frequency or more are dropped. Order:
    score and a descending, then the phrase. Null texts are empty, a null
    language is ``und``; repeated rows count as often as they occur, texts
    without words and empty tables give no row. Other columns are not looked at.
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("bytes")
    ).filter(F.octet_length("bytes") > 0)
    if bits is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
        bits = min(MOST_BITS, max(RANGE, (size // BYTES_A_BIT).bit_length()))
    table = frequent_bits(rows, least, bits)
    windows = stored(count_windows(rows, table, window), "collocations-windows")
    counts = stored(phrase_counts(windows, least), "collocations-counts")

    candidates = counts.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda a, n: F.concat_ws(" ", F.slice("w", a, n))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right")
    )
    parts = counts.filter("k >= 1")
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    totals = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    scored = (
        cuts.join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
        .join(totals, "lang")
        .withColumn("score", score("a", "n", "l", "r"))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
        .select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    )
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("k") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda at: F.concat_ws(" ", F.slice("w", at, n))),
        )
    )
    longer = candidates.filter("k >= 3").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)
    )
    order = "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)"
    return (
        kept.withColumn("rank", F.expr(order))
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
