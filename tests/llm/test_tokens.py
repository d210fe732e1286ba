"""Token ids, packing and token files against direct encoding."""

import random
import zlib
from bisect import bisect_left, insort
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from canopygrid.llm import packing, tokenfiles, tokens

HARD = [
    "", " \t\n\x0b\x0c\r ", "It's we're A'b don't's 'S 'ss x' 'll", "\x1c q\x1fr\x85s\xa0t u", "İstanbul ΣΑΣ ﬁ é K å Å",
    "12,345.67 a.b,c ... !! ?!,", "<|endoftext|> <|STARTOFTEXT|>", "x <|endoftext|> Y", "a<|startoftext|>b <|endoftext", "你好,世界. ½² Ünïcödé, ÀÉ. ª º ŉ ǅ ß", "naïve... été!? ö;",
    "a" * 5000 + ".", "😀 é ́x", "word " * 3000, "\x00 \x7f \xad​",
]


@pytest.fixture(scope="module")
def direct():
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [0, 10**6])
def test_same_ids_as_the_tokenizer(direct, remembered):
    encode = tokens.WordEncoder(tokens.vocabulary_path(), remembered)
    r = random.Random(1)
    bits = [x for t in HARD for x in t.split(" ")[:40]] + [" ", ",", ".", "'", "é", "É", "ß", "İ", "Σ", "9"]
    texts = HARD + ["".join(r.choices(bits, k=r.randrange(1, 9))) for _ in range(400)]
    for text, packed in zip(texts, encode(t.encode() for t in texts)):
        assert np.frombuffer(packed, "<u4").tolist() == direct(text), text[:80]


def one_by_one(lengths, capacity):
    """Best-fit decreasing: the sorted gaps it leaves, and its sequences."""
    gaps, sequences = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect_left(gaps, n)
        sequences += k == len(gaps)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        insort(gaps, gap - n)
    return gaps, sequences


@pytest.mark.parametrize("seed", range(30))
def test_sweep_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 50, 300])
    lengths = [min(capacity, int(r.paretovariate(r.choice([0.3, 1])))) for _ in range(r.randrange(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    segments, opened = packing.sweep(counts, capacity)
    placed = {}
    for length, rank, pieces, first, each, base in segments.tolist():
        for i in range(pieces):
            placed.setdefault(first + i // each, []).append((base + i % each * length, length, rank + i))
    gaps = []
    for inside in placed.values():
        inside.sort()
        ends = [a + n for a, n, _ in inside]
        assert [a for a, _, _ in inside] == [0, *ends[:-1]] and ends[-1] <= capacity
        gaps.append(capacity - ends[-1])
    assert sorted((n, k) for inside in placed.values() for _, n, k in inside) == sorted(
        (n, k) for n, c in counts.items() for k in range(c)
    )
    assert (sorted(gaps), opened) == one_by_one(lengths, capacity)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        if r.sequence_id is not None:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in by.values():
        inside.sort()
        assert [a for a, _ in inside] == [0, *np.cumsum([n for _, n in inside])[:-1].tolist()]
        assert sum(n for _, n in inside) <= capacity
    return len(by)


def test_packing_rows(spark):
    r = random.Random(2)
    rows = [(i, 0, 5 if i % 3 == 0 else r.randrange(1, 41), "x", i) for i in range(3000)]
    rows += [(7, 0, 5, "x", 7), (7, 0, 5, "x", 7), (None, None, 3, None, None), (9000, 0, 0, "zero", 1), (9001, 0, None, "null", 1)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length int, kept string, offset long").repartition(5)
    got = packing.best_fit(pieces, 40)
    assert got.columns == ["doc_id", "piece", "length", "kept", "sequence_id", "offset"]
    got = got.collect()
    key = lambda x: repr(tuple(x)[:4])
    assert sorted(map(key, got)) == sorted(map(key, rows))
    assert {x.kept for x in got if x.sequence_id is None} == {"zero", "null"}
    assert check_places(got, 40) == one_by_one([x[2] for x in rows if x[2]], 40)[1]


def test_piece_too_long(spark):
    with pytest.raises(ValueError, match="does not fit"):
        packing.best_fit(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length int"), 8)


ROWS = [(40, HARD[7]), (3, None), (3, ""), (12, HARD[11]), (-5, "same text"), (12, "same text"), (12, "same text"), (None, HARD[2])]


def documents(spark):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in ROWS], "doc_id long, text string, start string, length int").repartition(3)


def test_pack_documents(spark, direct):
    got = packing.pack_documents(documents(spark), 256).collect()
    check_places(got, 256)
    want = []
    for i, text in ROWS:
        ids = [*direct(text), 0]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want.append((i, k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(repr, (tuple(x)[:5] for x in got))) == sorted(map(repr, want))


@pytest.mark.parametrize("bits", [16, 32])
def test_token_files(spark, direct, tmp_path, bits):
    folder = tokenfiles.write_tokens(documents(spark), f"{tmp_path}/store", bits=bits)
    got = [tuple(r) for r in tokenfiles.read_tokens(spark, folder).orderBy("start").collect()]
    order = sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    want, at, every = [], 0, []
    for i, text in order:
        ids = [*direct(text), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        every += ids
    assert got == want
    manifest = spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()
    flat = np.concatenate([np.fromfile(f"{m.path}.bin", f"<u{bits // 8}") for m in manifest])
    assert flat.tolist() == every
    assert [m.token_base for m in manifest] == [0, *np.cumsum([m.n_tokens for m in manifest])[:-1].tolist()]
    assert all(np.fromfile(f"{m.path}.off", "<u8")[-1] == m.n_tokens for m in manifest)


def test_uri_of_a_store(spark, tmp_path):
    folder = tokenfiles.write_tokens(documents(spark), f"file://{tmp_path}/store")
    assert tokenfiles.read_tokens(spark, folder).count() == len(ROWS)
    assert list(Path(tmp_path, "store").glob("*.bin"))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).count() == 0
    assert tokenfiles.read_tokens(spark, tokenfiles.write_tokens(docs)).count() == 0
    assert packing.sweep({}, 9)[1] == 0


def test_hot_length_is_spread(spark):
    """Most pieces of one length still lie in many parts, and are all placed."""
    pieces = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id") % 64 + 1).alias("length")
    )
    got = packing.best_fit(pieces, 64)
    assert got.agg(F.count("sequence_id"), F.sum("length")).first() == pieces.agg(F.count("*"), F.sum("length")).first()
