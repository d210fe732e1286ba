"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from canopygrid.llm import simhash
from canopygrid.llm.components import components


def groups(nodes, edges):
    """Smallest member of each node's component."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near(values):
    unsigned = np.array(values, np.int64).view(np.uint64)
    for i, v in enumerate(unsigned):
        for j in np.flatnonzero(np.bitwise_count(unsigned[i + 1 :] ^ v) <= 2):
            yield values[i], values[i + 1 + int(j)]


def by_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("text", ["", " \n", "A", "a É", "A b\tC", "x  y z\x0bw x y z", "été " * 40, "à b c d e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == by_words(text)


def test_long_text(monkeypatch):
    text = " ".join(random.Random(3).choices(["a", "bb", "ccc", "dd"], k=500))
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert simhash.fingerprint(text.encode()) == by_words(text)


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (500, 501), (501, 500)]
    edges += [(r.randrange(600, 900), r.randrange(600, 900)) for _ in range(150)] + [(None, 3), (-9, -5)]
    r.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    real = [e for e in edges if None not in e]
    want = groups({n for e in real for n in e}, real)
    assert got == {n: root for n, root in want.items() if n != root}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("parts", "hot"), [(None, 64), (4, 3), (3, 3), (2, 3), (2, 64), (4, 0)])
def test_links_connect_what_is_near(spark, parts, hot):
    r = random.Random(8)
    values = {r.getrandbits(64) for _ in range(150)} | {0, 1, (1 << 64) - 1}
    for v in list(values)[:12]:
        for _ in range(30):  # chains and clusters of copies
            v ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            values.add(v)
            values.add(v ^ 7)
    values = sorted(simhash._signed(v) for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = [tuple(x) for x in simhash.links(fps, parts, hot).collect()]
    want = list(near(values))
    assert set(got) <= {*want, *((b, a) for a, b in want)}
    assert groups(values, got) == groups(values, want)


def test_thresholds_are_the_cheapest():
    r = random.Random(2)
    for _ in range(40):
        costs = [[r.random() * k for k in (1, 20, 400)] for _ in range(r.randrange(1, 5))]
        chosen = simhash.allocate(costs, 2)
        assert sum(t + 1 for t in chosen) == 3

        def total(ts):
            return sum(c[t] for c, t in zip(costs, ts) if t >= 0)

        every = [ts for ts in np.ndindex(*[4] * len(costs)) if sum(ts) == 3]
        assert total(chosen) == pytest.approx(min(total([t - 1 for t in ts]) for ts in every))


def test_bits_fall_into_groups_once():
    r = np.random.default_rng(1)
    x = r.integers(0, 2, (500, 64))
    x[:, 9] = x[:, 40]
    groups_ = simhash.group_bits(500, (x.T @ x).astype(float), 4)
    assert sorted(b for g in groups_ for b in g) == list(range(64))
    assert any({9, 40} <= set(g) for g in groups_)


DOCS = [
    (5, "one two three four five six"),
    (3, "one two three  four five SIX"),
    (9, "one two three four five six"),
    (9, "one two three four five six"),
    (9, "quite another text of this id"),
    (2, None),
    (4, ""),
    (None, " "),
    (None, "nobody knows this document at all"),
    (8, "lone words here"),
]


def test_near_duplicates_of_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in DOCS], "doc_id long, text string, component_id string, i int")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 2), (2, 2), (3, 3), (4, 2), (5, 3), (8, 8), (9, 3), (9, 3), (9, 9)]
    kept = sorted(((r.doc_id or -1, r.text) for r in simhash.keep_one(docs).collect()), key=repr)
    assert kept == sorted(
        [(3, DOCS[1][1]), (9, DOCS[4][1]), (2, None), (-1, DOCS[8][1]), (8, DOCS[9][1])], key=repr
    )
    assert simhash.keep_one(docs).columns == docs.columns


def test_keep_one_of_unique_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0
