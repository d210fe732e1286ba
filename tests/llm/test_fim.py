"""Fill-in-the-middle against plain slicing, and boundary sets against lists."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.llm import fim


def brute(doc_id, text, seed=1, cut=90, suffix_first=20, unit="characters"):
    text = text or ""
    units = list(text) if unit == "characters" else text.splitlines(keepends=True) if "\r" not in text else None
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < suffix_first:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


def texts(seed):
    r = random.Random(seed)
    letters = "ab <>PSM\né日\U0001f600"
    out = [None, "", "x", "<P>", "a<S>b", "<M", "<<P", "\U0001f600", "<S", "P>"]
    out += ["".join(r.choices(letters, k=r.randrange(1, 60))) for _ in range(300)]
    out += ["é" * 100_000 + "a" * 150_000, "a" * 300_000, "".join(r.choices("a日", k=200_000))]
    return out + out[-2:]


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_digests_match_slicing(spark):
    rows = [(i % 310 if i % 17 else None, t, 3, "f") for i, t in enumerate(texts(1))]
    got = fim.digests(spark.createDataFrame(rows, "doc_id long, text string, n long, form string"))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = []
    for i, t, *_ in rows:
        n, form, low, middle, out = brute(i, t)
        want.append((i, n, form, low, middle, sha(out), sha(t)))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("options", [{"seed": 5, "cut": 100, "suffix_first": 50}, {"unit": "lines", "cut": 100}, {"cut": 0}])
def test_output_and_round_trip(spark, monkeypatch, options):
    monkeypatch.setattr(fim, "STRETCH", 1000)
    rows = [(i, t, "k") for i, t in enumerate(texts(2))]
    df = spark.createDataFrame(rows, "doc_id int, text string, output string")
    made = fim.restore(fim.fill_in_middle(df, ("doc_id", "text"), **options))
    for r in made.collect():
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == brute(r.doc_id, r.text, **options)
        assert r.restored == (r.text or "")


def test_own_marks(spark):
    df = spark.createDataFrame([(i, "some <P> text") for i in range(50)], "doc_id long, text string")
    marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    made = fim.restore(fim.fill_in_middle(df, marks=marks, cut=100), marks)
    assert made.filter((F.col("restored") == "some <P> text") & (F.col("form") != "plain")).count() == 50
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, unit="words")


def test_empty_table(spark):
    assert fim.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize(
    ("share", "kind"), [(1.0, fim.Runs), (0.999, fim.Runs), (0.5, fim.Bitmap), (0.01, fim.Array), ("blocks", fim.Runs)]
)
def test_containers(share, kind):
    r = np.random.default_rng(3)
    present = np.arange(fim.CHUNK) // 700 % 2 == 0 if share == "blocks" else r.random(fim.CHUNK) < share
    held, n = fim.container(present)
    places = np.flatnonzero(present)
    assert isinstance(held, kind) and n == len(places)
    assert [held.select(k) for k in range(0, n, 7)] == places[::7].tolist()


def test_boundary_set_over_many_containers():
    r = np.random.default_rng(4)
    parts = [r.random(fim.CHUNK) < s for s in (1.1, 0, 0.5, 0.001, 0.9999)] + [r.random(1234) < 0.3]
    present = np.concatenate(parts)
    held = fim.BoundarySet(present)
    places = np.flatnonzero(present)
    assert len(held) == len(places)
    some = [0, len(places) - 1, *r.integers(0, len(places), 500).tolist()]
    assert [held.select(k) for k in some] == places[some].tolist()
    assert len({type(c) for c in held.containers}) == 3


def test_sql_agrees(spark):
    import duckdb

    from canopygrid.llm.queries import SQL

    rows = [(i, t) for i, t in enumerate(texts(6)) if t is None or len(t) < 1000]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    want = []
    for i, t in rows:
        n, form, low, middle, out = brute(i, t)
        want.append((i, n, form, low, middle, sha(out), sha(t)))
    assert sorted(con.execute(f"SELECT {names} FROM ({SQL['op13_fill_in_middle']})").fetchall()) == sorted(want)
