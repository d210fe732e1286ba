"""Collocations against brute force over all n-grams."""

import random
import re
from collections import Counter

import pytest

from canopygrid.llm import collocations
from canopygrid.llm.queries import SQL

SCHEMA = "doc_id long, text string, lang string, n long, score string"


def brute(rows, least, top, share=100, window=5):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, window + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    inside = {}
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = lang, w[i : i + m]
                inside[key] = max(inside.get(key, 0), a)
    out = []
    for (lang, w), a in found.items():
        if 100 * inside.get((lang, w), -1) >= share * a:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), l, r, totals[lang]))
    ranked = []
    for lang in sorted(totals):
        best = sorted(x for x in out if x[0] == lang)[:top]
        ranked += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (_, s, a, p, l, r, n) in enumerate(best, 1)]
    return ranked


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, g, 1, "x") for i, (t, g) in enumerate(rows)], SCHEMA)
    got = collocations.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(t == "bigint" for c, t in got.dtypes if c not in ("lang", "phrase"))
    return sorted(tuple(r) for r in got.collect())


def invented(seed, docs=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "é", "A", "a", "日本", "x y", "-", "\x1c"]
    chunks = [r.choices(words, k=r.randrange(2, 7)) for _ in range(6)]
    texts = []
    for _ in range(docs):
        out = []
        for _ in range(r.randrange(0, 40)):
            out += r.choice(chunks) if r.random() < 0.6 else r.choices(words, k=1)
            if r.random() < 0.2:
                out.append(r.choice([".", ",", ";", "!", "?", ":", "\n", "\r", "\x0b", "\x0c", "..", "\t"]))
        texts.append((r.choice([" ", "  ", "\t"]).join(out), r.choice(["en", "en", "de", None, "und", ""])))
    return texts


@pytest.mark.parametrize(("least", "top", "share", "bits"), [(5, 2000, 100, None), (2, 7, 100, 16), (4, 2000, 60, 20), (1, 50, 100, 16)])
def test_matches_brute_force(spark, least, top, share, bits):
    rows = invented(least)
    want = brute(rows, least, top, share)
    assert len(want) > 20
    assert run(spark, rows, least=least, top=top, share=share, bits=bits) == want


def test_small_stretches_and_a_full_table(spark, monkeypatch):
    """A table of bits that is all set only keeps more windows."""
    monkeypatch.setattr(collocations, "STRETCH", 40)
    monkeypatch.setattr(collocations, "WINDOWS", 25)
    rows = invented(9, 30)
    assert run(spark, rows, least=3) == brute(rows, 3, 2000)
    bits = collocations.frequent_bits
    monkeypatch.setattr(collocations, "frequent_bits", lambda *a: bits(*a) | 255)
    assert run(spark, rows, least=3) == brute(rows, 3, 2000)


def test_rare_words_end_windows(spark):
    rows = [("a b c a b d a b e", "en"), ("a b", "en"), ("p q r. " * 2 + "p q. q r", "de")]
    df = spark.createDataFrame([(t.encode(), g) for t, g in rows], "bytes binary, lang string")
    table = collocations.frequent_bits(df, 3, 20)
    windows = {tuple(r) for r in collocations.count_windows(df, table).collect()}
    assert windows == {("en", "a", "b", "", "", "", 4), ("en", "b", "", "", "", "", 4), ("en", "", "", "", "", "", 3),
                       ("de", "p", "q", "", "", "", 3), ("de", "q", "r", "", "", "", 3), ("de", "q", "", "", "", "", 1), ("de", "r", "", "", "", "", 3)}


def test_window_length(spark):
    rows = invented(2)
    assert run(spark, rows, least=3, window=3) == brute(rows, 3, 2000, window=3)


def test_long_texts_ties_and_repeats(spark):
    long = "one two three. " * 30_000 + "four five " * 10_000
    rows = [(long, "en"), (long, "en"), ("b a " * 3, "fr"), ("d c " * 3, "fr")]
    assert run(spark, rows, least=3) == brute(rows, 3, 2000)


def test_products_beyond_64_bits():
    a, n, l, r = 10**12, 10**17, 10**12, 10**14
    assert 1000 * a * n > 2**63 and 1000 * a * n // (l * r) == 10**6


def test_score_is_exact(spark):
    counts = spark.createDataFrame([(10**13 + 7, 10**13 + 9, 10**16 + 3, 10**17 + 1)], "a long, l long, r long, n long")
    got = counts.select(collocations.score("a", "n", "l", "r").alias("score")).first()[0]
    assert got == 1000 * (10**13 + 7) * (10**17 + 1) // ((10**13 + 9) * (10**16 + 3))


def test_awkward_rows(spark):
    assert run(spark, [(None, "en"), ("", "en"), (" . \n", "en"), ("\t", None)], least=1) == []
    assert run(spark, [], least=1) == []
    assert run(spark, [("a b", None)], least=1) == [("und", 1, "a b", 1, 1, 1, 2, 2000)]


def test_sql_agrees(spark):
    import duckdb

    rows = invented(5, 200)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, g) for i, (t, g) in enumerate(rows)])
    got = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({SQL['op11_collocations']})").fetchall()
    assert sorted(got) == brute(rows, 100, 2000) != []
