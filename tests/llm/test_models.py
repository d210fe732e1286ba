"""Language, quality and mixing: held-out accuracy, brute force and awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.llm import langid, mixing, quality

SF = "/root/testdata/sf0.01"
LANGUAGES = {"aa": "karo mine tulo hesi", "bb": "zwix qorp vlad ghun", "cc": "été où çà naïf"}


def sentences(r, lang, n):
    return " ".join("".join(r.sample(w, len(w))) if r.random() < 0.2 else w for w in r.choices(LANGUAGES[lang].split(), k=n))


def test_language_weights_are_naive_bayes(spark):
    rows = [("aa", "abcab"), ("aa", "b"), ("bb", "Cb"), (None, "zzzz"), ("bb", None)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), 64)
    assert model.languages == ["aa", "bb"]
    for k, texts in enumerate((["abcab", "b"], ["cb"])):
        counts = Counter(int(b) for t in texts for part in langid.gram_buckets(t, 64) for b in part)
        total = sum(counts.values()) + 64 * langid.SMOOTHING
        want = [math.log((counts[b] + langid.SMOOTHING) / total) for b in range(64)]
        assert model.weights[:, k] == pytest.approx(want, abs=1e-5)
    assert np.exp(model.prior) == pytest.approx([2 / 3, 1 / 3])


def test_long_texts_count_every_gram_once(monkeypatch):
    text = "".join(random.Random(3).choices("abcd é", k=997))
    whole = Counter(int(b) for part in langid.gram_buckets(text) for b in part)
    monkeypatch.setattr(langid, "STRETCH", 10)
    assert Counter(int(b) for part in langid.gram_buckets(text) for b in part) == whole


def test_languages(spark):
    r = random.Random(5)
    rows = [(i, sentences(r, lang, r.randrange(2, 30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 ½ _ !", "aa"), (1003, "karo mine", None), (None, "karo mine", "aa")]
    docs = spark.createDataFrame([(*x, 0.5, "und") for x in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string")
    got = langid.identify(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = {x.doc_id: x for x in got.collect()}
    assert len(got) == len(rows) + len(odd)
    for i, _, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].lang_pred == lang and 0.5 < got[i].score <= 1
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == got[None].lang_pred == "aa"


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = langid.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


@pytest.mark.parametrize("text", ["", "  ", "one", " one, two!!", "é_a-b 9", "x" * 300 + " y"])
def test_word_buckets(text):
    def bucket(word):
        h = 0
        for i, c in enumerate(word):
            h = (h + (c + 1) * int(quality._POWERS[i % 64])) % 2**32
        return ((h ^ h >> 16) * 0x7FEB352D % 2**32) >> 19

    words, last = [], False
    for c in text.encode():
        kind = bool(quality._WORD[c])
        if quality._SPACE[c]:
            last = False
        elif kind and last:
            words[-1].append(c)
        else:
            words.append([c])
            last = kind
    assert quality.word_buckets(text.encode()).tolist() == [bucket(w) for w in words]


def test_word_vectors_are_sums_of_neighbours(spark):
    texts = ["a b c d a", "b", None, "", "c c x"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = quality.word_vectors(docs)
    places, signs = quality.index_vectors()
    context, n = np.zeros((quality.BUCKETS, quality.DIMENSIONS)), np.zeros(quality.BUCKETS)
    for t in texts:
        ids = quality.word_buckets((t or "").encode())
        for i, own in enumerate(ids):
            n[own] += 1
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    np.add.at(context[own], places[ids[j]], signs[ids[j]])
    unit = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1)
    unit -= n / n.sum() @ unit
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got.vectors, unit, atol=1e-5)
    assert np.allclose(got.weights, 1e-3 / (1e-3 + n / n.sum()))


def test_pooling_in_parts(monkeypatch):
    r = np.random.default_rng(2)
    words = quality.WordVectors(r.normal(0, 1, (quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32), r.random(quality.BUCKETS).astype(np.float32))
    texts = [b"", b"one", b" ".join(b"w%d" % (i % 40) for i in range(500)) + b" end"]
    whole = quality.pooled(texts, words)
    monkeypatch.setattr(quality, "STRETCH", 200)
    assert np.allclose(quality.pooled(texts, words), whole, atol=1e-5)
    assert not whole[0].any()


def test_temperature_calibrates():
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (6000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (r.random(6000) < p).astype(float)
    net = quality.fit_network(x[:4000], y[:4000])
    got = net.probability(x[4000:])
    for low in np.arange(0, 1, 0.2):
        inside = (got >= low) & (got < low + 0.2)
        assert abs(got[inside].mean() - p[4000:][inside].mean()) < 0.06
    assert quality.fit_network(x[:0], y[:0]).probability(x[:3]).tolist() == [0.5] * 3


def test_quality_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    both = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert (both.predicted == both.quality).mean() > 0.95


def test_quality_of_awkward_rows(spark):
    rows = [(1, None, 9.0), (2, "", 9.0), (3, "good words here", 9.0), (3, "good words here", 9.0), (None, "!!", 9.0), (4, "x " * 9000, 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for labels in ([], [(3, 1), (None, 0), (77, 1), (2, None)]):
        got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    assert quality.classify(docs.limit(0), labels).count() == 0
    model = quality.fit(docs, labels)
    assert quality.accepted(docs, model, 0.0).columns == docs.columns
    assert sorted(map(repr, quality.accepted(docs, model, 0.0).collect())) == sorted(map(repr, docs.collect()))


# Mixing --------------------------------------------------------------------


def members(spark, seed, n, soft):
    r = np.random.default_rng(seed)
    p = r.dirichlet([soft] * 3, n)
    return spark.createDataFrame(
        [(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(r.integers(0, 400, n), p))], "doc_id long, tokens long, p array<double>"
    )


@pytest.mark.parametrize(("soft", "targets"), [(0.05, (0.5, 0.3, 0.2)), (0.5, (0.4, 0.35, 0.25)), (0.05, (1, 1, 0))])
def test_expected_totals_meet_targets(spark, soft, targets):
    rows = members(spark, 3, 800, soft)
    share = dict(zip("abc", targets))
    mix = mixing.solve(rows, share, budget=20_000)
    got = rows.withColumn("rate", mix.rate(F.col("p"))).toPandas()
    assert got.rate.between(0, 1).all()
    totals = (got.rate * got.tokens).to_numpy() @ np.array(got.p.tolist())
    if min(targets):
        assert totals == pytest.approx(20_000 * np.array(targets) / sum(targets), rel=2e-3)


def test_steps_lessen_the_miss_and_settle(spark):
    """Out of reach: the rates are those at which no document can lessen the weighted miss by moving."""
    rows = members(spark, 4, 60, 1.0)
    mix = mixing.solve(rows, {"a": 1.0, "b": 0.0, "c": 0.0}, budget=6000)
    table = rows.withColumn("rate", mix.rate(F.col("p"))).toPandas()
    p, tokens = np.array(table.p.tolist()), table.tokens.to_numpy(float)
    inverse = np.linalg.inv((p * tokens[:, None]).T @ p)
    slope = p @ (inverse @ ((table.rate.to_numpy() * tokens) @ p - np.array([6000.0, 0, 0])))
    free = (table.rate > 1e-6) & (table.rate < 1 - 1e-6)
    assert np.abs(slope[free]).max(initial=0) < 0.02
    assert (slope[table.rate <= 1e-6] > -0.02).all() and (slope[table.rate >= 1 - 1e-6] < 0.02).all()


def test_mixing_without_tokens_or_rows(spark):
    rows = members(spark, 4, 3, 1.0).withColumn("tokens", F.lit(0).cast("long"))
    for own in (rows, rows.limit(0)):
        assert mixing.solve(own, {"a": 1.0, "b": 1.0, "c": 1.0}).steps == []
    with pytest.raises(ValueError):
        mixing.solve(rows, {"a": 0.0, "b": 0.0, "c": 0.0})


def test_copies_follow_rates(spark):
    got = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("n")).groupBy().agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(got[0] - 1.3) < 0.02 and got[1:] == (1, 2)


def test_profile_in_parts(monkeypatch):
    text = ("né oui, non\n" * 90).encode()
    whole = mixing.features(text)
    assert whole[1] == len(text.split())
    monkeypatch.setattr(mixing, "STRETCH", 7)
    part = mixing.features(text)
    assert np.allclose(whole[0], part[0]) and whole[1] == part[1]
    assert mixing.features(b"")[1] == 0


def test_mixing_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.rates(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    parts = got[[f"p_{d}" for d in mixing.TARGETS]]
    assert (parts.idxmax(axis=1).str[2:] == got.lang).mean() > 0.97
    totals = parts.mul(got.tokens * got.rate, axis=0).sum()
    assert (totals / totals.sum()).tolist() == pytest.approx(list(mixing.TARGETS.values()), abs=1e-3)


def test_mixing_awkward_rows(spark):
    rows = [(1, None, "en", 1.0), (2, "", "fr", 1.0), (3, "a b", None, 1.0), (3, "a b", None, 1.0), (None, "c", "en", 1.0), (5, "d " * 9000, "xx", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, p double")
    labels = spark.createDataFrame([(1,), (None,), (3,), (5,)], "doc_id long")
    assert mixing.rates(docs, labels).count() == 6
    assert mixing.mixed(docs, labels).columns == docs.columns
    assert mixing.mixed(docs.limit(0), labels).count() == 0


def test_budget_keeps_what_fits(spark):
    """A domain of all that is asked holds nothing back: no room is left unused."""
    rows = spark.createDataFrame([(i, 100, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)], "doc_id long, tokens long, p array<double>")
    mix = mixing.solve(rows, {"a": 0.5, "b": 0.5})
    assert mix.wanted.sum() == pytest.approx(4000) and np.abs(mix.miss).max() < 1
    assert rows.filter(mix.rate(F.col("p")) < 0.9999).count() == 0


def test_scarce_domain_is_told_or_repeated(spark):
    rows = spark.createDataFrame([(i, 100, [1.0, 0.0] if i else [0.0, 1.0]) for i in range(100)], "doc_id long, tokens long, p array<double>")
    with pytest.warns(UserWarning, match="'b' holds the mix at 0.0714"):
        mixing.solve(rows, {"a": 0.86, "b": 0.14})
    mix = mixing.solve(rows, {"a": 0.86, "b": 0.14}, most=float("inf"))
    rate = {r.doc_id: r.rate for r in rows.withColumn("rate", mix.rate(F.col("p"))).collect()}
    assert rate[0] == pytest.approx(14, rel=1e-3) and rate[1] == pytest.approx(8600 / 9900, rel=1e-3)


def test_missed_targets_are_told(spark):
    with pytest.warns(UserWarning, match="targets are missed by"):
        mix = mixing.solve(members(spark, 4, 60, 1.0), {"a": 1.0, "b": 0.0, "c": 0.0}, budget=6000)
    assert np.abs(mix.miss).max() > 1e-4 * 6000


def test_label_sample_bounds_rows(spark):
    """Repeated ids take one row, and other languages no place."""
    rows = [(1, f"text {i}", "en") for i in range(50)] + [(i, f"own {i}", "fr") for i in range(2, 6)]
    rows += [(i, "autre", "xx") for i in range(100, 160)] + [(2, "z", "xx"), (3, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = docs.select("doc_id").distinct()
    got = mixing.sampled_labels(docs, labels, ["en", "fr"], 5).collect()
    assert sorted((r.doc_id, r.domain) for r in got) == [(1, "en"), (2, "fr"), (3, "fr"), (4, "fr"), (5, "fr")]


def test_a_missing_language_does_not_empty_the_corpus(spark):
    """Without its scarcest language the corpus stays, the others at their shares."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.filter("lang <> 'de'")
    with pytest.warns(UserWarning, match="'de' would hold the mix below"):
        kept = mixing.mixed(docs, labels)
    kept = kept.select("doc_id", "lang", "text").toPandas()
    assert 0.5 * 871 < len(kept) < 871
    words = kept.text.str.split().str.len().groupby(kept.lang).sum()
    want = {d: x / 0.82 for d, x in mixing.TARGETS.items() if d != "de"}
    assert (words / words.sum()).to_dict() == pytest.approx(want, abs=0.04)


def test_scarce_domain_gives_all_it_has(spark):
    rows = spark.createDataFrame([(i, 100, [1.0, 0.0] if i else [0.0, 1.0]) for i in range(100)], "doc_id long, tokens long, p array<double>")
    with pytest.warns(UserWarning, match="'b' would hold"):
        mix = mixing.solve(rows, {"a": 0.86, "b": 0.14}, floor=0.5)
    assert mix.wanted.tolist() == pytest.approx([9900, 100])
    assert rows.filter(mix.rate(F.col("p")) < 0.999).count() == 0


def test_one_row_teaches_for_a_repeated_labelled_id(spark):
    """A labelled id on most rows counts once, and no label is left out for it."""
    good, bad = "plain words in a row", "zz qq zz qq zz"
    rows = [(i, good if i % 2 else bad) for i in range(40)] + [(0, bad)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = quality.fit(docs.dropDuplicates(), labels, sample=40)
    seen = []
    network = quality.fit_network
    try:
        quality.fit_network = lambda x, y: seen.append(y) or network(x, y)
        quality.fit(docs, labels, sample=40)
    finally:
        quality.fit_network = network
    assert len(seen[0]) == 40 and sum(seen[0]) == 20 and once is not None


def test_more_languages_than_one_matrix_holds(spark):
    """Blocks of languages give what one matrix of all gives; 600 languages are no error."""
    r = random.Random(8)
    words = {f"l{i:03d}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)] for i in range(600)}
    rows = [(i, " ".join(r.choices(words[lang], k=12)), lang) for i, lang in enumerate(words)]
    rows += [(1000, None, None), (1001, "", None), (1002, "12 3", None), (5, rows[5][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    few = docs.filter("lang IS NULL OR lang < 'l020'")
    one = langid.predict(few, langid.fit(few)).collect()
    model = langid.fit(few, most=3)
    assert isinstance(model, langid.LanguageBlocks) and [len(m.languages) for m in model.models()] == [3] * 6 + [2]
    blocks = langid.predict(few, model).collect()
    key = lambda x: (x.doc_id, x.lang_pred)
    for a, b in zip(sorted(one, key=key), sorted(blocks, key=key), strict=True):
        assert (a.doc_id, a.lang_pred) == (b.doc_id, b.lang_pred) and abs(a.score - b.score) < 1e-6
    got = {x.doc_id: x for x in langid.predict(docs, langid.fit(docs)).collect()}
    assert sum(got[i].lang_pred == rows[i][2] for i in range(600)) > 570
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
