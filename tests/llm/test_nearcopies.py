"""Near copies by similarity of shingles against brute force, and through the pipeline's stage."""

import random

import pytest

import corpus_pipeline
from canopygrid.llm import nearcopies
from test_simhash import DOCS, groups


def shingled(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(seed):
    """Texts and copies of them with some words changed: similarities on both sides of 0.8; and a crowd of copies."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        own = r.choices(vocabulary, k=r.choice([6, 12, 60, 200, 400]))
        texts.append(own)
        for _ in range(4):
            copy = list(own)
            for _ in range(r.randrange(0, 1 + len(own) // 30)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(copy[r.randrange(2) :])
    crowd = r.choices(vocabulary, k=120)
    for _ in range(60):
        copy = list(crowd)
        for _ in range(r.randrange(0, 5)):
            copy[r.randrange(120)] = r.choice(vocabulary)
        texts.append(copy)
    r.shuffle(texts)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("hot", "block"), [(64, 128), (5, 7), (0, 50), (1000, 9)])
def test_groups_are_those_of_all_pairs(spark, hot, block):
    texts = planted(4)
    sets = [shingled(t) for t in texts]
    edges = [(j, i) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    values = [similarity(sets[i], sets[j]) for j, i in edges]
    assert min(values) < 0.85 and sum(0.8 <= v < 0.95 for v in values) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = nearcopies.near_duplicates(docs, hot=hot, block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == groups(range(len(texts)), edges)


def test_the_stage_links_by_simhash(spark, monkeypatch):
    """Fingerprints' candidates are those of all pairs within two bits, are checked, and are not compared again."""
    from canopygrid.llm import simhash

    texts = planted(9)
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    names = [nearcopies.node(nearcopies.shingles(t.encode())) for t in texts]
    meet = [(j, i) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert any(names[i] != names[j] for j, i in meet)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, made = [], nearcopies.fingerprint_pairs
    monkeypatch.setattr(nearcopies, "fingerprint_pairs", lambda *a: asked.append(made(*a)) or asked[-1])
    corpus_pipeline.near_duplicate_stage(spark, docs, "").count()
    assert len(asked) == 1
    found = [tuple(r) for r in made(docs).collect()]
    assert groups(set(names), found) == groups(set(names), [(names[j], names[i]) for j, i in meet])


def test_stage_removes_near_copies(spark):
    texts = planted(6)
    sets = [shingled(t) for t in texts]
    edges = [(j, i) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups(range(len(texts)), edges).values()))


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in DOCS], "doc_id long, text string, node string, n int")
    kept = sorted(((r.doc_id or -1, r.text) for r in nearcopies.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(3, DOCS[1][1]), (9, DOCS[4][1]), (2, None), (-1, DOCS[8][1]), (8, DOCS[9][1])], key=repr)
    assert nearcopies.keep_one(docs).columns == docs.columns
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("own", [60, 5])
def test_a_crowd_is_copied_in_proportion(spark, monkeypatch, own):
    """Four times as many texts around one passage: with much of their own they do not meet at all, near copies are all joined by hubs."""
    r = random.Random(own)
    passage = [f"t{i}" for i in range(300)]
    copied = []
    dealt = nearcopies._dealt

    def counted(*args):
        rows = dealt(*args)
        copied.append(rows.count())
        return rows

    monkeypatch.setattr(nearcopies, "_dealt", counted)
    for n in (110, 440):
        texts = [" ".join([*passage[:150], *(f"o{r.random()}" for _ in range(own)), *passage[150:]]) for _ in range(n)]
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        groups = {x.component_id for x in nearcopies.near_duplicates(docs).collect()}
        assert len(groups) == (n if own == 60 else 1)
    assert copied == [0, 0]


def test_scratch_tables_go(spark, tmp_path):
    from canopygrid.llm import tables

    paths = []
    shared = tables.shared_folder
    try:
        tables.shared_folder = lambda s, purpose: paths.append(str(tmp_path / f"{purpose}-{len(paths)}")) or paths[-1]
        with tables.scratch(spark):
            tables.stored(spark.range(3), "goes")
            with tables.scratch(spark):
                tables.stored(spark.range(3), "inner")
                outer = tables.stored(spark.range(3), "outer", keep=True)
            assert outer.count() == 3
            kept = tables.stored(spark.range(4), "kept", keep=True)
    finally:
        tables.shared_folder = shared
    assert kept.count() == 4 and [p.name for p in tmp_path.iterdir()] == ["kept-3"]


def test_batches_are_bounded_in_bytes_while_a_table_is_stored(spark):
    from canopygrid.llm import tables

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes])})

    before = spark.conf.get(tables.BATCH_CONF, None)
    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 3000) AS t")
    seen = [r.bytes for r in tables.stored(texts.mapInArrow(sizes, "bytes long"), "batches").collect()]
    assert len(seen) > 1 and max(seen) < 2 * tables.BATCH_BYTES
    assert spark.conf.get(tables.BATCH_CONF, None) == before


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.length())) if n.startswith("shuffle_")}


def test_what_a_stored_table_was_shuffled_for_goes_with_it(spark):
    import time

    from canopygrid.llm import tables

    before = shuffle_files(spark)
    tables.stored(spark.range(1000).repartition(3, "id"), "shuffled")
    for _ in range(50):  # files are deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(tables.CLEANED) == "false"


def test_texts_stay_where_they_lie_as_copies_go(spark):
    """The stage ends by sending ids to the texts, not texts to ids, even where Spark itself sends nothing."""
    docs = spark.createDataFrame([(i, f"text {i // 2} of this table") for i in range(60)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = nearcopies.keep_one(docs)
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [1 << 19, 0])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_rows_with_ids(spark, monkeypatch, most, kind):
    from canopygrid.llm import tables

    monkeypatch.setattr(tables, "SENT", most)
    r = random.Random(3)
    ends = [-(2**63), 2**63 - 1, 2**62] if kind == "long" else [-(2**31), 2**31 - 1]
    own = [*range(-200, 200), *ends, None]
    for chosen in (r.sample(own, 150), own, [None], [63, 64, -64, -1], []):
        as_kind = lambda i: str(i) if kind == "string" and i is not None else i
        docs = spark.createDataFrame([(as_kind(i), 7) for i in own], f"doc_id {kind}, _word int")
        ids = spark.createDataFrame([(as_kind(i),) for i in chosen], f"_id {kind}")
        got = tables.with_ids(docs, "doc_id", ids)
        assert got.columns == ["doc_id", "_word"]
        assert sorted((x.doc_id for x in got.collect()), key=str) == sorted((x._id for x in ids.collect()), key=str)


def test_a_small_crowd_has_few_copies_of_its_hubs(spark):
    """A crowd's hubs are copied in proportion to it: 100 classes are one part, 1,000 are four."""
    rows = [(i, True, 0) for i in range(100)] + [(i, True, 1) for i in range(100, 1100)]
    crowds = spark.createDataFrame(rows, "node long, index boolean, crowd long")
    got = {r.crowd: (r.salts, len(set(r.hubs))) for r in nearcopies._hubs(crowds).collect()}
    assert got == {0: (1, nearcopies.HUBS), 1: (4, nearcopies.HUBS)}
