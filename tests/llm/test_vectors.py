"""Vector near-duplicates against brute force."""

import numpy as np
import pytest

from canopygrid.llm import vectors

SCHEMA = "vec_id long, embedding array<double>, n_links string, key int"


def sound(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, least=0.9):
    good = [i for i, (_, v) in enumerate(rows) if sound(v)]
    near = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            a, b = rows[i][1], rows[j][1]
            if j < i and len(a) == len(b):
                a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, (own, _) in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - reached
            reached |= new
            todo.extend(new)
        ids = [rows[j][0] for j in reached if rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((own, len(near[i]), first, own == first))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = vectors.near_duplicates(df, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def planted(seed, dim, n=240, groups=6, spread=0.3):
    """Groups of near copies on both sides of the bound, single vectors, and copies at other lengths."""
    r = np.random.default_rng(seed)
    middles = r.normal(size=(groups, dim))
    rows = []
    for i in range(n):
        if i % 3:
            v = middles[i % groups] + r.normal(size=dim) * spread * r.random()
        else:
            v = r.normal(size=dim)
        rows.append(v * 10.0 ** r.integers(-3, 4))
    rows += [rows[1], rows[1] * 1.0, rows[1] * 2.0, rows[0], -rows[0]]
    return [(1000 - i, v.tolist()) for i, v in enumerate(rows)]


@pytest.mark.parametrize(
    ("dim", "options"),
    [
        (64, {}),
        (64, {"chunk": 20}),
        (32, {"width": 4, "chunk": 37}),
        (17, {"least": 0.8, "width": 5}),
        (3, {"chunk": 25}),
        (2, {"least": 0.99, "width": 1, "chunk": 16}),
        (1, {}),
    ],
)
def test_matches_brute_force(spark, dim, options):
    rows = planted(dim, dim)
    want = brute(rows, options.get("least", 0.9))
    assert run(spark, rows, **options) == want
    assert len({w[2] for w in want}) < len(want) - 20


def test_trees_and_strips(spark, monkeypatch):
    """Data with distant clusters is cut by planes, rows visit, and no pair counts twice."""
    monkeypatch.setattr(vectors, "VISITORS", 0.6)
    monkeypatch.setattr(vectors, "STRIP", 8)
    rows = planted(3, 16, n=400, groups=9, spread=0.9)
    plans = vectors.fit([np.array(v) for _, v in rows], 0.9, 4)
    assert any(isinstance(t, vectors.Plane) for t in plans[16].trees)
    assert run(spark, rows, width=4, chunk=30) == brute(rows)


def test_planes_lose_and_repeat_no_pair():
    r = np.random.default_rng(5)
    points = np.concatenate([r.normal(m, 1, (60, 3)) for m in (0, 3, 6, 9)])
    radius = 0.8
    tree = vectors.fit_tree(points, radius)
    seen = []
    for _, rows, crossed in vectors.route(tree, points, radius):
        seen += [
            (min(a, b), max(a, b))
            for i, (a, x) in enumerate(zip(rows, crossed))
            for b, y in zip(rows[:i], crossed)
            if np.linalg.norm(points[a] - points[b]) <= radius and not x & y
        ]
    want = [(a, b) for a in range(240) for b in range(a + 1, 240) if np.linalg.norm(points[a] - points[b]) <= radius]
    assert isinstance(tree, vectors.Plane) and sorted(seen) == want


def test_crowds_are_counted_by_balls(spark):
    """A crowd of near copies meets nobody of its own ball."""
    r = np.random.default_rng(8)
    middle = r.normal(size=24)
    rows = [(i, (middle + r.normal(size=24) * (0.05 if i % 4 else 0.35)).tolist()) for i in range(300)]
    units = vectors.unit(np.array([v for _, v in rows]))
    balls = vectors.fit_balls(units, 0.9)
    held = np.linalg.norm(units - balls[0], axis=1) <= vectors.ball_radius(0.9)
    assert 200 < held.sum() < 300 and (units[held] @ units[held].T).min() >= 0.9
    assert run(spark, rows, chunk=64) == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0]
    rows = [
        (5, None), (4, []), (3, [0.0, 0.0]), (3, [0.0, -0.0]), (2, [nan, 1.0]), (1, [inf, 1.0]), (0, [None, 1.0]),
        (9, v), (8, v), (None, v), (8, [2.0, 4.0]), (7, [1.0, 2.0, 0.0]), (None, None), (None, [5.0, -1.0, 0.0]),
        (6, [1e-200, 2e-200]), (10, [1e200, 2e200]), (11, [-0.0, 3.0]), (12, [0.0, 3.0]),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_sql_agrees(spark):
    import duckdb

    from canopygrid.llm.queries import SQL

    rows = planted(2, 12, n=150)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    got = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({SQL['op12_vector_neighbours']})").fetchall()
    assert sorted(got, key=str) == brute(rows)


def test_blocks_without_planes_are_dealt_once(spark):
    """Vectors without structure are moved for all blocks together; with planes, a row is at home once."""
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, 1, r.normal(size=64).tolist()) for i in range(100)], "node long, copies long, v array<double>")
    plans = vectors.fit([np.array(x.v) for x in df.collect()], 0.9, 16)
    assert vectors.cut_blocks(plans, 64) == []
    dealt = vectors._dealt(df, plans, 0.9, 16).collect()
    assert len(dealt) == 100 and all(x.home and x.block == vectors.REST for x in dealt)
    middles = r.normal(size=(5, 16)) * 3
    rows = [(i, 1, (middles[i % 5] + r.normal(size=16) * 0.2).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "node long, copies long, v array<double>")
    plans = vectors.fit([np.array(v) for *_, v in rows], 0.9, 4)
    assert vectors.cut_blocks(plans, 16)
    assert sorted(x.node for x in vectors._dealt(df, plans, 0.9, 4).filter("home").collect()) == list(range(400))


def test_some_blocks_with_planes_and_some_without(spark):
    """Two clusters in the first block's space, and a cloud in the others': pairs on both sides of the bound count once."""
    r = np.random.default_rng(6)
    turned = r.normal(size=(300, 16)) * r.uniform(0.05, 0.1, (300, 1))
    turned[:, 0] += np.where(np.arange(300) % 2, 0.7, -0.7)
    rows = [(i, v.tolist()) for i, v in enumerate(turned @ vectors.rotation(16).T / vectors.UNIT)]
    plans = vectors.fit([np.array(v) for _, v in rows], 0.9, 4)
    assert vectors.cut_blocks(plans, 16) == [0]
    want = brute(rows)
    assert 1000 < sum(w[1] for w in want) < 300 * 149
    assert run(spark, rows, width=4, chunk=40) == want


def test_a_round_moves_rows_in_proportion(spark, monkeypatch):
    """Four times the rows, all pairs of chunks: no round moves more than twice the rows."""
    monkeypatch.setattr(vectors, "ROUND", 1)
    moved, compared = [], vectors.stored

    def seen(df, purpose, **options):
        out = compared(df, purpose, **options)
        if purpose == "vectors-pairs":
            total = out.selectExpr("sum(moved)").first()[0]
            n = vectors.rounds_of(size, total)
            moved.append((total / size, n, total / n / size))
        return out

    monkeypatch.setattr(vectors, "stored", seen)
    r = np.random.default_rng(1)
    for size in (60, 240):
        rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(size, 5)))]
        assert run(spark, rows, chunk=12) == brute(rows)
    (few, _, _), (many, rounds, each) = moved
    assert many > 3 * few and rounds > 2 and each <= vectors.SHARE
