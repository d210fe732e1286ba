import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from canopygrid.functions.quantiles import grouped_percentiles

PS = (0, 5, 50, 75, 95, 99, 100)
NAMES = [f"p{p}" for p in PS]


def by_group(df):
    return {r["g"]: [r["n"], *[r[n] for n in NAMES]] for r in df.collect()}


def check(spark, groups, **options):
    rows = [(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, value double")
    want = {}
    for g, vs in groups.items():
        clean = [v for v in vs if v is not None and not np.isnan(v)]
        if clean:
            want[g] = [len(clean), *np.percentile(clean, PS)]
    for bins in (options.pop("bins", None), (1024,), (8, 16), (4, 4, 4)):
        if bins is None:
            continue
        got = by_group(grouped_percentiles(df, ["g"], "value", PS, bins=bins, **options))
        assert set(got) == set(want)
        for g in want:
            np.testing.assert_allclose(got[g], want[g], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("method", ["binned", "hash"])
def test_matches_numpy(spark, method):
    rng = np.random.default_rng(0)
    groups = {
        "one": [0.25],
        "two": [0.1, 0.9],
        "ties": [0.5] * 50 + [0.7] * 3,
        "wide": list(rng.normal(0, 5, 500)),
        "narrow": list(0.8 + rng.uniform(0, 1e-5, 500)),
        "gaps": [None, float("nan"), 0.3, -0.3],
        "none": [None, float("nan")],
    }
    check(spark, groups, method=method)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=60))
def test_binned_equals_numpy_for_any_values(spark, values):
    check(spark, {"a": values, "b": values[: len(values) // 2 + 1]}, bins=(16,))


def test_hot_group(spark):
    """A group with most rows, half of them one value, next to small ones."""
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.full(20000, 0.75), rng.uniform(-1, 1, 20000)])
    check(spark, {"hot": list(hot), "small": list(rng.uniform(-1, 1, 20))})


def test_null_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 0.1), (None, 0.3), ("a", 0.2)], "g string, value double")
    assert by_group(grouped_percentiles(df, ["g"], "value", PS))[None][0] == 2


def test_no_keys(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "value double")
    row = grouped_percentiles(df, [], "value", (50, 95), value_range=(0, 100)).first()
    assert (row.n, row.p50, row.p95) == (101, 50.0, 95.0)
    assert grouped_percentiles(df.filter("value < 0"), [], "value", (50,)).count() == 0


@pytest.mark.parametrize("method", ["binned", "hash"])
@pytest.mark.parametrize("inclusive, want", [(True, {100, 101}), (False, {101})])
def test_threshold_edges(spark, method, inclusive, want):
    rows = [(n, float(i)) for n in (99, 100, 101) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, value double")
    out = grouped_percentiles(df, ["g"], "value", (95,), min_count=100, inclusive=inclusive, method=method)
    assert {r.g for r in out.collect()} == want


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        grouped_percentiles(spark.range(1), [], "id", (50,), method="guess")


def stratified(spark, rows, strata, **options):
    df = spark.createDataFrame(rows, "g string, side string, value double")
    got = grouped_percentiles(df, ["g"], "value", PS, part="side", strata=strata, **options)
    assert got.columns == ["g", "stratum", "n", *NAMES]
    return {(r.g, r.stratum): [r.n, *[r[n] for n in NAMES]] for r in got.collect()}


@pytest.mark.parametrize("options", [{}, {"bins": (16,)}, {"bins": (4, 8)}, {"method": "hash"}])
def test_strata_add_up(spark, options):
    """Strata that overlap, one of everything, one that nothing belongs to, and parts that no stratum names."""
    rng = np.random.default_rng(6)
    rows = [
        (str(g), side, float(v))
        for g in range(4)
        for side, n in (("s", 90), ("n", 40 * g), ("e", 5), (None, 7), ("", 3))
        for v in rng.uniform(-1.2, 1.2, n).round(2)
    ]
    strata = {"whole": None, "south": ["s"], "north": ["n"], "both": ["s", "n"], "none": ["x"]}
    want = {}
    for g in map(str, range(4)):
        for name, parts in strata.items():
            vs = [v for k, side, v in rows if k == g and (parts is None or side in parts)]
            if vs:
                want[g, name] = [len(vs), *np.percentile(vs, PS)]
    got = stratified(spark, rows, strata, **options)
    assert set(got) == set(want)
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-12, atol=1e-12)
    assert stratified(spark, [], strata, **options) == {}


def test_bits_that_meet_change_nothing(spark, monkeypatch):
    from canopygrid.functions import quantiles

    monkeypatch.setattr(quantiles, "MARKS", 64)
    rng = np.random.default_rng(7)
    check(spark, {str(g): list(rng.uniform(-1, 1, 40)) for g in range(60)})
