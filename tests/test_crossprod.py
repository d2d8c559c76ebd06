"""Cross products of many columns against direct computation."""

import numpy as np
import pytest

from tidegauge.functions import crossprod
from tidegauge.operators import columns, profile


def table_of(spark, x, keys, parts=5):
    k = x.shape[1]
    rows = [(str(g), *[None if np.isnan(v) else float(v) for v in r]) for g, r in zip(keys, x)]
    return spark.createDataFrame(rows, "recording_id string, " + ", ".join(f"s{i} double" for i in range(k))).repartition(parts)


def numbers(seed=0, n=400, k=12):
    """Signals around a large value, one constant, one without any value, one with few, and gaps everywhere."""
    rng = np.random.default_rng(seed)
    x = 1e7 + rng.normal(0, 1, (n, k)) + np.sin(np.arange(n) / 9)[:, None]
    x[rng.random((n, k)) < 0.2] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 3]), np.nan, 0.1)
    x[:, 4] = np.nan
    x[5:, 5] = np.nan
    x[:, 7] = x[:, 6] * 2
    return x, rng.integers(0, 3, n)


def direct(x, keys):
    out = {}
    for g in set(keys.tolist()):
        y = x[keys == g]
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                both = ~np.isnan(y[:, i]) & ~np.isnan(y[:, j])
                if both.any():
                    a, b = y[both, i] - y[both, i][0], y[both, j] - y[both, j][0]
                    out[str(g), f"s{i}", f"s{j}"] = abs(np.corrcoef(a, b)[0, 1]) if np.ptp(a) > 0 and np.ptp(b) > 0 else None
    return out


@pytest.mark.parametrize("cells", [4_000_000, 10])
def test_correlations_of_many_columns(spark, monkeypatch, cells):
    """Also with a task that sends its sums after every group."""
    monkeypatch.setattr(crossprod, "MOST_CELLS", cells)
    x, keys = numbers()
    names = [f"s{i}" for i in range(x.shape[1])]
    wide = table_of(spark, x, keys)
    want = direct(x, keys)
    got = {(r.recording_id, r.signal_a, r.signal_b): r.r for r in profile.pairwise_correlation(wide, names).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, abs=1e-7)), k
    matrix = {(r.recording_id, r.signal_a, r.signal_b): r.r for r in profile.correlation_matrix(wide, names).collect()}
    same = lambda x, y: x is y is None or x == pytest.approx(y, abs=1e-9)
    assert all(same(matrix[g, a, b], got[g, a, b]) and same(matrix[g, b, a], got[g, a, b]) for g, a, b in got)
    assert matrix["0", "s0", "s0"] == 1.0 and matrix["0", "s3", "s3"] is None and ("0", "s4", "s4") not in matrix


def test_expressions_and_cross_products_agree(spark, monkeypatch):
    x, keys = numbers(1, 200, 8)
    wide, names = table_of(spark, x, keys), [f"s{i}" for i in range(8)]
    few = {tuple(r)[:3]: r.r for r in profile.pairwise_correlation(wide, names).collect()}
    monkeypatch.setattr(profile, "EXPRESSIONS", 1)
    many = {tuple(r)[:3]: r.r for r in profile.pairwise_correlation(wide, names).collect()}
    # Merging partial moments leaves the expressions a trace of spread in the constant column; the cross products have none.
    known = lambda found: {k: v for k, v in found.items() if v is not None and "s3" not in k}
    assert known(few).keys() == known(many).keys() and all(known(many)[k] == pytest.approx(v, abs=1e-7) for k, v in known(few).items())
    assert not any(v is not None for k, v in many.items() if "s3" in k)


def test_duplicates_of_many_columns(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 10))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 6], x[:, 7], x[:, 8], x[:, 9] = x[:, 1], x[:, 1] * (1 + 1e-7), x[:, 2], np.nan
    x[3, 8] = np.nan if not np.isnan(x[3, 2]) else 1.0
    wide, names = table_of(spark, x, np.zeros(90, int)), [f"s{i}" for i in range(10)]
    many = columns.duplicate_groups(wide, names)
    pairs = {(r.a, r.b): r.same for r in columns.duplicate_pairs(wide, names).collect()}
    monkeypatch.setattr(columns, "EXPRESSIONS", 99)
    assert many == columns.duplicate_groups(wide, names) == [["s1", "s6", "s7"]]
    assert pairs == {(r.a, r.b): r.same for r in columns.duplicate_pairs(wide, names).collect()}
