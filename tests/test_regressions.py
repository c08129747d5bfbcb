"""Regression filling against a plain version, on both paths, with and without shrinkage."""
import random

import numpy as np
import pytest

from tablewright.operators import impute


def table_with_gaps(seed: int, n: int = 250, m: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 2)) @ rng.standard_normal((2, m)) + 0.3 * rng.standard_normal((n, m)) + 50
    return np.where(rng.random((n, m)) < [0.1, 0.25, 0.3, 0.0][:m], np.nan, base)


def ridge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by evidence, from the rows themselves."""
    n, prior, noise, w = len(y), 1.0, 1.0 / y.var(), None
    for _ in range(300):
        before, w = w, np.linalg.solve(x.T @ x + prior / noise * np.eye(x.shape[1]), x.T @ y)
        e = np.linalg.eigvalsh(x.T @ x)
        used = (noise * e / (prior + noise * e)).sum()
        prior, noise = (used + 2e-6) / (w @ w + 2e-6), (n - used + 2e-6) / (((y - x @ w) ** 2).sum() + 2e-6)
        if before is not None and np.abs(before - w).sum() < 1e-3:
            break
    return np.linalg.solve(x.T @ x + prior / noise * np.eye(x.shape[1]), x.T @ y)


def plain(x: np.ndarray, rounds: int, shrinkage: str) -> np.ndarray:
    gaps = np.isnan(x)
    out = np.where(gaps, np.nanmean(x, axis=0), x)
    for _ in range(rounds):
        for i in sorted(range(x.shape[1]), key=lambda i: gaps[:, i].sum()):
            if not gaps[:, i].any():
                continue
            others, has = [j for j in range(x.shape[1]) if j != i], ~gaps[:, i]
            mx, my = out[has][:, others].mean(axis=0), out[has, i].mean()
            a, b = out[has][:, others] - mx, out[has, i] - my
            w = ridge(a, b) if shrinkage == "evidence" else np.linalg.lstsq(a, b, rcond=None)[0]
            out[~has, i] = my + (out[~has][:, others] - mx) @ w
    return out


@pytest.mark.parametrize("most", [4096, 0])
@pytest.mark.parametrize("shrinkage", ["none", "evidence"])
def test_rounds(spark, monkeypatch, most, shrinkage):
    monkeypatch.setattr(impute, "MAX_PATTERNS", most)
    x = table_with_gaps(3)
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
                               "id long, a double, b double, c double, d double")
    got = impute.fill_mice(df, ["a", "b", "c", "d"], max_iter=2, tolerance=0.0, shrinkage=shrinkage).orderBy("id").collect()
    assert np.allclose([r[1:] for r in got], plain(x, 2, shrinkage), atol=1e-6)


def test_rounds_end_when_values_settle(spark):
    x = table_with_gaps(4)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double")
    one = impute.fill_mice(df, ["a", "b", "c", "d"], max_iter=1)
    soon = impute.fill_mice(df, ["a", "b", "c", "d"], max_iter=50, tolerance=10.0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, soon.collect()))
    with pytest.raises(ValueError):
        impute.fill_mice(df, ["a"], shrinkage="some")


def test_odd_columns(spark):
    rng = random.Random(1)
    rows = [(i, None, 7.0, float(i), 2.0 * i if rng.random() < 0.7 else None, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, none double, flat double, a double, b double, s string")
    got = impute.fill_mice(df, ["none", "flat", "a", "b"]).collect()
    assert all(r["none"] is None and r["flat"] == 7.0 and abs(r["b"] - 2 * r["a"]) < 1e-6 and r["s"] == "x" for r in got)
    assert impute.fill_mice(df, ["none"]).collect() == df.collect()
