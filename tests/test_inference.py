"""Regressions with inference against plain numpy."""

import numpy as np
import pytest

from hearthmark.operators import inference as I

XS = ["a", "b"]


def rows(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal(n), rng.standard_normal(n) + 1000
    y = 3 + 2 * a - b + 0.3 * rng.standard_normal(n)
    data = [(f"r{i}", "g" if i % 3 else "h", f"c{i % 7}", float(a[i]), float(b[i]), float(y[i])) for i in range(n)]
    return data, spark.createDataFrame([*data, ("null", "g", "c1", None, 1.0, 2.0)], "id string, seg string, c string, a double, b double, y double")


def dense(data, weights=None):
    x = np.array([[1, r[3], r[4]] for r in data])
    y, w = np.array([r[5] for r in data]), np.ones(len(data)) if weights is None else weights
    beta = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * y))
    return beta, 1 - (w * (y - x @ beta) ** 2).sum() / (w * (y - np.average(y, weights=w)) ** 2).sum()


def test_fit_recovers_coefficients(spark):
    data, df = rows(spark)
    got = {(r["seg"], r["term"]): r for r in I.ols_fit(df, "seg", XS, "y").collect()}
    for seg in "gh":
        own = [r for r in data if r[1] == seg]
        beta, r2 = dense(own)
        assert [got[seg, t]["coef"] for t in ("intercept", "a", "b")] == pytest.approx(beta, rel=1e-7)
        assert got[seg, "a"]["r2"] == pytest.approx(r2) and got[seg, "a"]["n"] == len(own)
        assert got[seg, "a"]["adj_r2"] == pytest.approx(1 - (1 - r2) * (len(own) - 1) / (len(own) - 3))
        assert got[seg, "a"]["std_coef"] == pytest.approx(beta[1] * np.std([r[3] for r in own]))


def test_dependent_and_constant_columns_have_no_fit(spark):
    df = spark.createDataFrame([(i, "g", "c", float(i), 2.0 * i, float(i % 5)) for i in range(20)] + [(i, "h", "c", 1.0, float(i), float(i)) for i in range(20)] + [(i, "flat", "c", float(i), float(i % 3), 4.0) for i in range(20)], "id long, seg string, c string, a double, b double, y double")
    got = {(r["seg"], r["term"]): (r["coef"], r["r2"]) for r in I.ols_fit(df, "seg", XS, "y").collect()}
    assert got["g", "a"] == (None, None) and got["h", "b"] == (None, None)
    assert got["flat", "a"] == (0.0, None) and got["flat", "intercept"][0] == 4.0
    assert I.ols_fit(df.limit(0), "seg", XS, "y").count() == 0 and I.bootstrap_ci(df.limit(0), "seg", XS, "y").count() == 0


def test_two_thousand_draws_equal_numpy(spark):
    data, df = rows(spark)
    got = {(r["seg"], r["term"]): r for r in I.bootstrap_ci(df, "seg", XS, "y").collect()}
    keys = {r["id"]: r["key"] for r in df.select("id", I.row_key("id")).collect()}
    a, b = I.factors(I.DRAWS, I.SEED)
    for seg in "gh":
        own = [r for r in data if r[1] == seg]
        w = I.draw_weights(np.array([keys[r[0]] for r in own]), a, b).astype(float)
        betas = np.sort(np.array([dense(own, d)[0][1:] for d in w]), axis=0)
        for i, t in enumerate(XS):
            assert got[seg, t]["low"] == pytest.approx(betas[50, i], rel=1e-6) and got[seg, t]["high"] == pytest.approx(betas[1950, i], rel=1e-6)
            assert got[seg, t]["draws"] == I.DRAWS and got[seg, t]["significant"]
        # the interval's width is that of theory: about 2 * 1.96 standard errors
        assert betas[1950, 0] - betas[50, 0] == pytest.approx(3.92 * 0.3 / len(own) ** 0.5, rel=0.25)


def test_weights_are_poisson():
    w = I.draw_weights(np.random.default_rng(1).integers(0, I.PRIME, 2000), *I.factors(500, 1)).astype(int)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.15


def test_leaving_clusters_out_is_subtraction(spark):
    data, df = rows(spark)
    got = {(r["seg"], r["term"]): r for r in I.leave_one_out(df, "seg", "c", XS, "y").collect()}
    own = [r for r in data if r[1] == "h"]
    fits = []
    for c in sorted({r[2] for r in own}):
        rest = [r for r in own if r[2] != c]
        fits.append(dense(rest)[0][1:] * [np.std([r[3] for r in rest]), np.std([r[4] for r in rest])])
    for i, t in enumerate(XS):
        r = got["h", t]
        assert (r["n_fits"], r["sign_stable"]) == (len(fits), True)
        assert (r["coef_min"], r["coef_max"]) == pytest.approx((min(f[i] for f in fits), max(f[i] for f in fits)), rel=1e-6)
    lone = df.filter("c = 'c1'")  # its only cluster left out, nothing is left
    assert I.leave_one_out(lone, "seg", "c", XS, "y").count() == 0
