"""Fitted generalised and nonlinear objects, Kenward-Roger, influence by deletion, sparse factors, and their odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina import api
from lamina.operators import ddf, diagnostics, inference, profiles, sparse, variance
from lamina.sources import frames


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for g in range(14):
        u = rng.normal(0, 1.2)
        for i in range(int(rng.integers(4, 9))):
            x = float(rng.normal())
            out.append((f"g{g}", x, 1.5 + 0.7 * x + u + float(rng.normal(0, 0.8)), int(rng.integers(0, 2)), "ab"[i % 2]))
    return spark.createDataFrame(out, "g string, x double, y double, b int, f string").cache()


def dense(model):
    """The marginal covariance of the rows, and their design."""
    data = model.prep.data.toPandas()
    p = model.prep.p
    x, y = data[[f"x{i}" for i in range(p)]].to_numpy(), data["y"].to_numpy()
    k = len(model.prep.z_names[0])
    z = data[[f"z0_{i}" for i in range(k)]].to_numpy()
    same = data["g0"].to_numpy()[:, None] == data["g0"].to_numpy()[None, :]
    cov = model.covariances()[0]
    return x, y, z, same, same * (z @ cov @ z.T) + model.solved.sigma2 * np.eye(len(y)), data


def test_kenward_roger_against_dense_matrices(rows):
    model = api.lmer("y ~ x + (1 + x | g)", rows)
    x, _, z, same, v, _ = dense(model)
    inverse = np.linalg.inv(v)
    parts = []
    for i in range(2):
        for j in range(i, 2):
            e = np.zeros((2, 2))
            e[i, j] = e[j, i] = 1
            parts.append(same * (z @ e @ z.T))
    parts.append(np.eye(len(v)))
    p_, q_, info = ddf._pieces(model)
    phi = model.vcov()
    for r, a in enumerate(parts):
        assert p_[r] == pytest.approx(-x.T @ inverse @ a @ inverse @ x, rel=1e-6, abs=1e-8)
        for s, b in enumerate(parts):
            q = x.T @ inverse @ a @ inverse @ b @ inverse @ x
            assert q_[r][s] == pytest.approx(q, rel=1e-6, abs=1e-8)
            project = inverse - inverse @ x @ phi @ x.T @ inverse
            assert info[r, s] == pytest.approx(0.5 * np.trace(project @ a @ project @ b), rel=1e-6)
    adjusted, df = api.kenward_roger(model)
    assert (np.diag(adjusted) >= np.diag(phi) - 1e-12).all() and all(1 < d < len(v) for d in df.values())
    with pytest.raises(ValueError):
        api.kenward_roger(api.lmer("y ~ x + (1 | g)", rows, reml=False))
    assert {r.term for r in api.coefficient_tests(model, "kenward_roger").collect()} == {"(Intercept)", "x"}


def test_deletion_influence_against_refits(rows):
    model = api.lmer("y ~ x + (1 | g)", rows)
    x, y, _, _, v, data = dense(model)
    found = model.leverages().toPandas()
    inverse = np.linalg.inv(v)
    full = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
    for i in (0, 5, 17):
        keep = np.arange(len(y)) != i
        less = np.linalg.inv(v[np.ix_(keep, keep)])
        beta = np.linalg.solve(x[keep].T @ less @ x[keep], x[keep].T @ less @ y[keep])
        row = found[(found["y"] - y[i]).abs() < 1e-12].iloc[0]
        assert np.array(row["dfbeta"]) == pytest.approx(full - beta, rel=1e-6, abs=1e-9)


def test_intervals_of_predictions_against_dense_matrices(rows, spark):
    model = api.lmer("y ~ x + (1 | g)", rows)
    x, y, _, _, v, data = dense(model)
    tau, sigma2 = model.covariances()[0][0, 0], model.solved.sigma2
    new = spark.createDataFrame([("g3", 0.4), ("other", 0.4)], "g string, x double")
    got = {r.g: r for r in model.predict(new, allow_new_levels=True, interval="prediction").collect()}
    inverse, at = np.linalg.inv(v), np.array([1, 0.4])
    c = tau * (data["g0"] == "g3").to_numpy()
    phi = np.linalg.inv(x.T @ inverse @ x)
    gap = at - x.T @ inverse @ c
    assert got["g3"].se_fit ** 2 == pytest.approx(tau - c @ inverse @ c + gap @ phi @ gap, rel=1e-6)
    assert got["other"].se_fit ** 2 == pytest.approx(tau + at @ phi @ at, rel=1e-6)
    assert (got["g3"].upper - got["g3"].lower) / 2 == pytest.approx(1.959964 * math.sqrt(got["g3"].se_fit ** 2 + sigma2), rel=1e-5)
    mean = model.predict(new, random=False, interval="confidence").first()
    assert mean.se_fit**2 == pytest.approx(at @ phi @ at, rel=1e-6)
    with pytest.raises(ValueError):
        model.predict(new, allow_new_levels=True, interval="other")


def test_generalised_object(rows, spark):
    model = api.glmer("b ~ x + (1 | g)", rows, "binomial")
    assert model.ngrps() == {"g": 14} and model.terms()["fixed"] == ["1", "x"] and model.model_matrix().columns == ["(Intercept)", "x"]
    new = spark.createDataFrame([("g1", 0.2), ("new", 0.2)], "g string, x double")
    eta = {r.g: r.fit for r in model.predict(new, "link", allow_new_levels=True).collect()}
    mean = {r.g: r.fit for r in model.predict(new, allow_new_levels=True).collect()}
    assert mean == pytest.approx({k: 1 / (1 + math.exp(-v)) for k, v in eta.items()})
    assert eta["new"] == pytest.approx(model.fixef()["(Intercept)"] + 0.2 * model.fixef()["x"])
    with pytest.raises(ValueError):
        model.predict(new)
    sim = model.simulate(seed=4).select("sim").toPandas()["sim"]
    assert set(sim) <= {0.0, 1.0} and len(sim) == model.nobs() and model.simulate(4).select("sim").toPandas()["sim"].equals(sim)
    assert model.confint()["x"][0] < model.fixef()["x"] < model.confint()["x"][1]
    hat = model.leverages().toPandas()["hat"]
    assert ((hat > 0) & (hat < 1)).all()
    assert {r.effect for r in model.tidy_all().collect()} == {"fixed", "ran_pars", "ran_vals"} and "binomial" in model.summary()
    assert model.glance().first().nobs == model.nobs() and model.extract_aic() == (model.npar(), model.aic())
    for kind in ("deviance", "pearson", "response", "working"):
        assert model.residuals(kind).where(F.col("resid").isNull()).count() == 0
    samples = profiles.bootstrap_glmer(model, 2, seed=1)
    assert samples.shape == (2, 3) and np.isfinite(samples).all()
    for name in ("theta", "beta", "Lambda", "n", "p", "q", "lower", "flist", "cnms", "devcomp"):
        assert model.get_me(name) is not None
    with pytest.raises(ValueError):
        model.get_me("nothing")


def test_crossed_generalised_terms(rows):
    model = api.glmer("b ~ 1 + (1 | g) + (1 | f)", rows, "binomial")
    assert len(model.ranef(1).collect()) == 2 and model.converged
    with pytest.raises(ValueError):
        model.leverages()


def test_optimisers_agree(rows):
    fits = api.all_fit(api.lmer("y ~ x + (1 + x | g)", rows))
    assert api.is_consistent(fits, 1e-3) and api.best_fit(fits).deviance == min(r.deviance for r in fits.collect())
    assert api.converged(api.lmer("y ~ x + (1 | g)", rows, control=api.lmer_control(optimizer="quasi_newton")))


def test_gradient_and_other_algorithms(rows):
    model = api.lmer("y ~ x + (1 + x | g)", rows)
    for reml in (True, False):
        at = np.array([0.9, 0.2, 0.5])
        _, slope = variance.deviance_gradient(at, model.gram, model.layout, reml)
        from lamina.operators.lmm import solve

        for i in range(3):
            e = np.eye(3)[i] * 1e-5
            up, down = (solve(at + s * e, model.gram, model.layout, reml, False).deviance for s in (1, -1))
            assert slope[i] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-5)
    if not model.is_singular():
        cov, sigma2, _ = variance.average_information(model)
        assert sigma2 == pytest.approx(model.solved.sigma2, rel=1e-2) and cov == pytest.approx(model.covariances()[0], rel=0.1, abs=0.02)


def test_sparse_cholesky_against_dense():
    rng = np.random.default_rng(1)
    n = 40
    i, j = rng.integers(0, n, 90), rng.integers(0, n, 90)
    v = rng.normal(0, 0.1, 90)
    a = np.zeros((n, n))
    for r, c, x in zip(i, j, v, strict=True):
        a[r, c] += x
        if r != c:
            a[c, r] += x
    a += 3 * np.eye(n)
    f = sparse.factor(sparse.analyse(n, i, j), i, j, v, 3.0)
    b = rng.normal(size=(n, 2))
    assert f.logdet() == pytest.approx(np.linalg.slogdet(a)[1]) and f.solve(b) == pytest.approx(np.linalg.solve(a, b))
    with pytest.raises(np.linalg.LinAlgError):
        sparse.factor(sparse.analyse(2, np.array([0]), np.array([1])), np.array([0]), np.array([1]), np.array([5.0]), 1.0)


def test_nonlinear_object(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(x), float((10 + u) * x / (4 + x) + rng.normal(0, 0.15))) for g, u in enumerate(rng.normal(0, 1, 8)) for x in (0.5, 1, 2, 4, 8, 16)]
    df = spark.createDataFrame(rows, "g long, x double, y double")
    m = api.nlmer("michaelis", df, "x", "y", "g")
    assert m.ngrps() == {"g": 8} and m.df_residual() == 48 - m.npar() and not m.is_singular() and m.confint()["vm"][0] < 10.5
    assert m.residuals("pearson").where("abs(resid) > 5").count() == 0 and len(m.coef().collect()) == 8 and m.glance().first().nobs == 48
    hat = m.leverages().toPandas()["hat"]
    assert ((hat > 0) & (hat < 1)).all() and 2 < hat.sum() < 12
    assert m.refit("y").deviance() == pytest.approx(m.deviance(), rel=1e-6) and m.update().deviance() == pytest.approx(m.deviance(), rel=1e-6)
    assert m.simulate(3).count() == 48 and m.simulate(3, random=False).count() == 48 and "michaelis" in m.summary()
    assert np.isfinite(profiles.bootstrap_nlmer(m, 1)).all()


def test_effects_and_profiles(rows):
    model = api.glmer("b ~ x + f", rows, "binomial")
    grid = api.adjusted_predictions(model, ["f", "x"], at={"x": [0.0, 1.0]}).collect()
    assert len(grid) == 4 and all(0 < r.conf_low < r.predicted < r.conf_high < 1 for r in grid)
    assert set(api.all_effects(model)) == {"x", "f"}
    linear = api.lmer("y ~ x + f + (1 | g)", rows)
    assert [r.contrast for r in api.contrast(linear, "f", {"half": [0.5, -0.5]}).collect()] == ["half"]
    with pytest.raises(ValueError):
        api.contrast(linear, "f", np.eye(3))
    p = api.profile_fixed(linear, ["x"])
    r = api.intervals(p).first()
    assert r.lower < linear.fixef()["x"] < r.upper and r.estimate == pytest.approx(linear.fixef()["x"], abs=1e-3)
    assert api.slice_2d(linear, "(Intercept)", "x", 5).count() == 25 and api.density(p).agg(F.max("density")).first()[0] == 1.0
    assert inference.drop1(linear).count() == 3 and diagnostics.icc(linear)["adjusted"] < 1


def test_generated_sets(spark):
    assert frames.ratings(spark, 200).where("y between 1 and 5").count() == 200
    assert frames.fruits(spark).where("total_fruits >= 0").count() == 625 and frames.ticks(spark).count() == 403 and frames.aggression(spark, 5).select("item").distinct().count() == 24
    assert frames.ratings(spark, 50).collect() == frames.ratings(spark, 50).collect()
