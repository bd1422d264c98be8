"""Fits against closed forms, dense linear algebra on the same rows, and each other."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina.operators import diagnostics, grouped, inference
from lamina.operators.glmm import glmer
from lamina.operators.gram import gram
from lamina.operators.lmm import Layout, layout_of, lmer, solve
from lamina.plans.frame import complete, level_codes, prepare
from lamina.sources.frames import dyestuff
from lamina.streaming.gram_stream import streaming_gram


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n, groups = 240, 12
    g, h = rng.integers(0, groups, n), rng.integers(0, 4, n)
    x, f = rng.normal(size=n), rng.integers(0, 3, n)
    b = rng.normal(size=(groups, 2)) * [1.5, 0.7]
    y = 2 + 0.5 * x + 0.8 * (f == 1) + b[g, 0] + b[g, 1] * x + 0.4 * h + rng.normal(size=n)
    frame = pd.DataFrame({"y": y, "x": x, "f": [f"l{v}" for v in f], "g": [f"g{v}" for v in g], "h": [f"h{v}" for v in h], "w": rng.uniform(0.5, 2, n), "o": rng.normal(size=n) / 10, "c": rng.poisson(np.exp(0.3 + 0.3 * x + 0.4 * b[g, 0]))})
    return frame, spark.createDataFrame(frame)


def dense(prep, theta, layout, reml):
    """The criterion from the marginal covariance of all rows."""
    d = prep.data.toPandas()
    n, p = len(d), prep.p
    x = d[[f"x{i}" for i in range(p)]].to_numpy()
    v = np.diag(1 / d["w"].to_numpy())
    for k, f in enumerate(layout.factors(theta)):
        z = d[[f"z{k}_{i}" for i in range(f.shape[0])]].to_numpy() @ f
        same = d[f"g{k}"].to_numpy()[:, None] == d[f"g{k}"].to_numpy()[None, :]
        v = v + (z @ z.T) * same
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    y = (d["y"] - d["o"]).to_numpy()
    beta = np.linalg.solve(a, x.T @ vi @ y)
    r = y - x @ beta
    dof = n - p if reml else n
    s2 = r @ vi @ r / dof
    return dof * (1 + math.log(2 * math.pi * s2)) + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(a)[1] if reml else 0), beta


@pytest.mark.parametrize("reml", [True, False])
@pytest.mark.parametrize("formula", ["y ~ x + (1 | g)", "y ~ x * f + (1 + x | g)", "y ~ x + (1 | g) + (1 | h)", "y ~ 0 + f + (1 | g/h)", "y ~ x"])
def test_criterion_equals_dense_algebra(rows, formula, reml):
    prep = prepare(formula, rows[1], weights="w", offset="o")
    layout = layout_of(prep)
    theta = np.linspace(0.4, 1.1, sum(layout.sizes))
    want, beta = dense(prep, theta, layout, reml)
    got = solve(theta, gram(prep), layout, reml)
    assert got.deviance == pytest.approx(want, abs=1e-6) and np.allclose(got.beta, beta)


def test_optimum_accessors_and_rows(rows):
    model = lmer("y ~ x + f + (1 + x | g)", rows[1])
    assert model.converged and not model.is_singular()
    for i in range(3):
        for step in (-1e-3, 1e-3):
            assert model.criterion(model.theta + step * np.eye(3)[i]) >= model.deviance() - 1e-8
    out = model.augmented().toPandas()
    assert (out["fitted"] + out["residual"] - out["y"]).abs().max() < 1e-9
    total = model.leverages().agg(F.sum("hat")).first()[0]
    assert model.prep.p < total < model.prep.p + 24
    again = model.predict(rows[1]).agg(F.sum("fit")).first()[0]
    assert again == pytest.approx(out["fitted"].sum())
    assert model.refit_ml().deviance() <= model.deviance() and model.npar() == 8
    assert model.tidy().count() == 4 and model.glance().first().nobs == 240 and model.ranef().count() == 12 and "groups" in model.summary()
    with pytest.raises(ValueError):
        model.predict(rows[1].withColumn("g", F.lit("new")))
    assert model.predict(rows[1].withColumn("g", F.lit("new")), allow_new_levels=True).count() == 240
    assert all(v > 1 for v in inference.satterthwaite(model).values())
    sims = model.simulate(3).agg(F.var_samp("sim")).first()[0]
    assert 0.2 < sims / rows[0]["y"].var() < 5


def test_balanced_one_way_has_its_closed_form(spark):
    model = lmer("Yield ~ 1 + (1 | Batch)", dyestuff(spark))
    parts = grouped.one_way(dyestuff(spark), "Yield", "Batch").first()
    assert model.solved.sigma2 == pytest.approx(parts.ms_within, rel=1e-6)
    assert model.var_corr()[0]["variance"][0] == pytest.approx(parts.var_group, rel=1e-4)
    assert model.solved.sigma2 == pytest.approx(2451.25, rel=1e-5) and parts.var_group == pytest.approx(1764.05, rel=1e-5)


def test_structured_covariances():
    for kind in ("cs", "ar1"):
        layout = Layout((3,), (kind,))
        f = layout.factors(np.array([2.0, 0.5]))[0]
        cov = f @ f.T
        assert np.allclose(np.diag(cov), 4) and cov[0, 1] == pytest.approx(2) and cov[0, 2] == pytest.approx(2 if kind == "cs" else 1)


def test_missing_values_and_levels(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (float("nan"), "a"), (2.0, None), (3.0, "a"), (4.0, "c")], "y double, g string")
    assert complete(df, ["y", "g"]).count() == 3
    with pytest.raises(ValueError, match="y, g"):
        complete(df, ["y", "g"], "na.fail")
    assert {(r.level, r.code) for r in level_codes(df, "g").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError):
        lmer("y ~ 1 + (1 | g)", df.limit(0))
    with pytest.raises(ValueError):
        prepare("y ~ q", df)


def test_poisson_and_binomial_mixed_models(rows):
    flat = glmer("c ~ x", rows[1], "poisson")
    x = np.column_stack([np.ones(240), rows[0]["x"]])
    assert np.allclose(x.T @ (rows[0]["c"] - np.exp(x @ flat.state.beta)), 0, atol=1e-5)  # score equations
    mixed = glmer("c ~ x + (1 | g)", rows[1], "poisson")
    assert mixed.deviance() < flat.deviance() and mixed.theta[0] > 0.1
    fine = glmer("c ~ x + (1 | g)", rows[1], "poisson", points=15)
    assert abs(fine.theta[0] - mixed.theta[0]) < 0.1
    aug = mixed.augmented().toPandas()
    assert (aug["mu"] > 0).all() and (np.sign(aug["deviance"]) == np.sign(aug["residual"])).all()
    found = diagnostics.dispersion(mixed.augmented(), mixed.family, mixed.df_residual())
    assert 0.5 < found["ratio"] < 1.5
    zeros = diagnostics.zero_inflation(mixed.augmented(), mixed.family)
    assert zeros["seen"] == (rows[0]["c"] == 0).sum() and 0.5 < zeros["ratio"] < 2


def test_inference_tables(rows):
    model = lmer("y ~ x + f + (1 | g)", rows[1])
    table = {r.term: r for r in inference.drop1(model).collect()}
    assert set(table) == {"<none>", "x", "f"} and table["f"].p_value < 1
    tests = inference.anova(lmer("y ~ 1 + (1 | g)", rows[1]), model).collect()
    assert tests[1].df == 3 and tests[1].chisq > 0
    levels, means, se, _ = inference.emmeans(model, "f")
    assert [v[0] for v in levels] == ["l0", "l1", "l2"] and means[1] - means[0] == pytest.approx(model.fixef()["f.1"])
    assert inference.pairs(model, "f").count() == 3 and (se > 0).all()
    wald = inference.linear_hypothesis(model, np.eye(4)[1])
    assert wald["chisq"] == pytest.approx((model.fixef()["x"] / model.std_errors()[1]) ** 2)
    r2 = diagnostics.r2_nakagawa(model)
    assert 0 < r2["marginal"] < r2["conditional"] < 1


def test_streaming_gram(spark, tmp_path, rows):
    rows[1].select("y", "x", "g").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("y double, x double, g string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_gram(stream, "y", ["x"], "g").writeStream.outputMode("complete").format("memory").queryName("gram_stream").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.level: (r.n, r.s_x_y) for r in spark.table("gram_stream").collect()}
    want = {k: (len(d), (d.x * d.y).sum()) for k, d in rows[0].groupby("g")}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_levels_on_the_cluster_give_the_same_fit(rows):
    from lamina.operators.large import lmer_large

    for formula in ("y ~ x + (1 | g)", "y ~ x + f + (1 + x | g)"):
        small, large = lmer(formula, rows[1], weights="w"), lmer_large(formula, rows[1], weights="w", limit=400)
        assert large.deviance == pytest.approx(small.deviance(), abs=1e-5) and np.allclose(large.beta, small.solved.beta, atol=1e-4)
        u = {r.level: r.u for r in large.effects.collect()}
        assert all(np.allclose(u[k], v, atol=1e-3) for k, v in zip(small.gram.keys[0], small.solved.u[0], strict=True))


def test_crossed_terms_beyond_the_dense_limit(spark, monkeypatch):
    """The largest crossed term is eliminated level by level, so that only the others count against the limit; criterion,
    effects and conditional variances are those of the whole dense system."""
    from lamina.operators import gram, lmm

    monkeypatch.setattr(gram, "MAX_CROSSED", 16)
    monkeypatch.setattr(lmm, "ROW_CELLS", 40, raising=False)  # several runs of levels
    rng = np.random.default_rng(8)
    n = 240
    a, b, c = rng.integers(0, 30, n), rng.integers(0, 5, n), rng.integers(0, 3, n)
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = 1 + x + rng.normal(size=30)[a] + rng.normal(size=5)[b] * (1 + z) + rng.normal(size=n)
    df = spark.createDataFrame([tuple(map(float, r[:3])) + tuple(map(str, r[3:])) for r in zip(x, z, y, a.tolist(), b.tolist(), c.tolist(), strict=True)], "x double, z double, y double, a string, b string, c string")
    for order in ("(1 + z | b) + (1 + x | a) + (1 | c)", "(1 + x | a) + (1 | c) + (1 + z | b)"):
        fit = lmer(f"y ~ x + {order}", df)
        theta = rng.uniform(0.3, 1.2, len(fit.theta))
        got = lmm.solve(theta, fit.gram, fit.layout)
        columns, at = [], []
        terms = {"a": (a, x), "b": (b, z), "c": (c, None)}
        for t, (name, lam) in enumerate(zip((r.group for r in fit.prep.random), fit.layout.factors(theta), strict=True)):
            level, slope = terms[name]
            for k, key in enumerate(fit.gram.keys[t]):
                own = (level == int(key)).astype(float)
                block = np.column_stack([own] if slope is None else [own, own * slope])
                columns.append(block @ lam)
                at.append((t, k, lam))
        u, f = np.concatenate(columns, 1), np.column_stack([np.ones(n), x])
        v = u @ u.T + np.eye(n)
        inner = np.linalg.inv(v)
        beta = np.linalg.solve(f.T @ inner @ f, f.T @ inner @ y)
        left = y - f @ beta
        sigma2 = left @ inner @ left / (n - 2)
        want = (n - 2) * (1 + np.log(2 * np.pi * sigma2)) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(f.T @ inner @ f)[1]
        assert np.isclose(got.deviance, want, atol=1e-8) and np.allclose(got.beta, beta)
        spherical, inverse, begin = u.T @ inner @ left, np.linalg.inv(u.T @ u + np.eye(u.shape[1])), 0
        assert np.isclose(got.ussq, spherical @ spherical)
        for t, k, lam in at:
            here = slice(begin, begin := begin + lam.shape[0])
            assert np.allclose(got.u[t][k], lam @ spherical[here]) and np.allclose(got.cond_var[t][k], lam @ inverse[here, here] @ lam.T)
