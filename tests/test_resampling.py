import numpy as np
import pandas as pd
import pytest

from lamina.operators import checks, inference, resample, staged
from lamina.operators.gram import gram
from lamina.operators.lmm import lmer
from lamina.plans.frame import prepare


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    g, x = np.repeat(np.arange(15), 8), rng.normal(size=120)
    y = 1 + 0.6 * x + rng.normal(size=15)[g] + rng.normal(size=120)
    return spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "g": [f"g{v}" for v in g], "id": np.arange(120)}))


def test_bootstrap_centres_on_the_fit(data):
    model = lmer("y ~ x + (1 | g)", data)
    s = resample.bootstrap(model, 30, seed=3)
    assert s.shape == (30, 4) and abs(s[:, 1].mean() - model.fixef()["x"]) < 4 * model.std_errors()[1] / np.sqrt(30) * 1.5
    assert np.allclose(s, resample.bootstrap(model, 30, seed=3))
    for method in ("percentile", "basic", "normal"):
        r = resample.boot_ci(model, s, method=method).collect()[1]
        assert r.conf_low < r.estimate < r.conf_high
    assert resample.power(model, "x", 5.0, n=10)["power"] == 1.0
    assert resample.power(model, "x", 0.0, n=20)["power"] < 0.4


def test_cross_validation_and_profile(data):
    cv = resample.cross_validate("y ~ x + (1 | g)", data, "id", 3).collect()
    assert sum(r.n_test for r in cv) == 120 and all(r.n_train + r.n_test == 120 and 0.5 < r.rmse < 2 for r in cv)
    model = lmer("y ~ x + (1 | g)", data)
    rows = resample.profile(model, 0).collect()
    low, high = resample.profile_interval(rows)
    assert low < model.refit_ml().theta[0] < high and all(a.zeta <= b.zeta for a, b in zip(rows, rows[1:], strict=False))


def test_em_agrees_with_the_optimum(data):
    cov, sigma2, _ = resample.em_reml("y ~ x + (1 | g)", data, iterations=2000, tol=1e-13)
    model = lmer("y ~ x + (1 | g)", data)
    assert cov[0, 0] == pytest.approx(model.covariances()[0][0, 0], rel=1e-3) and sigma2 == pytest.approx(model.solved.sigma2, rel=1e-3)


def test_stages_and_checks(data):
    parsed = staged.parse_data("y ~ x + (1 | g)", data)
    fun = staged.criterion(parsed)
    made = staged.model(parsed, staged.optimise(fun, parsed))
    assert made.deviance() == pytest.approx(lmer("y ~ x + (1 | g)", data).deviance())
    prep = prepare("y ~ x + I(x**1) + (1 | id)", data)
    assert len(checks.problems(prep, gram(prep))) >= 2
    with pytest.raises(ValueError):
        checks.run(prep, gram(prep), "stop")


def test_templates_simulation_and_term_tests(spark, data):
    rows = resample.template(spark, {"s": 6, "t": 3}, 4)
    assert rows.count() == 72 and rows.select("s", "t").distinct().count() == 18
    sim = resample.simulate_formula("y ~ t + (1 | s)", rows, [1, 2, 3], [1.0], 0.01, seed=4)
    out = sim.groupBy("g0").agg({"sim": "avg"}).count()
    assert out == 6
    table = {r.term: r for r in inference.anova_terms(lmer("y ~ x + (1 | g)", data)).collect()}
    assert set(table) == {"x"} and table["x"].num_df == 1 and 60 < table["x"].den_df < 120 and table["x"].p_value < 1e-3
