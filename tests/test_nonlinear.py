import numpy as np
import pandas as pd
import pytest

from lamina import api
from lamina.operators.nonlinear import CURVES


@pytest.mark.parametrize("name", sorted(CURVES))
def test_gradients(name):
    curve, x = CURVES[name], np.linspace(0.5, 20, 9)
    at = {"asymptotic": [10, 2, -2], "logistic": [10, 8, 3], "michaelis": [10, 7], "four_parameter": [1, 10, 8, 3], "gompertz": [10, 2, 0.8], "biexponential": [5, -1, 3, -3]}[name]
    g = curve.gradient(x, [float(v) for v in at])
    for i in range(len(at)):
        up = [float(v) + (1e-4 if j == i else 0) for j, v in enumerate(at)]
        assert np.allclose((curve.array(x, up) - curve.array(x, at)) / 1e-4, g[:, i], rtol=1e-2, atol=1e-3)


def test_logistic_mixed_model_recovers_its_parameters(spark):
    rng = np.random.default_rng(8)
    x, g = np.tile(np.linspace(0, 20, 15), 12), np.repeat(np.arange(12), 15)
    b = rng.normal(size=12) * 1.5
    y = (12 + b[g]) / (1 + np.exp(-(x - 9) / 2.5)) + rng.normal(size=180) * 0.3
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "g": g}))
    fit = api.nlmer("logistic", df, "x", "y", "g")
    assert np.allclose(fit.phi, [12 + b.mean(), 9, 2.5], atol=[0.5, 0.15, 0.15]) and fit.sigma == pytest.approx(0.3, rel=0.15)
    assert np.corrcoef(fit.b[np.argsort([int(k) for k in fit.keys]), 0], b)[0, 1] > 0.98
    out = fit.predict(df).toPandas()
    assert np.sqrt(((out["fit"] - out["y"]) ** 2).mean()) < 0.35 and fit.tidy().count() == 3 and fit.aic() > fit.deviance()


def test_accessors(spark):
    fit = api.lmer("Yield ~ 1 + (1 | Batch)", api.dyestuff(spark))
    assert api.get_me(fit, "q") == 6 and api.fixef(fit) == fit.fixef() and api.ngrps(fit) == {"Batch": 6} and api.log_lik(fit) < 0 < api.sigma(fit)
    with pytest.raises(ValueError):
        api.get_me(fit, "nothing")
