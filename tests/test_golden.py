"""Fits of the built-in data sets against published values."""

import numpy as np
import pytest

from lamina import api
from lamina.sources import frames


# Cases and herd sizes of the variant that the published fit uses.
CASES = (
    2, 3, 4, 0, 3, 1, 3, 2, 0, 2, 0, 1, 1, 2, 0, 0, 1, 0, 2, 0, 4, 3, 0, 2, 1, 0, 0, 1, 0, 0, 1, 0, 0, 0, 2, 1, 2, 0, 1, 0, 3, 0, 0, 1, 0, 0, 1, 1, 0,
    1, 1, 0, 1, 0, 0, 0,
)
SIZES = (
    14, 12, 9, 5, 22, 18, 21, 22, 16, 16, 20, 10, 10, 9, 6, 18, 25, 24, 13, 11, 10, 5, 6, 8, 3, 3, 5, 3, 2, 2, 10, 8, 4, 2, 14, 11, 9, 8, 4, 5, 7, 3,
    7, 8, 4, 4, 2, 4, 6, 5, 5, 3, 3, 2, 2, 2,
)


def test_sleepstudy(spark):
    fit = api.lmer("Reaction ~ Days + (Days | Subject)", frames.sleepstudy(spark))
    assert np.allclose(fit.solved.beta, [251.19101636363638, 10.529083771043759], atol=1e-8)
    assert np.allclose(fit.theta, [0.9467987315840892, 0.018801466252854657, 0.22768771787157], atol=2e-5)
    assert fit.sigma == pytest.approx(25.828313444164642, abs=2e-5) and fit.deviance() == pytest.approx(1746.069424187031, abs=2e-5)
    assert np.allclose(fit.vcov(), [[46.025663493861, -1.361786361477], [-1.361786361477, 2.383643743142]], atol=2e-4)
    assert fit.nobs() == 180 and fit.ngrps() == {"Subject": 18} and fit.npar() == 6 and not fit.is_singular()


def test_penicillin_crossed(spark):
    fit = api.lmer("diameter ~ 1 + (1 | plate) + (1 | sample)", frames.penicillin(spark))
    assert fit.solved.beta[0] == pytest.approx(22.81944444444444, abs=1e-9)
    assert np.allclose(fit.theta, [1.720313360433691, 2.12067267084168], atol=2e-5)
    assert fit.sigma == pytest.approx(0.9376710791427862, abs=2e-5) and fit.deviance() == pytest.approx(483.25999628008196, abs=2e-5)


def test_cbpp_binomial(spark):
    fit = api.glmer("incidence / size ~ period + (1 | herd)", frames.cbpp(spark), "binomial")
    assert fit.nobs() == 56
    rows = [(str(i // 4 + 1), c, n, str(i % 4 + 1)) for i, (c, n) in enumerate(zip(CASES, SIZES, strict=True))]
    fit = api.glmer("incidence / size ~ period + (1 | herd)", spark.createDataFrame(rows, "herd string, incidence int, size int, period string"), "binomial")
    assert fit.deviance() == pytest.approx(74.03136198466316, abs=1e-4)
    assert np.allclose(fit.state.beta, [-1.861164732564236, -0.208553975355595, -0.078281733042295, -0.618291994021517], atol=1e-3) and fit.theta[0] == pytest.approx(0.48750557774242, abs=1e-3)
