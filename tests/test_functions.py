import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import tails
from lamina.functions.families import LINKS, SPARK, family
from lamina.operators import convert


def test_tails_against_known_values():
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_ppf(0.975, 5) == pytest.approx(2.570582, abs=1e-5)
    assert tails.studentized_range_sf(3.577935, 3, 20) == pytest.approx(0.05, abs=1e-4)
    assert tails.studentized_range_sf(3.314493, 3, math.inf) == pytest.approx(0.05, abs=1e-4)
    assert tails.adjust([0.01, 0.04, 0.03], "holm") == pytest.approx([0.03, 0.06, 0.06])
    assert tails.adjust([0.01, 0.04, 0.03], "fdr") == pytest.approx([0.03, 0.04, 0.04])


@pytest.mark.parametrize("name", sorted(LINKS))
def test_links_invert_and_have_their_slopes(spark, name):
    link, mu = LINKS[name], np.linspace(0.05, 0.9, 12)
    assert np.allclose(link.inverse(link.link(mu)), mu)
    h = 1e-6
    assert np.allclose(link.slope(mu), (link.link(mu + h) - link.link(mu - h)) / (2 * h), rtol=1e-4)
    eta = link.link(mu)
    rows = spark.createDataFrame([(float(e),) for e in eta], "e double").select(link.inverse(F.col("e"), SPARK).alias("m")).collect()
    assert np.allclose([r.m for r in rows], mu, atol=3e-7)


def test_families_in_both_engines(spark):
    y, mu = np.array([0.0, 1.0, 2.0, 5.0]), np.array([0.5, 0.8, 2.5, 3.0])
    rows = spark.createDataFrame(list(zip(y.tolist(), mu.tolist(), strict=True)), "y double, mu double")
    for name in ("gaussian", "poisson", "negative_binomial"):
        fam = family(name, theta=1.5)
        got = [r.d for r in rows.select(fam.deviance(F.col("y"), F.col("mu"), F.lit(2.0), SPARK).alias("d")).collect()]
        assert np.allclose(got, fam.deviance(y, mu, 2.0))
    assert family("binomial").deviance(np.array([0.0, 1.0]), np.array([0.2, 0.2]), 1.0) == pytest.approx([-2 * math.log(0.8), -2 * math.log(0.2)])


def test_conversions():
    cov = np.array([[4.0, 1.0], [1.0, 9.0]])
    sd, corr = convert.cov2sdcor(cov)
    assert np.allclose(convert.sdcor2cov(sd, corr), cov)
    assert np.allclose(convert.theta_to_cov(convert.cov_to_theta(cov, 2.0), 2, 2.0), cov)
    grid, w = convert.gauss_hermite_grid(2, 5)
    assert w.sum() == pytest.approx(1) and (w * grid[:, 0] ** 2).sum() == pytest.approx(1)
    some = [np.arange(6.0).reshape(2, 3), np.ones((1, 2))]
    assert all(np.allclose(a, b) for a, b in zip(convert.vector_to_matrices(convert.matrices_to_vector(some), [(2, 3), (1, 2)]), some, strict=True))
