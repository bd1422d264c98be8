"""The public surface in one place, with accessor functions over fitted models."""

from __future__ import annotations

from lamina.functions.families import LINKS, Family, family, resolve_link
from lamina.functions.tails import adjust, wilson
from lamina.operators.checks import problems
from lamina.operators.control import Control, GeneralisedControl, glmer_control, lmer_control
from lamina.operators.convert import components, cov2sdcor, cov_of_sdcor, cov_to_theta, cov_vector, gauss_hermite, gauss_hermite_grid, matrices_to_vector, safe_chol, scale_vcov, sdcor2cov, sdcor_vector, theta_to_cov, theta_vector, vector_to_matrices, vector_to_triangles
from lamina.operators.ddf import coefficient_tests, kenward_roger
from lamina.operators.diagnostics import condition_indices, dispersion, icc, influential, r2_nakagawa, vif, zero_inflation
from lamina.operators.effects import adjusted_predictions, all_effects, contrast
from lamina.operators.glmm import glmer, glmer_nb
from lamina.operators.grouped import extend, fold_of, is_nested, lm_list, one_way, weighted_metrics
from lamina.operators.inference import all_fit, anova, anova_terms, best_fit, criteria, drop1, evidence_set, is_consistent, emmeans, linear_hypothesis, pairs, rank_models, reference_grid, satterthwaite
from lamina.operators.large import lmer_large
from lamina.operators.lmm import lmer
from lamina.operators.nlmm import nlmer
from lamina.operators.nonlinear import CURVES
from lamina.operators.optimise import available, coordinates, golden, minimise, quasi_newton, run
from lamina.operators.profiles import bootstrap_glmer, bootstrap_nlmer, density, intervals, profile_fixed, slice_2d, transformed
from lamina.operators.resample import boot_ci, bootstrap, cross_validate, em_reml, power, power_curve, profile, profile_interval, simulate_formula, template
from lamina.operators.staged import criterion, criterion_generalised, model, model_generalised, new_random_design, optimise, over_some, parse_data, parse_generalised, random_terms
from lamina.operators.variance import average_information, deviance_gradient, mm_reml
from lamina.plans.formula import findbars, is_mixed, nobars, parse, set_cov_type, split_double_bars, subbars, update
from lamina.plans.frame import contrast_matrix, dummy, expand_to_original, factorize
from lamina.sources.frames import aggression, cbpp, dyestuff, dyestuff2, fruits, pastes, penicillin, ratings, sleepstudy, table, ticks

__all__ = [name for name in dir() if not name.startswith("_") and name != "annotations"]


def fixef(fit) -> dict[str, float]:
    return fit.fixef()


def ranef(fit, k: int = 0):
    return fit.ranef(k) if k else fit.ranef()


def sigma(fit) -> float:
    return getattr(fit, "sigma", 1.0)


def ngrps(fit) -> dict[str, int]:
    return fit.ngrps()


def log_lik(fit) -> float:
    return fit.log_lik()


def get_me(fit, name: str):
    """A named part of a linear fit: X and Z cross-products, theta, Lambda, beta, u, sigma, criterion, dimensions."""
    parts = {
        "theta": lambda: fit.theta, "beta": lambda: fit.solved.beta, "b": lambda: fit.solved.u, "Lambda": lambda: fit.layout.factors(fit.theta), "sigma": lambda: fit.sigma, "XtWX": lambda: fit.gram.xx, "XtWy": lambda: fit.gram.xy,
        "ZtWZ": lambda: fit.gram.zz, "ZtWX": lambda: fit.gram.zx, "n": lambda: fit.gram.n, "p": lambda: fit.prep.p, "q": lambda: sum(z.shape[0] * z.shape[1] for z in fit.gram.zz), "devcomp": fit.components, "REML": lambda: fit.reml, "cnms": lambda: fit.prep.z_names, "flist": lambda: fit.gram.keys, "lower": lambda: [b[0] for b in fit.layout.bounds()],
    }
    if name not in parts:
        raise ValueError(f"unknown component {name!r}; known: {', '.join(parts)}")
    return parts[name]()


def converged(fit, tol: float = 1e-4) -> bool:
    """Whether the optimiser ended by its own rule and the criterion doesn't fall within ``tol`` around the estimates."""
    return fit.converged and not problems_of(fit, tol)


def problems_of(fit, tol: float = 1e-4) -> list[str]:
    """What speaks against a fit: not converged, singular, a parameter on its bound, a lower criterion nearby."""
    found = [] if fit.converged else ["the optimiser stopped at its limit"]
    if fit.is_singular():
        found.append("the covariance of the effects is singular")
    best = fit.criterion(fit.theta)
    for i, (low, high) in enumerate(fit.layout.bounds()):
        for step in (1e-3, -1e-3):
            near = fit.theta.copy()
            near[i] = min(high, max(low, near[i] + step))
            if fit.criterion(near) < best - tol * (abs(best) + 1) * 1e-2:
                found.append(f"parameter {i + 1} has a better value nearby")
                break
    return found
