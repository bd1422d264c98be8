"""Registered queries of whole fits and of the algebra around them, each with SQL that reaches the result another way: in
closed form (balanced designs, one factor, least squares), or by a search over a grid that is narrowed step by step.

Results that hang on an optimum are rounded well above what the optimisers leave open.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import tails
from lamina.functions.families import SPARK, family
from lamina.operators import checks, control, convert, ddf, diagnostics, effects, inference, optimise, profiles, resample, sparse, staged, variance
from lamina.operators.glmm import glmer
from lamina.operators.gram import gram
from lamina.operators.lmm import LmerResult, lmer, solve
from lamina.operators.nlmm import nlmer
from lamina.plans import formula as fm
from lamina.plans import frame
from lamina.queries import PLANTED, QUERIES, SQL, planted, query
from lamina.sources import frames
from lamina.sources.frames import table

__all__ = ["QUERIES", "SQL"]


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The rows as SQL, in the order of the names."""
    def cell(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else f"{x!r}::DOUBLE" if isinstance(x, float) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


# formulas and codings

FORMULAS = [
    ("nobars", "y ~ 1 + x"), ("findbars", "(1 + x | g)"), ("subbars", "y ~ 1 + x + g + g:x"), ("mixed", "True"), ("split", "y ~ 1 + x + (1 | g) + (0 + x | g)"),
    ("star", "y ~ 1 + a + b + a:b"), ("power", "y ~ 1 + I(x**2)"), ("without", "y ~ 0 + x"), ("added", "y ~ 1 + x + z + (1 | g)"), ("dropped", "y ~ 1 + z + (1 | g)"),
    ("trials", "y / n ~ 1 + (1 | g)"), ("nested", "y ~ 1 + (1 | a/b)"), ("variables", "y,x,g"), ("fixed", "1 + x"), ("response", "y"),
]


@query(values(FORMULAS, "what, text"))
def formula_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fm.parse("y ~ x + (1 + x | g)")
    rows = {
        "nobars": fm.nobars(f), "findbars": fm.findbars(f)[0], "subbars": fm.subbars(f), "mixed": fm.is_mixed(f), "split": fm.split_double_bars("y ~ x + (1 + x || g)"),
        "star": fm.parse("y ~ a * b"), "power": fm.parse("y ~ I(x**2)"), "without": fm.parse("y ~ 0 + x"), "added": fm.update("y ~ x + (1 | g)", ". ~ . + z"),
        "dropped": fm.update("y ~ x + z + (1 | g)", ". ~ . - x"), "trials": fm.parse("y / n ~ 1 + (1 | g)"), "nested": fm.parse("y ~ 1 + (1 | a/b)"),
        "variables": ",".join(f.variables), "fixed": f.fixed_str(), "response": f.response,
    }
    return small(spark, [(k, str(v)) for k, v in rows.items()], "what string, text string")


@query("""WITH c AS (SELECT unnest(range(1, 5)) AS level),
t AS (SELECT 'treatment' AS kind, level, j, CAST(level = j + 1 AS DOUBLE) AS v FROM c, (SELECT unnest(range(1, 4)) AS j)
 UNION ALL SELECT 'sum', level, j, CASE WHEN level = 4 THEN -1e0 ELSE CAST(level = j AS DOUBLE) END FROM c, (SELECT unnest(range(1, 4)) AS j)
 UNION ALL SELECT 'helmert', level, j, (CASE WHEN level <= j THEN -1e0 WHEN level = j + 1 THEN j ELSE 0 END)/sqrt(j*j + j) FROM c, (SELECT unnest(range(1, 4)) AS j)
 UNION ALL SELECT 'poly', level, 1, (2*level - 5)/sqrt(20e0) FROM c UNION ALL SELECT 'poly', level, 2, CASE WHEN level IN (1, 4) THEN 0.5e0 ELSE -0.5e0 END FROM c
 UNION ALL SELECT 'poly', level, 3, CASE level WHEN 1 THEN -1e0 WHEN 2 THEN 3e0 WHEN 3 THEN -3e0 ELSE 1e0 END/sqrt(20e0) FROM c)
SELECT kind, level::INT AS level, j::INT AS j, round(v, 6) AS v FROM t""")
def contrast_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(kind, i + 1, j + 1, round(v, 6) + 0.0) for kind in ("treatment", "sum", "helmert", "poly") for i, row in enumerate(frame.contrast_matrix(kind, 4)) for j, v in enumerate(row)]
    return small(spark, rows, "kind string, level int, j int, v double")


@query("""SELECT l_returnflag AS flag, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r,
  round(sum(CASE l_returnflag WHEN 'A' THEN -1e0 WHEN 'N' THEN 1e0 ELSE 0e0 END)/sqrt(2e0), 3) AS h1, round(sum(CASE l_returnflag WHEN 'R' THEN 2e0 ELSE -1e0 END)/sqrt(6e0), 3) AS h2 FROM lineitem GROUP BY 1""")
def dummy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame.dummy(frame.factorize(table(spark, sf_dir, "lineitem").select("l_returnflag")), "l_returnflag")
    rows = frame.dummy(rows, "l_returnflag", 0, "helmert")
    sums = [F.sum(f"`l_returnflag.{v}`").cast("long").alias(v.lower()) for v in "ANR"]
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(*sums, F.round(F.sum("`l_returnflag.1`"), 3).alias("h1"), F.round(F.sum("`l_returnflag.2`"), 3).alias("h2"))


@query("""SELECT l_returnflag AS flag, round(sum(CASE l_returnflag WHEN 'A' THEN 0.5e0 WHEN 'N' THEN -0.25e0 ELSE -0.25e0 END), 3) AS own FROM lineitem GROUP BY 1""")
def own_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_returnflag"))
    prep = frame.prepare("l_quantity ~ l_returnflag + (1 | key)", rows, contrasts={"l_returnflag": [[0.5], [-0.25], [-0.25]]})
    return prep.data.groupBy(F.col("g0").alias("flag")).agg(F.round(F.sum("x1"), 3).alias("own"))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS v FROM orders)
SELECT count(*) AS n, count(v) AS kept, round(sum(v)/1e6, 4) AS total FROM r""")
def excluded_rows_come_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("v"))
    fitted = frame.complete(rows, ["v"], "exclude").withColumn("fit", F.col("v"))
    out = frame.expand_to_original(rows, fitted, "o_orderkey", "fit")
    return out.agg(F.count("*").alias("n"), F.count("fit").alias("kept"), F.round(F.sum("fit") / 1e6, 4).alias("total"))


DATASETS = [("dyestuff", 30, 6, 45825.0), ("dyestuff2", 30, 6, 184.8), ("pastes", 60, 10, 3651.6), ("penicillin", 144, 24, 3286.0), ("sleepstudy", 180, 18, 53742.94), ("cbpp", 56, 14, 65.0), ("ratings", 500, 14, None), ("aggression", 240, 10, None)]


@query(values(DATASETS, "name, n, groups, total"))
def built_in_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [("dyestuff", frames.dyestuff(spark), "Batch", "Yield"), ("dyestuff2", frames.dyestuff2(spark), "Batch", "Yield"), ("pastes", frames.pastes(spark), "batch", "strength"), ("penicillin", frames.penicillin(spark), "plate", "diameter"), ("sleepstudy", frames.sleepstudy(spark), "Subject", "Reaction"), ("cbpp", frames.cbpp(spark), "herd", "incidence"), ("ratings", frames.ratings(spark, 500), "dept", None), ("aggression", frames.aggression(spark, 10), "id", None)]
    out = None
    for name, df, group, y in sets:
        one = df.agg(F.lit(name).alias("name"), F.count("*").cast("int").alias("n"), F.countDistinct(group).cast("int").alias("groups"), (F.round(F.sum(F.col(y).cast("double")), 2 if y != "Yield" else 3) if y else F.lit(None).cast("double")).alias("total"))
        out = one if out is None else out.union(one)
    return out


# conversions, tails, optimisers, small linear algebra

CONVERSIONS = [("sdcor2cov", 3.0), ("cov2sdcor_sd", 2.0), ("cov2sdcor_corr", 0.5), ("theta_cov", 8.0), ("cov_theta", 2.0), ("cov_vector", 10.0), ("theta_vector", 3.0), ("sdcor_vector", 0.5), ("cov_of_sdcor", 3.0), ("triangles", 5.0), ("columns", 4.0), ("back", 3.0), ("scaled", 33.0), ("repaired", 1.0), ("grid", 1.0)]


@query(values(CONVERSIONS, "what, value"))
def covariance_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    corr = np.array([[1, 0.5], [0.5, 1]])
    sd, back = convert.cov2sdcor(np.array([[4.0, 3.0], [3.0, 9.0]]))
    nodes, weights = convert.gauss_hermite_grid(2, 3)
    flat = convert.matrices_to_vector([np.array([[1.0, 3.0], [4.0, 2.0]]), np.array([[7.0]])])
    found = {
        "sdcor2cov": convert.sdcor2cov([2.0, 3.0], corr)[0, 1], "cov2sdcor_sd": sd[0], "cov2sdcor_corr": back[0, 1], "theta_cov": convert.theta_to_cov(np.array([1.0, 2.0, 2.0]), 2)[1, 1],
        "cov_theta": convert.cov_to_theta(np.array([[4.0, 2.0], [2.0, 5.0]]))[2], "cov_vector": convert.cov_vector(np.array([1.0, 1.0, 3.0]), 2)[2], "theta_vector": convert.theta_vector(np.array([1.0, 1.0, 10.0]), 2)[2],
        "sdcor_vector": convert.sdcor_vector(np.array([4.0, 3.0, 9.0]), 2)[1], "cov_of_sdcor": convert.cov_of_sdcor(np.array([2.0, 0.5, 3.0]), 2)[1], "triangles": convert.vector_to_triangles(np.array([1.0, 2.0, 3.0, 5.0]), [2, 1])[1][0, 0],
        "columns": flat[1], "back": convert.vector_to_matrices(flat, [(2, 2), (1, 1)])[0][0, 1], "scaled": convert.scale_vcov(np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([4.0]))[0, 0],
        "repaired": float((convert.safe_chol(np.array([[1.0, 2.0], [2.0, 1.0]])) ** 2).sum() > 0), "grid": float(weights @ nodes[:, 0] ** 2),
    }
    return small(spark, [(k, round(float(v), 8) + 0.0) for k, v in found.items()], "what string, value double")


@query("""SELECT 'chi2' AS what, round(exp(-3.5e0/2), 8) AS value UNION ALL SELECT 't1', round(1 - 2/pi()*atan(2.5e0), 8) UNION ALL SELECT 't2', round(1 - 2.5e0/sqrt(2 + 2.5e0*2.5e0), 8)
UNION ALL SELECT 'f2', round(power(1 + 2*1.7e0/9, -4.5e0), 8) UNION ALL SELECT 'chi2_4', round(exp(-1.5e0)*(1 + 1.5e0), 8) UNION ALL SELECT 'range2', round(1 - 2/pi()*atan(3e0/sqrt(2e0)), 5)
UNION ALL SELECT 'wilson_low', round((0.3e0 + 3.841458820694124e0/80 - sqrt(3.841458820694124e0)*sqrt(0.3e0*0.7e0/40 + 3.841458820694124e0/6400))/(1 + 3.841458820694124e0/40), 6)
UNION ALL SELECT 'holm', 0.06e0 UNION ALL SELECT 'fdr', 0.03e0 UNION ALL SELECT 'bonferroni', 0.06e0""")
def tail_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("chi2", tails.chi2_sf(3.5, 2), 8), ("t1", tails.t_two_sided(2.5, 1), 8), ("t2", tails.t_two_sided(2.5, 2), 8), ("f2", tails.f_sf(1.7, 2, 9), 8), ("chi2_4", tails.chi2_sf(3.0, 4), 8),
        ("range2", tails.studentized_range_sf(3.0, 2, 1), 5), ("wilson_low", tails.wilson(12, 40)[0], 6), ("holm", tails.adjust([0.02, 0.03, 0.03], "holm")[0], 8), ("fdr", tails.adjust([0.01, 0.02, 0.03], "fdr")[2], 8), ("bonferroni", tails.adjust([0.02, 0.5, 0.9], "bonferroni")[0], 8),
    ]
    return small(spark, [(k, round(float(v), d)) for k, v, d in rows], "what string, value double")


@query(values([("coordinates", 1.0, 2.0, True), ("quasi_newton", 1.0, 2.0, True), ("simplex", 1.0, 2.0, True), ("at_bound", 3.0, 2.0, True), ("golden", 0.5, 0.0, True)], "method, x, y, converged"))
def optimisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def bowl(v: np.ndarray) -> float:
        return float((v[0] - 1) ** 2 + 3 * (v[1] - 2) ** 2 + 0.5 * (v[0] - 1) * (v[1] - 2) + 7)

    free, rows = [(-math.inf, math.inf)] * 2, []
    for method in optimise.available():
        m = optimise.run(bowl, np.array([4.0, -3.0]), free, method)
        rows.append((method, round(float(m.x[0]), 3), round(float(m.x[1]), 3), m.converged))
    m = optimise.run(lambda v: float((v[0] - 1) ** 2 + (v[1] - 2) ** 2), np.array([4.0, 0.0]), [(3.0, math.inf), (-math.inf, math.inf)], "quasi_newton")
    rows.append(("at_bound", round(float(m.x[0]), 3), round(float(m.x[1]), 3), m.converged))
    rows.append(("golden", round(optimise.golden(lambda t: (t - 0.5) ** 2, 0.0, 2.0)[0], 4), 0.0, True))
    return small(spark, rows, "method string, x double, y double, converged boolean")


@query("SELECT round(ln(7e0), 8) AS logdet, 9::INT AS entries, round(6e0/7, 8) AS first, round(1e0/7, 8) AS last, TRUE AS again")
def sparse_cholesky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of second differences (2 on the diagonal, -1 beside it, six places, plus a shift): determinant n + 1."""
    i, j = np.append(np.arange(6), np.arange(5)), np.append(np.arange(6), np.arange(1, 6))
    v = np.append(np.full(6, 1.0), np.full(5, -1.0))
    pattern = sparse.analyse(6, i, j)
    found = sparse.factor(pattern, i, j, v, 1.0)
    x = found.solve(np.eye(6)[:, 0])
    other = sparse.factor(pattern, i, j, 2 * v, 2.0)  # the same pattern, other numbers
    return small(spark, [(round(found.logdet(), 8), pattern.entries - 2, round(float(x[0]), 8), round(float(x[5]), 8), bool(np.allclose(other.solve(np.eye(6)), found.solve(np.eye(6)) / 2)))], "logdet double, entries int, first double, last double, again boolean")


@query(values([("unknown optimiser", True), ("unknown action", True), ("limit", True), ("tolerance passed", True), ("inner", True)], "what, ok"))
def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fails(f) -> bool:
        try:
            f()
        except ValueError:
            return True
        return False

    rows = [("unknown optimiser", fails(lambda: optimise.run(lambda v: 0.0, np.zeros(1), [(0, 1)], "none"))), ("unknown action", fails(lambda: control.lmer_control(check_rank_x="shout"))), ("limit", fails(lambda: control.lmer_control(max_evaluations=0))), ("tolerance passed", control.lmer_control(tolerance=1e-3).settings() == {"tol": 1e-3}), ("inner", control.glmer_control().inner_iterations == 100)]
    return small(spark, rows, "what string, ok boolean")


# balanced one-way designs: restricted maximum likelihood is analysis of variance

YIELDS = ", ".join(f"('{b}', {y})" for b, ys in frames.DYESTUFF.items() for y in ys)
BALANCED = f"""WITH d AS (SELECT * FROM (VALUES {YIELDS}) AS t(b, y)), m AS (SELECT b, avg(y) AS m, sum((y - (SELECT avg(y) FROM d AS i WHERE i.b = d.b))*(y - (SELECT avg(y) FROM d AS i WHERE i.b = d.b))) AS ss FROM d GROUP BY b),
a AS (SELECT 5*var_samp(m) AS msb, sum(ss)/24 AS msw, avg(m) AS mean FROM m) """


def dye(spark: SparkSession, reml: bool = True, **options) -> LmerResult:
    return lmer("Yield ~ 1 + (1 | Batch)", frames.dyestuff(spark), reml, **options)


@query(BALANCED + """SELECT what, round(v, 0) AS batch, round(msw, 0) AS residual FROM a, (SELECT 'reml' AS what, (msb - msw)/5 AS v FROM a UNION ALL SELECT 'staged', (msb - msw)/5 FROM a
 UNION ALL SELECT 'em', (msb - msw)/5 FROM a UNION ALL SELECT 'average information', (msb - msw)/5 FROM a UNION ALL SELECT 'mm', (msb - msw)/5 FROM a UNION ALL SELECT 'ml', (msb*5/6 - msw)/5 FROM a)""")
def variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two variances by six ways."""
    data = frames.dyestuff(spark)
    model, ml = dye(spark), dye(spark, False)
    parsed = staged.parse_data("Yield ~ 1 + (1 | Batch)", data)
    fitted = staged.model(parsed, staged.optimise(staged.criterion(parsed), parsed))
    em = resample.em_reml("Yield ~ 1 + (1 | Batch)", data, iterations=5000, tol=1e-13)
    ai, mm = variance.average_information(model), variance.mm_reml(model)
    rows = [("reml", model.covariances()[0][0, 0], model.solved.sigma2), ("staged", fitted.covariances()[0][0, 0], fitted.solved.sigma2), ("em", em[0][0, 0], em[1]), ("average information", ai[0][0, 0], ai[1]), ("mm", mm[0], mm[1]), ("ml", ml.covariances()[0][0, 0], ml.solved.sigma2)]
    return small(spark, [(k, round(float(a), 0), round(float(b), 0)) for k, a, b in rows], "what string, batch double, residual double")


@query(BALANCED + """SELECT method, round(mean, 3) AS estimate, round(sqrt(msb/30), 3) AS std_error, 5e0 AS df FROM a, (SELECT unnest(['kenward_roger', 'satterthwaite']) AS method)""")
def degrees_of_freedom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced mean has the degrees of freedom of the batches, whatever the method."""
    model, rows = dye(spark), []
    for method in ("kenward_roger", "satterthwaite"):
        r = ddf.coefficient_tests(model, method).first()
        rows.append((method, round(r.estimate, 3), round(r.std_error, 3), round(r.df, 1)))
    return small(spark, rows, "method string, estimate double, std_error double, df double")


@query(BALANCED + """SELECT b AS level, round((msb - msw)/msb*(m - mean), 2) AS effect, round(sqrt((msb - msw)/5*msw/msb), 1) AS sd, round(mean + (msb - msw)/msb*(m - mean), 2) AS coefficient FROM m, a""")
def shrunken_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = dye(spark)
    coef = model.coef().select("level", F.round("`(Intercept)`", 2).alias("coefficient"))
    return model.ranef().select("level", F.round("`(Intercept)`", 2).alias("effect"), F.round(F.sqrt("`condvar_(Intercept)`"), 1).alias("sd")).join(coef, "level")


@query(BALANCED + """SELECT round(mean, 3) AS fit, round(sqrt(msb/30 + msw + (msb - msw)/5), 1) AS spread FROM a""")
def prediction_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new observation of a new batch."""
    model = dye(spark)
    r = model.predict(small(spark, [("new",)], "Batch string"), allow_new_levels=True, interval="prediction").first()
    return small(spark, [(round(r.fit, 3), round((r.upper - r.lower) / 2 / tails.norm_ppf(0.975), 1))], "fit double, spread double")


@query(BALANCED + """SELECT effect, "group", term, round(estimate, 0) AS estimate FROM (SELECT 'fixed' AS effect, NULL AS "group", '(Intercept)' AS term, mean AS estimate FROM a
 UNION ALL SELECT 'ran_pars', 'Batch', 'sd__(Intercept)', sqrt((msb - msw)/5) FROM a UNION ALL SELECT 'ran_pars', 'Residual', 'sd__Observation', sqrt(msw) FROM a
 UNION ALL SELECT 'ran_vals', 'Batch', '(Intercept)', (msb - msw)/msb*(m - mean) FROM m, a)""")
def tidy_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dye(spark).tidy_all().select("effect", "group", "term", (F.round("estimate", 0) + 0.0).alias("estimate"))


@query(BALANCED + """SELECT round((msb - msw)/5/((msb - msw)/5 + msw), 3) AS icc, 0e0 AS marginal, round((msb - msw)/5/((msb - msw)/5 + msw), 3) AS conditional, FALSE AS singular, TRUE AS consistent, 3::BIGINT AS fits, 1e0 AS share FROM a""")
def fit_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = dye(spark)
    fits = inference.all_fit(model)
    r2 = diagnostics.r2_nakagawa(model)
    row = (round(diagnostics.icc(model)["adjusted"], 3), round(r2["marginal"], 3) + 0.0, round(r2["conditional"], 3), model.is_singular(), inference.is_consistent(fits), fits.count(), round(float(model.re_pca()[0]["proportion"][0]), 6))
    return small(spark, [row], "icc double, marginal double, conditional double, singular boolean, consistent boolean, fits long, share double")


@query(BALANCED + """, g AS (SELECT 25e0*m*m AS s2, 5*m AS s, (SELECT sum(y*y) FROM d) AS yy, mean FROM m, a),
v AS (SELECT t, max(yy) AS yy, sum(t*t*s2/(5*t*t + 1)) AS cc, sum(s/(5*t*t + 1)) AS b, sum(5/(5*t*t + 1)) AS x, sum(ln(5*t*t + 1)) AS ld FROM g, (SELECT unnest([0.4e0, 1.2e0]) AS t) GROUP BY t)
SELECT t AS theta, round(29*(1 + ln(2*pi()*(yy - cc - b*b/x)/29)) + ld + ln(x), 4) AS deviance, TRUE AS gradient FROM v""")
def deviance_and_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criterion away from its optimum, and whether its exact gradient is that of differences."""
    model, rows = dye(spark), []
    for t in (0.4, 1.2):
        value, slope = variance.deviance_gradient(np.array([t]), model.gram, model.layout)
        h = 1e-5
        ends = [solve(np.array([t + s * h]), model.gram, model.layout, True, False).deviance for s in (1, -1)]
        rows.append((t, round(value, 4), bool(abs((ends[0] - ends[1]) / (2 * h) - slope[0]) < 1e-4)))
    return small(spark, rows, "theta double, deviance double, gradient boolean")


# unbalanced fits: the optimum by a grid narrowed six times

def narrowed(what: str, reml: bool) -> str:
    """SQL for the optimum of ``y ~ 1 (+ x) + (1 | g)`` on the planted rows: theta, beta0, beta1, sigma2, deviance, and v00, v01,
    v11 (unscaled covariance). ``what`` is 'x' or '1'."""
    dof = ("nn - 2e0" if what == "x" else "nn - 1e0") if reml else "nn"
    det = "ln(a00*a11 - a01*a01)" if what == "x" else "ln(a00)"
    pw = "c - ((a11*b0 - a01*b1)*b0 + (a00*b1 - a01*b0)*b1)/(a00*a11 - a01*a01)" if what == "x" else "c - b0*b0/a00"
    sums = """sum(n) AS nn, sum(ln(t*t*n + 1e0)) AS ld, sum(n - t*t*n*n/(t*t*n + 1e0)) AS a00, sum(sx - t*t*n*sx/(t*t*n + 1e0)) AS a01, sum(sxx - t*t*sx*sx/(t*t*n + 1e0)) AS a11,
  sum(sy - t*t*n*sy/(t*t*n + 1e0)) AS b0, sum(sxy - t*t*sx*sy/(t*t*n + 1e0)) AS b1, sum(syy - t*t*sy*sy/(t*t*n + 1e0)) AS c"""
    value = f"({dof})*(1e0 + ln(2e0*pi()*({pw})/({dof}))) + ld" + (f" + {det}" if reml else "")
    steps, before, width = [], "(SELECT 2e0 AS t)", 2.0
    for i in range(7):
        steps.append(f"s{i} AS (SELECT t, {value} AS dev FROM (SELECT t, {sums} FROM gram, (SELECT greatest(0e0, o.t + {width!r}*(k - 20)/20) AS t FROM {before} AS o, (SELECT unnest(range(0, 41)) AS k)) GROUP BY t)), o{i} AS (SELECT t, dev FROM s{i} ORDER BY dev, t LIMIT 1)")
        before, width = f"o{i}", width / 15
    last = f"""best AS (SELECT t AS theta, {value} AS deviance, ({pw})/({dof}) AS sigma2, {'(a11*b0 - a01*b1)/(a00*a11 - a01*a01)' if what == 'x' else 'b0/a00'} AS beta0,
  {'(a00*b1 - a01*b0)/(a00*a11 - a01*a01)' if what == 'x' else '0e0'} AS beta1, {'a11/(a00*a11 - a01*a01)' if what == 'x' else '1/a00'} AS v00, {'-a01/(a00*a11 - a01*a01)' if what == 'x' else '0e0'} AS v01, {'a00/(a00*a11 - a01*a01)' if what == 'x' else '0e0'} AS v11
  FROM (SELECT t, {sums} FROM gram, o6 GROUP BY t))"""
    return PLANTED + ", gram AS (SELECT g, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x*x) AS sxx, sum(y) AS sy, sum(x*y) AS sxy, sum(y*y) AS syy FROM src GROUP BY g), " + ", ".join(steps) + ", " + last + " "


def planted_fit(spark: SparkSession, sf_dir: str, fixed: str = "x", reml: bool = True) -> LmerResult:
    return lmer(f"y ~ {fixed} + (1 | g)", planted(spark, sf_dir), reml)


@query(narrowed("x", True) + "SELECT round(beta0, 3) AS intercept, round(beta1, 3) AS slope, round(sqrt(sigma2*v00), 3) AS se_intercept, round(sqrt(sigma2*v11), 3) AS se_slope, round(sqrt(sigma2), 3) AS sigma, round(theta*sqrt(sigma2), 2) AS sd, round(deviance, 2) AS criterion FROM best")
def lmer_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = planted_fit(spark, sf_dir)
    b, s = list(m.fixef().values()), m.std_errors()
    return small(spark, [(round(b[0], 3), round(b[1], 3), round(float(s[0]), 3), round(float(s[1]), 3), round(m.sigma, 3), round(float(m.var_corr()[0]["sd"][0]), 2), round(m.reml_criterion(), 2))], "intercept double, slope double, se_intercept double, se_slope double, sigma double, sd double, criterion double")


@query(narrowed("x", True) + "SELECT g::VARCHAR AS level, round(theta*theta/(theta*theta*n + 1)*(sy - beta0*n - beta1*sx), 2) AS effect FROM gram, best")
def lmer_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_fit(spark, sf_dir).ranef().select("level", F.round("`(Intercept)`", 2).alias("effect"))


@query(narrowed("x", True) + """, u AS (SELECT g, theta*theta/(theta*theta*n + 1)*(sy - beta0*n - beta1*sx) AS u, beta0, beta1 FROM gram, best), r AS (SELECT y, beta0 + beta1*x + u AS f, x FROM src JOIN u USING (g))
SELECT count(*) AS n, round(avg(f), 2) AS fitted, round(avg((y - f)*(y - f)), 1) AS mse, round(corr(y, f), 3) AS corr FROM r""")
def lmer_fitted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted_fit(spark, sf_dir).residuals()
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("fitted"), 2).alias("fitted"), F.round(F.avg(F.col("resid") * F.col("resid")), 1).alias("mse"), F.round(F.corr("y", "fitted"), 3).alias("corr"))


@query(narrowed("x", True) + """, p AS (SELECT unnest([1, 2, 999999999]) AS g), w AS (SELECT p.g, x/10e0 AS x FROM p, (SELECT unnest(range(0, 3)) AS x))
SELECT w.g::VARCHAR AS g, w.x, round(beta0 + beta1*w.x + coalesce(theta*theta/(theta*theta*n + 1)*(sy - beta0*n - beta1*sx), 0), 2) AS fit FROM w LEFT JOIN gram ON w.g = gram.g, best""")
def lmer_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = small(spark, [(str(g), x / 10) for g in (1, 2, 999_999_999) for x in range(3)], "g string, x double")
    return planted_fit(spark, sf_dir).predict(new, allow_new_levels=True).select("g", "x", F.round("fit", 2).alias("fit"))


_second = narrowed("1", False).split(" FROM src GROUP BY g), ", 1)[1]
for _i in range(7):
    _second = _second.replace(f"s{_i} AS", f"p{_i} AS").replace(f"FROM s{_i} ", f"FROM p{_i} ").replace(f"o{_i} AS", f"q{_i} AS").replace(f"FROM o{_i} AS o", f"FROM q{_i} AS o")
_second = _second.replace("FROM gram, o6 GROUP", "FROM gram, q6 GROUP").replace("best AS", "least_ AS")
ML = narrowed("x", False).replace("best AS", "full_ AS").rstrip() + ", " + _second


@query(ML + "SELECT 'x' AS term, 1::INT AS df, round(least_.deviance - full_.deviance, 2) AS chisq, round(full_.deviance, 1) AS deviance FROM full_, least_")
def lmer_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test by drop1, which deletes a column of the cross-products, and by anova, which fits both."""
    full = planted_fit(spark, sf_dir)
    by_drop = inference.drop1(full).where("term = 'x'").first()
    by_anova = inference.anova(planted_fit(spark, sf_dir, "1"), full).where("chisq is not null").first()
    chi = by_anova.chisq if abs(by_drop.lrt - by_anova.chisq) < 1e-3 else math.nan
    return small(spark, [("x", by_anova.df, round(chi, 2), round(by_anova.deviance, 1))], "term string, df int, chisq double, deviance double")


# least squares

@query(PLANTED + """, m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*)::DOUBLE AS n, regr_sxx(y, x) AS sxx, avg(x) AS mx FROM src),
s AS (SELECT sum((y - a - b*x)*(y - a - b*x))/(max(n) - 2) AS s2 FROM src, m),
e AS (SELECT x, y - a - b*x AS r, 1/n + (x - mx)*(x - mx)/sxx AS h, n, sxx, mx, s2 FROM src, m, s)
SELECT round(max((x - mx)/sxx*r/(1 - h)), 8) AS slope, round(min((1/n - mx*(x - mx)/sxx)*r/(1 - h)), 8) AS intercept, round(max((x - mx)/sxx*r/(1 - h)/sqrt(s2/sxx)), 6) AS scaled, round(max(r*sqrt(h)/(sqrt(s2)*(1 - h))), 6) AS dffits FROM e""")
def deletion_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lmer("y ~ x", planted(spark, sf_dir)).leverages()
    return rows.agg(F.round(F.max(F.col("dfbeta")[1]), 8).alias("slope"), F.round(F.min(F.col("dfbeta")[0]), 8).alias("intercept"), F.round(F.max(F.col("dfbetas")[1]), 6).alias("scaled"), F.round(F.max("dffits"), 6).alias("dffits"))


@query(PLANTED + """, m AS (SELECT regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx, count(*)::DOUBLE AS n FROM src)
SELECT round(n*ln(syy/(syy - sxy*sxy/sxx)), 4) AS lrt, round(sxy*sxy/sxx/((syy - sxy*sxy/sxx)/(n - 2)), 4) AS f, round(n*ln(1 + 4*(1/(n - 2))), 6) AS at_two_errors FROM m""")
def least_squares_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropping the slope by likelihood ratio, its Wald test, and the squared profile two standard errors away."""
    model = lmer("y ~ x", planted(spark, sf_dir))
    wald = inference.linear_hypothesis(model, np.array([[0.0, 1.0]]), df=model.df_residual())
    profile = profiles.profile_fixed(model, ["x"], points=3, spread=2.0).collect()
    return small(spark, [(round(inference.drop1(model).where("term = 'x'").first().lrt, 4), round(wald["f"], 4), round(profile[0].zeta ** 2, 6))], "lrt double, f double, at_two_errors double")


@query(PLANTED + """, g AS (SELECT flag, avg(y) AS m, count(*)::DOUBLE AS n, sum(y*y) - sum(y)*sum(y)/count(*) AS ss FROM src GROUP BY flag), s AS (SELECT sum(ss)/(sum(n) - 3) AS s2 FROM g)
SELECT b.flag || ' - ' || a.flag AS contrast, round(b.m - a.m, 4) AS estimate, round(sqrt(s2*(1/a.n + 1/b.n)), 5) AS std_error FROM g a, g b, s WHERE a.flag = 'A' AND b.flag > 'A'
UNION ALL SELECT flag || ' effect', round(m - (SELECT avg(m) FROM g), 4), round(sqrt(s2*((SELECT sum(1/n) FROM g)/9 + 1/(3*n))), 5) FROM g, s
UNION ALL SELECT flag, round(m, 4), round(sqrt(s2/n), 5) FROM g, s""")
def marginal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a factor: adjusted predictions, contrasts with the first level, and with the mean of all."""
    model = lmer("y ~ flag", planted(spark, sf_dir))
    parts = [effects.contrast(model, "flag", kind).select("contrast", "estimate", "std_error") for kind in ("trt.vs.ctrl", "effects")]
    parts.append(effects.all_effects(model)["flag"].select(F.col("flag").alias("contrast"), F.col("predicted").alias("estimate"), "std_error"))
    out = parts[0].union(parts[1]).union(parts[2])
    return out.select("contrast", F.round("estimate", 4).alias("estimate"), F.round("std_error", 5).alias("std_error"))


@query(PLANTED + """, w AS (SELECT y - 2*tax AS y, x, 1 + line AS w FROM src), m AS (SELECT sum(w) AS sw, sum(w*x) AS sx, sum(w*x*x) AS sxx, sum(w*y) AS sy, sum(w*x*y) AS sxy FROM w)
SELECT round((sw*sxy - sx*sy)/(sw*sxx - sx*sx), 5) AS slope, round((sxx*sy - sx*sxy)/(sw*sxx - sx*sx), 5) AS intercept, round(sw, 1) AS weight FROM m""")
def weights_and_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir).withColumns({"wt": (1 + F.col("line")).cast("double"), "off": 2 * F.col("tax")})
    model = lmer("y ~ x", rows, weights="wt", offset="off")
    b = list(model.fixef().values())
    return small(spark, [(round(b[1], 5), round(b[0], 5), round(model.weights().agg(F.sum("w")).first()[0], 1))], "slope double, intercept double, weight double")


@query("""SELECT 'rank' AS what, TRUE AS found UNION ALL SELECT 'levels', TRUE UNION ALL SELECT 'clean', TRUE""")
def design_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir).withColumns({"x2": 2 * F.col("x"), "one": F.lit("a")})
    say = lambda f: checks.problems(p := frame.prepare(f, rows), gram(p))
    return small(spark, [("rank", bool(say("y ~ x + x2 + (1 | g)"))), ("levels", bool(say("y ~ x + (1 | one)"))), ("clean", not say("y ~ x + (1 | line)"))], "what string, found boolean")


# generalised models of one factor: each level's mean is its maximum likelihood estimate

@query(PLANTED + """, b AS (SELECT status, CAST(y > 50 AS INT) AS big FROM src), p AS (SELECT status, avg(big) AS p, count(*)::DOUBLE AS n FROM b GROUP BY status),
f AS (SELECT a.p AS pa, a.n AS na, b.p AS pb, b.n AS nb FROM p a, p b WHERE a.status = 'F' AND b.status = 'O')
SELECT '(Intercept)' AS term, round(ln(pa/(1 - pa)), 5) AS estimate, round(sqrt(1/(na*pa*(1 - pa))), 6) AS std_error FROM f
UNION ALL SELECT 'status.1', round(ln(pb/(1 - pb)) - ln(pa/(1 - pa)), 5), round(sqrt(1/(na*pa*(1 - pa)) + 1/(nb*pb*(1 - pb))), 6) FROM f""")
def logistic_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir).withColumn("big", (F.col("y") > 50).cast("int"))
    return glmer("big ~ status", rows, "binomial").tidy().select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 6).alias("std_error"))


@query("""WITH g AS (SELECT l_returnflag AS flag, avg(l_linenumber) AS m, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
r AS (SELECT l_returnflag AS flag, l_linenumber::DOUBLE AS y, m, n FROM lineitem JOIN g ON l_returnflag = flag)
SELECT flag, round(avg(m), 5) AS mean, round(sum((y - m)*(y - m)/m), 3) AS pearson, round(sum(2*(y*ln(y/m) - (y - m))), 3) AS deviance, round(sum((y - m)/m), 5) + 0e0 AS working, round(max(1/n), 9) AS hat,
  round(max((y - m)*(y - m)/m*(1/n)/(3*(1 - 1/n)*(1 - 1/n))), 9) AS cooks FROM r GROUP BY flag""")
def poisson_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions, residuals of four kinds, leverages and Cook's distances of a Poisson model of one factor."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("double").alias("y"))
    model = glmer("y ~ l_returnflag", rows, "poisson")
    every = model.leverages().withColumn("working", F.col("residual") * model.family.link.slope(F.col("mu"), SPARK))
    flag = F.when(F.col("x1") == 1, "N").when(F.col("x2") == 1, "R").otherwise("A")
    out = every.groupBy(flag.alias("flag")).agg(F.round(F.sum(F.col("pearson") ** 2), 3).alias("pearson"), F.round(F.sum(F.col("deviance") ** 2), 3).alias("deviance"), (F.round(F.sum("working"), 5) + 0.0).alias("working"), F.round(F.max("hat"), 9).alias("hat"), F.round(F.max("cooks"), 9).alias("cooks"))
    mean = model.predict(small(spark, [("A",), ("N",), ("R",)], "l_returnflag string")).select(F.col("l_returnflag").alias("flag"), F.round("fit", 5).alias("mean"))
    return out.join(mean, "flag")


@query("""WITH g AS (SELECT l_returnflag AS flag, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT fam, round(ln(a.m), 4) AS intercept, round(ln(b.m/a.m), 4) AS second FROM g a, g b, (SELECT unnest(['gamma', 'inverse_gaussian', 'negative_binomial', 'gaussian']) AS fam) WHERE a.flag = 'A' AND b.flag = 'N'""")
def families_of_one_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever the family, one factor with a log link has the levels' mean."""
    rows, data = [], table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    for name in ("gamma", "inverse_gaussian", "negative_binomial", "gaussian"):
        b = list(glmer("l_quantity ~ l_returnflag", data, family(name, "log", theta=2.0)).fixef().values())
        rows.append((name, round(b[0], 4), round(b[1], 4)))
    return small(spark, rows, "fam string, intercept double, second double")


@query("""WITH m AS (SELECT l_quantity/10 + 0.5e0 AS mu, l_tax + 0.1e0 AS p FROM lineitem)
SELECT round(sum(p*(1 - p)), 4) AS binomial, round(sum(mu), 3) AS poisson, count(*)::DOUBLE AS gamma, round(sum(1/mu), 3) AS inverse_gaussian, round(sum(mu/(1 + mu/2)), 3) AS negative_binomial, count(*)::DOUBLE AS gaussian,
  round(sum(mu*mu*mu), 0) AS variance_ig, round(sum(mu + mu*mu/2), 2) AS variance_nb, round(sum(p*(1 - p)*3), 4) AS quasi FROM m""")
def working_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10 + 0.5).alias("mu"), (F.col("l_tax") + 0.1).alias("p"))
    names = {"binomial": 4, "poisson": 3, "gamma": 3, "inverse_gaussian": 3, "negative_binomial": 3, "gaussian": 3}
    parts = [F.round(F.sum(family(n, theta=2.0).weight(F.col("p" if n == "binomial" else "mu"), SPARK)), d).alias(n) for n, d in names.items()]
    more = [F.round(F.sum(family("inverse_gaussian").variance(F.col("mu"), SPARK)), 0).alias("variance_ig"), F.round(F.sum(family("negative_binomial", theta=2.0).variance(F.col("mu"), SPARK)), 2).alias("variance_nb"), F.round(F.sum(family("binomial").quasi(3.0).variance(F.col("p"), SPARK)), 4).alias("quasi")]
    return rows.agg(*parts, *more)


@query("""SELECT 'laplace' AS what, TRUE AS same UNION ALL SELECT 'staged', TRUE UNION ALL SELECT 'refit', TRUE UNION ALL SELECT 'update', TRUE UNION ALL SELECT 'criterion', TRUE UNION ALL SELECT 'drop1', TRUE UNION ALL SELECT 'quadrature', TRUE""")
def generalised_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways to the same generalised mixed model agree: stages, refit, update, the criterion at its optimum; deleting a term
    gives the model without it; quadrature with one point is Laplace's approximation."""
    data = frames.cbpp(spark)
    m = glmer("incidence / size ~ period + (1 | herd)", data, "binomial")
    parsed = staged.parse_generalised("incidence / size ~ period + (1 | herd)", data, "binomial")
    again = staged.model_generalised(parsed, staged.optimise(staged.criterion_generalised(parsed), parsed))
    small_model = m.update(". ~ . - period")
    near = lambda a, b, tol=1e-3: bool(abs(a - b) < tol)
    drop = inference.drop1(m).where("term = 'period'").first()
    rows = [("laplace", near(m.state.laplace, m.deviance())), ("staged", near(again.deviance(), m.deviance())), ("refit", near(m.refit("incidence").deviance(), m.deviance())), ("update", small_model.npar() == m.npar() - 3), ("criterion", near(m.criterion(m.theta), m.deviance())), ("drop1", near(drop.lrt, small_model.deviance() - m.deviance(), 1e-2)), ("quadrature", near(glmer("incidence / size ~ period + (1 | herd)", data, "binomial", points=9).deviance(), m.deviance(), 2.0))]
    return small(spark, rows, "what string, same boolean")


# nonlinear fits, intervals, templates

@query("SELECT 10e0 AS vm, 7e0 AS k, round(10e0*20/27, 4) AS at_twenty, 5::INT AS groups, 0e0 AS sd, TRUE AS singular")
def exact_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of one curve with errors that cancel at every place: the curve itself, and no difference of groups."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x")).distinct()
    rows = x.crossJoin(spark.range(5).withColumnRenamed("id", "g")).crossJoin(small(spark, [(-0.1,), (0.1,)], "e double")).select("x", "g", (10 * F.col("x") / (7 + F.col("x")) + F.col("e")).alias("y"))
    m = nlmer("michaelis", rows, "x", "y", "g")
    at = m.predict(small(spark, [(20.0, 1)], "x double, g long")).first().fit
    return small(spark, [(round(m.fixef()["vm"], 3), round(m.fixef()["k"], 2), round(at, 4), m.ngrps()["g"], round(float(m.var_corr()[0]["sd"][0]), 3) + 0.0, m.is_singular())], "vm double, k double, at_twenty double, groups int, sd double, singular boolean")


@query("""WITH s AS (SELECT (i*37 % 101)/10e0 AS v FROM (SELECT unnest(range(0, 101)) AS i))
SELECT 'percentile' AS method, round(quantile_cont(v, 0.025), 6) AS conf_low, round(quantile_cont(v, 0.975), 6) AS conf_high, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std_error FROM s
UNION ALL SELECT 'basic', round(2*1527.5e0 - quantile_cont(v, 0.975), 6), round(2*1527.5e0 - quantile_cont(v, 0.025), 6), round(avg(v), 6), round(stddev_samp(v), 6) FROM s""")
def bootstrap_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of given replicates."""
    model = dye(spark)
    samples = np.array([[(i * 37 % 101) / 10, 1.0, 1.0] for i in range(101)])
    out = resample.boot_ci(model, samples).union(resample.boot_ci(model, samples, method="basic"))
    return out.select("method", *[F.round(c, 6).alias(c) for c in ("conf_low", "conf_high", "mean", "std_error")])


@query("""SELECT a, b, count(*) AS n FROM (SELECT 'a' || unnest(range(1, 4)) AS a), (SELECT 'b' || unnest(range(1, 3)) AS b), (SELECT unnest(range(0, 5)) AS k) GROUP BY a, b""")
def balanced_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.template(spark, {"a": 3, "b": 2}, 5).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("""WITH z AS (SELECT unnest([0.5e0, 1e0, 2e0]) AS v, unnest([-1e0, 0e0, 2e0]) AS zeta)
SELECT kind, round(CASE kind WHEN 'log' THEN ln(v) WHEN 'variance' THEN v*v ELSE sqrt(v) END, 6) AS value, zeta FROM z, (SELECT unnest(['log', 'variance', 'sd']) AS kind)""")
def profile_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = small(spark, [("a", 0.5, -1.0), ("a", 1.0, 0.0), ("a", 2.0, 2.0)], "parameter string, value double, zeta double")
    parts = [profiles.transformed(base, k).select(F.lit(k).alias("kind"), F.round("value", 6).alias("value"), "zeta") for k in ("log", "variance", "sd")]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH m AS (SELECT 'm' || l_linenumber AS model, -100e0 - l_linenumber AS log_lik FROM lineitem GROUP BY l_linenumber),
w AS (SELECT model, exp(log_lik + 101)/sum(exp(log_lik + 101)) OVER () AS weight FROM m), c AS (SELECT *, sum(weight) OVER (ORDER BY weight DESC, model ROWS UNBOUNDED PRECEDING) AS cumulative FROM w)
SELECT model, round(weight, 6) AS weight FROM c WHERE cumulative - weight < 0.9e0""")
def models_of_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    rows = rows.select(F.concat(F.lit("m"), F.col("l_linenumber")).alias("model"), F.lit(2).alias("npar"), F.lit(500).cast("long").alias("nobs"), (-100.0 - F.col("l_linenumber")).alias("log_lik"))
    return inference.evidence_set(inference.rank_models(rows, "aic"), 0.9).select("model", F.round("weight", 6).alias("weight"))
