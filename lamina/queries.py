"""Registered queries of the engine's operators, each with the same result in DuckDB SQL where SQL can express it.

Numbers are rounded on both sides well above the last bits in which engines may differ.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.families import LINKS, SPARK, family
from lamina.operators import convert, diagnostics, grouped, inference, resample
from lamina.operators.glmm import glmer
from lamina.operators.gram import gram, level_table
from lamina.operators.lmm import Layout, lmer, solve
from lamina.operators.nlmm import nlmer
from lamina.operators.nonlinear import CURVES
from lamina.plans.frame import complete, level_codes, prepare
from lamina.sources.frames import dyestuff, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a supplier effect of known size."""
    effect = 5.0 * ((F.col("l_suppkey") * 7919) % 11).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_discount").alias("x"), (F.col("l_quantity") + effect).alias("y"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), F.col("l_tax").alias("tax"))


PLANTED = "WITH src AS (SELECT l_suppkey AS g, l_discount AS x, l_quantity + 5e0 * CAST((l_suppkey * 7919) % 11 AS DOUBLE) AS y, l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line, l_tax AS tax FROM lineitem)"


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


# frames

@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT count(*) AS n, sum(CAST(l_orderkey % 7 = 0 OR l_linenumber = 5 AS INT))::BIGINT AS dropped FROM lineitem")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.select(F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("a"), F.when(F.col("l_linenumber") == 5, float("nan")).otherwise(1.0).alias("b"))
    kept = complete(rows, ["a", "b"]).agg(F.count("*").alias("kept"))
    return rows.agg(F.count("*").alias("n")).crossJoin(kept).select("n", (F.col("n") - F.col("kept")).alias("dropped"))


@query("SELECT level, dense_rank() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT p_brand AS level FROM part)")
def dense_level_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_codes(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT l_suppkey || '/' || l_linenumber AS level, count(*) AS n FROM lineitem GROUP BY 1")
def nested_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep = prepare("l_quantity ~ 1 + (1 | l_suppkey/l_linenumber)", table(spark, sf_dir, "lineitem"))
    return prep.data.groupBy(F.col("g0").alias("level")).agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag AS flag, round(sum(CASE WHEN l_returnflag = 'N' THEN 1e0 ELSE 0e0 END), 4) AS c1,
  round(sum(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END), 4) AS c2, round(sum(l_tax * CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END), 4) AS tax_c2 FROM lineitem GROUP BY 1""")
def contrast_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_returnflag"))
    prep = prepare("l_quantity ~ l_returnflag * l_tax + (1 | key)", rows)
    at = {n: f"x{i}" for i, n in enumerate(prep.x_names)}
    return prep.data.groupBy(F.col("g0").alias("flag")).agg(*[F.round(F.sum(at[n]), 4).alias(a) for n, a in (("l_returnflag.1", "c1"), ("l_returnflag.2", "c2"), ("l_returnflag.2:l_tax", "tax_c2"))])


@query("""WITH s AS (SELECT l_quantity AS y, l_tax AS x, l_tax * l_tax AS x2 FROM lineitem)
SELECT round(sum(x), 4) AS x, round(sum(x2), 4) AS x2, round(sum(x * x2), 5) AS xx2, round(sum(y * x2), 2) AS yx2 FROM s""")
def power_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepare("l_quantity ~ l_tax + I(l_tax**2)", table(spark, sf_dir, "lineitem")).data
    return data.agg(F.round(F.sum("x1"), 4).alias("x"), F.round(F.sum("x2"), 4).alias("x2"), F.round(F.sum(F.col("x1") * F.col("x2")), 5).alias("xx2"), F.round(F.sum(F.col("y") * F.col("x2")), 2).alias("yx2"))


# cross-products and the linear mixed model

@query(PLANTED + "SELECT CAST(g AS VARCHAR) AS key, count(*) AS n, round(sum(x), 5) AS sx, round(sum(y), 3) AS sy FROM src GROUP BY g")
def gram_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep = prepare("y ~ x + (1 | g)", planted(spark, sf_dir))
    return level_table(prep, 0).select("key", "n", F.round(F.col("zx")[1], 5).alias("sx"), F.round(F.col("zy")[0], 3).alias("sy"))


@query(PLANTED + """, gram AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x*x) AS sxx, sum(y) AS sy, sum(x*y) AS sxy, sum(y*y) AS syy FROM src GROUP BY g),
grid AS (SELECT unnest([0e0, 0.5e0, 1e0, 1.1e0, 1.2e0, 2e0]) AS theta),
s AS (SELECT theta, sum(n) AS nn, sum(ln(theta*theta*n + 1e0)) AS ldl2,
  sum(n - theta*theta*n*n/(theta*theta*n + 1e0)) AS a00, sum(sx - theta*theta*n*sx/(theta*theta*n + 1e0)) AS a01, sum(sxx - theta*theta*sx*sx/(theta*theta*n + 1e0)) AS a11,
  sum(sy - theta*theta*n*sy/(theta*theta*n + 1e0)) AS b0, sum(sxy - theta*theta*sx*sy/(theta*theta*n + 1e0)) AS b1, sum(syy - theta*theta*sy*sy/(theta*theta*n + 1e0)) AS c
  FROM gram CROSS JOIN grid GROUP BY theta),
f AS (SELECT *, a00*a11 - a01*a01 AS det, (a11*b0 - a01*b1)/(a00*a11 - a01*a01) AS beta0, (a00*b1 - a01*b0)/(a00*a11 - a01*a01) AS beta1 FROM s)
SELECT theta, round(beta0, 5) AS beta0, round(beta1, 5) AS beta1, round(sqrt((c - beta0*b0 - beta1*b1)/(nn - 2e0)), 5) AS sigma,
  round((nn - 2e0)*(1e0 + ln(2e0*pi()*(c - beta0*b0 - beta1*b1)/(nn - 2e0))) + ldl2 + ln(det), 3) AS remlcrit FROM f""")
def reml_criterion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, layout = gram(prepare("y ~ x + (1 | g)", planted(spark, sf_dir))), Layout((1,), ("us",))
    rows = []
    for theta in (0.0, 0.5, 1.0, 1.1, 1.2, 2.0):
        s = solve(np.array([theta]), g, layout, True, False)
        rows.append((theta, *map(float, s.beta), float(np.sqrt(s.sigma2)), s.deviance))
    out = spark.createDataFrame(rows, "theta double, beta0 double, beta1 double, sigma double, remlcrit double")
    return out.select("theta", *[F.round(c, 5).alias(c) for c in ("beta0", "beta1", "sigma")], F.round("remlcrit", 3).alias("remlcrit"))


@query(PLANTED + """, gram AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy FROM src GROUP BY g),
t AS (SELECT sum(sy/(n + 1e0))/sum(n/(n + 1e0)) AS b FROM gram)
SELECT CAST(g AS VARCHAR) AS level, round((sy - n*b)/(n + 1e0), 5) AS effect FROM gram, t""")
def blups_at_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted supplier effects of an intercept-only model at relative standard deviation 1."""
    g = gram(prepare("y ~ 1 + (1 | g)", planted(spark, sf_dir)))
    s = solve(np.array([1.0]), g, Layout((1,), ("us",)))
    return spark.createDataFrame(list(zip(g.keys[0], map(float, s.u[0][:, 0]), strict=True)), "level string, effect double").select("level", F.round("effect", 5).alias("effect"))


@query()
def lmer_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmer("y ~ x + (1 | g)", planted(spark, sf_dir)).tidy()


@query()
def lmer_slopes_glance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmer("y ~ x + flag + (1 + x | g)", planted(spark, sf_dir)).glance()


@query()
def lmer_crossed_ranef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmer("y ~ x + (1 | g) + (1 | line)", planted(spark, sf_dir)).ranef(0)


@query()
def lmer_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmer("y ~ x + (1 | g)", planted(spark, sf_dir)).leverages().select("y", "fitted", "residual", "hat", "cooks")


@query()
def lmer_predict_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = lmer("y ~ x + (1 | g)", planted(spark, sf_dir))
    new = spark.createDataFrame([(str(g), x / 10) for g in (1, 2, 999_999_999) for x in range(3)], "g string, x double")
    return model.predict(new, allow_new_levels=True)


@query()
def lmer_drop1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.drop1(lmer("y ~ x + tax + flag + (1 | g)", planted(spark, sf_dir)))


@query()
def lmer_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = planted(spark, sf_dir)
    return inference.anova(lmer("y ~ 1 + (1 | g)", data), lmer("y ~ x + (1 | g)", data), lmer("y ~ x + flag + (1 | g)", data))


@query()
def emmeans_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.pairs(lmer("y ~ x + flag + (1 | g)", planted(spark, sf_dir)), "flag")


@query()
def glmer_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir).withColumn("big", (F.col("y") > 50).cast("int"))
    return glmer("big ~ status + (1 | g)", rows, "binomial").tidy()


@query()
def dyestuff_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = lmer("Yield ~ 1 + (1 | Batch)", dyestuff(spark))
    return spark.createDataFrame([(float(model.var_corr()[0]["variance"][0]), model.solved.sigma2)], "batch double, residual double")


# ordinary least squares cases that SQL can state

@query(PLANTED + """, m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*)::DOUBLE AS n, regr_sxx(y, x) AS sxx, avg(x) AS mx FROM src),
e AS (SELECT x, y - a - b*x AS r, 1/n + (x - mx)*(x - mx)/sxx AS h, n FROM src, m)
SELECT round(sum(h), 6) AS edf, round(max(h), 8) AS top, round(sum(r*r)/(max(n) - 2), 5) AS sigma2,
  round(max(r*r/(2*(SELECT sum(r*r)/(max(n) - 2) FROM e))*h/((1 - h)*(1 - h))), 8) AS cooks FROM e""")
def ols_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = lmer("y ~ x", planted(spark, sf_dir))
    rows = model.leverages()
    return rows.agg(F.round(F.sum("hat"), 6).alias("edf"), F.round(F.max("hat"), 8).alias("top"), F.round(F.lit(model.solved.sigma2), 5).alias("sigma2"), F.round(F.max("cooks"), 8).alias("cooks"))


@query("""SELECT l_suppkey, count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity)*regr_sxy(l_extendedprice, l_quantity))/1e6, 2) AS rss FROM lineitem GROUP BY l_suppkey""")
def lm_list_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped.lm_list(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_suppkey")
    return out.select("l_suppkey", "n", F.round("intercept", 3).alias("intercept"), F.round("slope", 4).alias("slope"), F.round(F.col("rss") / 1e6, 2).alias("rss"))


@query(PLANTED + """, l AS (SELECT g, count(*)::DOUBLE AS n, sum(y) AS s, sum(y*y) AS ss FROM src GROUP BY g),
t AS (SELECT sum(n) AS n, count(*)::DOUBLE AS k, sum(s) AS s, sum(ss) AS ss, sum(s*s/n) AS b, sum(n*n) AS n2 FROM l),
c AS (SELECT (b - s*s/n)/(k - 1) AS mb, (ss - b)/(n - k) AS mw, (n - n2/n)/(k - 1) AS n0 FROM t)
SELECT round(mb, 3) AS ms_between, round(mw, 5) AS ms_within, round((mb - mw)/n0, 5) AS var_group, round(((mb - mw)/n0)/((mb - mw)/n0 + mw), 7) AS icc FROM c""")
def one_way_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped.one_way(planted(spark, sf_dir), "y", "g")
    return out.select(F.round("ms_between", 3).alias("ms_between"), F.round("ms_within", 5).alias("ms_within"), F.round("var_group", 5).alias("var_group"), F.round("icc", 7).alias("icc"))


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS d FROM lineitem),
e AS (SELECT *, 1 + 2*a*b*d - a*a - b*b - d*d AS det FROM c)
SELECT 'l_quantity' AS term, round((1 - d*d)/det, 5) AS vif FROM e UNION ALL SELECT 'l_extendedprice', round((1 - b*b)/det, 5) FROM e UNION ALL SELECT 'l_tax', round((1 - a*a)/det, 5) FROM e""")
def collinearity_vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep = prepare("l_discount ~ l_quantity + l_extendedprice + l_tax", table(spark, sf_dir, "lineitem"))
    found = diagnostics.vif(gram(prep), prep.x_names)
    return spark.createDataFrame([(k, round(v, 5)) for k, v in found.items()], "term string, vif double")


# links, families, metrics

@query("""WITH m AS (SELECT l_tax + 0.1e0 + l_discount AS mu FROM lineitem)
SELECT round(sum(ln(mu/(1 - mu))), 3) AS logit, round(sum(ln(-ln(1 - mu))), 3) AS cloglog, round(sum(tan(pi()*(mu - 0.5e0))), 3) AS cauchit, round(sum(ln(mu)), 3) AS log,
  round(sum(1/mu), 3) AS inverse, round(sum(sqrt(mu)), 3) AS sqrt, round(sum(1/(mu*mu)), 2) AS inverse_squared, round(sum(1/(mu*(1 - mu))), 3) AS logit_slope FROM m""")
def link_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = F.col("l_tax") + 0.1 + F.col("l_discount")
    rows = table(spark, sf_dir, "lineitem").select(mu.alias("mu"))
    digits = {"inverse_squared": 2}
    return rows.agg(*[F.round(F.sum(LINKS[n].link(F.col("mu"), SPARK)), digits.get(n, 3)).alias(n) for n in ("logit", "cloglog", "cauchit", "log", "inverse", "sqrt", "inverse_squared")], F.round(F.sum(LINKS["logit"].slope(F.col("mu"), SPARK)), 3).alias("logit_slope"))


@query("""WITH e AS (SELECT 20*l_tax - 1 AS eta FROM lineitem)
SELECT round(sum(1/(1 + exp(-eta))), 4) AS logit, round(sum(1 - exp(-exp(eta))), 4) AS cloglog, round(sum(atan(eta)/pi() + 0.5e0), 4) AS cauchit, round(sum(exp(eta)), 3) AS log, round(sum(eta*eta), 3) AS sqrt FROM e""")
def inverse_link_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((20 * F.col("l_tax") - 1).alias("eta"))
    return rows.agg(*[F.round(F.sum(LINKS[n].inverse(F.col("eta"), SPARK)), d).alias(n) for n, d in (("logit", 4), ("cloglog", 4), ("cauchit", 4), ("log", 3), ("sqrt", 3))])


@query("""WITH d AS (SELECT l_linenumber::DOUBLE AS y, l_quantity/10 + 0.5e0 AS mu, CAST(l_linenumber > 3 AS DOUBLE) AS b, l_tax + 0.2e0 AS p FROM lineitem)
SELECT round(sum((y - mu)*(y - mu)), 2) AS gaussian, round(sum(2*(y*ln(y/mu) - (y - mu))), 2) AS poisson, round(sum(2*(y/mu - 1 - ln(y/mu))), 2) AS gamma,
  round(sum((y - mu)*(y - mu)/(mu*mu*y)), 2) AS inverse_gaussian, round(sum(CASE WHEN b = 1 THEN -2*ln(p) ELSE -2*ln(1 - p) END), 2) AS binomial,
  round(sum(2*(y*ln(y/mu) - (y + 2)*ln((y + 2)/(mu + 2)))), 2) AS negative_binomial FROM d""")
def family_deviances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("y"), (F.col("l_quantity") / 10 + 0.5).alias("mu"), (F.col("l_linenumber") > 3).cast("double").alias("b"), (F.col("l_tax") + 0.2).alias("p"))
    names = ("gaussian", "poisson", "gamma", "inverse_gaussian", "binomial", "negative_binomial")
    return rows.agg(*[F.round(F.sum(family(n, theta=2.0).deviance(*(F.col(c) for c in (("b", "p") if n == "binomial" else ("y", "mu"))), F.lit(1.0), SPARK)), 2).alias(n) for n in names])


@query("""WITH d AS (SELECT l_linenumber::DOUBLE AS y, l_quantity/10 + 0.5e0 AS mu FROM lineitem)
SELECT round(sum((y - mu)*(y - mu)/mu), 2) AS chisq, round(sum((y - mu)*(y - mu)/mu)/(count(*) - 1), 6) AS ratio FROM d""")
def pearson_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("y"), (F.col("l_quantity") / 10 + 0.5).alias("mu"), F.lit(1.0).alias("w"))
    found = diagnostics.dispersion(rows, family("poisson"), rows.count() - 1)
    return spark.createDataFrame([(round(found["chisq"], 2), round(found["ratio"], 6))], "chisq double, ratio double")


@query("""SELECT round(sum(l_tax*(y - f)*(y - f))/sum(l_tax), 5) AS mse, round(sqrt(sum(l_tax*(y - f)*(y - f))/sum(l_tax)), 5) AS rmse, round(sum(l_tax*abs(y - f))/sum(l_tax), 5) AS mae,
  round(1 - sum(l_tax*(y - f)*(y - f))/(sum(l_tax*y*y) - sum(l_tax*y)*sum(l_tax*y)/sum(l_tax)), 6) AS r2 FROM (SELECT l_tax, l_quantity AS y, l_extendedprice/2000 AS f FROM lineitem)""")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_tax", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000).alias("f"))
    out = grouped.weighted_metrics(rows, "y", "f", "l_tax")
    return out.select(*[F.round(c, 5).alias(c) for c in ("mse", "rmse", "mae")], F.round("r2", 6).alias("r2"))


# windows over small tables

@query("""WITH p AS (SELECT l_suppkey AS k, (1e0 + (l_suppkey*37) % 101)/2000e0 AS p FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p)
SELECT k, round(p, 6) AS p, round(max(least(1e0, (m - r + 1)*p)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING), 6) AS holm,
  round(min(least(1e0, m*p/r)) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 6) AS fdr, round(least(1e0, m*p), 6) AS bonferroni FROM r""")
def adjusted_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    rows = keys.withColumn("p", (1.0 + (F.col("k") * 37) % 101) / 2000.0)
    for method in ("holm", "fdr", "bonferroni"):
        rows = inference.adjust_column(rows, "p", method).withColumnRenamed("p_adjusted", method)
    return rounded(rows)


@query("""WITH m AS (SELECT 'm' || l_linenumber AS model, l_linenumber + 2 AS npar, 500::BIGINT AS nobs, -1000e0 + round(sum(l_tax)/1e5, 6)*1e3 + l_linenumber*1.5e0 AS log_lik FROM lineitem GROUP BY l_linenumber),
a AS (SELECT *, -2*log_lik + 2*npar AS aic, -2*log_lik + ln(nobs)*npar AS bic, -2*log_lik + 2*npar + 2e0*npar*(npar + 1)/(nobs - npar - 1) AS aicc FROM m),
d AS (SELECT *, aicc - min(aicc) OVER () AS delta FROM a), w AS (SELECT *, exp(-delta/2)/sum(exp(-delta/2)) OVER () AS weight FROM d)
SELECT model, round(aic, 4) AS aic, round(bic, 4) AS bic, round(aicc, 4) AS aicc, round(delta, 4) AS delta, round(weight, 6) AS weight,
  row_number() OVER (ORDER BY aicc, model)::INT AS rank, round(sum(weight) OVER (ORDER BY aicc, model ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM w""")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.sum("l_tax").alias("t"))
    rows = rows.select(F.concat(F.lit("m"), F.col("l_linenumber")).alias("model"), (F.col("l_linenumber") + 2).alias("npar"), F.lit(500).cast("long").alias("nobs"), (-1000.0 + F.round(F.col("t") / 1e5, 6) * 1e3 + F.col("l_linenumber") * 1.5).alias("log_lik"))
    out = inference.rank_models(rows, "aicc")
    return out.select("model", *[F.round(c, 4).alias(c) for c in ("aic", "bic", "aicc", "delta")], F.round("weight", 6).alias("weight"), "rank", F.round("cumulative", 6).alias("cumulative"))


# nesting, extension, curves

@query("SELECT (SELECT count(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(DISTINCT n_regionkey) > 1)) = 0 AS nested, (SELECT count(*) FROM (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(DISTINCT n_nationkey) > 1)) = 0 AS reversed")
def nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return spark.createDataFrame([(grouped.is_nested(nation, "n_nationkey", "n_regionkey"), grouped.is_nested(nation, "n_regionkey", "n_nationkey"))], "nested boolean, reversed boolean")


@query("SELECT CASE WHEN i = 0 THEN n_regionkey::VARCHAR ELSE n_regionkey || '_' || i END AS n_regionkey, count(*) AS n FROM nation, (SELECT unnest(range(0, 3)) AS i) GROUP BY 1")
def extended_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.extend(table(spark, sf_dir, "nation").select("n_regionkey"), "n_regionkey", 3).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_quantity AS x FROM lineitem)
SELECT round(sum(10 + (2 - 10)*exp(-exp(-3e0)*x)), 2) AS asymptotic, round(sum(10/(1 + exp(-(x - 20)/5))), 2) AS logistic, round(sum(10*x/(7 + x)), 2) AS michaelis,
  round(sum(1 + 9/(1 + exp(-(x - 20)/5))), 2) AS four_parameter, round(sum(10*exp(-2*power(0.9e0, x))), 2) AS gompertz, round(sum(5*exp(-exp(-2e0)*x) + 3*exp(-exp(-4e0)*x)), 2) AS biexponential FROM s""")
def self_starting_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"asymptotic": [10, 2, -3], "logistic": [10, 20, 5], "michaelis": [10, 7], "four_parameter": [1, 10, 20, 5], "gompertz": [10, 2, 0.9], "biexponential": [5, -2, 3, -4]}
    return table(spark, sf_dir, "lineitem").agg(*[F.round(F.sum(CURVES[n].column(F.col("l_quantity"), p)), 2).alias(n) for n, p in at.items()])


@query("SELECT max(l_extendedprice) AS asym, median(l_quantity) AS xmid, (max(l_quantity) - min(l_quantity))/4 AS scal FROM lineitem")
def curve_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([tuple(CURVES["logistic"].start(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))], "asym double, xmid double, scal double")


@query("SELECT * FROM (VALUES (1, -1.732051e0, 0.166667e0), (2, 0e0, 0.666667e0), (3, 1.732051e0, 0.166667e0)) AS t(i, node, weight)")
def quadrature_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, weights = convert.gauss_hermite(3)
    return spark.createDataFrame([(i + 1, round(float(a), 6) + 0.0, round(float(b), 6)) for i, (a, b) in enumerate(zip(nodes, weights, strict=True))], "i int, node double, weight double")


@query("""SELECT (CAST('0x' || md5('0/' || o_custkey)[1:8] AS BIGINT) % 5)::INT AS fold, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1""")
def hashed_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(grouped.fold_of(F.col("o_custkey"), 5).alias("fold"), "o_totalprice")
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


# resampling and nonlinear fits

@query()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = lmer("y ~ x + (1 | g)", planted(spark, sf_dir))
    return resample.boot_ci(model, resample.bootstrap(model, 10, seed=1))


@query()
def cross_validated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.cross_validate("y ~ x + (1 | g)", planted(spark, sf_dir), "line", 3)


@query()
def power_of_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.power_curve(lmer("y ~ x + (1 | g)", planted(spark, sf_dir)), "x", [0.0, 20.0], n=10)


@query()
def theta_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.profile(lmer("y ~ x + (1 | g)", planted(spark, sf_dir)), 0, 9)


@query()
def nonlinear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price against quantity by size class, averaged first, as a saturating curve with a random ceiling."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("g"), F.col("l_quantity").alias("x")).agg(F.round(F.avg("l_extendedprice"), 2).alias("y"))
    return nlmer("michaelis", rows, "x", "y", "g").tidy()
