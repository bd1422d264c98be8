"""Group-wise operators: least squares within groups, variance components by moments, folds, nesting, extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lm_list(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """Intercept, slope, n and residual sum of squares of y on x in every group, in one aggregation."""
    yd, xd = F.col(y).cast("double"), F.col(x).cast("double")
    sums = df.where(yd.isNotNull() & xd.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.avg(xd).alias("mx"), F.avg(yd).alias("my"), F.var_pop(xd).alias("vx"), F.covar_pop(xd, yd).alias("cxy"), F.var_pop(yd).alias("vy"))
    slope = F.when(F.col("vx") > 0, F.col("cxy") / F.col("vx"))
    return sums.select(group, "n", (F.col("my") - slope * F.col("mx")).alias("intercept"), slope.alias("slope"), (F.col("n") * (F.col("vy") - slope * F.col("cxy"))).alias("rss"))


def one_way(df: DataFrame, y: str, group: str) -> DataFrame:
    """Between and within mean squares, variance components by moments and the intraclass correlation, as one row."""
    yd = F.col(y).cast("double")
    levels = df.where(yd.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").cast("double").alias("n"), F.sum(yd).alias("s"), F.sum(yd * yd).alias("ss"))
    t = levels.agg(F.sum("n").alias("n"), F.count("*").cast("double").alias("k"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("ss") - F.col("b")) / (F.col("n") - F.col("k"))
    n0 = (F.col("n") - F.col("n2") / F.col("n")) / (F.col("k") - 1)
    t = t.select(between.alias("ms_between"), within.alias("ms_within"), ((between - within) / n0).alias("var_group"))
    return t.withColumn("icc", F.col("var_group") / (F.col("var_group") + F.col("ms_within")))


def fold_of(key: Column, folds: int, seed: int = 0) -> Column:
    """A fold from 0 by a hash of the key: the same wherever and whenever it is computed, with no shuffle of rows."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int")


def is_nested(df: DataFrame, inner: str, outer: str) -> bool:
    """Whether every level of ``inner`` occurs within one level of ``outer``."""
    return not df.select(inner, outer).distinct().groupBy(inner).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()


def extend(df: DataFrame, along: str, times: int) -> DataFrame:
    """The rows ``times`` over, with new levels of ``along`` each time; the first copy keeps its own."""
    copies = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("__copy"))
    renamed = F.when(F.col("__copy") == 0, F.col(along).cast("string")).otherwise(F.concat_ws("_", F.col(along).cast("string"), F.col("__copy").cast("string")))
    return copies.withColumn(along, renamed).drop("__copy")


def weighted_metrics(df: DataFrame, y: str, fit: str, w: str | None = None) -> DataFrame:
    """mse, rmse, mae and r2 of predictions, as one row."""
    weight, gap = F.col(w) if w else F.lit(1.0), F.col(y) - F.col(fit)
    s = df.agg(F.sum(weight).alias("w"), F.sum(weight * gap * gap).alias("se"), F.sum(weight * F.abs(gap)).alias("ae"), F.sum(weight * F.col(y)).alias("wy"), F.sum(weight * F.col(y) * F.col(y)).alias("wyy"))
    return s.select((F.col("se") / F.col("w")).alias("mse"), F.sqrt(F.col("se") / F.col("w")).alias("rmse"), (F.col("ae") / F.col("w")).alias("mae"), (1 - F.col("se") / (F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w"))).alias("r2"))
