"""Cross-products of a stream: they are sums, so a streaming aggregation keeps them up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_gram(stream: DataFrame, y: str, x: list[str], group: str, time: str | None = None, late: str = "10 minutes", window: str | None = None) -> DataFrame:
    """n, sums and products of (1, x, y) for every group, and for every time window if one is given. With a window the
    state is bounded by the watermark; without one it grows with the number of groups."""
    keys = [F.col(group).cast("string").alias("level")]
    if time and window:
        stream, keys = stream.withWatermark(time, late), [F.window(time, window).alias("window"), *keys]
    cols = {"1": F.lit(1.0), **{c: F.col(c).cast("double") for c in x}, y: F.col(y).cast("double")}
    names = list(cols)
    aggs = [F.sum(cols[a] * cols[b]).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)
