"""Line deduplication: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import SPACE, checked, lower_ascii, row_key, save


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop, from every document, the lines whose key occurs in at least ``min_docs`` documents.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased; keys of fewer than ``min_chars``
    code points never drop. Returns the input columns, with the text replaced, plus ``n_lines`` and ``n_dropped``.

    Null and empty texts are one empty line. Rows with the same id count as one document, as do all rows with a null id.
    Repeated rows get equal results. Columns named n_lines or n_dropped in the input are replaced. Two 128-bit hashes
    stand for lines and rows. One pass over the texts makes hash rows (about 40 bytes a line), one reassembles.
    """
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    key = F.btrim(lower_ascii(F.col("line")), F.lit(SPACE))
    exploded = docs.select(F.struct(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.posexplode(lines).alias("pos", "line"))
    hashed = save(
        exploded.withColumn("key", key).where(F.char_length("key") >= min_chars)
        .select("id", "k1", "k2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")),
        "lines",
    )
    # count(DISTINCT) is planned with map-side merging on (hash, id), so a line of every document stays spread out
    frequent = save(hashed.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"), "frequent")
    drops = hashed.join(checked(frequent), ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set("pos").alias("drop"))
    rest = docs.drop("n_lines", "n_dropped")
    joined = rest.withColumns({"__k1": k1, "__k2": k2}).join(drops.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("drop").alias("__drop")), ["__k1", "__k2"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("long"), text_col: text}
    return joined.select(*[F.col(f"`{c}`") if c != text_col else text.alias(text_col) for c in rest.columns], out["n_lines"].alias("n_lines"), out["n_dropped"].alias("n_dropped"))
