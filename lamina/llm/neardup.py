"""Near-duplicate documents by bottom-k sketches of one hash function.

Equal shingle sets are one class from the start. A class keeps the k smallest hashes of its set (the whole set, if that
is little more). Inverted lists are kept for runs of three neighbouring retained values: classes with a Jaccard
similarity of 0.8 share about half of those runs, and sets kept whole share at least 0.4 of them. So many may be
missing from each class that its most frequent runs can be left out (a prefix filter), which empties the lists of common
word pairs. Every list names its best connected class, and the distinct (named, member) entries are tested: the union
sketch estimates, exact Jaccard on full sets verifies. What is still in different components is then tested against
each other within the named class's neighbourhood, in blocks; distances to the named class rule out most of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import checked, empty, save, small_batches, trim
from lamina.llm.components import components
from lamina.llm.shingles import forget, mix, shingle_set

KEEP, WHOLE, RUN = 64, 80, 3
BLOCK = 128
BANDS = 10  # of the distance to the named class; the last also holds what the estimate left untested


def sketch(values: np.ndarray) -> np.ndarray:
    """The smallest KEEP hashes, or all of a set of at most WHOLE; hashes are uniform, so this is a uniform sample."""
    return values if len(values) <= WHOLE else values[:KEEP]


def list_keys(kept: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of RUN neighbouring values, cyclic in a whole set."""
    around = np.append(kept, np.resize(kept, RUN - 1)) if size <= WHOLE else kept
    keys = around[: len(around) - RUN + 1]
    for i in range(1, RUN):
        keys = mix(keys, around[i : len(around) - RUN + 1 + i])
    return np.unique(keys)


def spare_keys(size: Column) -> Column:
    """How many runs a class may leave out: one less than two linked classes share. Up to KEEP shingles that is certain; beyond,
    the least of 28,000 simulated pairs at exactly 0.8 shared 11 runs, and 5 are enough."""
    return F.when(size <= KEEP, size - F.floor(size * 3 / 5) - 1).otherwise(4)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity by the KEEP smallest values of the union."""
    union = np.union1d(a[:KEEP], b[:KEEP])[:KEEP]
    return np.isin(union, np.intersect1d(a[:KEEP], b[:KEEP], assume_unique=True), assume_unique=True).sum() / max(1, len(union))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections of two bounded blocks of sets, a bounded number of values at a time."""
    sizes_l, sizes_r = [len(x) for x in left], [len(x) for x in right]
    values, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.concatenate([np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)])
    on_left = np.arange(len(at)) < sum(sizes_l)
    both = np.zeros(len(values), bool)
    both[at[on_left]] = True
    only = np.zeros(len(values), bool)
    only[at[~on_left]] = True
    both &= only
    column = np.where(both, np.cumsum(both) - 1, -1)[at]
    out, width = np.zeros((len(left), len(right))), 8192
    order = np.argsort(column, kind="stable")
    column, row, on_left = column[order], row[order], on_left[order]
    for c in range(0, int(both.sum()), width):
        lo, hi = np.searchsorted(column, [c, c + width])
        some, r, is_left = column[lo:hi] - c, row[lo:hi], on_left[lo:hi]
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        a[r[is_left], some[is_left]] = 1
        b[r[~is_left], some[~is_left]] = 1
        out += a @ b.T
    return out.astype(np.int64)


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def _star(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The members of a part of a named class's entries against it: distance band, and whether they link."""
    rep, member = rows["rep"].iloc[0], rows["cls"] != rows["rep"]
    center, others = np.frombuffer(rows.loc[~member, "data"].iloc[0], np.uint64), rows[member]
    sets = _sets(others["data"])
    likely = np.array([estimate(center, x) >= 0.25 for x in sets], bool)
    band, linked = np.full(len(sets), BANDS), np.zeros(len(sets), bool)
    for i in np.flatnonzero(likely):
        common = len(np.intersect1d(center, sets[i], assume_unique=True))
        union = len(center) + len(sets[i]) - common
        band[i], linked[i] = min(BANDS, (union - common) * BANDS // union), 100 * common >= percent * union
    return pd.DataFrame({"rep": rep, "cls": others["cls"].to_numpy(), "n": [len(x) for x in sets], "band": band, "linked": linked})


def _block(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between different components of two blocks of a neighbourhood."""
    left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    common = intersections(_sets(left["data"]), _sets(right["data"]))
    union = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :] - common
    i, j = np.nonzero((100 * common >= percent * union) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]))
    return pd.DataFrame({"a": left["cls"].to_numpy()[i], "b": right["cls"].to_numpy()[j]})


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link if 100 * |A and B| >= percent * |A or B| for their sets of ``shingle``-word shingles (percent is 80
    or more); fewer words are one shingle. component_id is the smallest id reachable by links, and kept says whether it
    is the document's own. Null and blank texts have no shingles and link with nothing. Rows that repeat an id or a
    text are linked if their sets are equal; rows with a null id have a null component and are kept. Very long texts
    are read whole. Other columns play no part. An empty table gives an empty result. Sets are known by 64-bit hashes
    of shingles and of sets.
    """
    if percent < 80:
        raise ValueError("the lists are laid out for similarities of 80 percent or more")
    small_batches(docs.sparkSession)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], ["doc_id", "n", "cls", "sketch"])
        forget()
        trim()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = save(texts.mapInArrow(sketches, "doc_id long, n long, cls long, sketch binary"), "sketches", "lz4")
    named = known.where(F.col("doc_id").isNotNull() & F.col("cls").isNotNull())
    classes = save(named.groupBy("cls").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes", "lz4")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list_keys(np.frombuffer(s, np.uint64), n) for n, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat)], ["cls", "n", "keys"])

    postings = classes.select("cls", "n", "sketch").mapInArrow(keys, "cls long, n long, keys array<long>").select("cls", "n", F.explode("keys").alias("key"))
    shared = save(postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    listed = postings.join(checked(shared), "key")
    hottest = F.row_number().over(Window.partitionBy("cls").orderBy(F.col("size").desc(), "key"))
    listed = save(listed.withColumn("at", hottest).where(F.col("at") > spare_keys(F.col("n"))).select("cls", "n", "key"), "listed")
    support = save(listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "support")
    weighed = save(listed.join(checked(support), "key"), "weighed")
    weight = weighed.groupBy("cls").agg(F.sum("size").alias("weight"))
    best = save(weighed.join(weight, "cls").groupBy("key").agg(F.max(F.struct("weight", "cls"))["cls"].alias("rep")), "best")
    entries = save(weighed.join(best, "key").where("cls <> rep").select("rep", "cls").distinct(), "entries")

    needed = save(entries.select("cls").union(entries.select("rep")).distinct().join(classes.select("cls", "doc"), "cls"), "needed")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c, shingle_set(t, shingle).tobytes()) for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s if xxhash.xxh3_64_intdigest(s) - (1 << 63) == c else None for c, s in found], pa.binary())], ["cls", "data"])
        forget()
        trim()

    read = texts.join(checked(needed), texts["doc_id"] == needed["doc"]).select("cls", "text")
    sets = save(read.mapInArrow(full, "cls long, data binary").where(F.col("data").isNotNull()).groupBy("cls").agg(F.first("data").alias("data")), "sets", "lz4")

    # named classes with their entries, in parts: a part has at most about BLOCK members and a copy of the named class
    parts = save(entries.groupBy("rep").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "parts")
    dealt = entries.join(parts, "rep").select("rep", F.pmod(F.xxhash64("cls"), "parts").alias("part"), "cls")
    centers = parts.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("rep").alias("cls"))
    tested = dealt.union(centers).join(sets, "cls").groupBy("rep", "part").applyInPandas(lambda r: _star(r, percent), "rep long, cls long, n long, band int, linked boolean")
    star = save(tested, "star")
    links = save(star.where("linked").select(F.col("rep").alias("a"), F.col("cls").alias("b")), "links")
    labels = components(links)

    # what the first links left apart, within each neighbourhood: blocks of a band against those of bands that may link
    at = star.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("rep", "cls", "n", "band", F.coalesce("component", "cls").alias("component"))
    at = save(at, "neighbourhoods")
    apart = at.groupBy("rep").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("rep")
    left_over = save(at.join(apart, "rep", "left_semi"), "apart")
    counts = left_over.groupBy("rep", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocked = save(left_over.join(counts, ["rep", "band"]).withColumn("block", F.pmod(F.xxhash64("cls"), "blocks")), "blocked")
    numbers = blocked.select("rep", "band", "block").distinct()
    other = numbers.select(F.col("rep").alias("rep2"), F.col("band").alias("band2"), F.col("block").alias("block2"))
    # a difference of distances is at most the distance; a band spans a tenth, the last everything from a half
    reach = F.when(F.col("band2") == BANDS, F.col("band") >= 3).otherwise(F.col("band2") - F.col("band") <= 2)
    ordered = (F.col("band") < F.col("band2")) | ((F.col("band") == F.col("band2")) & (F.col("block") <= F.col("block2")))
    pairs = save(numbers.join(other, (F.col("rep") == F.col("rep2")) & ordered & reach).drop("rep2"), "pairs")
    sides = [blocked.join(pairs, ["rep", "band", "block"]).select("rep", "band", "block", "band2", "block2", F.lit(0).alias("side"), "cls", "n", "component"),
             blocked.withColumnsRenamed({"band": "band2", "block": "block2"}).join(pairs, ["rep", "band2", "block2"]).select("rep", "band", "block", "band2", "block2", F.lit(1).alias("side"), "cls", "n", "component")]
    late = sides[0].union(sides[1]).join(sets, "cls").groupBy("rep", "band", "block", "band2", "block2").applyInPandas(lambda r: _block(r, percent), "a long, b long")
    late = save(late.distinct(), "late")
    if not empty(late):
        labels = components(links.union(late))

    smallest = classes.select("cls", "doc").join(labels, F.col("cls") == F.col("node")).select("cls", "component", "doc")
    smallest = save(smallest, "members")
    tops = save(smallest.groupBy("component").agg(F.min("doc").alias("top")), "tops")
    linked = smallest.join(tops, "component").select("cls", "top")
    of_class = save(classes.select("cls", "doc").join(linked, "cls", "left").select("cls", F.coalesce("top", "doc").alias("component_id")), "of")
    out = known.select("doc_id", "n", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))
