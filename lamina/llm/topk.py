"""Exact top-k search by inner product: a ball tree per shard, searched best bound first.

Vectors are dealt to bounded shards; each becomes one row that holds its tree. Queries form bounded blocks, and a block is
broadcast to one pass over all shards, so no shard ever moves: a task goes through its shards one after another and keeps
the k best of every query. All nodes' upper bounds q.c + |q| r are known from one product; a leaf is as good as the
worst bound on its path, leaves are visited from the best bound down, and a query stops where the bound falls below its
current kth score. That score is shared: from shard to shard within a task, and from a first pass over one bounded pilot
shard to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import parts_for, save, small_batches

SHARD_ROWS, LEAF_ROWS = 4096, 128
#: Bytes of query vectors broadcast for one pass over the shards.
BLOCK_BYTES = 8 << 20
FOUND = "query_id long, query_key long, vec_id long, score long"
EXACT = float(1 << 52)  # doubles hold integers exactly below this


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in the narrowest type that holds them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


class BallTree:
    """A balanced binary tree of balls over integer vectors: nodes in heap order, leaves of about LEAF_ROWS rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf_rows))))
        order, wide = np.arange(len(ids)), vectors.astype(np.float64)
        centres, radii = [], []
        for level in range(self.depth + 1):
            for a, b in self.spans(len(ids), level):
                part = order[a:b]
                centre = wide[part].mean(0) if b > a else np.zeros(wide.shape[1])
                away = wide[part] - centre
                square = (away**2).sum(1)
                centres.append(centre)
                radii.append(np.sqrt(square.max()) if b > a else -np.inf)
                if level < self.depth and b - a > 1:  # split along the direction of the farthest row
                    order[a:b] = part[np.argsort(away @ away[np.argmax(square)], kind="stable")]
        self.ids, self.vectors, self.centres, self.radii = ids[order], vectors[order], np.array(centres), np.array(radii)

    @staticmethod
    def spans(rows: int, level: int) -> list[tuple[int, int]]:
        """The rows of a level's nodes: halves of halves."""
        found = [(0, rows)]
        for _ in range(level):
            found = [x for a, b in found for x in ((a, a + (b - a) // 2), (a + (b - a) // 2, b))]
        return found

    def pack(self) -> tuple[int, bytes, bytes, int, bytes, bytes]:
        data = _narrow(self.vectors)
        return self.depth, self.ids.astype("<i8").tobytes(), data.tobytes(), data.dtype.itemsize, self.centres.tobytes(), self.radii.tobytes()

    @classmethod
    def unpack(cls, depth: int, ids: bytes, data: bytes, width: int, centres: bytes, radii: bytes) -> BallTree:
        tree = cls.__new__(cls)
        tree.depth, tree.ids, tree.radii = depth, np.frombuffer(ids, "<i8"), np.frombuffer(radii)
        tree.vectors = np.frombuffer(data, f"<i{width}").reshape(len(tree.ids), -1)
        tree.centres = np.frombuffer(centres).reshape(len(tree.radii), -1)
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For every query and leaf the least upper bound of the leaf and the nodes above it."""
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))[:, None]
        inner = queries.astype(np.float64) @ self.centres.T
        every = inner + norms * self.radii
        every += 1e-9 * (np.abs(every) + norms * np.abs(self.centres).sum(1)) + 1e-6  # rounding never prunes
        found = every[:, :1]
        for level in range(1, self.depth + 1):
            own = every[:, (1 << level) - 1 : (2 << level) - 1]
            found = np.minimum(own, np.repeat(found, 2, 1))
        return found

    def search(self, best: Best) -> None:
        """Bring the k best of every query up to date with this tree's rows."""
        bounds, kth = self.bounds(best.queries), best.kth()
        order = np.argsort(-bounds, 1, kind="stable")
        ranked = np.take_along_axis(bounds, order, 1)
        exact = best.largest * float(np.abs(self.vectors).max(initial=0)) * best.queries.shape[1] < EXACT
        wide = self.vectors.astype(np.float64 if exact else np.int64)
        asked = best.queries.astype(wide.dtype)
        leaves = self.spans(len(self.ids), self.depth)
        for turn in range(len(leaves)):
            live = np.flatnonzero(ranked[:, turn] >= kth)
            if not len(live):  # all further bounds are lower
                break
            live = live[np.argsort(order[live, turn], kind="stable")]
            names, starts = np.unique(order[live, turn], return_index=True)
            for leaf, rows in zip(names, np.split(live, starts[1:]), strict=True):
                a, b = leaves[leaf]
                if b > a:
                    best.offer(rows, self.ids[a:b], (asked[rows] @ wide[a:b].T).astype(np.int64))
                    kth[rows] = best.kth(rows)


class Best:
    """The k best (score, id) of a block of queries so far; ties go to the smaller id, and a query never finds its own."""

    LOWEST = np.iinfo(np.int64).min

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.own, self.queries, self.floor = ids, queries, floor
        self.largest = float(np.abs(queries).max(initial=0))
        self.scores = np.full((len(ids), k), self.LOWEST)
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max)

    def kth(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        last = self.scores[rows, -1].astype(np.float64)
        return np.maximum(np.where(self.scores[rows, -1] == self.LOWEST, -np.inf, last), self.floor[rows])

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        k = self.scores.shape[1]
        scores = np.where(ids[None, :] == self.own[rows][:, None], self.LOWEST, scores)
        if scores.shape[1] > 4 * k:  # those below the kth best of the leaf can't be among the k best
            cut = np.partition(scores, -k, 1)[:, -k]
            width = int((scores >= cut[:, None]).sum(1).max())
            some = np.argpartition(scores, -width, 1)[:, -width:]
            scores, ids = np.take_along_axis(scores, some, 1), ids[some]
        all_scores = np.concatenate([self.scores[rows], scores], 1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], 1)
        top = np.lexsort((all_ids, -all_scores.astype(np.float64) if np.abs(all_scores[all_scores != self.LOWEST]).max(initial=0) < EXACT else _descending(all_scores)), 1)[:, :k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero((self.scores != self.LOWEST) & (self.scores >= self.floor[:, None]))
        return row, self.ids[row, col], self.scores[row, col]


def _descending(scores: np.ndarray) -> np.ndarray:
    """An ascending key for integers in descending order, exact at any size."""
    return ~scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row of ``queries`` its k best rows of ``vectors`` by the integer inner product of floor(scale * x).

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id and a row never finds its own id. Vectors
    that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id; vectors meet
    only those of the same length. Repeated ids are separate candidates; equal query rows are asked once, those with one id and
    different vectors separately. Fewer than k rows give all there are. Other columns play no part. Shards hold a bounded
    number of rows dealt by a hash of id and vector, equal rows having been counted before, so the number of shards, not
    their size, grows. Scores must fit in 64 bits. The shards are read once for every block of queries.
    """
    def clean(df: DataFrame) -> DataFrame:
        x = F.col(vector_col).cast("array<double>")
        good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
        return df.where(good).select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))

    def trees(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key").loc[lambda r: r.index.repeat(r["copies"])]
        tree = BallTree(rows["id"].to_numpy(np.int64), np.stack(rows["v"].to_list()).astype(np.int64)).pack()
        return pd.DataFrame([(rows["shard"].iloc[0], rows["dim"].iloc[0], *tree)], columns=["shard", "dim", "depth", "ids", "data", "width", "centres", "radii"])

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "key"])
        return pd.DataFrame([(rows["block"].iloc[0], rows["dim"].iloc[0], rows["id"].to_numpy(np.int64).tobytes(), rows["key"].to_numpy(np.int64).tobytes(), np.stack(rows["v"].to_list()).astype(np.int64).tobytes())], columns=["block", "dim", "ids", "keys", "data"])

    spark = vectors.sparkSession
    small_batches(spark)  # a row is a packed shard
    # at most k copies of a row can be among the k best
    rows = clean(vectors).groupBy("id", "dim", "v").agg(F.least(F.count("*"), F.lit(k)).alias("copies")).withColumn("key", F.xxhash64("id", "v"))
    number = parts_for(vectors.count(), shard_rows)
    dealt = rows.withColumn("shard", F.pmod("key", F.lit(number)))
    shards = save(dealt.groupBy("shard", "dim").applyInPandas(trees, "shard long, dim int, depth int, ids binary, data binary, width int, centres binary, radii binary"), "shards", "lz4")
    asked = clean(queries).withColumn("key", F.xxhash64("id", "v")).distinct()
    blocks = parts_for(asked.agg(F.sum(F.col("dim") * 8)).first()[0] or 0, block_bytes)
    asked = save(asked.withColumn("block", F.pmod("key", F.lit(blocks))).groupBy("block", "dim").applyInPandas(packed, "block long, dim int, ids binary, keys binary, data binary"), "queries", "lz4")

    def search(some: DataFrame, block: dict) -> DataFrame:
        """The k best of a block's queries ({dim: (ids, keys, vectors, floors)}) in each partition of the shards."""
        shared = spark.sparkContext.broadcast(block)
        sent.append(shared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {dim: (keys, Best(ids, data, k, floor)) for dim, (ids, keys, data, floor) in shared.value.items()}
            for batch in batches:
                for r in batch.to_pylist():
                    if r["dim"] in found:
                        BallTree.unpack(*(r[c] for c in ("depth", "ids", "data", "width", "centres", "radii"))).search(found[r["dim"]][1])
            for keys, best in found.values():
                row, vec, score = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(best.own[row]), pa.array(keys[row]), pa.array(vec), pa.array(score)], ["query_id", "query_key", "vec_id", "score"])

        return some.mapInArrow(run, FOUND)

    best_first = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    results, sent = [], []
    for block in range(blocks):
        held = {}
        for r in asked.where(F.col("block") == block).collect():  # block_bytes, by the number of blocks
            ids, keys = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["keys"], np.int64)
            held[r["dim"]] = (ids, keys, np.frombuffer(r["data"], np.int64).reshape(len(ids), -1), np.full(len(ids), -np.inf))
        if not held:
            continue
        if number > 1:  # the kth scores in the pilot shard are floors for all
            pilot = search(shards.where("shard = 0"), held).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") == k)
            floors = {(r["query_id"], r["query_key"]): r["score"] for r in pilot.collect()}
            for dim, (ids, keys, data, _) in held.items():
                held[dim] = (ids, keys, data, np.array([floors.get(x, -np.inf) for x in zip(ids.tolist(), keys.tolist(), strict=True)], np.float64))
        results.append(save(search(shards, held), "found"))
        while sent:
            sent.pop().unpersist()
    found = results[0] if results else spark.createDataFrame([], FOUND)
    for more in results[1:]:
        found = found.union(more)
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
