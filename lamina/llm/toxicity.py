"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its byte n-grams (3 to 6, with word borders) and of itself, all hashed to buckets; a
text is the mean of its distinct words and of PAD words without a vector, so that no short text hangs on a few words. Embeddings and softmax are trained together. As the softmax is linear in the text's mean,
scoring needs one number a bucket, and words, which repeat, are scored once per process.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import save, small_batches, trim

BUCKET_BITS, SIZES, PAD = 20, (3, 4, 5, 6), 30
#: Words scored or hashed once and kept per process before the cache starts afresh.
CACHE_WORDS = 500_000
_PRIME, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> set[bytes]:
    """The distinct words, A-Z lower-cased, between ASCII white space."""
    return set((text or "").encode("utf-8", "replace").lower().split())


def subwords(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams, and the place of each one's word. Every word has at least one."""
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in some), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in some), np.int64, len(some))
    owner = np.repeat(np.arange(len(some)), sizes)
    buckets, owners = [], []
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, SIZES[-1] + 1):
        h = h[: len(raw) - n + 1] * _PRIME + raw[n - 1 :] + np.uint64(1) if n > 1 else raw + np.uint64(1)
        if n in SIZES and len(h):
            inside = owner[: len(h)] == owner[n - 1 :]
            buckets.append((((h + np.uint64(n)) * _SPREAD) >> np.uint64(64 - BUCKET_BITS))[inside].astype(np.int32))
            owners.append(owner[: len(h)][inside])
    # the whole word: a sum over its bytes, each weighted by its place
    place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.add.reduceat((raw + np.uint64(7)) * _SPREAD * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _PRIME), np.cumsum(sizes) - sizes) if len(some) else np.zeros(0, np.uint64)
    buckets.append(((whole * _SPREAD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    owners.append(np.arange(len(some)))
    return np.concatenate(buckets), np.concatenate(owners)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their weights; empty for a text without words."""
    found = sorted(words(text))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, owner = subwords(found)
    used, at = np.unique(buckets, return_inverse=True)
    return used.astype(np.int32), np.bincount(at, (1 / np.bincount(owner))[owner] / (len(found) + PAD)).astype(np.float32)


@dataclass
class ToxicityModel:
    """``table[bucket]`` is the bucket's share of the difference of the two classes' logits."""

    table: np.ndarray
    bias: float
    constant: float | None = None  # the score of every text, where there was nothing to tell the classes apart by
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"table": self.table, "bias": self.bias, "constant": self.constant, "_known": {}}

    def score(self, texts: list) -> np.ndarray:
        split = [words(t) for t in texts]
        new = {x for x in set().union(*split) if x not in self._known}
        if len(self._known) + len(new) > CACHE_WORDS:
            self._known.clear()
            new = set().union(*split)
        some = list(new)
        for at in range(0, len(some), 50_000):
            part = some[at : at + 50_000]
            buckets, owner = subwords(part)
            self._known.update(zip(part, (np.bincount(owner, self.table[buckets]) / np.bincount(owner)).tolist(), strict=True))
        get = self._known.__getitem__
        means = np.array([math.fsum(map(get, w)) / (len(w) + PAD) for w in split])
        return np.full(len(texts), self.constant) if self.constant is not None else 1 / (1 + np.exp(-np.clip(means + self.bias, -500, 500)))


def fit(bags: list, labels: np.ndarray, dim: int = 4, epochs: int = 12, rate: float = 0.2, scale: float = 300.0, decay: float = 1e-4, min_texts: int = 3, seed: int = 7) -> ToxicityModel:
    """Train embeddings and softmax together by minibatches with per-bucket Adagrad steps. ``scale`` multiplies the mean,
    so that one toxic word among hundreds shows; buckets of fewer than ``min_texts`` texts are not learnt."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(1 << BUCKET_BITS, np.float32), 0.0, float((labels.sum() + 0.5) / (len(labels) + 1)))
    texts = np.zeros(1 << BUCKET_BITS, np.int32)
    for buckets, _ in bags:
        texts[buckets] += 1
    least = min(min_texts, len(labels) // 8 + 1)
    for i, (b, w) in enumerate(bags):  # in place: the driver holds one copy
        keep = texts[b] >= least
        bags[i] = (b[keep], w[keep].astype(np.float32))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (1 << BUCKET_BITS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (dim, 2)), np.log(np.bincount(labels, minlength=2) / len(labels))
    grown, grown_out, grown_bias = np.full(1 << BUCKET_BITS, 1e-3, np.float32), np.full((dim, 2), 1e-3), np.full(2, 1e-3)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(labels))
        for rows in np.array_split(order, max(1, len(order) // 32)):
            sizes = np.array([len(bags[i][0]) for i in rows])
            buckets = np.concatenate([bags[i][0] for i in rows])
            weight = np.concatenate([bags[i][1] for i in rows]) * scale
            owner = np.repeat(np.arange(len(rows)), sizes)
            used, at = np.unique(buckets, return_inverse=True)
            vectors = table[used]
            hidden = np.stack([np.bincount(owner, weight * vectors[at, d], minlength=len(rows)) for d in range(dim)], 1)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            back = p @ out.T
            grad = np.stack([np.bincount(at, weight * back[owner, d]) for d in range(dim)], 1) + decay * vectors / len(rows)
            grad_out, grad_bias = hidden.T @ p + decay * out, p.sum(0)
            grown[used] += (grad**2).mean(1)
            table[used] -= (step * grad / np.sqrt(grown[used])[:, None]).astype(np.float32)
            grown_out += grad_out**2
            out -= step * grad_out / np.sqrt(grown_out)
            grown_bias += grad_bias**2
            bias = bias - step * grad_bias / np.sqrt(grown_bias)
    table[texts < least] = 0
    return ToxicityModel((scale * (table @ (out[:, 1] - out[:, 0]))).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = 1500, negatives: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on a bounded sample: of the labelled ids for which ``learn`` (a column of the id) holds, the ``positives``
    and ``negatives`` first by a hash of the id, with whole texts. Ids without a label or with a null one are left
    out; an id with several labels has the largest. Only the sample's bags reach the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y")).where(learn)
    picked = [known.where(F.col("y") > 0).orderBy(F.xxhash64(id_col), id_col).limit(positives), known.where(F.col("y") <= 0).orderBy(F.xxhash64(id_col), id_col).limit(negatives)]
    sample = save(picked[0].union(picked[1]).select(F.col(id_col).alias("__id"), F.col("y").cast("int").alias("__y")), "sample")
    small_batches(docs.sparkSession)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array([x[1].astype(np.float16).tobytes() for x in found], pa.binary())], ["id", "y", "buckets", "weights"])

    rows = docs.join(F.broadcast(sample), docs[id_col] == sample["__id"]).select(F.xxhash64("__id").alias("id"), text_col, "__y").mapInArrow(bags, "id long, y int, buckets binary, weights binary")
    found = []
    for r in save(rows, "bags").toLocalIterator():  # a partition at a time
        found.append((r["id"], r["y"], np.frombuffer(bytes(r["buckets"]), np.int32), np.frombuffer(bytes(r["weights"]), np.float16)))
    found.sort(key=lambda x: (x[0], x[1], x[2].tobytes()[:64]))
    known_labels = np.array([x[1] for x in found], np.int64)
    sample_bags = [x[2:] for x in found]
    del found
    model = fit(sample_bags, known_labels)
    del sample_bags
    trim()
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The input with a column ``score`` (0 to 1); an input column of that name is replaced. Null and blank texts have
    the score that the bias gives; very long texts are read whole."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()))
        trim()

    return docs.withColumn("score", scored(F.col(text_col)))
