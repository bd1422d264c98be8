"""Language-model scoring with a weighted backoff automaton.

Counting and scoring go block by block. A block is a bounded run of documents with its own numbering of words; it asks
for the corpus counts of just the n-grams that occur in it. Requests are dealt by ranges of the n-grams' hashes to
shards, which add up counts over all blocks and answer each block. From the answers a block builds its part of the
automaton (states, arcs with targets, failure arcs) and traverses its documents from left to right, a state carried along
each. Nothing that grows with the corpus is broadcast or meets in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import parts_for, save, small_batches, trim

BLOCK_TOKENS, SHARD_BYTES = 1_500_000, 24 << 20
#: Tokens that a lane of the traversal scores.
SEGMENT = 192
END, BEGIN = b" ", b"  "  # no word holds a space
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _zip(x: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    head = np.array([x.dtype.itemsize], "u1").tobytes()
    return head + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.view("u1").reshape(-1, x.dtype.itemsize).T).tobytes())


def _unzip(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), "u1").reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{data[0]}").astype(kind)


def _small(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).astype(f"<u{np.min_scalar_type(int(x.max(initial=0))).itemsize}")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * _MIX[0] + b
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


class Grams:
    """The distinct n-grams of a block. Level k has, for every token, the n-gram of length k that ends there (-1 where
    the document is too short for one), and for every n-gram its history on level k - 1, its last word and its key."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, order: int) -> None:
        n_words = len(hashes)  # the last two are the end and the beginning
        starts = np.cumsum(lengths) - lengths
        where = np.arange(len(words)) - np.repeat(starts, lengths)
        self.at, self.history, self.word = [words], [np.zeros(n_words, np.int64)], [np.arange(n_words)]
        self.keys = [hashes]
        for k in range(2, order + 1):
            before = np.append(np.int64(-1), self.at[-1][:-1].astype(np.int64))
            before[starts] = n_words - 1 if k == 2 else -1
            ok = where >= k - 2
            codes = np.where(ok, before * n_words + words, -1)
            distinct, at = np.unique(codes, return_inverse=True)
            none = int(len(distinct) > 0 and distinct[0] < 0)
            distinct = distinct[none:]
            self.at.append((at.reshape(-1) - none).astype(np.int32))
            self.history.append(distinct // n_words)
            self.word.append(distinct % n_words)
            self.keys.append(_mix(self.keys[-1][self.history[-1]], hashes[self.word[-1]]))

    def counts(self, level: int, trained: np.ndarray) -> np.ndarray:
        at = self.at[level][trained]
        return np.bincount(at[at >= 0], minlength=len(self.keys[level]))

    def requests(self, level: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of a level's keys, and where each shard, which is a range of keys, begins in it."""
        keys = self.keys[level]
        order = np.argsort(keys, kind="stable")
        shard = ((keys[order] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        return order, np.searchsorted(shard, np.arange(shards + 1))

    def shorter(self, level: int) -> np.ndarray:
        """For each n-gram of a level the one without its first word, found at any place where the longer one ends."""
        out = np.zeros(len(self.keys[level]), np.int64)
        has = self.at[level] >= 0
        out[self.at[level][has]] = self.at[level - 1][has]
        return out


class BackoffAutomaton:
    """A deterministic automaton over a block's words. The states are the root (0) and the histories of up to order - 1
    words that training holds. Of a state's arcs, sorted by (state, word), each carries the log10 probability of its word
    and leads to the state of the longest history after it. Each other state has a weighted failure arc to the state of
    its history without the first word, taken if it has no arc for a word. The root has an arc for every word.

    Smoothing, from the root up: p1(w) = (c(w) + 1) / (N + V + 1), pk(w | h) = (c(hw) + b p(k-1)(w | h')) / (c(h) + b),
    so a failure arc weighs b / (c(h) + b) and all words of a state, with the unseen ones through failure, sum to one.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, vocabulary: int, strength: float) -> None:
        order, self.words = len(counts), len(counts[0])
        first = np.cumsum([0, 1, *map(len, counts[:-1])])  # the number of a level's first state; the root is level 0
        p = (counts[0] + 1.0) / (total + vocabulary + 1.0)
        self.fail_to, self.fail_weight = np.zeros(first[-1], np.int64), np.zeros(first[-1])
        codes, weights, targets = [], [], []
        for k in range(order):
            shorter = grams.shorter(k) if k else np.zeros(len(p), np.int64)
            if k:
                history = counts[k - 1][grams.history[k]]
                p = (counts[k] + strength * p[shorter]) / (history + strength)
            seen = np.flatnonzero(counts[k] > 0) if k else np.arange(len(p))
            codes.append((first[k] + grams.history[k][seen]) * self.words + grams.word[k][seen])
            weights.append(np.log10(p[seen]))
            if k + 1 < order:  # these n-grams are states too; words that training doesn't hold lead to the root
                states = slice(first[k + 1], first[k + 1] + len(counts[k]))
                self.fail_to[states] = first[k] + shorter
                self.fail_weight[states] = np.log10(strength / (counts[k] + strength))
                targets.append(np.where(counts[k][seen] > 0, first[k + 1] + seen, 0))
            else:
                targets.append(first[k] + shorter[seen] if k else np.zeros(len(seen), np.int64))
        self.codes, self.weights, self.targets = (np.concatenate(x) for x in (codes, weights, targets))
        self.begin = int(first[1] + self.words - 1) if order > 1 and counts[0][-1] > 0 else 0
        self.root = weights[0]
        self.history = order - 1

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading a word each, and the log10 probabilities of the words."""
        states, added, waiting = states.copy(), np.zeros(len(states)), np.arange(len(states))
        while len(waiting):
            code = states[waiting] * self.words + words[waiting]
            arc = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            found = self.codes[arc] == code
            take, arc = waiting[found], arc[found]
            added[take] += self.weights[arc]
            states[take] = self.targets[arc]
            waiting = waiting[~found]
            added[waiting] += self.fail_weight[states[waiting]]
            states[waiting] = self.fail_to[states[waiting]]
        return states, added

    def traverse(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The log10 probability of every token, from left to right. Documents go side by side in lanes; a long one is cut
        into segments, whose states come from reading the few words before them (a state is no longer than those)."""
        cuts = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(lengths)), cuts)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = (np.cumsum(lengths) - lengths)[doc] + turn * SEGMENT
        size = np.minimum(SEGMENT, lengths[doc] - turn * SEGMENT)
        warm = np.where(turn > 0, self.history, 0)
        order = np.argsort(-(size + warm), kind="stable")
        begin, size, warm = begin[order], size[order], warm[order]
        states = np.where(warm > 0, 0, self.begin)
        out = np.zeros(len(words))
        steps = size + warm
        for t in range(int(steps.max(initial=0))):
            live = int(np.searchsorted(-steps, -t, side="left"))  # lanes with more than t steps come first
            at = begin[:live] - warm[:live] + t
            states[:live], added = self.step(states[:live], words[at].astype(np.int64))
            scored = t >= warm[:live]
            out[at[scored]] = added[scored]
        return out


def _pack(block_tokens: int):
    """Documents as bounded blocks: numbers of words, and what the words hash to."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0

        def close(vocabulary: dict, held: list, ids: list, words: list) -> pa.RecordBatch:
            lengths = np.array([len(x) for x in words], np.int64)
            flat = np.concatenate(words)
            words.clear()
            hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in [*vocabulary, END, BEGIN]], np.uint64)
            flat[flat < 0] = len(vocabulary)
            docs = b"".join(len(x).to_bytes(8, "little") + x for x in (np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], "u1").tobytes(), np.array(held, "u1").tobytes(), _zip(lengths.astype("<u8")), _zip(_small(flat)), hashes.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + seq]), pa.array([int(lengths[~np.array(held)].sum())]), pa.array([docs], pa.binary())], ["block", "n", "payload"])

        def fresh() -> tuple[dict, list, list, list]:
            vocabulary: defaultdict = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            return vocabulary, [], [], []

        vocabulary, held, ids, words = fresh()
        size = 0
        for batch in batches:
            for doc, text, out in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tokens = (text or "").encode("utf-8", "replace").lower().split()
                words.append(np.fromiter(chain(map(vocabulary.__getitem__, tokens), (-1,)), np.int32, len(tokens) + 1))
                held.append(bool(out))
                ids.append(doc)
                size += len(tokens) + 1
                if size >= block_tokens:
                    yield close(vocabulary, held, ids, words)
                    seq, size = seq + 1, 0
                    vocabulary, held, ids, words = fresh()
                    trim()
        if ids:
            yield close(vocabulary, held, ids, words)
            del vocabulary, held, ids, words
        trim()

    return pack


class _Block:
    """A packed block: its documents and their n-grams."""

    def __init__(self, data: bytes, order: int) -> None:
        parts, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            parts.append(data[at + 8 : at + 8 + n])
            at += 8 + n
        self.ids, self.has, self.held = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "u1").astype(bool), np.frombuffer(parts[2], "u1").astype(bool)
        self.lengths, self.words = _unzip(parts[3], "i8"), _unzip(parts[4], "i4")
        self.grams = Grams(self.words, self.lengths, np.frombuffer(parts[5], "<u8"), order)


def _ask(order: int, shards: int):
    """A block's requests: for each shard of each level the keys, in order, and how often they occur in training."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = _Block(data.as_py(), order)
                trained = np.repeat(~block.held, block.lengths)
                for level in range(order):
                    counts = block.grams.counts(level, trained)
                    if not level:
                        counts[-1] = int((~block.held).sum())  # beginnings
                    by, ends = block.grams.requests(level, shards)
                    keys, counts = block.grams.keys[level][by], counts[by]
                    cut = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                    columns = [pa.array([level * shards + s for s in range(shards)], pa.int64()), pa.array([number] * shards, pa.int64()), pa.array([_zip(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cut], pa.binary()), pa.array([_zip(_small(counts[a:b])) for a, b in cut], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "payload", "counts"])
                del block
                trim()

    return ask


def _answer(rows: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The corpus counts of a shard's keys, for each block in the order it asked in; and how many keys are words."""
    keys = [np.cumsum(_unzip(x, "u8")) for x in rows["payload"]]
    sizes = np.cumsum([0, *map(len, keys)])
    flat = np.concatenate(keys)
    counts = np.concatenate([_unzip(x, "i8") for x in rows["counts"]])
    distinct, at = np.unique(flat, return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, at, counts)
    words = int(((totals > 0) & (distinct != np.uint64(xxhash.xxh3_64_intdigest(BEGIN)))).sum()) if rows["shard"].iloc[0] < shards else 0
    mine = totals[at]
    return pd.DataFrame({"block": rows["block"], "shard": rows["shard"], "counts": [_zip(_small(mine[a:b])) for a, b in zip(sizes[:-1], sizes[1:], strict=True)], "words": [words, *[0] * (len(rows) - 1)]})


def _score(docs: pd.DataFrame, answers: pd.DataFrame, order: int, shards: int, total: int, vocabulary: int, strength: float) -> pd.DataFrame:
    block = _Block(docs["payload"].iloc[0], order)
    grams, words, lengths = block.grams, block.words, block.lengths
    parts, counts = answers.sort_values("shard")["counts"].to_list(), []
    for level in range(order):
        counts.append(np.empty(len(grams.keys[level]), np.int64))
        counts[level][grams.requests(level, shards)[0]] = np.concatenate([_unzip(x, "i8") for x in parts[level * shards : (level + 1) * shards]])
    automaton = BackoffAutomaton(grams, counts, total, vocabulary, strength)
    grams.at = grams.history = []
    starts = np.cumsum(lengths) - lengths
    out = {"doc_id": pd.array(np.where(block.has, block.ids, 0), "Int64"), "held_out": block.held, "n_tokens": lengths, "n_known": np.add.reduceat((counts[0][words] > 0).astype(np.int64), starts), "train_tokens": total, "base_score": np.add.reduceat(automaton.root[words], starts), "score": np.add.reduceat(automaton.traverse(words, lengths), starts)}
    out["doc_id"][~block.has] = pd.NA
    del grams, automaton, block, counts
    trim()
    return pd.DataFrame(out)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, held_out: Column, order: int = 3, strength: float = 30.0, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Score every document with an n-gram model of the documents where ``held_out`` is not true.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; an end follows them and counts as a token.
    ``score`` is the log10 probability of the text under the automaton, ``base_score`` under add-one unigrams. Null and
    empty texts are the end alone. Repeated rows count and score as often as they occur; a null id stays null and other
    columns play no part. If nothing is held in, every count is 0. An empty table gives an empty result. N-grams
    are known by 64-bit hashes. A single document is scored in one task's memory. A block sends one message to every
    shard: larger corpora want larger blocks and shards, as far as executors have memory.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = parts_for(size, shard_bytes)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.coalesce(held_out, F.lit(False)))
    known = save(rows.mapInArrow(_pack(block_tokens), "block long, n long, payload binary"), "blocks", "uncompressed")
    asked = known.select("block", "payload").mapInArrow(_ask(order, shards), "shard long, block long, payload binary, counts binary")
    # twice as many partitions as groups, so that few groups meet by chance
    answered = asked.repartition(2 * order * shards, "shard").groupBy("shard").applyInPandas(lambda r: _answer(r, shards), "block long, shard long, counts binary, words long")
    answers = save(answered, "answers", "uncompressed")
    total = known.agg(F.sum("n")).first()[0] or 0
    vocabulary = answers.agg(F.sum("words")).first()[0] or 0
    parts = 2 * max(1, known.count())
    return known.repartition(parts, "block").groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block")).applyInPandas(lambda d, a: _score(d, a, order, shards, total, vocabulary, strength), SCORED)
