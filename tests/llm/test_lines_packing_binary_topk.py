"""Line deduplication, packing, binary output and exact search against brute force, and their odd inputs."""

import collections
import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina.llm import linededup, packing, repair, topk
from lamina.llm.bpe import ChunkEncoder, vocabulary_path
from tests.llm.conftest import DATA, SCHEMA

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def plain_ids(name, text):
    """The library's own encoding, strings of special tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name)).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("name", "words"), [(BYTE, False), (WORD, True)])
def test_chunked_encoding_is_exact(spark, odd_docs, name, words):
    texts = [r.text for r in odd_docs.collect()] + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    texts += ["a  b", "a\n b", "a \nb", "x's y'll", " a", "a ", "İstanbul ΣΑΣ Σ", "a<|endoftext|>b", "<|endoftext|> <|startoftext|>", "<|ENDOFTEXT|>", "x <|endoftext|> y z", "\x1c a \x85b", "e ́x", "1 000,5"]
    found = ChunkEncoder(vocabulary_path(name), words, entries=50).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [plain_ids(name, t) for t in texts]


def test_line_dedup_against_brute_force(spark, odd_docs):
    got = linededup.line_dedup(odd_docs, min_docs=2).collect()
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    gone = {k for k, v in seen.items() if k and len(v) >= 2}
    want = sorted((str(i), "\n".join(x for x in (t or "").split("\n") if key(x) not in gone), len((t or "").split("\n"))) for i, t in docs)
    assert sorted((str(r.doc_id), r.text or "", r.n_lines) for r in got) == want
    assert [c for c in linededup.line_dedup(odd_docs.withColumnRenamed("source", "n_lines")).columns] == ["doc_id", "text", "n_lines", "n_dropped"]
    assert linededup.line_dedup(odd_docs.limit(0)).collect() == []


def test_packing_is_gapless_complete_and_certified(spark, odd_docs):
    odd_docs = odd_docs.withColumns({"length": F.lit("x"), "part": F.lit(0), "bin": F.lit(0)})  # names that the operator uses
    packed = packing.best_fit_packing(odd_docs, vocabulary_path(BYTE), 64, 2, items_each=4)
    got = packed.toPandas()
    want = []
    for r in odd_docs.collect():
        ids = plain_ids(BYTE, r.text) + [2]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want += [(-1 if r.doc_id is None else r.doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False, name=None)) == sorted(want)
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 64
    proof = packing.certificate(packed, 64).first()
    assert proof.n_pieces == len(got) and proof.n_sequences == got.sequence_id.nunique() and proof.lower_bound == packing.lower_bound(got.length.to_numpy(), 64)
    assert 0 <= proof.gap <= 1 and proof.gap == proof.n_sequences - proof.lower_bound
    none = packing.best_fit_packing(odd_docs.limit(0), vocabulary_path(BYTE))
    assert none.collect() == [] and tuple(packing.certificate(none).first()) == (0, 0, 0, 0, None)


def test_bounds_and_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 100, rng.integers(1, 60))
        bins, offsets, fill = packing.best_fit_decreasing(lengths, 100)
        assert fill.max() <= 100 and fill.sum() == lengths.sum()
        assert packing.lower_bound(lengths, 100) <= len(fill) <= packing.lower_bound(lengths, 100) * 1.3 + 1
        for b in range(len(fill)):
            o = np.argsort(offsets[bins == b])
            assert (np.cumsum(lengths[bins == b][o]) - lengths[bins == b][o] == offsets[bins == b][o]).all()
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3
    assert packing.lower_bound(np.array([34, 34, 34, 34]), 100) == 2


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    docs = [np.concatenate([rng.integers(0, 9, rng.integers(0, 400)), [1]]).astype("<u4") for _ in range(50)] + [np.array([7] * 501 + [1], "<u4"), np.array([1], "<u4")]
    data = repair.compress([None, *range(51)], [x.tobytes() for x in docs], base=10, least=4)
    shard = repair.ShardFile(data)
    assert shard.doc_ids == [None, *range(51)] and len(shard.left) > 0 and shard.count < sum(map(len, docs)) / 2
    assert all((a == b).all() for a, b in zip(shard.documents(), docs, strict=True))
    for i in (0, 7, 50, 51):
        for a, b in ((0, 5), (3, 90), (100, 100), (17, 10_000)):
            assert shard.document(i, a, b).tolist() == docs[i][a:b].tolist()
    assert (shard.lengths[shard.base :] == shard.lengths[shard.left] + shard.lengths[shard.right]).all()


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    phrase = rng.integers(0, 1000, 40)
    docs = [np.concatenate([rng.integers(0, 1000, 30), phrase[: rng.integers(5, 40)], [1]]).astype("<u4") for _ in range(400)]
    shard = repair.ShardFile(repair.compress(list(range(400)), [x.tobytes() for x in docs], base=1000, least=16))
    assert all((a == b).all() for a, b in zip(shard.documents(), docs, strict=True)) and shard.lengths.max() > 16
    left = collections.Counter(p for i in range(400) for p in itertools.pairwise(shard.symbols(shard.first[i], shard.first[i + 1]).tolist()))
    assert max(left.values()) < 16


@pytest.mark.parametrize("width", [1, 7, 16, 17, 32])
def test_packed_bits(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 1000).astype("<u4")
    data = np.frombuffer(repair.pack_bits(x, width), "u1")
    assert len(data) == (1000 * width + 7) // 8
    for a, b in ((0, 1000), (3, 3), (17, 400), (999, 1000)):
        assert (repair.unpack_bits(data, width, a, b) == x[a:b]).all()


def test_binary_output_of_odd_documents(spark, odd_docs):
    odd_docs = odd_docs.withColumns({"part": F.lit("x"), "file": F.lit(0), "id": F.lit(7)})  # names that the operator uses
    index = repair.write_shards(odd_docs, vocabulary_path(WORD), 49_408, 1, shard_tokens=10)
    files = [r.file for r in index.collect()]
    assert len(files) > 3 and all(open(f.removeprefix("file:"), "rb").read(4) == repair.MAGIC for f in files)
    got = repair.read_documents(index).toPandas()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text is not None, r.text or "") for r in odd_docs.collect())
    want, at = [], 0
    for (has, doc), _, text in rows:
        ids = [*plain_ids(WORD, text), 1]
        want.append((doc if has else -1, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got.fillna({"doc_id": -1}).astype(int).itertuples(index=False, name=None), key=lambda x: x[1]) == want
    assert repair.read_documents(repair.write_shards(odd_docs.limit(0), vocabulary_path(WORD), 49_408, 1)).collect() == []


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist(), "x") for i in range(300)] + [(i, rows_i, "y") for i, rows_i in ((300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [1.0, 2.0]), (305, [3.0, 1.0]), (None, [0.0] * 8), (306, []))]
    rows += [(400 + i, rows[i][1], "tie") for i in range(40)] + [(7, rows[7][1], "repeated")] * 9 + [(8, rows[9][1], "one id, two vectors")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").withColumn("shard", F.lit("z"))
    want = []
    ok = [(i, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist())) for i, v, _ in rows if i is not None and v and not any(x is None or not np.isfinite(x) for x in v)]
    for i, v in set(ok):
        if i % 10 == 0 or i in (303, 8, 7):
            best = sorted((-int(np.dot(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    for block_bytes in (200, 1 << 20):
        got = topk.top_k(df, df.where("vec_id % 10 = 0 or vec_id in (303, 8, 7)"), k=5, shard_rows=70, block_bytes=block_bytes * 8)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.limit(0), df, k=5).collect() == [] and topk.top_k(df, df.limit(0), k=5).collect() == []


def test_ball_tree_visits_few_leaves_and_large_scores_stay_exact():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3000, (16, 8))
    vectors = np.floor(centres[rng.integers(0, 16, 2000)] + rng.normal(0, 50, (2000, 8))).astype(np.int64)
    for scale in (1, 1 << 24):  # the second beyond what doubles hold
        v = vectors * scale + rng.integers(0, 2, vectors.shape)
        tree = topk.BallTree.unpack(*topk.BallTree(np.arange(2000), v, 64).pack())
        best = topk.Best(np.full(20, -1), v[:20].copy(), 5, np.full(20, -np.inf))
        asked = []
        offer = best.offer
        best.offer = lambda rows, ids, scores: (asked.append(len(rows)), offer(rows, ids, scores))  # noqa: B023
        tree.search(best)
        assert sum(asked) < 0.8 * 20 * 32
        for i in range(20):
            want = sorted((-sum(int(a) * int(b) for a, b in zip(v[i], w, strict=True)), j) for j, w in enumerate(v))[:5]
            assert [(-int(s), int(j)) for s, j in zip(best.scores[i], best.ids[i], strict=True)] == want


def test_sha_of_all_lines_dropped(spark):
    docs = spark.createDataFrame([(i, "Same line", "s") for i in range(10)], SCHEMA)
    out = linededup.line_dedup(docs).collect()
    assert {(r.text, r.n_lines, r.n_dropped) for r in out} == {("", 1, 1)}
    assert hashlib.sha256(b"").hexdigest() and isinstance(pd.DataFrame(out), pd.DataFrame)
