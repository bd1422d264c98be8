"""Token ids in a binary file format with Re-Pair grammar compression and random access.

Documents go to shards in ascending id order. In a shard, the adjacent id pairs that occur often are replaced by new
symbols, the most frequent first and matches taken left to right, never across documents, until no pair occurs LEAST
times. A shard file holds the rules, the length each symbol expands to, and the symbols in as few bits as they need, so
that any document, or a slice of one, decodes on its own.

File layout, little-endian: magic b"RPG2"; uint32 base (smallest nonterminal); uint32 rules, docs, width (bits a symbol);
uint64 symbols; uint32 left[rules], right[rules], length[rules]; int64 doc_id[docs]; uint8 has_id[docs];
uint32 first_symbol[docs + 1], tokens[docs]; symbols, most significant bit first.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.bpe import encoder
from lamina.llm.common import checked, parts_for, save, shared_dir, small_batches, trim

MAGIC = b"RPG2"
#: Ids of a shard; how often a pair must occur in it to be replaced; how far below the most frequent pair one pass goes.
SHARD_TOKENS, LEAST, STEP = 2_000_000, 16, 16
#: Chunks that encoding remembers, about 250 MB.
REMEMBERED = 1_400_000
#: Bytes of text for a partition of the range partitioning.
PARTITION_BYTES = 16 << 20
_HASH_BITS, _SPREAD = 20, (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


def frequent_pairs(symbols: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the pairs that occur at least ``floor`` times, the pairs' numbers there, and that floor, which is a STEP-th
    of the most frequent pair's count, but no less than ``least``. Counts of hash slots narrow down what is counted."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if len(symbols) < 2:
        return none
    a, b = symbols[:-1], symbols[1:]
    slot = ((a * _SPREAD[0] + b * _SPREAD[1]) >> np.uint32(32 - _HASH_BITS)).astype(np.int32)
    slot[last[:-1]] = 1 << _HASH_BITS  # a pair across documents
    counts = np.bincount(slot, minlength=(1 << _HASH_BITS) + 1)
    counts[-1] = 0
    floor = max(least, int(counts.max()) // STEP)
    while True:
        at = np.flatnonzero((counts >= floor)[slot])
        pairs, number, times = np.unique(a[at].astype(np.uint64) << np.uint64(32) | b[at], return_inverse=True, return_counts=True)
        good = times >= floor
        if good.any():
            keep = good[number]
            return at[keep], number[keep], floor
        if floor == least:
            return none
        floor = max(least, floor // STEP)  # slots that several pairs share counted too much


def replace_pairs(symbols: np.ndarray, last: np.ndarray, next_symbol: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass: symbols and end marks after it, and the pairs replaced by next_symbol, next_symbol + 1, ..."""
    at, number, _ = frequent_pairs(symbols, last, least)
    if not len(at):
        return symbols, last, np.zeros((0, 2), np.uint32)
    # overlapping matches form runs of consecutive places; every other one, from the left, is taken
    begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    at, number = at[place % 2 == 0], number[place % 2 == 0]
    used = np.bincount(number)
    if used.max() < 2:
        return symbols, last, np.zeros((0, 2), np.uint32)
    chosen = np.flatnonzero(used >= min(max(2, least // 2), int(used.max())))
    name = np.full(len(used), -1, np.int64)
    name[chosen] = next_symbol + np.arange(len(chosen))
    new = name[number]
    at, new, number = at[new >= 0], new[new >= 0], number[new >= 0]
    pairs = np.zeros((len(chosen), 2), np.uint32)
    pairs[new - next_symbol, 0], pairs[new - next_symbol, 1] = symbols[at], symbols[at + 1]
    symbols, last = symbols.copy(), last.copy()
    symbols[at] = new
    last[at] |= last[at + 1]
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return symbols[keep], last[keep], pairs


def pack_bits(symbols: np.ndarray, width: int) -> bytes:
    out = []
    for at in range(0, len(symbols), 1 << 19):  # whole bytes each
        bits = np.unpackbits(symbols[at : at + (1 << 19)].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
        out.append(np.packbits(bits[:, 32 - width :]).tobytes())
    return b"".join(out)


def unpack_bits(data: np.ndarray, width: int, start: int, stop: int) -> np.ndarray:
    """Symbols start..stop of packed bytes; only the bytes that hold them are read."""
    first = start * width // 8
    bits = np.unpackbits(data[first : (stop * width + 7) // 8])[start * width - 8 * first :][: (stop - start) * width]
    wide = np.zeros((stop - start, 32), np.uint8)
    wide[:, 32 - width :] = bits.reshape(-1, width)
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype("<u4")


def compress(doc_ids: list, docs: list[bytes], base: int, least: int = LEAST) -> bytes:
    """A shard file of documents given as uint32 id bytes, each of at least one id; ids are below ``base``."""
    tokens = np.array([len(x) // 4 for x in docs], np.uint64)
    symbols = np.frombuffer(b"".join(docs), "<u4")
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(tokens).astype(np.int64) - 1] = True
    rules, known = [np.zeros((0, 2), np.uint32)], np.ones(base, np.uint32)
    while True:
        symbols, last, pairs = replace_pairs(symbols, last, len(known), least)
        if not len(pairs):
            break
        rules.append(pairs)
        known = np.append(known, known[pairs[:, 0]] + known[pairs[:, 1]])
    every, width = np.concatenate(rules), max(1, int(len(known) - 1).bit_length())
    first = np.append(0, np.flatnonzero(last) + 1).astype("<u4")
    head = MAGIC + struct.pack("<IIIIQ", base, len(every), len(docs), width, len(symbols))
    has = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([head, every[:, 0].astype("<u4").tobytes(), every[:, 1].astype("<u4").tobytes(), known[base:].astype("<u4").tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), has.tobytes(), first.tobytes(), tokens.astype("<u4").tobytes(), pack_bits(symbols, width)])


class ShardFile:
    """Random access to a shard file's documents."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.base, rules, docs, self.width, self.count = struct.unpack_from("<IIIIQ", data, 4)
        at = 28

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.left, self.right, grown = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        ids, has = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(x) if h else None for x, h in zip(ids, has, strict=True)]
        self.first, self.tokens = take("<u4", docs + 1).astype(np.int64), take("<u4", docs)
        self.data = take("u1", (self.count * self.width + 7) // 8)
        self.lengths = np.append(np.ones(self.base, np.int64), grown.astype(np.int64))
        self.starts = np.cumsum(np.append(0, self.lengths[:-1]))
        table = np.empty(int(self.lengths.sum()), "<u4")  # each symbol's expansion, one after the other
        table[: self.base] = np.arange(self.base)
        for s, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True), self.base):
            to, n_a, n_b = int(self.starts[s]), int(self.lengths[a]), int(self.lengths[b])
            table[to : to + n_a] = table[self.starts[a] : self.starts[a] + n_a]
            table[to + n_a : to + n_a + n_b] = table[self.starts[b] : self.starts[b] + n_b]
        self.table = table

    def symbols(self, start: int, stop: int) -> np.ndarray:
        return unpack_bits(self.data, self.width, start, stop)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        return self.table[np.repeat(self.starts[symbols] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop of document i; only the symbols that cover them are expanded."""
        part = self.symbols(self.first[i], self.first[i + 1])
        stop = int(self.tokens[i]) if stop is None else min(stop, int(self.tokens[i]))
        ends = np.cumsum(self.lengths[part])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
        skip = start - (int(ends[a - 1]) if a else 0)
        return self._expand(part[a : b + 1])[skip : skip + max(0, stop - start)]

    def documents(self) -> Iterator[np.ndarray]:
        """All documents, a bounded number of symbols at a time."""
        i, docs = 0, len(self.tokens)
        while i < docs:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + 500_000, side="right")) - 1)
            j = min(j, docs)
            ids, at = self._expand(self.symbols(self.first[i], self.first[j])), 0
            for n in self.tokens[i:j].astype(np.int64).tolist():
                yield ids[at : at + n]
                at += n
            i = j


def _filesystem(path: str):
    """The file system and the path in it of a folder that all executors share: anything that pyarrow can open."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, path: str, vocabulary: int, end_id: int, folder: str | None = None, words: bool = True, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append ``end_id``, and write shard files in ascending id order into ``folder`` (by default a new one in
    the shared folder); returns the saved index (part, seq, n_docs, n_tokens, file, bytes) whose order is (part, seq). A
    task names its files after its attempt and the index holds those of the attempt that succeeded, so a task
    that is run again leaves at most files that nothing reads.

    Null and empty texts are the end id alone; null ids come first; rows with the same id are ordered by text. The rows are
    range-partitioned by id and the first characters of the text, so that an id of many texts is spread too; a
    shard is closed at ``shard_tokens`` ids or after one document. Other columns play no part. An empty table
    gives an empty index.
    """
    spark = docs.sparkSession
    small_batches(spark)
    end = np.array([end_id], "<u4").tobytes()
    folder = folder or f"{shared_dir(spark)}/lamina-files-{uuid.uuid4().hex}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task, seq, ids, held, size = encoder(path, words, REMEMBERED), TaskContext.get(), 0, [], [], 0
        part = task.partitionId()

        def shard() -> pa.RecordBatch:
            files, root = _filesystem(folder)
            files.create_dir(root, recursive=True)
            name = f"part-{part:06d}-{seq:06d}-{task.taskAttemptId()}.rpg"
            data = compress(ids, held, vocabulary)
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(ids)]), pa.array([size]), pa.array([f"{folder}/{name}"]), pa.array([len(data)])], ["part", "seq", "n_docs", "n_tokens", "file", "bytes"])

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), code.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(doc)
                held.append(found + end)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    yield shard()
                    seq, ids, held, size = seq + 1, [], [], 0
        if ids:
            yield shard()
        ids, held = [], []
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = parts_for(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PARTITION_BYTES)
    ordered = rows.repartitionByRange(parts, F.col("id"), F.substring("text", 1, 32)).sortWithinPartitions("id", "text")
    return save(ordered.mapInArrow(encode, "part long, seq long, n_docs long, n_tokens long, file string, bytes long"), "index", "uncompressed")


def read_documents(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shard files of an index; ``start`` counts
    the ids of all documents before it. The running sums are over the shards of a part and over the parts."""
    spark = index.sparkSession
    small_batches(spark)
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select(F.col("part"), before(Window.orderBy("part")).alias("of_part"))
    starts = index.withColumn("in_part", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part")
    starts = save(starts.select(F.element_at(F.split("file", "/"), -1).alias("name"), (F.col("of_part") + F.col("in_part")).alias("begin")), "starts")
    found = index.select("file").head(1)
    if not found:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, shard, out = batch.column(0)[i].as_py(), ShardFile(batch.column(1)[i].as_py()), []
                for doc, ids in zip(shard.doc_ids, shard.documents(), strict=True):
                    out.append((doc, at, len(ids), zlib.crc32(np.ascontiguousarray(ids))))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
        trim()

    files = spark.read.format("binaryFile").load(found[0]["file"].rsplit("/", 1)[0]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.join(checked(starts), "name").select("begin", "content").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
