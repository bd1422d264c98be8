"""Best-fit packing with certified bin counts.

Items are dealt to bounded partitions; each packs by best-fit decreasing and certifies its bin count with
dual-feasible-function lower bounds. Partitions that are over their bound, and the emptiest bin of every partition, give
up their unfilled bins; those documents are exchanged and packed again for as long as that saves bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.bpe import encoder
from lamina.llm.common import parts_for, save, small_batches, trim

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, part long, bin int, offset long, open boolean"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill. An item goes to the fullest bin that still holds it."""
    bins, offsets, room = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i], room[b] = b, capacity - r, r - n
        by_room[r - n].append(b)
        mask |= 1 << (r - n)
    return bins, offsets, capacity - np.array(room, np.int64)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The least number of bins for ``count[n]`` items of each length n, as far as these dual feasible functions prove: the
    identity, the threshold family (over capacity - e counts whole, under e counts nothing, for every e up to half) and the
    rounding family (k in 1..20)."""
    x = np.arange(capacity + 1)
    best = -(-int(count @ x) // capacity)
    for e in range(1, capacity // 2 + 1):
        best = max(best, -(-int(count[capacity - e + 1 :].sum() * capacity + count[e : capacity - e + 1] @ x[e : capacity - e + 1]) // capacity))
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        scaled = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # times k
        best = max(best, -(-int(count @ scaled) // (k * capacity)))
    return best


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The bound of ``bound_of_counts`` for a partition's lengths."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def certificate(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row that says how good a packing is: n_pieces, n_sequences, lower_bound (sequences that any packing of these
    pieces needs), gap, fill (tokens a place). Only the number of pieces of each length, at most ``capacity`` rows,
    reaches the driver."""
    rows = packed.groupBy("length").count().collect()
    count = np.zeros(capacity + 1, np.int64)
    for r in rows:
        count[r["length"]] = r["count"]
    used = packed.select("sequence_id").distinct().count()
    bound = bound_of_counts(count, capacity) if len(rows) else 0
    fill = float(count @ np.arange(capacity + 1)) / (used * capacity) if used else None
    return packed.sparkSession.createDataFrame([(int(count.sum()), used, bound, used - bound, fill)], "n_pieces long, n_sequences long, lower_bound long, gap long, fill double")


def encode_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece (PIECES): a document's ids and the end id, cut only if longer than the capacity; the first
    piece takes the remainder. Null and empty texts are the end id alone."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    take = capacity if (n - at) % capacity == 0 else (n - at) % capacity
                    rows.append((doc, piece, at, take, zlib.crc32(ids[4 * at : 4 * (at + take)])))
                    at, piece = at + take, piece + 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(pieces, PIECES)


def pack(pieces: DataFrame, capacity: int, items_each: int = 16_384, rounds: int = 3) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to PIECES rows, with as few sequences of ``capacity`` as the method finds.

    Whole pieces fill a sequence alone. The rest is dealt by hash to partitions of about ``items_each`` rows, so memory
    is bounded and no key gathers rows; ``rounds`` exchanges follow, each only over what unfilled bins hold. A round's
    result is kept per group only where it saves bins. An empty input gives an empty result.
    """
    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        held = len(rows[["part", "bin"]].drop_duplicates()) if key[1] else len(fill) + 1
        if len(fill) < held:
            gap = len(fill) > lower_bound(lengths, capacity)
            unfilled = (fill < capacity) if gap else np.arange(len(fill)) == np.argmin(fill)
            rows = rows.assign(part=key[0], bin=bins, offset=offsets, open=(unfilled & (fill < capacity))[bins])
        else:
            rows = rows.assign(open=False)  # packing these again would save nothing
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "open"]]

    partial = pieces.where(F.col("length") < capacity)
    state, done, base = partial.withColumns({"part": F.lit(0).cast("long"), "bin": F.lit(0), "offset": F.lit(0).cast("long")}), [], 0
    for turn in range(rounds + 1):
        n = state.count()
        if not n:
            break
        groups = parts_for(n, items_each)
        hashed = F.pmod(F.xxhash64("part", "bin") if turn else F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("long")
        placed = save(state.withColumns({"group": hashed + base, "again": F.lit(bool(turn))}).groupBy("group", "again").applyInPandas(place, PLACED), "pack")
        base += groups
        done.append(placed.where(~F.col("open")) if turn < rounds else placed)
        state = placed.where("open").drop("open") if turn < rounds else None
        if state is None:
            break
    whole = pieces.where(F.col("length") >= capacity).select(*pieces.columns, (F.monotonically_increasing_id() + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for part in done:
        whole = whole.unionByName(part.select(*pieces.columns, (F.col("part") * F.lit(1 << 31) + F.col("bin")).alias("sequence_id"), "offset"))
    return whole


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, items_each: int = 16_384, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text packs as an empty one
    (the end id alone), a null id stays null, repeated rows are packed as often as they occur, and other columns play no
    part. A single text is encoded in one task's memory.
    """
    return pack(save(encode_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity, items_each, rounds)
