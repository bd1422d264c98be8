"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

Texts become arrays of word hashes. At every position, each fixed mask hashes six of the next twelve words and ignores
the others, so that substituted words at ignored positions do not hide an overlap. Seeds of the documents meet seeds of
the benchmark items in a join; around every hit the twelve words are compared in full, and at most two may differ.

The twelve positions fall in four classes of three, and the masks are all six pairs of classes: two substitutions touch at
most two classes, so the pair of the others is a whole mask, and no window with up to two substitutions is missed.
Verified windows on one alignment of a document with an item are one overlap, from the first to the last of them. Items
too short for a window are found where they are copied whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import fits, row_key, save

SPAN, PIECE = 12, 32
#: Words from which on a whole item is told from chance.
LEAST_WORDS = 8
MASKS = ((0, 2, 4, 6, 8, 10), (1, 3, 5, 7, 9, 11), (0, 1, 4, 5, 8, 9), (2, 3, 6, 7, 10, 11), (0, 3, 4, 7, 8, 11), (1, 2, 5, 6, 9, 10))
#: Substitutions in a window that leave a whole mask wherever they fall.
MOST_ALLOWED = 2
#: Seeds (narrow rows with one window of twelve hashes) up to which the benchmark side is broadcast: below 150 MB.
SEED_ROWS = 1_000_000


def word_array(text: Column) -> Column:
    """64-bit hashes of the runs of letters and digits, lower-cased."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _positions(df: DataFrame, keep: list[str], span: int, each: int) -> DataFrame:
    """``each`` rows (q) for every run of ``span`` words of column h: the kept columns, c and the place of the run, in c
    (at) and in the text (pos). Texts are first cut into short overlapping pieces, so that no row drags a long array along."""
    pieces = F.posexplode(F.transform(F.sequence(F.lit(0), F.size("h") - span, F.lit(PIECE)), lambda i: F.slice("h", i + 1, PIECE + span - 1)))
    cut = df.where(F.size("h") >= span).select(*keep, pieces.alias("piece", "c"))
    rows = cut.select(*keep, "piece", "c", F.explode(F.sequence(F.lit(0), each * (F.size("c") - span + 1) - 1)).alias("q"))
    at = F.expr(f"cast(q div {each} as int)")
    return rows.select(*keep, "c", at.alias("at"), (PIECE * F.col("piece") + at).alias("pos"), (F.col("q") % each).alias("q"))


def _seeds(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each position and mask of column h: the kept columns, c, at and pos, seed. The masks are a formula of the
    mask's number, which keeps the generated code small enough to be compiled."""
    # every mask is two offsets below four, repeated each four words: two bits of a number for each mask
    low, high = (F.expr(f"shiftright({sum(m[j] << 2 * i for i, m in enumerate(MASKS))}, cast(2 * q as int)) & 3") for j in (0, 1))
    kept = [4 * (j // 2) + (high if j % 2 else low) for j in range(len(MASKS[0]))]
    seed = F.xxhash64(F.col("q"), *[F.col("c")[F.col("at") + i] for i in kept])
    return _positions(df, keep, SPAN, len(MASKS)).select(*keep, "c", "at", "pos", seed.alias("seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame, keys: dict[str, Column], allowed: int = 2, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Verified windows, all distinct: the ``keys`` of the document, item_id, the alignment (the document's place less the
    item's), the place in the document, the window's words and how many of them are equal."""
    if allowed > MOST_ALLOWED:
        raise ValueError(f"the masks are laid out for at most {MOST_ALLOWED} substitutions")
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), word_array(F.col(text_col)).alias("h"))
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], word_array(F.col(text_col)).alias("h"))
    known = save(_seeds(items, ["item_id"]).select("item_id", "seed", F.col("pos").alias("item_pos"), F.slice("c", F.col("at") + 1, SPAN).alias("item_words")).distinct(), "seeds")
    known = F.broadcast(known) if fits(known, SEED_ROWS) else known.hint("merge")
    hits = _seeds(rows, list(keys)).join(known, "seed").select(*keys, "item_id", "pos", "item_pos", "item_words", F.slice("c", F.col("at") + 1, SPAN).alias("words"))
    same = F.aggregate(F.zip_with("words", "item_words", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    found = hits.select(*keys, "item_id", (F.col("pos") - F.col("item_pos")).alias("alignment"), "pos", F.lit(SPAN).alias("words"), same.alias("equal_words")).where(F.col("equal_words") >= SPAN - allowed)
    short = save(items.where(F.size("h").between(LEAST_WORDS, SPAN - 1)).select("item_id", F.size("h").alias("n"), F.xxhash64("h").alias("seed")), "short")
    for n in [r["n"] for r in short.select("n").distinct().collect()]:  # at most SPAN - LEAST_WORDS lengths
        some = short.where(F.col("n") == n)
        some = F.broadcast(some) if fits(some, SEED_ROWS) else some.hint("merge")
        runs = _positions(rows, list(keys), n, 1).withColumn("seed", F.xxhash64(F.slice("c", F.col("at") + 1, n)))
        found = found.union(runs.join(some, "seed").select(*keys, "item_id", F.col("pos").alias("alignment"), "pos", F.lit(n).alias("words"), F.lit(n).alias("equal_words")))
    return found.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, allowed: int = 2, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The documents that share a window of SPAN words with an item, at most ``allowed`` of them substituted: doc_id,
    n_items, first_item (the smallest id), best_words (the most equal words of a window), overlap_words (the longest
    aligned stretch from a first to a last such window).

    Other documents are not listed. Words are runs of letters and digits, lower-cased, so punctuation and spacing play
    no part. An item of LEAST_WORDS words or more, but fewer than SPAN, counts as one window, of which no word may differ.
    Shorter, empty and null texts overlap with nothing, on either side; long texts are read whole. Items with a null id
    take no part; documents with one id, or a null id, are one row. Other columns play no part.
    """
    found = overlaps(docs, benchmark, {"doc_id": F.col(id_col)}, allowed, item_col, text_col)
    aligned = found.groupBy("doc_id", "item_id", "alignment").agg((F.max(F.col("pos") + F.col("words")) - F.min("pos")).alias("stretch"), F.max("equal_words").alias("equal_words"))
    return aligned.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), F.max("equal_words").alias("best_words"), F.max("stretch").alias("overlap_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, allowed: int = 2, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The documents that ``contaminated`` would not list, with all their columns; rows are told apart by id and text."""
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    gone = save(overlaps(docs, benchmark, {"__k1": k1, "__k2": k2}, allowed, item_col, text_col).select("__k1", "__k2").distinct(), "contaminated")
    if fits(gone):
        gone = F.broadcast(gone)
    return docs.withColumns({"__k1": k1, "__k2": k2}).join(gone, ["__k1", "__k2"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
