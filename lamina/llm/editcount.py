"""Edit-aware token counts: a segment tree over each document's pre-tokens, updated where edits touch it.

The leaves are pieces of text that the vocabulary encodes on their own (they begin at borders that no pre-token crosses),
each with its length and its number of tokens; inner nodes hold sums. An edit re-encodes the leaves it touches and one
more on each side, whose borders may have moved, and updates the sums above them; everything else keeps its counts.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.bpe import encoder
from lamina.llm.common import small_batches, trim

#: Characters after which a leaf ends at the next border.
LEAF_CHARS = 200


def cut_points(text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Borders of leaves: a single space between two characters that aren't white space, the first such one after each
    ``leaf_chars`` characters. Text without such borders stays one leaf."""
    out, at = [0], leaf_chars
    while (at := text.find(" ", at)) >= 0:
        if at and at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
            out.append(at)
            at += leaf_chars
        else:
            at += 1
    return out


def leaves_of(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    cuts = cut_points(text, leaf_chars)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class CountTree:
    """Lengths and token counts of leaves, with sums above them: node i has children 2i and 2i + 1, the root is 1."""

    def __init__(self, text: str, path: str, leaf_chars: int = LEAF_CHARS, counts: list[int] | None = None) -> None:
        """``counts`` are the leaves' tokens, where they are known already."""
        self.path, self.leaf_chars, self.encoded = path, leaf_chars, 0
        self._grow(leaves_of(text, leaf_chars), counts)

    def _count(self, leaves: list[str]) -> list[int]:
        self.encoded += sum(map(len, leaves))
        return [len(x) // 4 for x in encoder(self.path).encode(leaves)]

    def _grow(self, leaves: list[str], counts: list[int] | None) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(leaves), 0] = [len(x) for x in leaves]
        self.sums[self.size : self.size + len(leaves), 1] = self._count(leaves) if counts is None else counts
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last leaf for the text's end), and where it begins."""
        node, begin = 1, 0
        place = min(place, max(0, int(self.sums[1, 0]) - 1))
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            node, begin = (2 * node, begin) if place < begin + left else (2 * node + 1, begin + left)
        return node - self.size, begin

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start..stop by ``new``."""
        first, begin = self.leaf_at(start)
        last, last_begin = self.leaf_at(max(start, stop - 1))
        end = last_begin + len(self.leaves[last])
        lo, hi = max(0, first - 1), min(len(self.leaves), last + 2)
        if lo < first:
            begin -= len(self.leaves[lo])
        if hi > last + 1:
            end += len(self.leaves[hi - 1])
        old = "".join(self.leaves[lo:hi])
        region = old[: start - begin] + new + old[stop - begin :]
        # the region's own ends are borders still, unless the edit reached them: then it grows to where they are
        while lo > 0 and not self._border(self.leaves[lo - 1], region):
            lo -= 1
            region = self.leaves[lo] + region
        while hi < len(self.leaves) and not self._border(region, self.leaves[hi]):
            region += self.leaves[hi]
            hi += 1
        fresh = leaves_of(region, self.leaf_chars)
        counts = self._count(fresh)
        if len(fresh) == hi - lo:
            for i, (leaf, n) in enumerate(zip(fresh, counts, strict=True), lo):
                self.leaves[i] = leaf
                node = self.size + i
                change = np.array([len(leaf), n]) - self.sums[node]
                while node:
                    self.sums[node] += change
                    node //= 2
        else:  # the shape changes: the sums are built anew, the other leaves' counts stay
            kept = self.sums[self.size : self.size + len(self.leaves), 1].tolist()
            self._grow(self.leaves[:lo] + fresh + self.leaves[hi:], kept[:lo] + counts + kept[hi:])

    def pack(self) -> bytes:
        """The tree as bytes, to be kept beside its document: number of leaves, their lengths and counts, their text."""
        own = self.sums[self.size : self.size + len(self.leaves)].astype("<u4")
        return struct.pack("<II", len(self.leaves), self.leaf_chars) + own.tobytes() + self.text.encode("utf-8", "surrogatepass")

    @classmethod
    def unpack(cls, data: bytes, path: str) -> CountTree:
        """A kept tree; nothing is encoded again."""
        n, leaf_chars = struct.unpack_from("<II", data)
        own = np.frombuffer(data, "<u4", 2 * n, 8).reshape(n, 2)
        text, ends = data[8 + 8 * n :].decode("utf-8", "surrogatepass"), np.cumsum(own[:, 0]).tolist()
        tree = cls.__new__(cls)
        tree.path, tree.leaf_chars, tree.encoded = path, leaf_chars, 0
        tree._grow([text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], own[:, 1].tolist())
        return tree

    @staticmethod
    def _border(left: str, right: str) -> bool:
        return len(right) > 1 and right[0] == " " and not right[1].isspace() and bool(left) and not left[-1].isspace()


def edited_counts(docs: DataFrame, path: str, edits: Column | None = None, redact: tuple[str, str] | None = None, leaf_chars: int = LEAF_CHARS, id_col: str = "doc_id", text_col: str = "text", tree_col: str | None = None, keep: bool = False) -> DataFrame:
    """Token counts before and after edits: doc_id, n_tokens, n_tokens_after, n_edits, n_chars, chars_reencoded.

    The edits come from ``redact``, a regular expression and what replaces its matches, or from ``edits``, a column of array<struct<start: int, stop: int, new: string>>, in characters (code points)
    of the text before any edit, in ascending order and without overlaps; null is no edit. ``chars_reencoded`` counts the characters that
    the edits made the tree encode again. With ``keep`` the edited trees are returned too (column tree); a table that has
    them in ``tree_col`` goes on from them, reads no text, and encodes only what new edits touch. Null and empty texts have no tokens. Repeated rows count as often as they
    occur, a null id stays null, and other columns play no part.
    """
    small_batches(docs.sparkSession)

    find = re.compile(redact[0]) if redact else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            docs_, texts, edits_ = (batch.column(i).to_pylist() for i in range(3))
            if tree_col is None:
                split = [leaves_of(t or "", leaf_chars) for t in texts]
                counts = iter([len(x) // 4 for x in encoder(path).encode([leaf for leaves in split for leaf in leaves])])
                trees = (CountTree(t or "", path, leaf_chars, list(islice(counts, len(leaves)))) for t, leaves in zip(texts, split, strict=True))
            else:
                trees = (CountTree.unpack(t, path) if t is not None else CountTree("", path, leaf_chars, [0]) for t in texts)
            for doc, changes, tree in zip(docs_, edits_, trees, strict=True):
                text = tree.text
                if find:
                    changes = [{"start": m.start(), "stop": m.end(), "new": redact[1]} for m in find.finditer(text)]
                before, built = tree.tokens, tree.encoded
                for e in reversed(changes or []):  # from the end, so that places stay right
                    tree.edit(e["start"], e["stop"], e["new"] or "")
                out.append((doc, before, tree.tokens, len(changes or []), len(text), tree.encoded - built, *([tree.pack()] if keep else [])))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "tree" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)
        trim()

    names = ["doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_chars", "chars_reencoded", *(["tree"] if keep else [])]
    source = F.col(tree_col or text_col)
    changes = (F.lit(None) if edits is None else edits).cast("array<struct<start: int, stop: int, new: string>>")
    schema = ", ".join(f"{n} {'binary' if n == 'tree' else 'long'}" for n in names)
    return docs.select(F.col(id_col).cast("long"), source, changes.alias("__edits")).mapInArrow(run, schema)
