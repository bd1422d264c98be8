"""Exact, cached encoding with vocabulary files of the tokenizers library.

Both supported vocabularies cut a text into pre-tokens that never span a border between a non-space character and a
single space before another non-space character. So a text may be encoded chunk by chunk between such borders; chunks
repeat a lot and are kept in a bounded cache in the worker process.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

#: Entries kept per process before the cache starts afresh: bounds its memory to about 200 MB.
CACHE_ENTRIES = 1_200_000
#: Marks that end many chunks. Both vocabularies always cut between a letter or digit and these.
TAIL = ".,;:!?*%&$#)]}>\"|"


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the library's own encoding.

    ``words=True`` is for vocabularies that drop white space and lower-case: chunks are then separated by ASCII white
    space, with A-Z lowered first. Otherwise chunks are separated by single spaces; a text in which a space touches other
    white space is encoded whole, and so is one that holds the string of a special token, which the library takes as that
    token.
    """

    def __init__(self, path: str, words: bool = False, entries: int = CACHE_ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.entries = words, entries
        if words:
            self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        else:  # bytes of each id: byte-level tokens are written with one character a byte
            self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.sizes[i] = len(token)
        self.tail = TAIL.encode() if words else TAIL
        self.tails = {self.tail[i : i + 1] for i in range(len(TAIL))}
        self.ends: dict = {}  # ids of tails
        self.first: dict = {}  # ids of a text's first chunk
        self.cache: dict = {}  # ids of later chunks, with their space; False for those that need the whole text

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_spaced(self, texts: list[str]) -> list[bytes]:
        """The same for chunks that begin with a space: encoded together, and cut where the ids' bytes fill a chunk."""
        out: list[bytes] = []
        for at in range(0, len(texts), 1000):
            some = texts[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = 4 * (1 + np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(x.encode()) for x in some])))
            data, begin = ids.tobytes(), 0
            for end in cuts.tolist():
                out.append(data[begin:end])
                begin = end
        return out

    def _ids_words(self, texts: list[str]) -> list[bytes]:
        """The same for chunks without white space: those of letters alone, which are one pre-token each, are encoded
        together and cut behind the ids that end a word."""
        out: dict[str, bytes] = {}
        letters = [x for x in texts if x.isalpha()]
        for at in range(0, len(letters), 1000):
            some = letters[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = 4 * (1 + np.flatnonzero(self.ends_word[ids]))
            if len(cuts) == len(some):
                data, begin = ids.tobytes(), 0
                for x, end in zip(some, cuts.tolist(), strict=True):
                    out[x] = data[begin:end]
                    begin = end
        rest = [x for x in texts if x not in out]
        out.update(zip(rest, self._ids(rest), strict=True))
        return [out[x] for x in texts]

    def _learn(self, cache: dict, pieces: set, space: str) -> None:
        new = {x for x in pieces if x not in cache}
        if len(cache) + len(new) > self.entries:
            cache.clear()
            new = pieces
        if len(self.ends) > 10_000:
            self.ends.clear()
        tailed, plain = [], set()  # chunks that are a known or new word and a tail; chunks to encode as they are
        for x in new:
            if x and x[-1:] in self.tails and (core := x.rstrip(self.tail)) and core[-1:].isalnum() and (not core[0:1].isspace()):
                tailed.append((x, core))
                if core not in cache:
                    plain.add(core)
            elif not self.words and (not x or x[0].isspace() or x[-1].isspace()):
                cache[x] = False
            else:
                plain.add(x)
        plain_list = list(plain)
        cache.update(zip(plain_list, self._ids_words([x.decode("utf-8", "replace") for x in plain_list]) if self.words else self._ids_spaced([" " + x for x in plain_list]) if space else self._ids(plain_list), strict=True))
        for x, core in tailed:
            tail = x[len(core) :]
            if tail not in self.ends:
                self.ends[tail] = self._ids([tail.decode() if self.words else tail])[0]
            cache[x] = cache[core] + self.ends[tail]

    def encode(self, texts: list) -> list[bytes]:
        """The ids of each text as bytes; null and empty texts have none. A few texts at a time, to stay in the processor's
        caches."""
        whole = [i for i, t in enumerate(texts) if t and any(x in t for x in self.special)]
        if whole:
            texts = list(texts)
            apart = self._ids([texts[i] for i in whole])
            for i in whole:
                texts[i] = None
        out = [x for at in range(0, len(texts), 256) for x in self._encode(texts[at : at + 256])]
        if whole:
            for i, ids in zip(whole, apart, strict=True):
                out[i] = ids
        return out

    def _found(self, split: list[list]) -> list[list]:
        """The cached ids of every chunk, after learning those that are missing."""
        found = [list(map(self.cache.get, pieces)) for pieces in split]
        gaps = [[i for i, ids in enumerate(row) if ids is None] if None in row else () for row in found]
        self._learn(self.cache, {pieces[i] for pieces, gap in zip(split, gaps, strict=True) for i in gap}, "" if self.words else " ")
        for pieces, row, gap in zip(split, found, gaps, strict=True):
            for i in gap:
                row[i] = self.cache[pieces[i]]
        return found

    def _encode(self, texts: list) -> list[bytes]:
        if self.words:
            return [b"".join(row) for row in self._found([(t or "").encode("utf-8", "replace").lower().split() for t in texts])]
        led = [bool(t) and len(t) > 1 and t[0] == " " and not t[1].isspace() for t in texts]  # begins like a later chunk
        split = [(t or "")[lead:].split(" ") for t, lead in zip(texts, led, strict=True)]
        self._learn(self.first, {x[0] for x, lead in zip(split, led, strict=True) if not lead}, "")
        out = []
        for text, pieces, row, lead in zip(texts, split, self._found(split), led, strict=True):
            if not lead:
                row[0] = self.first[pieces[0]]
            if False in row:  # a space beside other white space
                out.append(self._ids([text])[0] if text else b"")
            else:
                out.append(b"".join(row))
        return out


@lru_cache(maxsize=1)
def encoder(path: str, words: bool = False, entries: int = CACHE_ENTRIES) -> ChunkEncoder:
    """One encoder, and so one cache, per worker process."""
    return ChunkEncoder(path, words, entries)
