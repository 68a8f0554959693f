"""Token ids of whole texts by a public byte-level BPE file.

The tokenizer splits a text, before it merges anything, at every space that follows a non-space and
precedes one; what stands on either side is encoded on its own. So the ids of a text are those of its
space-led words in order. Arrow cuts a few million characters of texts at a time into words and numbers the
distinct ones; each of them is looked up or encoded once, and numpy lays out the ids of all words.

The tokenizer splits likewise at a line break between two other characters, and between letters and a run of
marks that doesn't begin with an apostrophe, so such words are put together from their parts. A run of letters,
with or without a space before it, is one unit for the library's merges and goes to them directly. Texts with
runs of spaces or with a space at either end are encoded as they are.

Words are remembered in two generations of `MOST_REMEMBERED` each: when the young one is full it becomes the
old one, and the words of the old one that aren't asked for again go with the next change.
"""

from __future__ import annotations

import gc
import os
import string
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_REMEMBERED, CHUNK_CHARS = 120_000, 4_000_000
_MARKS = string.punctuation


def _shown() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: itself if it is one, else the next from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


_SHOWN = _shown()
_SPACE = _SHOWN[32]


class _Words:
    """Ids, as bytes, of words that follow a space; runs of letters are remembered without it."""

    def __init__(self, tokenizer):
        self.tokenizer, self.merge = tokenizer, tokenizer.model.tokenize
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, word: str, space: str) -> bytes:
        shown = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.merge(space + shown)]).tobytes()

    def ids(self, words: list[str]) -> list[bytes]:
        young, old, merge, out = self.young, self.old, self.merge, []
        for word in words:
            ids = young.get(word)
            if ids is None:
                ids = old.get(word)
                if ids is None:
                    if not word.isalpha():
                        out.append(self.parts(word, _SPACE))
                        continue
                    ids = array("I", [t.id for t in merge(_SPACE + (word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(_SHOWN)))]).tobytes()
                young[word] = ids
            out.append(ids)
        if len(young) > MOST_REMEMBERED:
            self.young, self.old = {}, young
        return out

    def parts(self, word: str, space: str) -> bytes:
        """Ids of any word, after a space or, with space = "", at the start of a text or line."""
        if word.isalpha():
            if not space:
                return self.letters(word, space)
            ids = self.young.get(word) or self.old.get(word)
            if ids is None:
                self.young[word] = ids = self.letters(word, space)
            return ids
        if "\n" in word:
            first, *lines = word.split("\n")
            if first and not first[-1].isspace() and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                return self._of_marks("\n").join([self.parts(first, space), *(self.parts(x, "") for x in lines)])
        else:
            body = word.rstrip(_MARKS)
            marks = word[len(body) :]
            if marks and marks[0] != "'" and body.isalpha():
                return self.parts(body, space) + self._of_marks(marks)
        return self.whole(" " + word if space else word)

    def _of_marks(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self.whole(marks)
            if len(self.marks) < 1000:
                self.marks[marks] = ids
        return ids


def _plain(text: str | None) -> bool:
    return bool(text) and "  " not in text and text[0] != " " and text[-1] != " "


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are packed in the machine's own order")
        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Words(self.tokenizer)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, in order; none for null."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHUNK_CHARS):
                chars += len(texts[end] or "")
                end += 1
            yield from self._chunk(texts[at:end])
            at = end

    def _chunk(self, texts: list[str | None]) -> Iterator[bytes]:
        plain = self._words([t for t in texts if _plain(t)])
        for text in texts:
            yield next(plain) if _plain(text) else self.known.whole(text) if text else b""

    def _words(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return
        cut = pc.split_pattern(pa.array(texts, type=pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = {}  # words at the start of a text follow no space
        code = code.copy()
        code[ends[:-1]] = [firsts.setdefault(t.partition(" ")[0], len(words) + len(firsts)) for t in texts]
        collecting = gc.isenabled()
        gc.disable()  # nothing here has cycles, and hundreds of thousands of remembered words make each collection slow
        try:
            ids = self.known.ids(words) + [self.known.parts(w, "") for w in firsts]
        finally:
            if collecting:
                gc.enable()
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, place = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size
        del coded, words, ids
        n = size[code]
        after = np.cumsum(n)
        out = flat[np.repeat(place[code] - (after - n), n) + np.arange(after[-1])]
        bounds = np.concatenate(([0], after))[ends - ends[0]].tolist()
        for i, j in zip(bounds, bounds[1:]):
            yield out[i:j].tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
