"""Token ids of whole texts by a byte-level BPE tokenizer, a distinct unit at a time.

The tokenizer splits a text into letters, digits, other signs and white space, each with at most one space in front, and
encodes each part on its own. A task therefore cuts texts only where the tokenizer cuts as well (see :func:`units`),
encodes each distinct unit once and gathers the ids of whole blocks of text with numpy. A text that holds a special
token's string goes through the tokenizer whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from framewell.llm import kernels as K

#: Classes of bytes: white space 0, ASCII letters 1, digits 2, signs 3; bytes of other characters 4.
_CLASS = np.full(256, 4, dtype=np.uint8)
_CLASS[[*range(0x21, 0x7F), *range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]] = 3
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
#: First bytes of the characters among which white space beyond ASCII is.
_WIDE_SPACE = np.zeros(256, dtype=bool)
_WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Units that a process remembers; beyond it, it starts anew.
KNOWN_LIMIT = 500_000


class Units(K.Words):
    """Units keep their case."""

    def hashes(self, fold: bool = False) -> np.ndarray:
        return super().hashes(False)


def units(data: np.ndarray, offsets: np.ndarray, lo: int) -> Units:
    """Parts of texts that can be encoded alone, white space in front included.

    Cut are: where white space begins, unless the character before it may be white space beyond ASCII; and where an ASCII
    letter, digit or sign is followed by one of another class, but not between an apostrophe and a letter.
    """
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    kind = _CLASS[data]
    cut = np.zeros(len(data), dtype=bool)
    if len(data):
        before, after = kind[:-1], kind[1:]
        wide = _WIDE_SPACE[data[:-1]]
        wide[1:] |= _WIDE_SPACE[data[:-2]]
        wide[2:] |= _WIDE_SPACE[data[:-3]]
        cut[1:] = (after == 0) & (before != 0) & ~((before == 4) & wide)
        cut[1:] |= (before != after) & (before > 0) & (before < 4) & (after > 0) & (after < 4) & ~((data[:-1] == 0x27) & (after == 1))
        cut[offsets[(offsets < len(data)) & (np.diff(offsets, append=offsets[-1]) > 0)]] = True
    start = np.flatnonzero(cut)
    return Units(data, start, np.append(start[1:], len(data))[: len(start)], np.searchsorted(start, offsets), lo)


class ByteEncoder:
    """Ids of texts; remembers the units it has met, up to :data:`KNOWN_LIMIT`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}  # shown as they are, others from U+0100 on
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._forget()

    def _forget(self) -> None:
        self.at: dict[int, int] = {}
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, unit: bytes) -> list[int]:
        text = unit.decode("utf-8")
        word = text[1:] if text[:1] == " " else text
        if word.isalpha() and max(word) < "\u0250" or word.isascii() and word.isdigit():
            return [t.id for t in self.tokenizer.model.tokenize("".join(map(self.shown.__getitem__, unit)))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, hashes: list[int], parts: list[bytes]) -> None:
        lists = [self._encode(x) for x in parts]
        size = np.array([len(x) for x in lists], dtype=np.int64)
        self.at.update(zip(hashes, range(len(self.size), len(self.size) + len(size)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.array([i for x in lists for i in x], dtype=np.uint32)])

    def block(self, block: Units) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the block's texts, and ``first`` of them by text."""
        codes, distinct = pd.factorize(block.hashes())
        if len(self.at) + len(distinct) > KNOWN_LIMIT:
            self._forget()
        names = distinct.tolist()
        new = [i for i, h in enumerate(names) if h not in self.at]
        if new:
            place = np.empty(len(distinct), np.int64)
            place[codes[::-1]] = np.arange(len(codes))[::-1]
            place = place[new]
            raw = block.data.tobytes()
            self._learn([names[i] for i in new], [raw[a:b] for a, b in zip(block.start[place].tolist(), block.end[place].tolist(), strict=True)])
        at = np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))[codes]
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.first[at] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[block.first]

    def column(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For each block of texts: its first row and each text's ids."""
        data, offsets = K.buffers(texts)
        odd = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            odd |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        lo, n = 0, len(texts)
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + K.BLOCK_BYTES, side="right")) - 1))
            ids, first = self.block(units(data, offsets[lo : hi + 1], lo))
            out = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            for i in np.flatnonzero(odd[lo:hi]).tolist():
                out[i] = np.array(self.tokenizer.encode(texts[lo + i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            yield lo, out
            lo = hi
        K.release()


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """The encoder of this process, kept from task to task."""
    return ByteEncoder(path)
