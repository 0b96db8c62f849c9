"""Token ids of whole texts by the public ``word_bpe_49k`` tokenizer, a distinct word at a time.

The tokenizer splits at white space and at changes between letters, digits and other signs, and then encodes each such
unit on its own. So a task encodes each distinct unit once and gathers the ids of whole blocks of text with numpy. Texts
are only cut where a cut cannot change the ids (see :func:`units`); a text that holds a special token's string goes
through the tokenizer whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from framewell.llm import kernels as K

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[0x21:0x7F] = True
_SIGN &= ~_LETTER & ~_DIGIT
#: Second bytes of the letters from U+00C0 to U+00FF, all but the signs U+00D7 and U+00F7.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_KNOWN_LIMIT = 1_000_000


def units(data: np.ndarray, offsets: np.ndarray, lo: int) -> K.Words:
    """Parts of texts that can be encoded alone: cut at ASCII white space, around ASCII digits, where a letter is followed
    by an ASCII sign, and where an ASCII sign other than an apostrophe is followed by a letter. Letters are those of
    ASCII and Latin-1; next to any other character nothing is cut."""
    found = K.words(data, offsets, K.NON_SPACE, lo)
    data = found.data
    if not len(data):
        return found
    letter, digit, sign = _LETTER[data], _DIGIT[data], _SIGN[data]
    tail = np.zeros(len(data), dtype=bool)
    tail[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    head = np.zeros(len(data), dtype=bool)
    head[:-1] = tail[1:]
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = digit[1:] | digit[:-1] | ((letter | tail)[:-1] & sign[1:]) | (sign[:-1] & (data[:-1] != 0x27) & (letter | head)[1:])
    cut &= K.NON_SPACE[data]
    cut[found.start] = True
    start = np.flatnonzero(cut)
    end = np.empty_like(start)
    end[:-1] = start[1:]
    end[-1:] = len(data)
    word = np.searchsorted(found.start, start, side="right") - 1
    end = np.minimum(end, found.end[word])
    return K.Words(data, start, end, np.searchsorted(start, offsets - offsets[0]), lo)


class Encoder:
    """Ids of texts for one task; remembers the units it has met, up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level BPE shows these bytes as they are, others from U+0100 on
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=K.U64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _encode(self, unit: bytes) -> list[int]:
        text = unit.decode("utf-8")
        if text.isascii():
            if text.isalpha() or all(0x21 <= b < 0x7F and not _LETTER[b] and not _DIGIT[b] for b in unit) or (len(unit) == 1 and text.isdigit()):
                return [t.id for t in self.model.tokenize(text.lower())]
        elif all("À" <= c <= "ÿ" and c not in "×÷" or c.isascii() and c.isalpha() for c in text):
            return [t.id for t in self.model.tokenize("".join(self.shown[b] for b in text.lower().encode()))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        if len(self.known) > _KNOWN_LIMIT:
            self._forget()
        lists = [self._encode(x) for x in parts]
        size = np.array([len(x) for x in lists], dtype=np.int64)
        first = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.ids = np.concatenate([self.ids, np.array([i for x in lists for i in x], dtype=np.uint32)])
        known, first, size = np.concatenate([self.known, hashes]), np.concatenate([self.first, first]), np.concatenate([self.size, size])
        order = np.argsort(known, kind="stable")
        self.known, self.first, self.size = known[order], first[order], size[order]

    def encode_block(self, block: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the block's texts, and ``first`` of them by text."""
        hashes = block.hashes(fold=True)
        codes, distinct = pd.factorize(hashes)
        at = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            place = np.empty(len(distinct), np.int64)
            place[codes[::-1]] = np.arange(len(codes))[::-1]
            raw = block.data.tobytes()
            if len(self.known) > _KNOWN_LIMIT:
                new = np.arange(len(distinct))
            self._learn(distinct[new], [raw[block.start[p] : block.end[p]] for p in place[new].tolist()])
            at = np.searchsorted(self.known, distinct)
        size = self.size[at][codes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.first[at][codes] - (ends - size), size) + np.arange(total)] if total else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], ends])[block.first]

    def column(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For each block of texts: its first row and each text's ids."""
        data, offsets = K.buffers(texts)
        odd = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            odd |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        lo, n = 0, len(texts)
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + K.BLOCK_BYTES, side="right")) - 1))
            ids, first = self.encode_block(units(data, offsets[lo : hi + 1], lo))
            out = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            for i in np.flatnonzero(odd[lo:hi]).tolist():
                out[i] = np.array(self.tokenizer.encode(texts[lo + i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            yield lo, out
            lo = hi
        K.release()
