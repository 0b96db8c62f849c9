"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A byte-level tokenizer splits a text into pre-tokens by a pattern and encodes each alone, so a document's count is the sum
over its pre-tokens. The leaves of a document's tree hold runs of pre-tokens with their length in characters and tokens;
inner nodes hold sums. :func:`build_trees` lexes and encodes each text once and gives its tree as a row that can be stored.
:func:`apply_edits` takes stored trees and edits: an edit descends to the leaves it touches, lexes again from two
pre-tokens before it until the new boundaries meet the old ones behind it, re-encodes only that, and updates the sums on
the way up. Nothing else of the document is lexed or encoded again, and the row that comes back can be edited further.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.shared import bound_batches, stash

#: A stored tree: the text, characters and tokens of each pre-token, and pre-tokens of each leaf.
TREE = "doc_id long, text string, chars binary, tokens binary, leaves binary, n_pieces long, n_tokens long"
COUNTED = "n_tokens_before long, n_edits long, n_chars long, n_reencoded long"
EDITS = "array<struct<start: int, end: int, text: string>>"
#: Characters by which a pre-token's match can look past its end.
LOOK_AHEAD = 3


@dataclass(frozen=True)
class TokenCounts:
    """``tokenizer``: a file of base64 tokens and ranks; ``pattern``: the pre-token pattern, which must be free of memory from match to match."""

    tokenizer: str
    pattern: str
    leaf: int = 64


class Lexer:
    """Pre-tokens and their token counts; counts are remembered up to a bound."""

    def __init__(self, conf: TokenCounts):
        import regex
        import tiktoken

        with open(conf.tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(conf.pattern).finditer
        self.match = regex.compile(conf.pattern).match
        self.split = regex.compile(conf.pattern).findall
        self.encoding = tiktoken.Encoding("counts", pat_str=conf.pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > 500_000:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


_lexers: dict[TokenCounts, Lexer] = {}


def lexer(conf: TokenCounts) -> Lexer:
    if conf not in _lexers:
        _lexers[conf] = Lexer(conf)
    return _lexers[conf]


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers as bytes of the width that the largest needs; the first byte is that width."""
    width = 1 if not len(x) or x.max() < 1 << 8 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack_numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


class SegmentTree:
    """Leaves of up to ``2 * leaf`` pre-tokens; sums of characters and tokens above them, in an implicit binary tree.

    A leaf that no edit has touched is the number of a stretch of the stored text, and its pre-tokens are not taken apart.
    """

    def __init__(self, text: str, conf: TokenCounts, chars: np.ndarray, tokens: np.ndarray, sizes: np.ndarray):
        self.lexer, self.size = lexer(conf), conf.leaf
        self.source, self.piece_chars, self.piece_tokens = text, chars, tokens
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.place = np.concatenate([[0], np.cumsum(chars)])
        self.leaves: list[list[str] | int] = list(range(len(sizes)))
        self.reencoded = 0
        total = np.concatenate([[0], np.cumsum(tokens)])
        self._build(np.diff(self.place[self.first]).tolist(), np.diff(total[self.first]).tolist())

    @classmethod
    def of(cls, text: str, conf: TokenCounts) -> SegmentTree:
        """The tree of a text that is lexed and encoded for the first time."""
        own = lexer(conf)
        pieces = own.split(text)
        sizes = np.full(max(1, -(-len(pieces) // conf.leaf)), conf.leaf, np.int64)
        sizes[-1] = len(pieces) - conf.leaf * (len(sizes) - 1)
        return cls(text, conf, np.array([len(p) for p in pieces], np.int64), np.array([own.count(p) for p in pieces], np.int64), sizes)

    def row(self) -> tuple[str, bytes, bytes, bytes, int, int]:
        """What :data:`TREE` stores, all but the id."""
        chars, tokens, sizes = [], [], []
        for leaf in self.leaves:
            own = slice(self.first[leaf], self.first[leaf + 1]) if isinstance(leaf, int) else None
            chars.append(self.piece_chars[own] if own else np.array([len(p) for p in leaf], np.int64))
            tokens.append(self.piece_tokens[own] if own else np.array([self.lexer.count(p) for p in leaf], np.int64))
            sizes.append(len(chars[-1]))
        return (self.text(), *(pack_numbers(x) for x in (np.concatenate(chars), np.concatenate(tokens), np.array(sizes))), sum(sizes), self.total())

    def leaf(self, i: int) -> list[str]:
        """A leaf's pre-tokens."""
        k = self.leaves[i]
        if isinstance(k, int):
            bounds = self.place[self.first[k] : self.first[k + 1] + 1].tolist()
            self.leaves[i] = k = [self.source[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return k

    def _sums(self, leaf: list[str]) -> tuple[int, int]:
        return sum(map(len, leaf)), sum(map(self.lexer.count, leaf))

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        rest = [0] * (self.width - len(chars))
        self.chars, self.tokens = [0] * self.width + chars + rest, [0] * self.width + tokens + rest
        for i in range(self.width - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def length(self) -> int:
        return self.chars[1]

    def __len__(self) -> int:
        """Pre-tokens of all leaves."""
        return sum(int(self.first[k + 1] - self.first[k]) if isinstance(k, int) else len(k) for k in self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf; the last leaf for the text's end."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def text(self) -> str:
        whole = lambda k: self.source[self.place[self.first[k]] : self.place[self.first[k + 1]]]
        return "".join(whole(leaf) if isinstance(leaf, int) else "".join(leaf) for leaf in self.leaves)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end`` by ``new``; places are clipped to the text."""
        start = min(max(start, 0), self.length())
        end = min(max(end, start), self.length())
        at, before = self._leaf_at(max(start - LOOK_AHEAD - 1, 0))
        # whole pre-tokens that cannot see the edit stay; two more are lexed again
        kept, place = 0, before
        for piece in self.leaf(at):
            if place + len(piece) + LOOK_AHEAD > start:
                break
            place += len(piece)
            kept += 1
        back = min(kept, 2)
        place -= sum(map(len, self.leaf(at)[kept - back : kept]))
        kept -= back
        if not kept and at and place > 0:
            # the leaf's first pre-tokens are lexed again, so its predecessor's last ones are as well
            at -= 1
            kept = max(len(self.leaf(at)) - 2, 0)
            place -= sum(map(len, self.leaf(at)[kept:]))
        first, head = at, self.leaf(at)[:kept]
        old, leaf, j = [], at, kept
        covered, lexed, tail, done = place, [], [], False

        def more(upto: int) -> None:
            """Take old pre-tokens until they reach ``upto``."""
            nonlocal leaf, j, covered
            while covered < upto and leaf < len(self.leaves):
                if j == len(self.leaf(leaf)):
                    leaf, j = leaf + 1, 0
                    continue
                old.append(self.leaf(leaf)[j])
                covered += len(old[-1])
                j += 1

        more(end)
        step = 64
        while not done:
            more(covered + step)
            step *= 2
            while leaf < len(self.leaves) and j == len(self.leaf(leaf)):
                leaf, j = leaf + 1, 0
            last = leaf >= len(self.leaves)
            was = "".join(old)
            text = was[: start - place] + new + was[end - place :]
            shift = len(new) - (end - start)
            bounds, at_old = set(), place
            for piece in old:
                at_old += len(piece)
                bounds.add(at_old)
            lexed, pos, meet = [], 0, None
            for m in self.lexer.find(text):
                lexed.append(m.group())
                pos = m.end()
                if place + pos - shift >= end + 1 and place + pos >= start + len(new) and (place + pos - shift) in bounds and pos + LOOK_AHEAD + 1 <= len(text):
                    meet = place + pos - shift
                    break
            if meet is not None or last:
                done = True
                if meet is not None:
                    at_old = place
                    for piece in old:
                        if at_old >= meet:
                            tail.append(piece)
                        at_old += len(piece)
        self.reencoded += len(lexed)
        rest = self.leaf(leaf)[j:] if leaf < len(self.leaves) else []
        merged = head + lexed + tail + rest
        stop = min(leaf + 1, len(self.leaves))
        parts = [merged[i : i + self.size] for i in range(0, len(merged), self.size)] if len(merged) > 2 * self.size * (stop - first) else None
        if parts is None and stop - first >= 1:
            n = stop - first
            step = -(-len(merged) // n) if merged else 0
            parts = [merged[i * step : (i + 1) * step] for i in range(n)]
            self.leaves[first:stop] = parts
            nodes = set()
            for i in range(first, stop):
                self.chars[self.width + i], self.tokens[self.width + i] = self._sums(self.leaf(i))
                nodes.add((self.width + i) // 2)
            while nodes and nodes != {0}:
                for i in nodes:
                    self._pull(i)
                nodes = {i // 2 for i in nodes}
        else:  # the edit made many new leaves
            chars, tokens = (x[self.width : self.width + len(self.leaves)] for x in (self.chars, self.tokens))
            new_chars, new_tokens = zip(*map(self._sums, parts), strict=True)
            self.leaves[first:stop], chars[first:stop], tokens[first:stop] = parts, new_chars, new_tokens
            self._build(chars, tokens)


def build_trees(documents: DataFrame, conf: TokenCounts) -> DataFrame:
    """The tree of each row of ``documents`` (doc_id, text): see :data:`TREE`. A null text is an empty one; repeated rows and rows
    without an id each get their tree; further columns are ignored."""
    bound_batches(documents)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [SegmentTree.of(text or "", conf).row() for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True))], names=_NAMES)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TREE)


_NAMES = [x.split()[0] for x in TREE.split(", ")]
_TYPES = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def apply_edits(trees: DataFrame, conf: TokenCounts, store: bool = True) -> DataFrame:
    """Per row of ``trees`` (:data:`TREE`, and edits: :data:`EDITS`): the edited tree (only its id and numbers without ``store``),
    n_tokens_before, n_edits, n_chars, n_reencoded. A table of edits by document is joined by the caller.

    Edits are applied in order, each to the text that the ones before left; places are code points and are clipped to
    that text. ``n_reencoded`` counts the pre-tokens that edits had encoded again. A null list is no edit, a null place or
    text in an edit counts as 0 or empty.
    """
    bound_batches(trees)
    kept = _NAMES if store else ["doc_id", "n_pieces", "n_tokens"]
    added = [x.split()[0] for x in COUNTED.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for text, chars, tokens, leaves, edits in zip(*(part.column(i).to_pylist() for i in range(1, 6)), strict=True):
                    tree = SegmentTree(text or "", conf, *map(unpack_numbers, (chars, tokens, leaves)))
                    before = tree.total()
                    for e in edits or []:
                        if e is not None:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                    own = tree.row() if store else (len(tree), tree.total())
                    rows.append((*own, before, len(edits or []), tree.length(), tree.reencoded))
                types = (_TYPES if store else _TYPES[-2:]) + [pa.int64()] * len(added)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names=kept + added)

    schema = TREE if store else "doc_id long, n_pieces long, n_tokens long"
    return trees.select("doc_id", "text", "chars", "tokens", "leaves", "edits").mapInArrow(run, f"{schema}, {COUNTED}")


def count_edited(documents: DataFrame, conf: TokenCounts) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after, n_reencoded, n_pieces, of the
    edits that :func:`revision` derives from the text. Trees are stored once; edits are applied to what was stored."""
    trees = stash(build_trees(documents, conf), compression="zstd")
    out = apply_edits(trees.withColumn("edits", revision(F.col("text"))), conf, store=False)
    return out.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), F.col("n_chars").alias("n_chars_after"), "n_reencoded", "n_pieces")


def revision(text: Column) -> Column:
    """An edit script that follows from a text: a note goes in front, a stretch in the middle is replaced by the text's first
    characters, and the last tenth is cut off."""
    n = F.length(F.coalesce(text, F.lit("")))
    edit = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), t.alias("text"))
    note = F.lit("Revised. ")
    half = (n / 2).cast("int")
    return F.array(
        edit(F.lit(0), F.lit(0), note),
        edit(half + 9, half + 41, F.substring(F.coalesce(text, F.lit("")), 1, 48)),
        edit((n * 0.9).cast("int") + 9, n + 1024, F.lit(".")),
    )
