"""Sum-of-squares packing against the tokenizer, the layout's rules and a plain search for the best level."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from framewell.llm.byte_tokens import ByteEncoder
from framewell.llm.squares_packing import SquaresPacking, Windows, pack_squares

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, sequence_id string, ids string"


def test_ids_equal_those_of_the_tokenizer() -> None:
    random.seed(7)
    parts = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", " ", " ", "　", "'", "s", "ll", "1", "23", "½", "٣", ".", "-", "_", "\x00", "\x1f", "\x85", "文", "😀", "'ve", "don't", "<|endoftext|>", "\r\n"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(5000)]
    found = [ids for _, some in ByteEncoder(PATH).column(pa.array(texts)) for ids in some]
    plain = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_level_is_the_one_of_the_smallest_sum_of_squares() -> None:
    random.seed(3)
    windows = Windows(64)
    for _ in range(2000):
        size = random.choice([1, 7, 20, 21, 40, 63])
        before, best = windows.counts.copy(), None
        for level in range(64 - size, -1, -1):
            if level and not before[level]:
                continue
            after = before.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 64
            cost = int((after[1:64] ** 2).sum())
            best = min(best or (cost, -level), (cost, -level))
        assert windows.level_for(size) == -best[1]
        windows.put((0, 0, np.zeros(size, np.uint32), size))
    assert windows.open == windows.counts.sum()


def check(rows: list, texts: list, length: int) -> None:
    """``rows`` of :func:`pack_squares` with ids, for documents numbered by their place in ``texts``."""
    plain, by_doc, by_sequence = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        mine = sorted(by_doc[i], key=lambda r: r.start)
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        assert b"".join(bytes(r.ids) for r in mine) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1].tolist()]
        assert {r.doc_tokens for r in mine} == {len(ids)}
    for mine in by_sequence.values():
        mine.sort(key=lambda r: r.offset)
        assert [r.offset for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1].tolist()]
        total = sum(r.length for r in mine)
        assert total <= length and total & (total - 1) == 0


@pytest.mark.parametrize("open_windows", [4096, 3])
def test_pieces_and_sequences(spark, open_windows: int) -> None:
    random.seed(5)
    words = ["alpha", "of", "the", "naïve", "x1", "don't", "\n"]
    texts = [None, "", " ", "one", "one", *(" ".join(random.choice(words) for _ in range(random.choice([1, 3, 40, 63, 64, 300, 1500]))) for _ in range(150))]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    conf = SquaresPacking(PATH, length=128, open_windows=open_windows)
    found = pack_squares(docs, conf, with_ids=True)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = found.collect()
    check(rows, texts, 128)
    if open_windows > 3:
        cut = sum(r.length < min(128, r.doc_tokens - r.start) for r in rows)
        assert cut <= 3 * (len(Windows(128).counts) // 2), "documents are cut only to fill windows and at the end of a task"


def test_edges(spark) -> None:
    conf = SquaresPacking(PATH)
    assert pack_squares(spark.createDataFrame([], SCHEMA), conf).collect() == []
    rows = pack_squares(spark.createDataFrame([(None, "a b", None, None), (4, "a b", None, None), (4, "a b", None, None)], SCHEMA).coalesce(1), conf).collect()
    assert sum(r.length for r in rows) == 9 and sum(r.length for r in rows if r.doc_id is None) == 3 and {r.doc_tokens for r in rows} == {3}
    long = pack_squares(spark.createDataFrame([(1, "word " * 40_000, None, None)], SCHEMA), conf, with_ids=True).collect()
    assert sum(r.length for r in long) == long[0].doc_tokens and max(r.length for r in long) == 2048
