"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, against brute force where it is short."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from framewell.llm import decontaminate, licenses, near_dedup, packing, pii, quality, search, substring_dedup, token_counts, warc
from framewell.llm.near_dedup import NearDedup
from pyspark.sql import functions as F

LINE = " ".join(f"w{i} x{i % 7}" for i in range(60))
NEAR = LINE.replace("w59", "other")
TEXTS = [(1, LINE), (2, NEAR), (3, LINE), (3, LINE), (4, None), (5, ""), (6, " \n\t"), (7, "one two"), (8, "One  TWO"), (None, LINE), (9, "a " * 5000), (10, "x" * 20000), (11, "mail me at joe@example.com or +1 (212) 555-0100, 10.0.0.1, 4111 1111 1111 1111. Released under the MIT License.")]
SCHEMA = "doc_id long, text string, n_shingles int, score string, spans int, start int, label string, kind string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "s", 1, 2, "l", "k") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_dedup(docs, none):
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    n = 116
    assert out[0] == (0, n, 1, False)
    assert out[1:5] == [(1, n, 1, True), (2, n, 1, False), (3, n, 1, False), (3, n, 1, False)]
    assert out[5:8] == [(4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert out[8:10] == [(7, 1, 7, True), (8, 1, 7, False)]
    assert near_dedup.near_duplicates(none).count() == 0


def near_copies(n, seed=4, share=0.02):
    """Texts of which some are near copies of each other and others just fall short of it."""
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(150)]
    return [(i, " ".join(w if rng.random() > share * (i % 4) else f"r{rng.integers(1 << 40)}" for w in base)) for i in range(n)]


def components(rows):
    """The smallest id that each row reaches, by comparing all pairs."""
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(len(rows)))

    def root(a):
        while label[a] != a:
            label[a] = label[label[a]]
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {rows[a][0]: rows[root(a)][0] for a in range(len(rows))}


def test_near_dedup_finds_all_links_of_a_large_group(spark):
    rows = near_copies(60)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for conf in (NearDedup(), NearDedup(block=16), NearDedup(block=7, rounds=0), NearDedup(block=4, rounds=1), NearDedup(block_bytes=9000)):
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame, conf).collect()} == components(rows)


def test_near_dedup_recall_near_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.8, each with nothing else to be linked by: none of 300 is missed, none below is linked."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        words = [f"p{i}w{j}" for j in range(240)]
        other = words.copy()
        for j in rng.choice(np.arange(0, 240, 5), rng.integers(5, 9), replace=False):
            other[j] = f"q{i}w{j}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = {}
    for (a, x), (b, y) in zip(rows[::2], rows[1::2], strict=True):
        p, q = ({tuple(t.split()[k : k + 5]) for k in range(236)} for t in (x, y))
        want |= {a: a, b: a if 100 * len(p & q) >= 75 * len(p | q) else b}
    assert sum(want[2 * i + 1] == 2 * i for i in range(400)) > 100
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_near_dedup_rows_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    """Twice the near copies give about twice the rows of any stored table while a list fits a block, as it does with the
    production block. Beyond it a member is there once for each block of members outside the largest component, and
    once for each block of all members if it is one of those."""
    from framewell.llm import components as C

    real = near_dedup.stash

    def largest(n, conf):
        sizes = []

        def stash(df, **kwargs):
            out = real(df, **kwargs)
            sizes.append(out.count())
            return out

        for module in (near_dedup, C):
            monkeypatch.setattr(module, "stash", stash)
        near_dedup.near_duplicates(spark.createDataFrame(near_copies(n, share=0.025), "doc_id long, text string"), conf).count()
        return max(sizes)

    small, large = largest(150, NearDedup()), largest(300, NearDedup())
    assert large <= 2.5 * small
    blocks = -(-300 // 64)
    assert largest(300, NearDedup(block=64)) <= large * 2 * blocks


def test_near_dedup_links_rows_without_an_id_and_rows_that_share_one(spark):
    base, other = near_copies(1)[0][1], "something else of more than five words"
    near = [base, base.replace("t149", "changed")]
    rows = [(None, near[0]), (None, near[1]), (7, other), (7, near[1] + " end"), (8, None)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r.doc_id, r.n_shingles): (r.component_id, r.kept, r.linked, r.first) for r in out}
    assert by == {(None, 146): (7, False, True, False), (7, 3): (7, True, False, True), (7, 147): (7, True, True, True), (8, 0): (8, True, False, True)}
    alone = near_dedup.near_duplicates(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert [(r.component_id, r.kept, r.linked) for r in alone] == [(None, True, True)] * 2 and sum(r.first for r in alone) == 1


def test_words_of_the_thue_morse_kind_differ(spark):
    """Words that a polynomial modulo a power of two can't tell apart are different words to every operator."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    tail = " ".join(f"k{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, a), (4, b)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}[4] == 4
    one = substring_dedup.remove_repeats(docs.filter("doc_id < 3"), substring_dedup.SubstringDedup(41, 8)).collect()
    assert [r.n_removed for r in one] == [0, 0]
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    for r in packing.pack_documents(docs, packing.Packing(path, length=1 << 16)).collect():
        ids = [*Tokenizer.from_file(path).encode({1: f"{a} {tail}", 2: f"{b} {tail}", 3: a, 4: b}[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    found = decontaminate.decontaminate(docs, spark.createDataFrame([(1, a)], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_hit for r in found} == {1: 1, 2: 0, 3: 1, 4: 0}
    hits = search.top_k(docs, spark.createDataFrame([(1, a)], "query_id long, text string")).collect()
    assert sorted(r.doc_id for r in hits) == [1, 3]


def test_warc(spark, tmp_path):
    long = "<p>" + "é" * 300 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"
    data = [(3, "http://a", long), (1, "http://b\r\nX: y", long), (1, "http://b", long), (2, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", long)]
    pages = spark.createDataFrame([(*r, 7) for r in data], "page_id long, url string, html string, refers_to int")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = sorted(((r.page_id or 0, r.record_type, r.payload_bytes, r.refers_to, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()), key=str)
    raw = long.encode()
    d, s, e = (hashlib.sha256(x).hexdigest() for x in (raw, b"short", b""))
    want = [(0, "revisit", len(raw), 1, d), (1, "response", len(raw), None, d), (1, "response", len(raw), None, d), (2, "response", 5, None, s), (3, "revisit", len(raw), 1, d), (4, "response", 5, None, s), (5, "response", 0, None, e)]
    assert got == sorted(want, key=str)
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_packing(docs, none, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["it's 'tis don't''s", "naïve café.É,é!’s “x”", "12a 3'4 ½x²", "<|endoftext|> a<|startoftext|>b", "a b c\x1cd", "日本語。テスト!!", "é ≮ İI ſ"]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    out = packing.pack_documents(both, packing.Packing(path, length=64, open_bins=4), with_ids=True).collect()
    tok = Tokenizer.from_file(path)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in [*TEXTS, *((100 + i, t) for i, t in enumerate(odd))]}
    for r in out:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert (r.start, r.ids_crc32, bytes(r.ids)) == (64 * r.piece, zlib.crc32(part), part)
    assert sum(r.length for r in out) == sum(len(ids[i]) for i, _ in [*TEXTS, *((100 + i, t) for i, t in enumerate(odd))])
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, packing.Packing(path)).count() == 0


def test_decontamination(docs, none, spark):
    words = LINE.split()
    items = [(1, " ".join(words[10:40])), (1, " ".join(words[10:40])), (2, "One two"), (3, None), (None, "nothing of it"), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (1 << 20, 40):  # one block, several
        out = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(docs, bench, decontaminate.Decontamination(block_chars=chars)).collect()}
        assert (out[1, 120].n_hit, out[1, 120].n_items, out[1, 120].items) == (30, 1, ["1"])
        assert out[None, 120].n_hit == 30 and out[7, 2].items == ["2"] and out[4, 0].n_hit == out[5, 0].n_hit == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.decontaminate(none, bench).count() == 0


def test_proximity(spark):
    text = " ".join(f"q{i}" for i in range(13))
    moved = text.replace("q5 q6", "q5 new q6")
    out = decontaminate.decontaminate(spark.createDataFrame([(1, moved), (2, text)], "doc_id long, text string"), spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert {r.doc_id: (r.n_hit, r.n_near > 0) for r in out.collect()} == {1: (0, True), 2: (13, False)}


def test_licenses(docs, none, spark):
    out = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (out[11].n_base, out[11].base_labels, out[11].labels, out[11].score) == (1, "mit", "mit", 1.0)
    assert (out[4].n_words, out[4].first_word, out[4].labels, out[4].score) == (0, None, "", 0.0)
    assert licenses.scan(docs).count() == len(TEXTS) and licenses.scan(none).count() == 0
    bent = "x Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction y"
    made = licenses.scan(spark.createDataFrame([(1, bent), (2, "CC-BY cc; by apache\nlicense"), (3, "the apache a license")], "doc_id long, text string"))
    again = licenses.scan(spark.createDataFrame([(1, "dedicated to the dedicated to the dedicated to the public domain under")], "doc_id long, text string")).first()
    assert again.labels == "" and again.score == 0.0  # a template's place counts once
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.labels) for r in made.collect()}
    assert got == {1: (0, None, None, "mit"), 2: (3, 0, 4, "apache,cc-by"), 3: (0, None, None, "")}


def test_substring_dedup(docs, none):
    def plain(rows, size):
        seen, lists = {}, [(t or "").split() for _, t in rows]
        for w in lists:
            for k in range(len(w) - size + 1):
                seen[tuple(w[k : k + size])] = seen.get(tuple(w[k : k + size]), 0) + 1
        for (i, _), w in zip(rows, lists, strict=True):
            gone = {j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
            yield (i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())

    for size, gram in ((35, 8), (12, 4)):
        out = substring_dedup.remove_repeats(docs, substring_dedup.SubstringDedup(size, gram)).drop("spans").collect()
        assert sorted(map(str, map(tuple, out))) == sorted(map(str, plain(TEXTS, size)))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_quality_on_held_out_labels(spark):
    from tests.conftest import DATA

    data = DATA.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality.score(d, labels).filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_quality_edges(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (99, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [True]
    assert quality.score(docs, labels.limit(0)).count() == len(TEXTS) and quality.score(none, labels).count() == 0


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, quality.N_FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.fit(x, first, y, quality.Quality(epochs=1))
    loss = lambda: float(-np.mean(y * np.log(s := model.forward(x, first)["score"]) + (1 - y) * np.log(1 - s)))
    for name, grad in model.gradient(x, first, y).items():
        p, at = model.p[name], tuple(0 for _ in model.p[name].shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grad[at], abs=1e-5)


def test_token_counts(docs, none):
    conf = token_counts.TokenCounts(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, leaf=8)
    count = lambda t: len(token_counts.lexer(conf).encoding.encode_ordinary(t))
    out = token_counts.count_edited(docs.withColumn("edits", token_counts.revision(F.col("text"))), conf).collect()
    want = []
    for i, t in TEXTS:
        t = t or ""
        new, half, n = "Revised. " + t, len(t) // 2, len(t)
        new = new[: half + 9] + t[:48] + new[half + 41 :]
        cut = min(int(n * 0.9) + 9, len(new))
        new = new[:cut] + "."
        want.append((i, count(t), count(new), len(new)))
    assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_after, r.n_chars_after) for r in out), key=str) == sorted(want, key=str)
    nine = next(r for r in out if r.doc_id == 9)
    assert nine.n_reencoded < nine.n_tokens / 2
    assert token_counts.count_edited(none.withColumn("edits", token_counts.revision(F.col("text"))), conf).count() == 0


def test_token_counts_after_random_edits():
    import random

    conf = token_counts.TokenCounts(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, leaf=4)
    rng, alphabet = random.Random(2), ["a", "Ab", " ", "  ", "\n", "'s", "'ll", "'", "1", "22", "é", "!", "...", "\t", " x"]
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    for _ in range(400):
        text = make(60)
        tree = token_counts.SegmentTree.of(text, conf)
        for _ in range(4):
            a = rng.randint(0, len(text) + 1)
            b, new = a + rng.choice([0, 0, 1, 3, 10]), make(6)
            tree.edit(a, b, new)
            a = min(a, len(text))
            text = text[:a] + new + text[min(max(b, a), len(text)) :]
            assert tree.text() == text and tree.total() == len(tree.lexer.encoding.encode_ordinary(text))
            if rng.random() < 0.5:  # stored and loaded in between
                stored = tree.row()
                assert stored[5] == tree.total()
                tree = token_counts.SegmentTree(stored[0], conf, *map(token_counts.unpack_numbers, stored[1:4]))


def test_edited_trees_can_be_edited_again(spark):
    conf = token_counts.TokenCounts(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, leaf=4)
    docs = spark.createDataFrame([(1, "one two three four five six seven " * 20), (2, None), (3, "x")], "doc_id long, text string")
    edits = lambda start, end, new: spark.createDataFrame([(1, [(start, end, new), None]), (2, [(None, None, "new")]), (3, None)], f"doc_id long, edits {token_counts.EDITS}")
    once = token_counts.apply_edits(token_counts.build_trees(docs, conf).join(edits(10, 20, "TEN"), "doc_id"), conf)
    twice = token_counts.apply_edits(once.join(edits(300, 310, ""), "doc_id"), conf).orderBy("doc_id").collect()
    text = "one two three four five six seven " * 20
    text = text[:10] + "TEN" + text[20:]
    text = text[:300] + text[310:]
    count = token_counts.lexer(conf).encoding.encode_ordinary
    assert [(r.text, r.n_tokens) for r in twice] == [(t, len(count(t))) for t in (text, "newnew", "x")]
    assert twice[0].n_reencoded < 20 < twice[0].n_pieces


RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_pii(docs, none, spark):
    odd = [(200, "a@b.com_x@y.org.uk,@z.com a..b@c-.d é😀 joe@ex.com 1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.1"), (201, "4111-1111-1111-1111 4111111111111112 1 2 3 +12345678 +1 23456789 (0)1."), (202, "1" * 30000 + " " + "a" * 30000), (203, 'token = "0f9e8d7c6b5a49382716051423324150"')]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    out = pii.find(both).select("doc_id", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")).collect()
    assert len(out) == len(TEXTS) + 4
    texts = dict([*TEXTS, *odd])
    for r in out:
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in RULES for m in re.finditer(p, texts[r.doc_id] or "") if _valid(k, m.group())]
        assert r.base == ",".join(want) and set(want) <= set(r.spans.split(",") + [""])
    clean = {r.doc_id: r.text for r in pii.redact(both).collect()}
    assert clean[11] == "mail me at [EMAIL] or [PHONE], [IP], [CARD]. Released under the MIT License."
    assert clean[1] == LINE and clean[4] is None
    assert pii.find(none).count() == 0


def test_search(docs, none):
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    asked = rows.filter("doc_id IN (1, 4, 7)").select(F.col("doc_id").alias("query_id"), "text")
    small = search.top_k(docs, asked, search.Search(k=3, segment_docs=2, query_block=1, block=2)).orderBy("query_id", "rank").collect()
    large = search.top_k(docs, asked, search.Search(k=3)).orderBy("query_id", "rank").collect()
    assert small == large and [r.doc_id for r in large if r.query_id == 7] == [7, 8]
    assert search.top_k(none, asked).count() == 0 and search.top_k(docs, asked.limit(0)).count() == 0


def test_pruned_search_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lists, full = [], {}
        for _ in range(rng.integers(1, 6)):
            docs = np.unique(rng.integers(0, 300, rng.integers(1, 120)))
            impact = np.round(rng.random(len(docs)) * rng.random() * 3, 2) + 0.01
            for d, v in zip(docs.tolist(), impact.tolist(), strict=True):
                full[d] = full.get(d, 0.0) + v
            lists.append((docs, impact))
        heads = [np.flatnonzero(np.append(True, np.diff(d // 8) > 0)) for d, _ in lists]
        runs = [((d // 8)[h], np.maximum.reduceat(v, h)) for (d, v), h in zip(lists, heads, strict=True)]
        best = search.TopK(5)
        search.block_max_wand(lists, runs, 8, np.arange(300), best)
        want = sorted(((-round(s, 9), d) for d, s in full.items()))[:5]
        assert sorted((-s, -d) for s, d in best.heap) == want
