"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import math
import re
from collections import Counter

from framewell.llm import licenses, queries, search, shared
from pyspark.sql import functions as F

from tests.conftest import DATA


def bm25(documents, asked, k=10):
    """``(query_id, rank, doc_id, score)`` by all distinct words of each query, one document at a time."""
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    counts = [(i, Counter(words(t))) for i, t in documents]
    df, size = Counter(w for _, c in counts for w in c), [sum(c.values()) for _, c in counts]
    n, mean = len(counts), sum(size) / len(counts)
    idf = {w: math.log(1 + (n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
    for q, text in asked:
        mine, found = set(words(text)), []
        for (i, c), length in zip(counts, size, strict=True):
            score = round(math.fsum(idf[w] * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean))) for w in mine & c.keys()), 9)
            found += [(-score, i)] if score > 0 else []
        yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1))


def same(got, want):
    got = [tuple(r) for r in got]
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(g[3] - w[3]) < 2e-9 for g, w in zip(got, want, strict=True))


def test_search_scores_all_words(spark):
    """The last words of a long query count, for each way in which a segment is searched."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, " ".join(f"w{i}" for i in range(30, 40))), (3, "w39"), (4, "w0 w1 w2 w3 w4 w5 w6 w7"), (5, None), (6, "other"), (6, "w38 w38 W39")]
    asked = [(1, text), (2, "w0 w1"), (3, "nothing"), (4, "w0 w1 w2 w3 w4 w5 w6 w7 w39")]
    docs, queries = (spark.createDataFrame(x, f"{n} long, text string") for x, n in ((rows, "doc_id"), (asked, "query_id")))
    want = list(bm25(rows, asked))
    assert [r[2] for r in want if r[0] == 1] == [1, 2, 4, 6, 3]
    for conf in (search.Search(), search.Search(segment_docs=2, block=2, query_terms=5, at_once=1), search.Search(short=100), search.Search(short=0, common=1)):
        same(search.top_k(docs, queries, conf).orderBy("query_id", "rank").collect(), want)


def test_op10_search_is_the_whole_bm25(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op10_search(spark, DATA).orderBy("query_id", "rank").select("query_id", "rank", "doc_id", F.col("score")).collect()
    same(got, list(bm25(docs, sorted((i, t) for i, t in docs if i % 20 == 0))))


def test_segments_are_dealt_evenly(spark, tmp_path):
    """Tasks come in full rounds of all cores, and no task gets only the end of a file, which has no rows."""
    conf = search.Search()
    assert [search.n_tasks(n, c, conf) for n, c in ((314, 12), (192, 12), (193, 12), (32, 8), (0, 8), (17, 1), (5, 0))] == [24, 12, 24, 8, 8, 2, 1]
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(3000))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    index = shared.stash(search.segments(docs, search.Search(segment_docs=1)), file_rows=1)
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, 20_000)
    try:
        with shared.whole_files(spark):
            held = index.select("n_docs").rdd.glom().map(len).collect()
        assert held == [1] * 8 and spark.conf.get(key) == "20000"
        assert 0 in index.select("n_docs").rdd.glom().map(len).collect(), "as it was"
    finally:
        spark.conf.set(key, before)


def test_licenses_of_one_family(spark):
    """One distinguishing word put in, replaced or left out decides the label."""
    gnu = "This is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3"
    cc = "licensed under a Creative Commons Attribution{} 4.0 International License"
    texts = [gnu.format(x) for x in ("", "Lesser ", "Affero ", "Library ")] + [cc.format(x) for x in ("", "-NonCommercial", "-ShareAlike", "-NoDerivatives")]
    texts.append(f"{gnu.format('Lesser ')}. The rest is {cc.format('')}")
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: ",".join(sorted({s.label for s in r.spans or []})) for r in out}
    assert got == dict(enumerate(["gpl", "lgpl", "agpl", "", "cc-by", "cc-by-nc", "cc-by-sa", "", "cc-by,lgpl"]))
