"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm.collocations import collocations
from framewell.llm.decontaminate import decontaminate
from framewell.llm.licenses import scan
from framewell.llm.near_dedup import near_duplicates
from framewell.llm.packing import Packing, pack_documents
from framewell.llm.periodic_runs import periodic_runs
from framewell.llm.pii import KINDS, find, listed
from framewell.llm.quality import score
from framewell.llm.search import top_k
from framewell.llm.shared import shared_folder
from framewell.llm.squares_packing import SquaresPacking, pack_squares
from framewell.llm.substring_dedup import remove_repeats
from framewell.llm.suffix_automaton import remove_reference
from framewell.llm.token_counts import TokenCounts, count_edited
from framewell.llm.warc import read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS shingle
  FROM tokens
), sizes AS (
  SELECT t.doc_id, count(s.shingle) AS n FROM tokens t LEFT JOIN shingles s USING (doc_id) GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, s.n AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept FROM sizes s JOIN reach r USING (doc_id) GROUP BY 1, 2
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH heads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM heads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM firsts
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Packing(public_tokenizers.path("word_bpe_49k.json")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), contaminated().alias("contaminated"))


def contaminated() -> Column:
    return F.expr("n_hit > 0 AND 20 * n_hit >= n_words")


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
  SELECT p.doc_id, p.i, p.k, x.item_id FROM places p JOIN windows x ON p.k = x.k AND p.phrase = x.phrase
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY 1
), matched AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN matched USING (doc_id)
"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    conf = TokenCounts(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return count_edited(docs, conf)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), places AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), repeated AS (
  SELECT h FROM places GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM places SEMI JOIN repeated USING (h)
), lists AS (
  SELECT doc_id, count(*) AS n, list(j) AS js FROM gone GROUP BY 1
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words) ANTI JOIN gone USING (doc_id, j) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def reference_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without passages of the benchmark, by suffix automata of its shards."""
    return remove_reference(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


REFERENCE_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), listed AS (
  SELECT list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), known AS (
  SELECT DISTINCT sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT w, unnest(range(1, len(w) - 33)) AS i FROM listed WHERE len(w) >= 35)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)) SEMI JOIN known USING (h)
), lists AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY 1
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words) ANTI JOIN gone USING (doc_id, j) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return top_k(docs, docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"))


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), stats AS (
  SELECT count(*) AS n, avg(len(w)) AS mean FROM docs
), postings AS (
  SELECT doc_id, any_value(size) AS size, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS word FROM docs) GROUP BY doc_id, word
), idfs AS (
  SELECT word, ln(1 + (max(n) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM postings, stats GROUP BY word
), asked AS (
  SELECT doc_id AS query_id, word, idf FROM postings JOIN idfs USING (word) WHERE doc_id % 20 = 0
), scored AS (
  SELECT query_id, doc_id, round(sum(idf * (tf * 2.2e0 / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * size / mean)))), 9) AS score FROM asked JOIN postings USING (word), stats GROUP BY 1, 2
)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10
"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True, detail=False)


OP11_SQL = r"""
WITH given AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substring(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)) AS digits
  FROM documents
), hashed AS (
  SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), digits),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) AS h
  FROM given
), cut AS (
  SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS changed, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM hashed
), docs AS (
  SELECT doc_id, n, CASE WHEN changed THEN list_concat(w[1:a], list_transform(range(0, n - a), lambda i: w[a + 1 + i % (1 + (n - a) // (3 + g % 8))])) ELSE w END AS v FROM cut
), grams AS (
  SELECT doc_id, n, i, array_to_string(v[i:i + 4], ' ') AS gram FROM (SELECT doc_id, n, v, unnest(range(1, n - 3)) AS i FROM docs WHERE n >= 6)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) - 1 AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM runs) WHERE k = 1
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY 1
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(v) AS word, unnest(range(0, n)) AS i FROM docs) ANTI JOIN dropped USING (doc_id, i) GROUP BY 1
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY 1
), counts AS (
  SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, k, p, f AS a, unnest(range(1, k)) AS cut FROM counts WHERE k > 1
), scored AS (
  SELECT c.*, l.f AS l, r.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.p = c.p[1:c.cut] JOIN counts r ON r.lang = c.lang AND r.p = c.p[cut + 1:c.k]
), lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS o FROM scored) WHERE o = 1
), inside AS (
  SELECT lang, p[i:i + m - 1] AS p, max(f) AS f
  FROM (SELECT lang, p, f, m, unnest(range(1, k - m + 2)) AS i FROM counts, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY 1, 2
), ranked AS (
  SELECT x.lang AS lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, array_to_string(x.p, ' ')) AS rank, array_to_string(x.p, ' ') AS phrase, a, l, r, score
  FROM lowest x LEFT JOIN inside y ON x.lang = y.lang AND x.p = y.p WHERE y.f IS NULL OR 100 * CAST(y.f AS HUGEINT) < 80 * CAST(a AS HUGEINT)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


def op13_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_squares(spark.read.parquet(f"{sf_dir}/documents.parquet"), SquaresPacking(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES: dict[str, Query] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_licenses": op5_licenses,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_search": op10_search,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_squares_packing": op13_squares_packing,
    "reference_passages": reference_passages,
}
ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op10_search": OP10_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "reference_passages": REFERENCE_SQL,
}
