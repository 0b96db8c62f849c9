"""MinHash near-duplicates through a signature-coordinate inverted join.

Each distinct shingle set is a node and gets a signature of ``coordinates`` minima. A (coordinate, value) pair is a posting
key. Two sets of similarity ``threshold`` agree on ``threshold * coordinates`` keys on average; a pair that collides on
``matches`` keys or more is a candidate and is then confirmed on the full sets.

The join never expands a posting list into all its pairs:

* a node needs ``matches`` keys that other nodes have too, or it has no partner (and, before all coordinates are looked
  at, ``probe_matches`` among the first ``probe``);
* prefix: of a node's common keys, ordered from the rarest, all but the last ``matches - 1`` suffice to meet a partner;
* hubs: each posting list of the prefixes first links its members to one hub, so it gives a pair per member;
* skip merging: the lists of the prefixes that still hold several components are merged. Members of one component skip
  each other, and a pair is looked at only in the list of the first coordinate that both prefixes share. Members with a
  candidate in another component bring their full sets; the task confirms its candidates, those with most collisions
  first, skips what it has connected meanwhile, and only links that connect two components leave it. So a list gives
  fewer rows than it has members.

A passage that very many documents share makes frequent keys, which the prefixes leave out. A list of more than ``block``
members (or ``block_bytes`` of sets) all the same, of near-equal documents, is dealt to several tasks: the members outside
its largest component meet all others, which takes a row per member and block of such members. Where that is more than
rounds over random blocks cost, a row per member and round, some of these go first and connect what they can.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm import kernels as K
from framewell.llm.components import connected
from framewell.llm.shared import bound_batches, keep_ids, small_join, stash

SET = ["n_shingles", "s1", "s2"]
SIGNED = "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, tokens array<long>"
SETS = "node long, keys binary, mask binary, shingles binary"


@dataclass(frozen=True)
class NearDedup:
    """``threshold`` is in hundredths. A pair at the threshold collides on fewer than ``matches`` of ``coordinates`` keys, or
    on fewer than ``probe_matches`` of ``probe``, about once in two million times."""

    words: int = 5
    threshold: int = 75
    coordinates: int = 128
    matches: int = 70
    probe: int = 16
    probe_matches: int = 3
    block: int = 2048
    block_bytes: int = 16 << 20
    #: At most so many rounds over random blocks of lists with more than twice as many blocks outside the largest component.
    rounds: int = 3


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of texts: its first row, the sorted distinct shingle hashes of all its texts, and ``first`` of them by text."""
    for block in K.blocks(column, K.NON_SPACE):
        hashes = block.hashes(fold=True)
        rolled, first = K.grams(block, hashes, k)
        counts = block.counts()
        sets = []
        for i, n in enumerate(counts):
            if n >= k:
                sets.append(np.unique(rolled[first[i] : first[i + 1]]))
            elif n:
                sets.append(K.rolling(hashes[block.first[i] : block.first[i + 1]], int(n), seed=0x5EED))
            else:
                sets.append(np.zeros(0, dtype=K.U64))
        yield block.lo, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, K.U64), np.cumsum(values)])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, K.U64), np.cumsum(values)])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _names(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums that stand for each set."""
    return [_sums(K.mix(values), first), _sums(K.mix(values ^ K.U64(0xD1F)), first)]


def sign(documents: DataFrame, conf: NearDedup) -> DataFrame:
    """Per document: the size of its shingle set, two 64-bit sums that stand for the set, and its posting keys."""
    flips, factors = K.constants(conf.coordinates, 11), K.constants(conf.coordinates, 12)
    salts = K.constants(conf.coordinates, 13)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, values, first in shingle_sets(batch.column(2), conf.words):
                n = len(first) - 1
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                keys = np.zeros((n, conf.coordinates), dtype=K.U64)
                if len(full):
                    for c in range(conf.coordinates):
                        keys[full, c] = np.minimum.reduceat((values ^ flips[c]) * factors[c], first[full])
                    keys = K.mix(keys ^ salts)
                offsets = np.zeros(n + 1, dtype=np.int32)
                np.cumsum(np.where(sizes > 0, conf.coordinates, 0), out=offsets[1:])
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel().view(np.int64)))
                own = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(sizes), *map(pa.array, _names(values, first)), tokens], names=["doc_id", "text_hash", *SET, "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNED)


def shared_keys(nodes: DataFrame, least: int) -> DataFrame:
    """``(node, keys array<struct<df, token>>)`` of nodes with at least ``least`` tokens that another node has too."""
    each = nodes.select("node", F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    met = each.join(common, "token").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("keys"))
    return met.filter(F.size("keys") >= least)


def shingle_table(rows: DataFrame, conf: NearDedup) -> DataFrame:
    """:data:`SETS` of rows (node, n_shingles, s1, s2, tokens, prefix, text): half of each posting key, which of them the prefix
    has, and the full set. Rows whose text is not of the node's set are dropped."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, values, first in shingle_sets(batch.column("text"), conf.words):
                n = len(first) - 1
                own = batch.slice(lo, n)
                same = np.all([own.column(x).to_numpy() == y for x, y in zip(SET, [np.diff(first), *_names(values, first)], strict=True)], axis=0)
                rows = np.flatnonzero(same)
                tokens = own.column("tokens").flatten().to_numpy().reshape(n, -1)[rows]
                mask = [np.isin(t, own.column("prefix")[i].values.to_numpy()) for i, t in zip(rows.tolist(), tokens, strict=True)]
                parts = [[x.tobytes() for x in tokens.astype(np.uint32)], [x.tobytes() for x in mask], [values[first[i] : first[i + 1]].tobytes() for i in rows]]
                yield pa.RecordBatch.from_arrays([own.column("node").take(pa.array(rows)), *(pa.array(x, pa.binary()) for x in parts)], names=["node", "keys", "mask", "shingles"])

    return rows.select("node", *SET, "tokens", "prefix", "text").mapInArrow(run, SETS)


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether ``100 * intersection >= threshold * union`` of two sorted sets."""
    if threshold * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    common = int((np.searchsorted(x, y, side="right") - np.searchsorted(x, y, side="left")).sum())
    return 100 * common >= threshold * (len(x) + len(y) - common)


def confirm(pairs: DataFrame, sets: DataFrame, conf: NearDedup) -> DataFrame:
    """The pairs ``(a, b)`` with at least ``matches`` collisions whose full sets are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(batch.num_rows, -1) for i in (2, 3))
            keep = (p == q).sum(axis=1) >= conf.matches
            for i in np.flatnonzero(keep).tolist():
                keep[i] = linked(*(np.frombuffer(batch.column(k)[i].as_buffer(), K.U64) for k in (4, 5)), conf.threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name, p, x: sets.select(F.col("node").alias(name), F.col("keys").alias(p), F.col("shingles").alias(x))
    both = pairs.join(side("a", "p", "x"), "a").join(side("b", "q", "y"), "b")
    return both.select("a", "b", "p", "q", "x", "y").mapInArrow(run, "a long, b long")


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree on the first ``keys`` columns, of a sorted stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        last = [c[0] for c in columns]
        if held and any(held[-1].column(i)[-1].as_py() != last[i] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


GROUP = ["token", "lo", "hi"]
MEMBER = ["node", "label", "at", "minor", "seeks", "sought"]


class Merge:
    """A group of a list's members: pairs of a seeking and a sought member that may be linked and are not yet connected."""

    def __init__(self, group: pa.Table, conf: NearDedup):
        self.conf = conf
        self.node, label, self.at, self.minor, self.seeks, self.sought = (group.column(x).to_numpy() for x in MEMBER)
        self.part = np.unique(label, return_inverse=True)[1]
        n = group.num_rows
        self.keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), "<u4").reshape(n, -1)
        self.mask = np.frombuffer(b"".join(group.column("mask").to_pylist()), bool).reshape(n, -1)

    def candidates(self, i: int) -> np.ndarray:
        """Members of other components that collide with member ``i`` often enough, those with most collisions first.

        Of two members that both seek, the one with the smaller id does; a pair belongs to the first key that both prefixes
        have.
        """
        others = np.flatnonzero(self.sought & (self.part != self.part[i]) & (~self.minor | (self.node > self.node[i])))
        same = self.keys[others] == self.keys[i]
        count = same.sum(axis=1)
        enough = np.flatnonzero(count >= self.conf.matches)
        both = same[enough] & self.mask[others[enough]] & self.mask[i]
        enough = enough[both.argmax(axis=1) == self.at[i]] if len(enough) else enough
        return others[enough[np.argsort(-count[enough], kind="stable")]]

    def open_members(self) -> np.ndarray:
        """Members with a candidate."""
        out = np.zeros(len(self.node), dtype=bool)
        for i in np.flatnonzero(self.seeks):
            found = self.candidates(i)
            out[found] = True
            out[i] |= len(found) > 0
        return np.flatnonzero(out)

    def links(self, sets: pa.ChunkedArray) -> Iterator[tuple[int, int]]:
        """Confirmed links, each between two components that no earlier one connects."""
        sets = [np.frombuffer(x.as_buffer(), K.U64) for x in sets]
        for i in np.flatnonzero(self.seeks):
            for j in self.candidates(i):
                if self.part[i] != self.part[j] and linked(sets[i], sets[j], self.conf.threshold):
                    self.part[self.part == self.part[j]] = self.part[i]
                    yield (min(self.node[i], self.node[j]), max(self.node[i], self.node[j]))


def mixed_lists(nodes: DataFrame, conf: NearDedup) -> DataFrame:
    """Posting lists of nodes (node, label, n_shingles, lists) that hold several components: token, the largest component
    ``major``, and how many blocks all members (``n_hi``) and those outside it (``n_lo``) make."""
    lists = nodes.select("label", "n_shingles", F.inline("lists"))
    parts = lists.groupBy("token", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    whole = parts.groupBy("token").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "label")).alias("major"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / conf.block), F.ceil(size * 8 / conf.block_bytes), F.lit(1)).cast("int")
    return whole.select("token", F.col("major.label").alias("major"), blocks(F.col("n"), F.col("size")).alias("n_hi"), blocks(F.col("n") - F.col("major.n"), F.col("size") - F.col("major.size")).alias("n_lo"))


def merge_lists(nodes: DataFrame, whole: DataFrame, sets: DataFrame, conf: NearDedup, salt: int | None) -> DataFrame:
    """Links ``(a, b)`` between components of ``nodes`` (node, label, n_shingles, lists) that meet in one of the lists ``whole``.

    With a ``salt``, members of a list meet within random blocks; without, those outside the list's largest component
    meet all others.
    """
    lists = nodes.select("node", "label", F.inline("lists"))
    rows = lists.join(whole, "token").withColumn("minor", F.col("label") != F.col("major"))
    if salt is None:
        own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        rows = rows.withColumns({"own_lo": own("n_lo"), "own_hi": own("n_hi")})
        pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
        none = F.array().cast("array<struct<lo: int, hi: int>>")
        seek = F.when(F.col("minor"), F.transform(F.sequence(F.lit(0), F.col("n_hi") - 1), lambda hi: pair(F.col("own_lo"), hi))).otherwise(none)
        meet = F.transform(F.sequence(F.lit(0), F.col("n_lo") - 1), lambda lo: pair(lo, F.col("own_hi")))
        rows = rows.withColumn("place", F.explode(F.array_union(seek, meet))).select("*", "place.*")
        roles = {"seeks": F.col("minor") & (F.col("lo") == F.col("own_lo")), "sought": F.col("hi") == F.col("own_hi")}
    else:
        block = F.pmod(F.xxhash64("node", F.lit(salt)), F.col("n_hi")).cast("int")
        rows = rows.withColumns({"lo": block, "hi": F.lit(0)})
        roles = {"minor": F.lit(True), "seeks": F.lit(True), "sought": F.lit(True)}
    rows = rows.withColumns(roles).select(*GROUP, *MEMBER)

    def meet_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, len(GROUP)):
            found = Merge(group, conf).open_members()
            if len(found):
                yield from group.select([*GROUP, *MEMBER]).take(pa.array(found)).combine_chunks().to_batches()

    def link_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, len(GROUP)):
            found = list(Merge(group, conf).links(group.column("shingles")))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def dealt(rows: DataFrame, *payload: str) -> DataFrame:
        return rows.join(sets.select("node", *payload), "node").select(*GROUP, *MEMBER, *payload).repartition(*GROUP).sortWithinPartitions(*GROUP, "node")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    met = stash(dealt(rows, "keys", "mask").mapInArrow(meet_up, schema))
    return stash(dealt(met, "keys", "mask", "shingles").mapInArrow(link_up, "a long, b long"))


def near_duplicates(documents: DataFrame, conf: NearDedup = NearDedup()) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept, n_links, linked, first, text_hash.

    Links join rows with ``100 * intersection >= threshold * union`` of their shingle sets, equal sets included, whatever
    their ids. ``component_id`` is the smallest doc_id reachable, ``kept`` is ``doc_id <=> component_id``, and ``n_links``
    counts confirmed links of the row's set that the search needed. ``linked`` tells whether the row is linked with
    another; ``first`` marks the one to keep: the smallest doc_id of its component (a null after all others), and of
    several texts with that id the one with the smallest ``text_hash`` (xxhash64 of the text). Rows that agree in both are
    repeated rows and marked alike; a row without links is first. A null or empty text has no shingles and no link. Rows
    that share a doc_id are documents of their own. A null doc_id is linked like any other, but component_id is null only
    where all ids of the component are. An empty table gives no rows; further columns are ignored.
    """
    bound_batches(documents)
    signed = stash(sign(documents, conf))
    full = signed.filter("n_shingles > 0")
    head = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    classes = full.groupBy(*SET).agg(F.min(head).alias("head"), F.count("*").alias("copies"), F.first(F.slice("tokens", 1, conf.probe)).alias("probe"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()))
    probed = stash(shared_keys(classes.select("node", F.col("probe").alias("tokens")), conf.probe_matches).select("node"))
    picks = stash(keep_ids(classes.select("node", *SET), probed, ["node"]))
    chosen = stash(small_join(keep_ids(full.select(*SET, "tokens"), picks.select(*SET), SET).dropDuplicates(SET), picks, SET))
    keys = shared_keys(chosen, conf.matches)
    keyed = stash(keys.select("node", F.expr(f"transform(slice(keys, 1, size(keys) - {conf.matches - 1}), k -> k.token)").alias("prefix")))
    wanted = stash(keep_ids(chosen, keyed.select("node"), ["node"]).join(keyed, "node").join(classes.select("node", "head.text_hash"), "node"))
    texts = documents.select(F.xxhash64("text").alias("text_hash"), "text")
    texts = keep_ids(texts, wanted.select("text_hash").distinct(), ["text_hash"]).distinct()
    sets = stash(shingle_table(texts.join(wanted, "text_hash"), conf).dropDuplicates(["node"]))

    postings = keyed.select("node", F.explode("prefix").alias("token"))
    hubs = postings.groupBy("token").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    pairs = postings.join(hubs, "token").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    links = stash(confirm(pairs, sets, conf))
    labels = connected(links)

    lists = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("at"), t.alias("token"))), lambda x: F.array_contains("prefix", x.token))
    nodes = wanted.select("node", "n_shingles", lists.alias("lists"))
    step, done = 0, False
    while not done:
        named = stash(nodes.join(labels.withColumnRenamed("doc_id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node")))
        lists = stash(mixed_lists(named, conf))
        long = lists.filter(f"n_lo > {2 * conf.rounds}")
        done = step == conf.rounds or long.isEmpty()
        found = merge_lists(named, lists if done else long, sets, conf, None if done else step)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = connected(links)
        step += 1

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = labels.withColumnRenamed("doc_id", "node").join(degree, "node").join(classes.select("node", "head"), "node")
    heads = named.groupBy("label").agg(F.min("head").alias("best"))
    named = stash(named.join(heads, "label").select("node", "best", "n_links"))
    grouped = classes.select("node", *SET, "head", "copies").join(named, "node", "left").filter("copies > 1 OR best IS NOT NULL")
    grouped = stash(grouped.select(*SET, F.coalesce("best", "head").alias("best"), "n_links"))
    out = small_join(signed.drop("tokens"), grouped, SET, "left").withColumn("linked", F.col("best").isNotNull())
    out = out.withColumn("component_id", F.when(F.col("linked"), F.col("best.doc_id")).otherwise(F.col("doc_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = ~F.col("linked") | (kept & (F.col("text_hash") == F.col("best.text_hash")))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "linked", first.alias("first"), "text_hash")
