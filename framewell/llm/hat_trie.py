"""A burstable trie of word ids with hash containers, for counting phrases within bounded memory.

A node splits its phrases by one word id into ranges; a range is a hash container (phrase rest to count) or, when it is a
single word, a node for the next word. A container that holds more than ``burst`` phrases splits at its median id, and one
whose phrases all share an id bursts into a node, so only frequent prefixes get nodes and the trie stays shallow. Once
``limit`` phrases are held, the largest subtrees are spilled whole as sorted runs and start empty again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

Container = dict[bytes, int]


class Node:
    """Ranges of ids: ``parts[i]`` holds ids from ``bounds[i]`` up to the next bound."""

    def __init__(self, part: Container):
        self.bounds = np.zeros(1, dtype=np.uint64)
        self.parts: list[Container | Node] = [part]

    def split(self, at: int, bound: int, right: Container | Node) -> None:
        self.bounds = np.insert(self.bounds, at + 1, np.uint64(bound))
        self.parts.insert(at + 1, right)


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row of ids as bytes whose order is that of the ids."""
    rows = np.ascontiguousarray(rows, dtype=">u8")
    return rows.view(f"V{8 * rows.shape[1]}").ravel().tolist()


def items(part: Container | Node, prefix: bytes = b"") -> Iterator[tuple[bytes, int]]:
    """Phrases and counts of a subtree, in order."""
    if isinstance(part, Node):
        for low, child in zip(part.bounds.tolist(), part.parts, strict=True):
            yield from items(child, prefix + low.to_bytes(8) if isinstance(child, Node) else prefix)
    else:
        yield from ((prefix + key, part[key]) for key in sorted(part))


class HatTrie:
    """Counts of phrases of ``width`` word ids."""

    def __init__(self, width: int, burst: int = 8192, limit: int = 500_000):
        self.width, self.burst, self.limit = width, burst, limit
        self.root = Node({})
        self.size = 0

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Count phrases: ``rows`` of ids, sorted and each there once."""
        self.size += self._add(self.root, rows, counts, 0)

    def _add(self, node: Node, rows: np.ndarray, counts: np.ndarray, depth: int) -> int:
        if not len(rows):
            return 0
        part = np.searchsorted(node.bounds, rows[:, depth], side="right") - 1
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(rows)]
        grown, full = 0, []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = int(part[a])
            child = node.parts[at]
            if isinstance(child, Node):
                grown += self._add(child, rows[a:b], counts[a:b], depth + 1)
                continue
            before, get = len(child), child.get
            for key, n in zip(packed(rows[a:b, depth:]), counts[a:b].tolist(), strict=True):
                child[key] = get(key, 0) + n
            grown += len(child) - before
            if len(child) > self.burst:
                full.append(at)
        for at in reversed(full):
            self._burst(node, at, depth)
        return grown

    def _burst(self, node: Node, at: int, depth: int) -> None:
        part = node.parts[at]
        keys = sorted(part)
        if len(keys) <= self.burst:
            return
        low, middle, high = keys[0][:8], keys[len(keys) // 2][:8], keys[-1][:8]
        if low < high:
            bound = middle if low < middle else keys[bisect_left(keys, (int.from_bytes(low) + 1).to_bytes(8))][:8]
            cut = bisect_left(keys, bound)
            node.parts[at] = {k: part[k] for k in keys[:cut]}
            node.split(at, int.from_bytes(bound), {k: part[k] for k in keys[cut:]})
            self._burst(node, at + 1, depth)
            self._burst(node, at, depth)
        elif depth + 1 < self.width:
            word, child = int.from_bytes(low), Node({k[8:]: n for k, n in part.items()})
            if word + 1 < 1 << 64 and (at + 1 == len(node.parts) or node.bounds[at + 1] > word + 1):
                node.split(at, word + 1, {})
            if node.bounds[at] < word:
                node.parts[at] = {}
                node.split(at, word, child)
            else:
                node.parts[at] = child
            self._burst(child, 0, depth + 1)

    def spill(self, keep: int) -> Iterator[list[tuple[bytes, int]]]:
        """Sorted runs of the root's largest subtrees, until at most ``keep`` phrases are held."""
        sizes = [sum(1 for _ in items(p)) if isinstance(p, Node) else len(p) for p in self.root.parts]
        for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            if self.size <= keep:
                return
            if sizes[at]:
                low = int(self.root.bounds[at]).to_bytes(8)
                part, self.root.parts[at] = self.root.parts[at], {}
                self.size -= sizes[at]
                yield list(items(part, low if isinstance(part, Node) else b""))
