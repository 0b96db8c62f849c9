"""Intervals that have been kept, found again by where they lie."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator


class Intervals:
    """Half-open intervals with a length of their own, sorted by start within classes of like extent.

    Those that overlap a given one begin before its end and after its start less the largest extent of their class, so a
    search bisects each class and looks at neighbours only.
    """

    def __init__(self) -> None:
        self.classes: dict[int, tuple[list[float], list[tuple[float, float]]]] = {}

    def add(self, start: float, end: float, length: float) -> None:
        if end <= start:  # overlaps nothing
            return
        starts, rest = self.classes.setdefault(math.frexp(end - start)[1], ([], []))
        at = bisect_right(starts, start)
        starts.insert(at, start)
        rest.insert(at, (end, length))

    def overlapping(self, start: float, end: float) -> Iterator[tuple[float, float, float]]:
        """(start, end, length) of those that share more than a point with an interval, the shortest first."""
        for size in sorted(self.classes):
            starts, rest = self.classes[size]
            lo, hi = bisect_right(starts, start - 2.0**size), bisect_left(starts, end)
            for i in range(lo, hi):
                if rest[i][0] > start:
                    yield starts[i], *rest[i]
