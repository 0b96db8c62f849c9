"""Gradient-boosted trees over coarse features, trained from counts and applied as a Spark column.

Features take few values each, so all rows of a table collapse to counts per distinct combination. Spark makes these
counts over all rows; only they come to the driver, at most the product of the features' sizes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    """Depth-two trees on logits: each a feature and bound, then for either side a feature, a bound and two leaves."""

    features: list[str]
    rounds: int = 40
    rate: float = 0.3
    least: float = 1.0
    bias: float = 0.0
    trees: list[tuple] = field(default_factory=list)

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        """The best feature and bound (left: value <= bound) by the usual gain on gradient and curvature sums."""
        best, total = (0.0, 0, -1), g.sum() ** 2 / (h.sum() + self.least)
        for f in range(x.shape[1]):
            gs, hs = (np.cumsum(np.bincount(x[:, f], w)) for w in (g, h))
            gain = gs**2 / (hs + self.least) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.least) - total
            at = int(gain.argmax())
            if gain[at] > best[0] + 1e-12:
                best = (float(gain[at]), f, at)
        return best

    def _leaf(self, g: np.ndarray, h: np.ndarray) -> float:
        return float(self.rate * g.sum() / (h.sum() + self.least))

    def fit(self, x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> Trees:
        share = (positive.sum() + 1) / (total.sum() + 2)
        self.bias = float(np.log(share / (1 - share)))
        logit = np.full(len(x), self.bias)
        for _ in range(self.rounds if len(x) else 0):
            p = 1 / (1 + np.exp(-logit))
            g, h = positive - total * p, total * p * (1 - p)
            _, f, bound = self._split(x, g, h)
            left = x[:, f] <= bound
            sides = []
            for side in (left, ~left):
                _, f2, bound2 = self._split(x[side], g[side], h[side]) if side.any() else (0.0, 0, -1)
                low = side & (x[:, f2] <= bound2)
                sides.append((f2, bound2, self._leaf(g[low], h[low]), self._leaf(g[side & ~low], h[side & ~low])))
            self.trees.append((f, bound, *sides))
            logit += self._values(x, self.trees[-1])
        return self

    def _values(self, x: np.ndarray, tree: tuple) -> np.ndarray:
        f, bound, low, high = tree
        leaf = lambda s: np.where(x[:, s[0]] <= s[1], s[2], s[3])
        return np.where(x[:, f] <= bound, leaf(low), leaf(high))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((self._values(x, t) for t in self.trees), np.zeros(len(x))))))

    def column(self) -> Column:
        """The same score as a column over the feature columns."""
        out = F.lit(self.bias)
        for f, bound, low, high in self.trees:
            leaf = [F.when(F.col(self.features[s[0]]) <= s[1], F.lit(s[2])).otherwise(F.lit(s[3])) for s in (low, high)]
            out = out + F.when(F.col(self.features[f]) <= bound, leaf[0]).otherwise(leaf[1])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-out))


#: Scores nearer than this are one: numpy and Spark differ in the last bits.
SAME = 1e-9


def threshold(score: np.ndarray, positive: np.ndarray, total: np.ndarray, precision: float) -> float:
    """A bound just below the lowest score from which on rows are positive in at least ``precision`` of the held-out counts; above
    1 if there is none. Rows of one score are in or out together."""
    order = np.argsort(-score, kind="stable")
    good, all_, score = np.cumsum(positive[order]), np.cumsum(total[order]), score[order]
    last = np.append(score[:-1] - score[1:] > SAME, True)[: len(score)]
    fit = np.flatnonzero((good >= precision * all_) & (all_ > 0) & last)
    return float(score[fit[-1]]) - SAME / 2 if len(fit) else 2.0
