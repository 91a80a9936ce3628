"""Gradient-boosted trees with monotonic constraints, as flat numpy node arrays.

Trees grow level by level on a bounded sample of binned features.  A feature
constrained to +1 (-1) may only split so that the score does not fall (rise)
with it; the middle of a constrained split bounds all leaves below.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node arrays of all trees: children of node i are 2i + 1 and 2i + 2; leaves fill the last level."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # go right if the value is greater
    value: np.ndarray  # (trees, leaves)
    start: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of a (rows, features) table."""
        rows = np.arange(len(features))
        total = np.full(len(features), self.start)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(features), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (features[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(features: np.ndarray, labels: np.ndarray, monotonic: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, shrink: float = 5.0, least_rows: int = 10) -> Trees:
    """Boost ``trees`` trees of fixed depth on the logistic loss; one label only gives a constant score."""
    n, width = features.shape
    rate_of_ones = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    start = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    if n == 0 or len(np.unique(labels)) < 2:
        return model
    cuts = [np.unique(np.quantile(features[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, features[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    total = np.full(n, start)
    all_feature, all_threshold, all_value = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = labels - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            base, count = 2**level - 1, 2**level
            local = node - base
            best_gain = np.full(count, 1e-6)
            g_all = np.bincount(local, slope, count)
            h_all = np.bincount(local, bend, count)
            lo, hi = low[base : base + count], high[base : base + count]

            def gain(g, h, lo=lo, hi=hi):
                v = np.clip(g / (h + shrink), lo[:, None], hi[:, None])
                return g * v - 0.5 * (h + shrink) * v * v, v

            whole = gain(g_all[:, None], h_all[:, None])[0]
            best_mid, best_at = np.zeros(count), np.zeros(count)
            for j in range(width):
                k = len(cuts[j]) + 1
                if k < 2:
                    continue
                place = local * k + binned[:, j]
                g = np.cumsum(np.bincount(place, slope, count * k).reshape(count, k), axis=1)[:, :-1]
                h = np.cumsum(np.bincount(place, bend, count * k).reshape(count, k), axis=1)[:, :-1]
                c = np.cumsum(np.bincount(place, minlength=count * k).reshape(count, k), axis=1)
                left, lv = gain(g, h)
                right, rv = gain(g_all[:, None] - g, h_all[:, None] - h)
                won = left + right - whole
                won[(c[:, :-1] < least_rows) | (c[:, -1:] - c[:, :-1] < least_rows)] = -1
                if monotonic[j]:
                    won[(rv - lv) * monotonic[j] < 0] = -1
                at = won.argmax(axis=1)
                top = won[np.arange(count), at]
                better = top > best_gain
                if better.any():
                    best_gain[better] = top[better]
                    feature[base : base + count][better] = j
                    threshold[base : base + count][better] = cuts[j][at[better]]
                    best_at[better] = at[better]
                    best_mid[better] = ((lv + rv) / 2)[np.arange(count), at][better]
            for i in range(count):
                me, left, right = base + i, 2 * (base + i) + 1, 2 * (base + i) + 2
                low[[left, right]], high[[left, right]] = low[me], high[me]
                side = monotonic[feature[me]] if np.isfinite(threshold[me]) else 0
                if side > 0:
                    high[left], low[right] = best_mid[i], best_mid[i]
                elif side < 0:
                    low[left], high[right] = best_mid[i], best_mid[i]
            node = 2 * node + 1 + (features[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = np.clip(np.bincount(leaf, slope, leaves) / (np.bincount(leaf, bend, leaves) + shrink), low[inner:], high[inner:]) * rate
        total = total + value[leaf]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_value.append(value)
    return Trees(np.array(all_feature), np.array(all_threshold), np.array(all_value), start)
