"""Thresholds from one-dimensional k-means, solved exactly (Wang and Song, 2011) over weighted distinct values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Threshold:
    value: float
    was_calibrated: bool


# Defaults, least distinct values, least gaps between clusters.
DUPLICATE_DEFAULT, CRITICAL_DEFAULT, MODERATE_DEFAULT = 90.0, 30.0, 10.0
LEAST_DISTINCT, DUPLICATE_GAP, SEVERITY_GAP = 6, 15.0, 5.0


def clusters(values: dict[float, int], k: int) -> list[tuple[float, float, float]]:
    """(center, least, largest) of each of k clusters of least squared error, ascending."""
    x = np.array(sorted(values))
    w = np.array([values[v] for v in x.tolist()], float)
    n = len(x)
    sw, sx, sxx = (np.concatenate([[0.0], np.cumsum(w * f)]) for f in (np.ones(n), x, x * x))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        weight, total = sw[j] - sw[i], sx[j] - sx[i]
        return np.maximum(sxx[j] - sxx[i] - total * total / weight, 0)

    best = [np.array([0.0] + [float(cost(np.array([0]), j)[0]) for j in range(1, n + 1)])]
    cut = []
    for c in range(1, k):
        row, where = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(c + 1, n + 1):
            starts = np.arange(c, j)
            total = best[-1][starts] + cost(starts, j)
            at = int(total.argmin())
            row[j], where[j] = total[at], starts[at]
        best.append(row)
        cut.append(where)
    edges = [n]
    for where in reversed(cut):
        edges.append(int(where[edges[-1]]))
    edges = [0, *reversed(edges)]
    out = []
    for i, j in zip(edges, edges[1:]):
        out.append((float((w[i:j] * x[i:j]).sum() / w[i:j].sum()), float(x[i]), float(x[j - 1])))
    return out


def duplicate_threshold(scores: dict[float, int]) -> Threshold:
    """Between the two clusters of pair scores, if a clear gap parts them."""
    if len(scores) < LEAST_DISTINCT:
        return Threshold(DUPLICATE_DEFAULT, False)
    low, high = clusters(scores, 2)
    if high[1] - low[2] < DUPLICATE_GAP:
        return Threshold(DUPLICATE_DEFAULT, False)
    return Threshold(round(min(max((low[0] + high[0]) / 2, 50.0), 99.0), 2), True)


def severity_thresholds(percentages: list[float]) -> tuple[Threshold, Threshold]:
    """Cutoffs of critical and moderate, between three clusters of percentages."""
    default = Threshold(CRITICAL_DEFAULT, False), Threshold(MODERATE_DEFAULT, False)
    values: dict[float, int] = {}
    for p in percentages:
        values[p] = values.get(p, 0) + 1
    if len(values) < LEAST_DISTINCT:
        return default
    low, mid, high = clusters(values, 3)
    if mid[1] - low[2] < SEVERITY_GAP or high[1] - mid[2] < SEVERITY_GAP:
        return default
    moderate = min(max((low[0] + mid[0]) / 2, 1.0), 95.0)
    critical = max(min((mid[0] + high[0]) / 2, 99.0), moderate + 1.0)
    return Threshold(round(critical, 2), True), Threshold(round(moderate, 2), True)
