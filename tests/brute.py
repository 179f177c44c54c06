"""Slow, obvious implementations to compare the operators with."""

import math


def roc_auc(pairs):
    pos = [p for p, y in pairs if y == 1]
    neg = [p for p, y in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def average_precision(pairs):
    total = sum(y for _, y in pairs)
    if not total or total == len(pairs):
        return None
    area, before = 0.0, 0
    for cut in sorted({p for p, _ in pairs}, reverse=True):
        kept = [y for p, y in pairs if p >= cut]
        area += (sum(kept) - before) / total * sum(kept) / len(kept)
        before = sum(kept)
    return area


def top(rows, rate):
    """rows: (id, target, probability)."""
    count = max(1, math.ceil(len(rows) * rate))
    return sorted(rows, key=lambda r: (-r[2], r[0]))[:count]


def bins(rows, descending):
    ordered = sorted(rows, key=lambda r: ((-r[2] if descending else r[2]), r[0]))
    return {r[0]: min(10, math.ceil((i + 1) * 10 / len(rows))) for i, r in enumerate(ordered)}


def quantile(values, q):
    v = sorted(values)
    at = (len(v) - 1) * q
    low, high = v[math.floor(at)], v[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))
