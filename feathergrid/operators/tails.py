"""Tail probabilities of test statistics."""

from __future__ import annotations

import math


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square by the recurrence in steps of two degrees of freedom."""
    half = max(x, 0.0) / 2
    tail = math.erfc(math.sqrt(half)) if df % 2 else math.exp(-half)
    at = 1 if df % 2 else 2
    while at < df:
        tail += math.exp(-half + (at / 2) * math.log(half) - math.lgamma(at / 2 + 1)) if half > 0 else 0.0
        at += 2
    return min(tail, 1.0)
