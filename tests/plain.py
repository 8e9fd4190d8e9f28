"""The scoring rules once more, in plain Python, for small comparisons with the Spark results."""

from __future__ import annotations

import re


def number(text):
    try:
        return float(text)
    except ValueError:
        return None


def harmonic(p, r):
    return 2 * p * r / (p + r) if p + r else 0.0


def identify(reported: set, truth: list) -> dict:
    """``truth`` is a list of (key, difficulty)."""
    weight = dict(truth)
    hits = reported & set(weight)
    out = {"tp": len(hits), "fp": len(reported) - len(hits), "fn": len(weight) - len(hits)}
    if not reported and not truth:
        return {**out, "f1": 1.0, "score": 1.0}
    p = out["tp"] / len(reported) if reported else 0.0
    r = out["tp"] / len(weight) if weight else 0.0
    found, total = sum(weight[k] for k in hits), sum(d for _, d in truth)
    wr = found / total if total else 0.0
    loss = out["fp"] * total / len(truth) if truth else 0.0
    wp = found / (found + loss) if found + loss else 0.0
    return {**out, "f1": harmonic(p, r), "score": harmonic(wp, wr)}


def points(kind, proposed, clean) -> float:
    """Score of one proposal; ``kind`` is None for a cell without a fault."""
    if kind is None or clean is None:
        return 0.0
    p, c = proposed.strip(), clean.strip()
    if p.lower() == c.lower():
        return 1.0
    n, m = number(p), number(c)
    both = n is not None and m is not None
    gap = abs(n - m) / abs(m) if both and m != 0 else None
    near = lambda limit: gap is not None and gap <= limit
    if kind == "missing_value":
        return 0.8 if p else 0.0
    if kind == "wrong_type":
        return 0.8 if n is not None else 0.1
    if kind == "out_of_range":
        if not both:
            return 0.1
        return 0.8 if near(0.5) else 0.4 if n > 0 and m > 0 else 0.1
    if kind == "format_violation":
        return 0.8 if re.match(r"\d{4}-\d{2}-\d{2}", p) else 0.4 if p else 0.1
    if kind in ("inconsistent_value", "statistical_outlier"):
        if not both:
            return 0.4 if len(p) > 10 else 0.1
        if m == 0:
            return 0.4
        return 1.0 if near(0.01) else 0.8 if near(0.2) else 0.4 if near(0.5) else 0.1
    return 0.8 if near(0.01) else 0.1
