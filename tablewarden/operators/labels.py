"""Checks of safety labels against the text they describe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from .rules import Rule, binary_labels, label_implication

__all__ = ["binary_labels", "label_implication", "lexicon_vs_label"]


def lexicon_vs_label(
    text: str, label: str, lexicon: list[str], direction: str = "both", min_hits: int = 1
) -> list[Rule]:
    """Candidates for review: a lexicon word in unflagged text, or flagged text without any.

    ``direction`` is ``unflagged``, ``flagged`` or ``both``; the two directions are separate rules.
    """
    words = F.array(*[F.lit(w.lower()) for w in lexicon])
    found = F.array_sort(F.array_intersect(words, tokens(F.col(text))))
    value = F.col(label).cast("string")
    rules = []
    if direction in ("unflagged", "both"):
        rules.append(Rule(f"lexicon_unflagged:{label}", label, "inconsistent_value",
                          (value == "0") & (F.size(found) >= min_hits), observed=F.array_join(found, ","), expected=F.lit("1")))
    if direction in ("flagged", "both"):
        rules.append(Rule(f"lexicon_flagged:{label}", label, "inconsistent_value",
                          (value == "1") & (F.size(found) < min_hits), observed=value, expected=F.lit("0")))
    if not rules:
        raise ValueError(f"unknown direction: {direction}")
    return rules
