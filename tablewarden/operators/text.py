"""Checks on prose: prompts, responses, documents.  All but the copies are decided inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_number
from ..functions.text import casefold_tokens, hit_count, is_blank, strip, word_count
from .rules import Rule

# Markers of leaked instructions.
MARKERS = [r"\[SYSTEM\]", r"You are a helpful AI", r"<\|im_start\|>", r"### Instruction"]

# Shapes of personal data, usable in both RE2 and Java.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[-. ]?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}

# Frequent function words of a few languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "as", "are", "this", "be"],
    "fr": ["le", "la", "les", "des", "et", "une", "du", "que", "est", "dans", "qui", "pour", "pas", "sur", "au"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "des", "nicht", "ein", "eine", "auf", "im"],
    "es": ["el", "los", "las", "de", "que", "y", "en", "un", "por", "con", "una", "para", "del", "se", "al"],
}

SENTENCE_END = r"[.!?][\"'’”)\]]?\s*$"


def leaked_prompt(col: str, markers: list[str] | None = None) -> Rule:
    """Instruction or template text inside a response."""
    pattern = "|".join(markers or MARKERS)
    seen = F.regexp_extract(F.col(col), f"({pattern})", 1)
    return Rule(f"leaked_prompt:{col}", col, "inconsistent_value", F.col(col).rlike(pattern), observed=seen)


def pii_counts(df: DataFrame, col: str, row_id: str = "row_id", patterns: dict[str, str] | None = None) -> DataFrame:
    """Rows with personal data: ``row_id, kind, hits``; one pass over the text per kind, one scan in all."""
    patterns = patterns or PII
    hits = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.regexp_count(F.col(col), F.lit(p)).cast("bigint").alias("hits"))
        for kind, p in patterns.items()
    ])
    return df.select(F.col(row_id).cast("bigint").alias("row_id"), F.explode(hits).alias("h")).where("h.hits > 0").select(
        "row_id", "h.kind", "h.hits"
    )


def pii(col: str, patterns: dict[str, str] | None = None) -> list[Rule]:
    return [
        Rule(f"pii:{kind}:{col}", col, "inconsistent_value", F.col(col).rlike(p),
             observed=F.regexp_extract(F.col(col), f"({p})", 1))
        for kind, p in (patterns or PII).items()
    ]


def truncated(col: str, issue_type: str = "missing_value") -> Rule:
    """Text that stops without the end of a sentence."""
    c = F.col(col)
    return Rule(f"truncated:{col}", col, issue_type, ~is_blank(c) & ~c.rlike(SENTENCE_END),
                observed=F.right(strip(c), F.lit(20)))


def with_language(
    df: DataFrame, col: str, out: str = "guessed_lang", min_words: int = 5, min_share: float = 0.05
) -> DataFrame:
    """Add the language whose function words make up the largest share of a text; NULL when too short or unclear.

    Words are counted in one projection and compared in the next, so every pattern passes over the text once.
    """
    text = F.col(col)
    counted = df.withColumn("__n", word_count(text)).withColumn(
        "__hits", F.struct(*[hit_count(text, words).alias(lang) for lang, words in STOP_WORDS.items()])
    )
    shares = [
        F.struct((F.col(f"__hits.{lang}") / F.col("__n")).alias("share"), F.lit(lang).alias("lang")) for lang in STOP_WORDS
    ]
    ranked = counted.withColumn("__best", F.when(F.col("__n") > 0, F.greatest(*shares)))
    clear = (F.col("__n") >= min_words) & (F.col("__best.share") >= min_share)
    return ranked.withColumn(out, F.when(clear, F.col("__best.lang"))).drop("__n", "__hits", "__best")


def language_mismatch(col: str, declared: str | Column, guessed: str = "guessed_lang") -> Rule:
    """Text of another language than the declared one; ``guessed`` comes from :func:`with_language`."""
    lang, guess = F.col(declared) if isinstance(declared, str) else declared, F.col(guessed)
    return Rule(f"language_mismatch:{col}", col, "inconsistent_value", guess != lang, observed=guess, expected=lang)


def off_topic(prompt: str, response: str, min_share: float = 0.05, min_words: int = 5) -> Rule:
    """Response that shares almost no content words with its prompt.  A heuristic, for review."""
    stop = F.array(*[F.lit(w) for words in STOP_WORDS.values() for w in words])
    content = lambda c: F.array_except(casefold_tokens(F.col(c)), stop)
    asked = content(prompt)
    shared = F.size(F.array_intersect(asked, content(response)))
    share = F.try_divide(shared.cast("double"), F.size(asked))
    bad = ~is_blank(F.col(response)) & (F.size(asked) >= min_words) & (share < F.lit(min_share))
    return Rule(f"off_topic:{response}", response, "inconsistent_value", bad, observed=F.round(share, 6))


def flagged_but_high_score(flag: str, score: str, at_least: float) -> Rule:
    """A row marked as bad that nevertheless carries a high score."""
    bad = (as_number(F.col(flag).cast("string")) == 1) & (as_number(F.col(score).cast("string")) >= F.lit(at_least))
    return Rule(f"flagged_but_high_score:{score}", score, "inconsistent_value", bad)
