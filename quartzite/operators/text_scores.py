"""Lexicon scores of texts and their daily panels."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scorer(lexicon: Mapping[str, float], negations: list[str], intensifiers: Mapping[str, float], reach: int = 6, scale: float = 8.0):
    """A function from text to a score in -1..1.

    Terms are matched longest first, without overlaps. Of the `reach` characters before a term, one that
    ends in a negation turns its sign; an intensifier that stands at their end, or within two characters
    of it, multiplies it (the longest that does).
    """
    terms = sorted(lexicon, key=lambda t: (-len(t), t))
    nots = sorted(negations, key=len, reverse=True)
    strong = sorted(intensifiers, key=lambda t: (-len(t), t))

    def score(text: str | None) -> float:
        s = (text or "").strip()
        used, total = bytearray(len(s)), 0.0
        for term in terms:
            for m in re.finditer(f"(?={re.escape(term)})", s):
                i, j = m.start(), m.start() + len(term)
                if any(used[i:j]):
                    continue
                used[i:j] = b"\1" * (j - i)
                before = s[max(0, i - reach) : i]
                sign = -1.0 if any(before.endswith(n) for n in nots) else 1.0
                times = next((intensifiers[t] for t in strong if t in before[-len(t) - 2 :]), 1.0)
                total += sign * times * lexicon[term]
        return max(-1.0, min(1.0, total / scale))

    return score


def with_scores(docs: DataFrame, text: str, out: str, lexicon: Mapping[str, float], negations: list[str], intensifiers: Mapping[str, float]) -> DataFrame:
    """docs with the score of the whole text; null and empty texts score 0."""
    score = scorer(lexicon, negations, intensifiers)

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: score(t))

    return docs.withColumn(out, run(F.coalesce(text, F.lit(""))))


def daily_mood(scored: DataFrame, score: str, weight: str, by: list[str], amplify: float = 1.5, penalty: float = 0.2) -> DataFrame:
    """by, texts, mood: the weighted mean of the scores, negative ones times `amplify`, less `penalty` times the share of negative texts."""
    v = F.when(F.col(score) < 0, F.col(score) * amplify).otherwise(F.col(score))
    mean = F.sum(v * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))
    share = F.avg((F.col(score) < 0).cast("double"))
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("texts"), (mean - penalty * share).alias("mood"))
