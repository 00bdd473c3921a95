"""Review flags and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.operators.calibration import CONFIDENCE, above, below

# Reasons written into the flagged table, and token rule defaults.
LOW_CONFIDENCE = "low_confidence"
HIGH_PERPLEXITY = "high_pseudo_perplexity"
MANY_TOKENS = "many_high_ppl_tokens"
TOKEN_PPL = 500_000.0
MIN_TOKENS = 3


def high_token_count(token_scores: Column, ppl: float = TOKEN_PPL) -> Column:
    """Tokens whose perplexity lies above ``ppl``."""
    return F.size(F.filter(token_scores, lambda t: above(t["token_ppl"], ppl)))


def flag_tokens(token_scores: Column, ppl: float = TOKEN_PPL, k: int = MIN_TOKENS) -> Column:
    """At least ``k`` tokens above a perplexity of ``ppl``."""
    return F.coalesce(high_token_count(token_scores, ppl) >= F.lit(k), F.lit(False))


def flag_review(
    df: DataFrame,
    threshold: float,
    confidence: str = CONFIDENCE,
    perplexity: str | None = None,
    ppl_threshold: float | None = None,
    many_tokens: Column | None = None,
) -> DataFrame:
    """Flags, their union ``manual_review``, and the reasons joined by a comma.

    Confidence counts as low strictly below ``threshold``. Perplexity and the
    token rule are off unless given, and the perplexity flag is then false.
    """
    low = below(F.col(confidence), threshold)
    if perplexity is not None and ppl_threshold is not None:
        high = above(F.col(perplexity), ppl_threshold)
    else:
        high = F.lit(False)
    flags = {"flag_low_confidence": (low, LOW_CONFIDENCE), "flag_high_ppl": (high, HIGH_PERPLEXITY)}
    if many_tokens is not None:
        flags["flag_many_high_ppl_tokens"] = (many_tokens, MANY_TOKENS)
    flagged = df.withColumns({name: test for name, (test, _) in flags.items()})
    review = F.lit(False)
    for name in flags:
        review = review | F.col(name)
    return flagged.withColumns(
        {
            "manual_review": review,
            "manual_review_reason": F.concat_ws(
                ",", *[F.when(F.col(name), reason) for name, (_, reason) in flags.items()]
            ),
        }
    )


def review_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flagged rows, all rows and their share in percent; null share without rows."""
    return df.groupBy(*by).agg(
        F.count_if("manual_review").alias("flagged"), F.count(F.lit(1)).alias("total")
    ).withColumn("percent", F.try_divide(100.0 * F.col("flagged"), F.col("total")))
