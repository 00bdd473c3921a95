"""Text classifier in closed form: multinomial naive Bayes by counts of tokens.

Fitting and scoring are aggregations over joins, so plain SQL can check every prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.functions.text import present_text, tokens
from labelsieve.session import require_columns, spool

# Tokens of a vocabulary that is sent to every task; a larger one meets the texts in a join
# by shuffle, where adaptive execution splits the frequent tokens.
BROADCAST_TOKENS = 500_000

_ABOUT = "smoothing double, texts array<long>"


@dataclass(frozen=True)
class CountClassifier:
    """Tokens with their counts by class (``token``, ``counts``), and training texts by class."""

    vocabulary: DataFrame
    texts: list[int]
    smoothing: float

    def _weights(self) -> tuple[DataFrame, int]:
        """Log-probability of each token by class, and the number of tokens."""
        classes = range(len(self.texts))
        sums = self.vocabulary.agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.col("counts")[k]).alias(f"t{k}") for k in classes]
        ).first()
        a, n = self.smoothing, sums["n"]
        logs = [
            F.ln(F.col("counts")[k] + F.lit(a)) - F.ln(F.lit(float((sums[f"t{k}"] or 0) + a * n))) for k in classes
        ]
        return self.vocabulary.select("token", *[logs[k].alias(f"w{k}") for k in classes]), n

    def logits(self, df: DataFrame, text: str = "text", name: str = "logits") -> DataFrame:
        """Add log prior plus log likelihood of each class, up to a constant of the text.

        Tokens that training never saw tell nothing. A text without any other has the
        log priors; a missing text is read as elsewhere (``present_text``).
        """
        classes = range(len(self.texts))
        # The rows are read twice: for their tokens, and to be given their scores.
        rows = spool(df.withColumn("_row", F.monotonically_increasing_id()))
        met = rows.select("_row", F.explode(tokens(present_text(F.col(text)))).alias("token"))
        weights, n = self._weights()
        if n <= BROADCAST_TOKENS:
            met, weights = met.withColumn("_n", F.lit(1)), F.broadcast(weights)
        else:
            met = met.groupBy("_row", "token").agg(F.count(F.lit(1)).alias("_n"))
        sums = (
            met.join(weights, "token")
            .groupBy("_row")
            .agg(*[F.sum(F.col("_n") * F.col(f"w{k}")).alias(f"s{k}") for k in classes])
        )
        every = sum(self.texts) + self.smoothing * len(self.texts)
        scores = [
            F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + F.ln(F.lit((self.texts[k] + self.smoothing) / every))
            for k in classes
        ]
        return rows.join(sums, "_row", "left").select(*[F.col(f"`{c}`") for c in df.columns], F.array(*scores).alias(name))

    def save(self, path: str) -> None:
        """Two tables below ``path``, which must not exist yet."""
        spark = SparkSession.active()
        self.vocabulary.write.parquet(f"{path}/vocabulary")
        spark.createDataFrame([(self.smoothing, self.texts)], _ABOUT).coalesce(1).write.json(f"{path}/about")

    @staticmethod
    def load(path: str) -> CountClassifier:
        """What :meth:`save` wrote, for a job of its own."""
        spark = SparkSession.active()
        about = spark.read.schema(_ABOUT).json(f"{path}/about").first()
        return CountClassifier(spark.read.parquet(f"{path}/vocabulary"), list(about["texts"]), about["smoothing"])


def fit_count_classifier(
    train: DataFrame, n_labels: int = 2, text: str = "text", label: str = "label", smoothing: float = 1.0
) -> CountClassifier:
    """Count tokens by class; ``label`` is 0 to ``n_labels`` - 1. The counts are written once.

    Rows with a null label, or one outside that range, count in no class.
    """
    require_columns(train, [text, label], "training table")
    if smoothing <= 0:
        raise ValueError(f"smoothing must be positive, got {smoothing}")
    known = train.where(F.col(label).between(0, n_labels - 1))
    of = [F.count_if(F.col("label") == k) for k in range(n_labels)]
    words = known.select(F.col(label).alias("label"), F.explode(tokens(present_text(F.col(text)))).alias("token"))
    vocabulary = spool(words.groupBy("token").agg(F.array(*of).alias("counts")))
    found = known.select(F.col(label).alias("label")).agg(F.array(*of).alias("n")).first()
    return CountClassifier(vocabulary, list(found["n"]), float(smoothing))
