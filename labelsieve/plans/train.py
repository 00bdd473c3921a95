"""Text classifier on Spark ML: hashed word counts, IDF, logistic regression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.functions.text import TOKEN_BREAK, model_text, present_text
from labelsieve.operators.labels import append_train, label_distribution
from labelsieve.operators.metrics import mean_cross_entropy
from labelsieve.operators.sampling import assign_split
from labelsieve.plans.count_classifier import fit_count_classifier
from labelsieve.plans.evaluate import evaluate, tuned_thresholds
from labelsieve.plans.predict_and_flag import (
    MULTI_LABEL,
    SINGLE_LABEL,
    Classifier,
    check_problem_type,
    probabilities,
)
from labelsieve.session import spool


# Learners: logistic regression on Spark ML, or counts of tokens in closed form.
LOGISTIC = "logistic"
COUNTS = "counts"


@dataclass(frozen=True)
class TextClassifier:
    """Fitted stages: the shared text features, and one model, or one per label."""

    features: PipelineModel
    heads: tuple
    problem_type: str

    def logits(self, df: DataFrame, text: str = "text", name: str = "logits") -> DataFrame:
        """Class scores whose softmax (or sigmoid, multi-label) is the model's probability."""
        kept = df.columns
        rows = self.features.transform(df.withColumn("_text", present_text(F.col(text))))
        if self.problem_type == SINGLE_LABEL:
            rows = self.heads[0].transform(rows)
            scores = F.transform(vector_to_array("probability"), lambda p: F.ln(p + F.lit(1e-300)))
        else:
            marks = []
            for i, head in enumerate(self.heads):
                rows = head.transform(rows).drop("_pred")
                marks.append(F.element_at(vector_to_array(f"_raw{i}"), 2))
            scores = F.array(*marks)
        return rows.select(*[F.col(f"`{c}`") for c in kept], scores.alias(name))

    def save(self, path: str) -> None:
        """The fitted stages in folders below ``path``, which must not exist yet."""
        spark = SparkSession.active()
        spark.createDataFrame([(self.problem_type, len(self.heads))], _ABOUT).coalesce(1).write.json(f"{path}/about")
        self.features.save(f"{path}/features")
        for i, head in enumerate(self.heads):
            head.save(f"{path}/head{i}")

    @staticmethod
    def load(path: str) -> TextClassifier:
        """What :meth:`save` wrote, for a job of its own."""
        about = SparkSession.active().read.schema(_ABOUT).json(f"{path}/about").first()
        heads = tuple(LogisticRegressionModel.load(f"{path}/head{i}") for i in range(about["n_heads"]))
        return TextClassifier(PipelineModel.load(f"{path}/features"), heads, about["problem_type"])


_ABOUT = "problem_type string, n_heads int"


def fit_text_classifier(
    train: DataFrame,
    problem_type: str = SINGLE_LABEL,
    n_labels: int = 2,
    text: str = "text",
    label: str = "label",
    n_features: int = 1 << 18,
    max_iter: int = 50,
    reg: float = 0.01,
) -> TextClassifier:
    """Fit on ``train``; ``label`` is 0/1, or an array of 0.0/1.0 for multi-label."""
    check_problem_type(problem_type)
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=TOKEN_BREAK),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=n_features),
        IDF(inputCol="_tf", outputCol="_features"),
    ]
    rows = train.select(present_text(F.col(text)).alias("_text"), F.col(label).alias("_label"))
    features = Pipeline(stages=stages).fit(rows)
    # Each optimiser step reads the features again, so they are written once.
    ready = spool(features.transform(rows).select("_features", "_label"))

    def head(i: int | None) -> object:
        target = F.col("_label") if i is None else F.element_at("_label", i + 1)
        lr = LogisticRegression(
            featuresCol="_features",
            labelCol="_y",
            maxIter=max_iter,
            regParam=reg,
            family="binomial" if i is not None or n_labels == 2 else "auto",
            rawPredictionCol="_raw" if i is None else f"_raw{i}",
            probabilityCol="probability" if i is None else "",
            predictionCol="_pred",
        )
        return lr.fit(ready.select("_features", target.cast("double").alias("_y")))

    heads = (head(None),) if problem_type == SINGLE_LABEL else tuple(head(i) for i in range(n_labels))
    return TextClassifier(features, heads, problem_type)


@dataclass(frozen=True)
class TrainingRun:
    """The model, its metrics, split rows, scored held-out rows, label counts by part, eval loss."""

    classifier: Classifier
    eval_metrics: DataFrame
    test_metrics: DataFrame
    parts: DataFrame
    scored: DataFrame
    label_counts: DataFrame
    eval_loss: DataFrame | None


def train_text_classifier(
    df: DataFrame,
    labels: Sequence[str],
    key: str = "row_id",
    problem_type: str = SINGLE_LABEL,
    extra: DataFrame | None = None,
    text: str = "text",
    label: str = "label",
    template: str | None = None,
    chat: tuple[str, str] | None = None,
    test_ratio: float = 0.2,
    eval_ratio: float = 0.1,
    seed: int = 42,
    tune: bool = False,
    eos: str | None = None,
    max_length: int | None = None,
    learner: str = LOGISTIC,
    **fit_options,
) -> TrainingRun:
    """Prompt, split, add extra rows to the training part only, fit, and judge.

    With ``tune``, multi-label thresholds come from the eval part and are applied
    to both parts. ``test_ratio=0`` is the two-way split: the test metrics are
    then those of the eval part. ``learner`` is ``LOGISTIC`` or, for exclusive
    classes, ``COUNTS`` (see ``fit_count_classifier``).
    """
    if learner not in (LOGISTIC, COUNTS) or learner == COUNTS and problem_type != SINGLE_LABEL:
        raise ValueError(f"learner {learner!r} does not fit {problem_type}")
    prompted = df.withColumn(text, model_text(F.col(text), template, chat, eos, max_length))
    # Fitting, counting and scoring all read the split rows; what they come from is read once.
    parts = spool(assign_split(spool(prompted), key, test_ratio, eval_ratio, seed))
    counts = label_distribution(parts, label, by=["split"])
    train = parts.where(F.col("split") == "train").select(text, label)
    if extra is not None:
        # Extra text has no prompt, but the same end and length.
        given = model_text(F.col(text), eos=eos, max_length=max_length).alias(text)
        added = spool(extra.select(given, label))
        train = append_train(train, added)
        for name, rows in (("extra", added), ("train and extra", train)):
            counted = label_distribution(rows.withColumn("split", F.lit(name)), label, by=["split"])
            counts = counts.unionByName(counted)
    classifier: Classifier
    if learner == COUNTS:
        classifier = fit_count_classifier(train, len(labels), text, label, **fit_options)
    else:
        classifier = fit_text_classifier(train, problem_type, len(labels), text, label, **fit_options)

    held = parts.where(F.col("split") != "train")
    scored = spool(
        classifier.logits(held, text)
        .withColumn("probs", probabilities(F.col("logits"), problem_type))
        .select(key, "split", label, "logits", "probs")
    )
    held_eval = scored.where(F.col("split") == "eval")
    held_test = scored.where(F.col("split") == "test") if test_ratio else held_eval
    thresholds = None
    if tune and problem_type == MULTI_LABEL:
        thresholds = tuned_thresholds(held_eval, "probs", label, len(labels))
    judged = [
        evaluate(part, problem_type, labels, "probs", label, thresholds=thresholds)
        for part in (held_eval, held_test)
    ]
    loss = mean_cross_entropy(held_eval, "probs", label) if problem_type == SINGLE_LABEL else None
    return TrainingRun(classifier, judged[0], judged[1], parts, scored, counts, loss)
