"""Token and text perplexity from a masked-token model made of counts.

Each token is hidden in turn and judged by its two neighbours:
``p(w | l, r) = (c(l, w, r) + a * c(w) / N) / (c(l, ., r) + a)``, with counts over
a corpus table. A word the corpus lacks counts as seen once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsieve.functions.text import tokens
from labelsieve.operators.skew import HOT_ROWS, lookup_join
from labelsieve.session import fill_cores, spool

# Neighbours beyond both ends of a text. Tokens hold only letters and digits.
TEXT_START = "<s>"
TEXT_END = "</s>"

# A context with more than this share of all tokens does not go to one task.
HOT_SHARE = 100
# Large contexts are looked for among about so many tokens; how often they occur is counted.
SKETCH_TOKENS = 1_000_000
# A word is common above this share of all tokens; fewer words than this can be.
COMMON_WORDS = 500_000
# Tokens dealt to one task, about.
TASK_TOKENS = 500_000

_TRIPLE = ["prev", "token", "next"]
_CONTEXT = ["_c1", "_c2"]


def _with_context(rows: DataFrame) -> DataFrame:
    """96 bits that stand for both neighbours where their strings would be shuffled."""
    return rows.withColumns(
        {"_c1": F.xxhash64("prev", "next"), "_c2": F.hash("prev", "next")}
    ).drop("prev", "next")


def token_rows(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per token with its neighbours; a text without tokens keeps one null row.

    Neighbours come from the row's own token array, shifted by one each way: no
    shuffle, and no lambda per token.
    """
    toks = df.select(*keep, tokens(F.col(text)).alias("_ts"))
    size = F.size("_ts")
    prev = F.slice(F.concat(F.array(F.lit(TEXT_START)), F.col("_ts")), F.lit(1), size)
    following = F.slice(F.concat(F.col("_ts"), F.array(F.lit(TEXT_END))), F.lit(2), size)
    zipped = F.arrays_zip(prev.alias("prev"), F.col("_ts").alias("token"), following.alias("next"))
    rows = toks.select(*keep, zipped.alias("_z")).select(
        *keep, F.posexplode_outer("_z").alias("_at", "_t")
    )
    return rows.select(*keep, (F.col("_at") + 1).alias("position"), "_t.*")


@dataclass(frozen=True)
class MaskedCounts:
    """Tokens between each pair of neighbours, the count of each token, and their total.

    ``triples`` has ``c_triple`` occurrences a row, and a triple may have several rows: as
    fitted they are the corpus itself, cut into tokens when read. ``sketch`` is a part of
    them.
    """

    triples: DataFrame
    words: DataFrame
    total: int
    sketch: DataFrame

    def save(self, path: str) -> None:
        self.triples.groupBy(*_TRIPLE).agg(F.sum("c_triple").alias("c_triple")).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> MaskedCounts:
        triples = spark.read.parquet(path)
        words = spool(triples.groupBy("token").agg(F.sum("c_triple").alias("c_word")))
        total = _total(words)
        return MaskedCounts(triples, words, total, _part(triples, total))


def _total(words: DataFrame) -> int:
    return int(words.agg(F.sum("c_word").alias("n")).first()["n"] or 0)


def _part(df: DataFrame, total: int) -> DataFrame:
    """Rows of ``df`` with about ``SKETCH_TOKENS`` of its ``total`` tokens."""
    return df.sample(SKETCH_TOKENS / total, seed=0) if total > SKETCH_TOKENS else df


def count_tokens(corpus: DataFrame, text: str = "text") -> MaskedCounts:
    """Fit the counts: words now; triples when scoring, in one shuffle with what is scored.

    The texts are read each time. Give a table, or a frame that is cheap to read again.
    """
    corpus = fill_cores(corpus)
    words = spool(
        corpus.select(F.explode(tokens(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("c_word"))
    )
    total = _total(words)

    def triples(of: DataFrame) -> DataFrame:
        return token_rows(of, text, []).where(F.col("token").isNotNull()).select(
            *_TRIPLE, F.lit(1).cast("long").alias("c_triple")
        )

    return MaskedCounts(triples(corpus), words, total, triples(_part(corpus, total)))


def _with_word_counts(rows: DataFrame, counts: MaskedCounts) -> DataFrame:
    """Add ``c_word``: common words by a broadcast, so that only the others are shuffled.

    A word that is common in ``rows`` alone makes a partition that Spark splits by itself.
    """
    common = counts.words.where(F.col("c_word") > counts.total // COMMON_WORDS)
    rows = rows.join(F.broadcast(common), "token", "left")
    found = F.col("c_word").isNotNull() | F.col("token").isNull()
    rest = rows.where(~found).drop("c_word").join(counts.words, "token", "left")
    return rows.where(found).unionByName(rest)


def _hot_contexts(seen: DataFrame, share: float, hot_rows: int) -> DataFrame:
    """Contexts with more than ``hot_rows`` rows and a ``HOT_SHARE``-th of all, judged by a part.

    ``seen`` is that part, with ``share`` of the rows.
    """
    per = spool(seen.groupBy(*_CONTEXT).agg(F.count(F.lit(1)).alias("n")))
    n = per.agg(F.sum("n").alias("n")).first()["n"] or 0
    return per.where(F.col("n") > max(hot_rows * share, n / HOT_SHARE)).select(*_CONTEXT)


def _counted_together(train: DataFrame, rows: DataFrame, tasks: int) -> DataFrame:
    """Add ``c_triple`` and ``c_context``: counts and what is scored meet by context, in one shuffle."""
    both = train.unionByName(rows, allowMissingColumns=True)
    context = Window.partitionBy(*_CONTEXT).orderBy("token")
    # In the order of the other window: rows are sorted once.
    whole = context.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        both.repartition(tasks, *_CONTEXT)
        .withColumn("c_context", F.sum("_c").over(whole))
        .withColumn("c_triple", F.sum("_c").over(Window.partitionBy(*_CONTEXT, "token")))
        .where(F.col("_c").isNull())
        .drop("_c")
    )


def _counted_apart(train: DataFrame, rows: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """The same for contexts too large for a task: counted before the shuffle, then looked up."""
    triples = spool(train.groupBy(*_CONTEXT, "token").agg(F.sum("_c").alias("c_triple")))
    contexts = triples.groupBy(*_CONTEXT).agg(F.sum("c_triple").alias("c_context"))
    rows = spool(rows)
    n = rows.count()
    rows = lookup_join(rows, triples, [*_CONTEXT, "token"], [key, "position"], n, hot_rows)
    return lookup_join(rows, contexts, _CONTEXT, [key, "position"], n, hot_rows)


def score_tokens(
    df: DataFrame,
    counts: MaskedCounts,
    key: str,
    text: str = "text",
    a: float = 1.0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``key``, ``position`` (from 1), ``token``, ``log_prob``, ``token_ppl``.

    The occurrences to score and those of the corpus are dealt out together by a digest of
    their two neighbours, and counted where they meet: nothing else of the corpus is
    shuffled or written. Contexts too large for a task are counted apart. A text without
    tokens keeps one row of nulls.
    """
    df = fill_cores(df, key)
    rows = _with_context(token_rows(df, text, [key]))
    # Texts without tokens have no context to share a task for.
    rows = rows.withColumn("_c1", F.when(F.col("token").isNull(), F.xxhash64(key)).otherwise(F.col("_c1")))
    rows = _with_word_counts(rows, counts)
    train = _with_context(counts.triples.withColumnRenamed("c_triple", "_c"))
    fewest = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(fewest, counts.total // TASK_TOKENS)

    hot = None
    if counts.total > hot_rows:
        share = min(1.0, SKETCH_TOKENS / counts.total)
        part = token_rows(_part(df, counts.total), text, []).where(F.col("token").isNotNull())
        seen = counts.sketch.select("prev", "next").unionByName(part.select("prev", "next"))
        hot = spool(_hot_contexts(_with_context(seen), share, hot_rows))
        hot = None if hot.isEmpty() else F.broadcast(hot)
    if hot is None:
        seen = _counted_together(train, rows, tasks)
    else:
        seen = _counted_together(
            train.join(hot, _CONTEXT, "left_anti"), rows.join(hot, _CONTEXT, "left_anti"), tasks
        ).unionByName(
            _counted_apart(
                train.join(hot, _CONTEXT, "left_semi"), rows.join(hot, _CONTEXT, "left_semi"), key, hot_rows
            )
        )

    total = float(max(counts.total, 1))
    share = F.lit(float(a)) * F.coalesce(F.col("c_word"), F.lit(1)) / F.lit(total)
    p = (F.coalesce(F.col("c_triple"), F.lit(0)) + share) / (
        F.coalesce(F.col("c_context"), F.lit(0)) + F.lit(float(a))
    )
    log_prob = F.when(F.col("token").isNotNull(), F.ln(p)).alias("log_prob")
    scored = seen.select(key, "position", "token", log_prob)
    return scored.withColumn("token_ppl", F.exp(-F.col("log_prob")))


def text_perplexity(token_scores: DataFrame, key: str, with_tokens: bool = False) -> DataFrame:
    """``exp(-mean(log_prob))`` per text; NaN for a text without tokens.

    With ``with_tokens`` the token records come along as an array in text order,
    as long as the text itself.
    """
    mean = F.avg("log_prob")
    aggs = [F.coalesce(F.exp(-mean), F.lit(float("nan"))).alias("pseudo_perplexity")]
    if with_tokens:
        # Few tokens of a text are in one task before the shuffle, so rows go through as they are.
        token_scores = token_scores.select(key, "position", "token", "log_prob").repartition(key)
        record = F.struct("position", "token", "log_prob", F.exp(-F.col("log_prob")).alias("token_ppl"))
        aggs.append(
            F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), record))).alias("token_scores")
        )
    return token_scores.groupBy(key).agg(*aggs)


def array_perplexity(token_scores: Column) -> Column:
    """Perplexity out of an array of token records; NaN when it is empty."""
    total = F.aggregate(token_scores, F.lit(0.0), lambda acc, t: acc + t["log_prob"])
    return F.coalesce(F.exp(-F.try_divide(total, F.size(token_scores))), F.lit(float("nan")))
