"""Prompts, chats, tokens, perplexity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.catalog import fixtures as fx
from labelsieve.catalog.registry import query, r6, s6, table
from labelsieve.functions import text as txt
from labelsieve.operators.calibration import above, ppl_threshold
from labelsieve.operators.chat import render_chat
from labelsieve.operators.perplexity import array_perplexity, count_tokens, score_tokens, text_perplexity
from labelsieve.operators.review import flag_review, flag_tokens, high_token_count
from labelsieve.operators.sampling import assign_split
from labelsieve.session import fill_cores, spool

_TEMPLATE = "### Text:\n{text}\n### {{text}} {{{text}}}"
_CHAT = ("<user>\n", "\n</user>")


@query(f"""
SELECT doc_id, md5('### Text:' || chr(10) || text || chr(10) || '### {{text}} {{' || text || '}}') AS templated,
       md5('<user>' || chr(10) || text || chr(10) || '</user>') AS chat, md5(text) AS plain
FROM documents
""")
def prompt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(txt.format_prompt(text, _TEMPLATE, _CHAT)).alias("templated"),
        F.md5(txt.format_prompt(text, None, _CHAT)).alias("chat"),
        F.md5(txt.format_prompt(text)).alias("plain"),
    )


@query("""
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_chat(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text")


@query("""
SELECT doc_id, md5(CASE WHEN ends_with(text, '.') THEN text ELSE text || '.' END) AS text_md5,
       ends_with(text, '.') AS unchanged
FROM documents
""")
def eos_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = txt.append_eos(F.col("text"), ".")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(marked).alias("text_md5"), (marked == F.col("text")).alias("unchanged")
    )


TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_LIMIT = 512


@query(f"""
SELECT doc_id, CAST(len(ts) AS INT) AS n_tokens, CAST(least(len(ts), {_LIMIT}) AS INT) AS n_kept,
       md5(array_to_string(ts[1:{_LIMIT}], ' ')) AS kept, len(ts) > {_LIMIT} AS truncated,
       CAST({_LIMIT} AS INT) AS n_padded,
       md5(array_to_string(ts[1:{_LIMIT}] || list_transform(range(greatest(0, {_LIMIT} - len(ts))), lambda k: '<pad>'), ' '))
         AS padded
FROM (SELECT doc_id, {TOKENS_SQL} AS ts FROM documents)
""")
def token_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_cores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # The array is read several times below; a generator hands it on as a value.
    rows = docs.select("doc_id", F.explode(F.array(txt.tokens(F.col("text")))).alias("ts"))
    return txt.tokenize(rows, "text", _LIMIT, "max_length", words="ts").select(
        "doc_id",
        F.size("ts").alias("n_tokens"),
        F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x).alias("n_kept"),
        F.md5(F.array_join(txt.truncate(F.col("ts"), _LIMIT), " ")).alias("kept"),
        txt.is_truncated(F.col("ts"), _LIMIT).alias("truncated"),
        F.size("tokens").alias("n_padded"),
        F.md5(F.array_join("tokens", " ")).alias("padded"),
    )


@query(f"""
SELECT lang, count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_tokens,
       CAST(max(len(ts)) AS INT) AS longest, count(*) FILTER (len(ts) > 256) AS n_truncated
FROM (SELECT lang, {TOKENS_SQL} AS ts FROM documents) GROUP BY lang
""")
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = txt.effective_length(512, 256)
    rows = table(spark, sf_dir, "documents").select("lang", txt.tokens(F.col("text")).alias("ts"))
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.size("ts")).alias("n_tokens"),
        F.max(F.size("ts")).alias("longest"),
        F.count_if(txt.is_truncated(F.col("ts"), limit)).alias("n_truncated"),
    )


# --- perplexity: counts from the training part, scores for the test part ---

def masked_sql(docs: str) -> str:
    """``docs``, ``occ`` and ``tok``, token scores of the test part of (doc_id, text, split) rows."""
    return f"""
WITH docs AS (SELECT doc_id, split, {TOKENS_SQL} AS ts FROM ({docs})),
occ AS (SELECT doc_id, split, CAST(i AS INT) AS position, ts[i] AS w,
               coalesce(CASE WHEN i > 1 THEN ts[i - 1] END, '<s>') AS l, coalesce(ts[i + 1], '</s>') AS r
        FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM docs)),
tri AS (SELECT l, w, r, count(*) AS c FROM occ WHERE split = 'train' GROUP BY l, w, r),
ctx AS (SELECT l, r, sum(c) AS c FROM tri GROUP BY l, r),
uni AS (SELECT w, sum(c) AS c FROM tri GROUP BY w),
tok AS (SELECT doc_id, position, w AS token,
               ln((coalesce(tri.c, 0) + coalesce(uni.c, 1) / (SELECT CAST(sum(c) AS DOUBLE) FROM tri))
                  / (coalesce(ctx.c, 0) + 1)) AS log_prob
        FROM occ LEFT JOIN tri USING (l, w, r) LEFT JOIN ctx USING (l, r) LEFT JOIN uni USING (w)
        WHERE split = 'test')
"""


_SCORED = masked_sql(
    f"SELECT d.doc_id, d.text, s.split FROM documents d JOIN ({fx.split_sql('documents', 'doc_id')}) s USING (doc_id)"
)


def _token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = assign_split(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    counts = count_tokens(parts.where(F.col("split") == "train"))
    return score_tokens(parts.where(F.col("split") == "test"), counts, "doc_id")


@query(f"""
{_SCORED} SELECT doc_id, position, token, {s6("log_prob")} AS log_prob, {s6("ln(exp(-log_prob))")} AS log_ppl FROM tok
""")
def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _token_scores(spark, sf_dir).where(F.col("token").isNotNull())
    return rows.select(
        "doc_id", "position", "token", r6("log_prob").alias("log_prob"), r6(F.ln("token_ppl")).alias("log_ppl")
    )


@query(f"""
{_SCORED}
SELECT d.doc_id, round(coalesce(p.ppl, 'nan'::DOUBLE), 4) AS pseudo_perplexity, coalesce(p.n, 0) AS n_tokens
FROM (SELECT doc_id FROM docs WHERE split = 'test') d
LEFT JOIN (SELECT doc_id, exp(-avg(log_prob)) AS ppl, count(*) AS n FROM tok GROUP BY doc_id) p USING (doc_id)
""")
def masked_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = text_perplexity(_token_scores(spark, sf_dir), "doc_id", with_tokens=True)
    return per_doc.select(
        "doc_id",
        F.round(array_perplexity(F.col("token_scores")), 4).alias("pseudo_perplexity"),
        F.size("token_scores").cast("long").alias("n_tokens"),
    )


@query(f"""
{_SCORED}, doc AS (SELECT doc_id, exp(-avg(log_prob)) AS ppl FROM tok GROUP BY doc_id)
SELECT doc_id, coalesce(ppl > (SELECT quantile_cont(ppl, 0.95) FROM doc), false) AS flag_high_ppl,
       coalesce(ppl > 4000, false) AS flag_absolute,
       coalesce(ppl > (SELECT quantile_cont(ppl, 0.8) FROM doc), false) AS flag_reference
FROM (SELECT doc_id FROM docs WHERE split = 'test') LEFT JOIN doc USING (doc_id)
""", "ppl_threshold")
def ppl_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The quantile passes and the result all read it.
    per_doc = spool(text_perplexity(_token_scores(spark, sf_dir), "doc_id"))
    scored = per_doc.where(~F.isnan("pseudo_perplexity"))
    reference = scored.withColumnRenamed("pseudo_perplexity", "m_pseudo_perplexity")
    cuts = {
        "flag_high_ppl": ppl_threshold(scored, "pseudo_perplexity"),
        "flag_absolute": ppl_threshold(scored, "pseudo_perplexity", absolute=4000.0),
        "flag_reference": ppl_threshold(
            scored, "pseudo_perplexity", percentile=80.0, reference=reference, model="m"
        ),
    }
    return per_doc.select(
        "doc_id", *[above(F.col("pseudo_perplexity"), cut).alias(name) for name, cut in cuts.items()]
    )


@query(f"""
{_SCORED}, doc AS (SELECT doc_id, exp(-avg(log_prob)) AS ppl FROM tok GROUP BY doc_id),
f AS (SELECT doc_id, least(length(text), 4000) / 4000.0 < 0.5 AS low,
             coalesce(ppl > (SELECT quantile_cont(ppl, 0.8) FROM doc), false) AS high
      FROM documents JOIN (SELECT doc_id FROM docs WHERE split = 'test') USING (doc_id) LEFT JOIN doc USING (doc_id))
SELECT doc_id, low AS flag_low_confidence, high AS flag_high_ppl, low OR high AS manual_review,
       concat_ws(',', CASE WHEN low THEN 'low_confidence' END, CASE WHEN high THEN 'high_pseudo_perplexity' END)
         AS manual_review_reason
FROM f
""")
def review_flags_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A stand-in confidence by length, so that each reason occurs alone and both together.
    per_doc = spool(text_perplexity(_token_scores(spark, sf_dir), "doc_id"))
    cut = ppl_threshold(per_doc.where(~F.isnan("pseudo_perplexity")), "pseudo_perplexity", percentile=80.0)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.least(F.length("text"), F.lit(4000)) / 4000.0).alias("sure")
    )
    flagged = flag_review(rows.join(per_doc, "doc_id"), 0.5, "sure", "pseudo_perplexity", cut)
    return flagged.select(
        "doc_id", "flag_low_confidence", "flag_high_ppl", "manual_review", "manual_review_reason"
    )


_TOKEN_CUT = 4321.5


@query(f"""
{_SCORED}
SELECT doc_id, CAST(count(*) FILTER (exp(-log_prob) > {_TOKEN_CUT}) AS INT) AS n_high,
       count(*) FILTER (exp(-log_prob) > {_TOKEN_CUT}) >= 3 AS flag_many_high_ppl_tokens
FROM (SELECT doc_id FROM docs WHERE split = 'test') LEFT JOIN tok USING (doc_id) GROUP BY doc_id
""")
def token_ppl_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = text_perplexity(_token_scores(spark, sf_dir), "doc_id", with_tokens=True)
    return per_doc.select(
        "doc_id",
        high_token_count(F.col("token_scores"), _TOKEN_CUT).alias("n_high"),
        flag_tokens(F.col("token_scores"), _TOKEN_CUT, 3).alias("flag_many_high_ppl_tokens"),
    )
