"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.catalog.registry import Query, table
from labelsieve.llm import (
    fingerprints,
    html_text,
    language,
    leaks,
    lexical,
    licenses,
    near,
    pieces,
    quality,
    sanitise,
    toxicity,
    whitening,
)
from labelsieve.llm.tokens import count_tokens

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query, sql: str | None = None) -> Query:
    QUERIES[fn.__name__] = fn
    if sql is not None:
        SQL[fn.__name__] = sql
    return fn


def _words_sql(text: str, gap: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{gap}'), lambda w: w <> '')"


# What is neither a letter nor a digit.
_NOT_WORD = r"[^\p{L}\p{N}]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, and whether they exceed the limit."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learnt from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    blamed = F.transform("offending", lambda s: F.concat_ws(":", s["begin"], s["end"]))
    return toxicity.score_documents(docs, model).withColumn("offending", F.array_join(blamed, ","))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learnt from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    return language.predict_documents(docs, language.fit_on(docs))


# All pairs that share a shingle, then what links connect.
_NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words_sql("text", "[[:space:]]+")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i : i + 4] END, ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT doc_id, class_id, coalesce(links, 0) AS links
FROM (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
LEFT JOIN (SELECT a AS doc_id, count(*) AS links FROM l GROUP BY a) USING (doc_id)
"""


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each document, five words, similarity 0.8."""
    return near.join_documents(table(spark, sf_dir, "documents"))


query(op8_near_join, _NEAR_SQL)


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, and how alike they are."""
    return fingerprints.fingerprint_beside_next(table(spark, sf_dir, "documents"))


@query
def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that occur in documents, exactly or nearly."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each document, and the text decoded from them."""
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each document, and the half that is sampled by it."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_NOTICES_SQL = ", ".join(
    f"({_quoted(name)}, {_quoted(notice)})" for name, notices in licenses.NOTICES.items() for notice in notices
)
_WITHIN_SQL = " OR ".join(
    f"f.license = {_quoted(inner)} AND x.license = {_quoted(outer)}" for inner, outer in licenses.WITHIN.items()
)
_LICENSE_SQL = f"""
WITH n AS (SELECT license, notice, {_words_sql("notice", _NOT_WORD)} AS ws
           FROM (VALUES {_NOTICES_SQL}) t(license, notice)),
ns AS (SELECT DISTINCT license, notice, array_to_string(ws[i : i + 4], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM n)),
size AS (SELECT license, notice, count(*) AS n FROM ns GROUP BY ALL),
sib AS (SELECT a.license, a.notice, b.license AS l2, b.notice AS n2 FROM ns a JOIN ns b USING (g)
        JOIN size z ON z.license = a.license AND z.notice = a.notice WHERE a.license <> b.license
        GROUP BY ALL HAVING count(*) >= {licenses.SIBLING} * any_value(z.n)),
own AS (SELECT s.*, a.g FROM sib s JOIN ns a USING (license, notice)
        WHERE NOT EXISTS (SELECT 1 FROM ns b WHERE b.license = s.l2 AND b.notice = s.n2 AND b.g = a.g)),
d AS (SELECT doc_id, {_words_sql("text", _NOT_WORD)} AS ws FROM documents),
ds AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM d)) WHERE g IN (SELECT g FROM ns)),
c AS (SELECT doc_id, license, notice, count(*) AS k FROM ds JOIN ns USING (g) GROUP BY ALL),
no AS (SELECT license, notice, l2, n2, count(*) AS n_own FROM own GROUP BY ALL),
co AS (SELECT doc_id, license, notice, l2, n2, count(*) AS k_own FROM ds JOIN own USING (g) GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id, license, notice FROM (SELECT DISTINCT doc_id, license, notice FROM c) JOIN no USING (license, notice)
        LEFT JOIN co USING (doc_id, license, notice, l2, n2) WHERE coalesce(k_own, 0) < {licenses.OWN} * n_own),
f AS (SELECT doc_id, license, max(k / n) AS containment FROM c JOIN size USING (license, notice)
      ANTI JOIN bad USING (doc_id, license, notice) WHERE k / n >= 0.8 GROUP BY doc_id, license)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.doc_id = f.doc_id AND ({_WITHIN_SQL}))
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that documents have a notice of."""
    found = licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))
    return found.select("doc_id", "license", "containment")


query(op3_license_scan, _LICENSE_SQL)


# Terms by their pattern, counts by grouping, all scores of an item, its ten best.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '{_TERM}')"


_SEARCH_SQL = f"""
WITH d AS (SELECT doc_id, ts, len(ts) AS n FROM (SELECT doc_id, {_terms_sql("text")} AS ts FROM documents) WHERE len(ts) > 0),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_terms_sql("text")}) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000.0::DOUBLE * ln(CAST(2 * nd + 2 AS DOUBLE) / (2.0::DOUBLE * count(*) + 1.0::DOUBLE))) AS BIGINT) AS w
      FROM p, s WHERE t IN (SELECT t FROM i) GROUP BY t, nd),
f AS (SELECT item_id, doc_id,
             CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // l))))) AS BIGINT) AS score
      FROM i JOIN w USING (t) JOIN p USING (t), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM f WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 10
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that match each benchmark item best."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


query(op11_lexical_search, _SEARCH_SQL)


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document, and terms that give it away."""
    found = sanitise.sanitise(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256")
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", digest
    )


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
