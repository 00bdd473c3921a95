"""Ratings, labels, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.catalog import fixtures as fx
from labelsieve.catalog.registry import query, r6, s6, table
from labelsieve.operators import labels as lab
from labelsieve.operators import ratings as rat
from labelsieve.operators.prefix import with_row_id
from labelsieve.operators.sampling import assign_split
from labelsieve.plans.labelled_data import label_ratings
from labelsieve.sources.tables import load_splits


def _groups_sql(where: str) -> str:
    return f"""
SELECT split, md5(text) AS text_md5, target, title, min(row_id) AS row_id,
       coalesce(first(cluster ORDER BY row_id), -1) AS cluster,
       string_agg(CAST(acceptability AS VARCHAR), ', ' ORDER BY row_id) AS concatenated_acceptability,
       {s6("CAST(avg(acceptability) AS FLOAT)")} AS average_acceptability
FROM ({fx.RATINGS})
WHERE acceptability IS NOT NULL AND {where}
GROUP BY split, text, target, title
"""


def _groups(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return rat.prepare_ratings(fx.ratings(spark, sf_dir), mode, split="split").select(
        "split",
        F.md5("text").alias("text_md5"),
        "target",
        "title",
        "row_id",
        F.coalesce("cluster", F.lit(-1)).alias("cluster"),
        rat.JOINED,
        r6(rat.MEAN).alias(rat.MEAN),
    )


@query(_groups_sql("true"))
def rating_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, "all")


@query(_groups_sql("cluster IS DISTINCT FROM 1"))
def rating_groups_cluster0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, "cluster 0")


@query(_groups_sql("cluster IS DISTINCT FROM 0"))
def rating_groups_cluster1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, "cluster 1")


@query(f"""
SELECT text, target, title, min(row_id) AS row_id,
       string_agg(CAST(acceptability AS VARCHAR), ', ' ORDER BY row_id) AS concatenated_acceptability,
       {s6("CAST(avg(acceptability) AS FLOAT)")} AS average_acceptability
FROM ({fx.WIDE_RATINGS}) GROUP BY text, target, title
""")
def rating_groups_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.wide_ratings(spark, sf_dir).drop("value")
    return rat.aggregate_ratings(rows).select(
        "text", "target", "title", "row_id", rat.JOINED, r6(rat.MEAN).alias(rat.MEAN)
    )


# Ratings per string in the query below: each event type holds more, and there are few types.
_PART_ROWS = 500


@query(f"""
SELECT text, CAST(part AS BIGINT) AS part, min(row_id) AS row_id, count(*) AS n_ratings,
       string_agg(CAST(acceptability AS VARCHAR), ', ' ORDER BY row_id) AS concatenated_acceptability
FROM (SELECT *, (row_number() OVER (PARTITION BY text ORDER BY row_id) - 1) // {_PART_ROWS} AS part
      FROM ({fx.WIDE_RATINGS}))
GROUP BY text, part
""")
def rating_groups_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.wide_ratings(spark, sf_dir)
    return rat.rating_parts(rows, _PART_ROWS, keys=["text"])


@query(f"""
SELECT text, row_id, md5(s) AS ratings_md5, n_ratings, label
FROM (SELECT text, min(row_id) AS row_id, count(*) AS n_ratings,
             string_agg(CAST(acceptability AS VARCHAR), ', ' ORDER BY row_id) AS s,
             CAST(avg(acceptability) < 2 AS INT) AS label
      FROM (SELECT * REPLACE (row_id * 1000 AS row_id) FROM ({fx.WIDE_RATINGS})) GROUP BY text)
""")
def label_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A few keys hold all rows, and their ids are far apart.
    rows = fx.wide_ratings(spark, sf_dir).withColumn("row_id", F.col("row_id") * 1000)
    rows = rows.withColumns({"target": F.lit("t"), "title": F.lit("")})
    data = label_ratings(rows, "single_label_classification", rule="<2", label_column=rat.MEAN)
    return data.rows.select(
        "text",
        "row_id",
        F.md5(rat.JOINED).alias("ratings_md5"),
        F.size(F.split(rat.JOINED, ", ")).cast("long").alias("n_ratings"),
        "label",
    )


@query(f"""
SELECT target, min(row_id) AS row_id, string_agg(CAST(value AS VARCHAR), ', ' ORDER BY row_id) AS concatenated_acceptability,
       round(CAST(CAST(avg(value) AS FLOAT) AS DOUBLE), 3) + 0.0 AS average_acceptability
FROM ({fx.WIDE_RATINGS}) GROUP BY target
""")
def rating_groups_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.wide_ratings(spark, sf_dir).select("row_id", "target", "value")
    return rat.aggregate_ratings(rows, keys=["target"], rating="value").select(
        "target",
        "row_id",
        rat.JOINED,
        (F.round(F.col(rat.MEAN).cast("double"), 3) + F.lit(0.0)).alias(rat.MEAN),
    )


@query(f"""
SELECT split, count(*) AS input_rows,
       count(*) FILTER (acceptability IS NULL) AS dropped_unrated,
       count(*) FILTER (acceptability IS NOT NULL AND cluster IS NOT DISTINCT FROM 1) AS dropped_cluster,
       count(*) FILTER (acceptability IS NOT NULL AND cluster IS DISTINCT FROM 1) AS kept_rows
FROM ({fx.RATINGS}) GROUP BY split
""")
def rating_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = {
        "unrated": F.col(rat.RATING).isNotNull(),
        "cluster": ~rat.other_cluster("cluster 0"),
    }
    return rat.filter_counts(fx.ratings(spark, sf_dir), steps, ["split"])


@query("""
SELECT split, count(*) AS n_rows, count(lang) AS n_lang, count(turn) AS n_turn,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM (SELECT 'documents' AS split, text, lang, NULL AS turn FROM documents
      UNION ALL SELECT 'conversations', text, NULL, turn FROM conversations)
GROUP BY split
""")
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {name: f"{sf_dir}/{name}.parquet" for name in ("documents", "conversations")}
    return (
        load_splits(spark, paths)
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("lang").alias("n_lang"),
            F.count("turn").alias("n_turn"),
            F.sum(F.length("text")).cast("long").alias("n_chars"),
        )
    )


_MEANS = f"""
SELECT split, min(row_id) AS row_id, CAST(CAST(avg(acceptability) AS FLOAT) AS DOUBLE) AS m
FROM ({fx.RATINGS}) WHERE acceptability IS NOT NULL GROUP BY split, text, target, title
"""


@query(f"""
SELECT row_id, {s6("m")} AS average_acceptability, CAST(m < 2 AS INT) AS below_two,
       CAST(m <= 2 AS INT) AS at_most_two, CAST(m != 2 AS INT) AS not_two, CAST(m != 0 AS INT) AS truthy
FROM ({_MEANS})
""")
def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rat.drop_null(rat.prepare_ratings(fx.ratings(spark, sf_dir), split="split"), rat.MEAN)
    for name, rule in {"below_two": "<2", "at_most_two": "<= 2", "not_two": "!=2", "truthy": ""}.items():
        rows = lab.binarise(rows, rat.MEAN, rule, name)
    return rows.select(
        "row_id", r6(rat.MEAN).alias(rat.MEAN), "below_two", "at_most_two", "not_two", "truthy"
    )


@query(f"""
SELECT split, CAST(m < 2 AS INT) AS label, count(*) AS n_rows FROM ({_MEANS}) GROUP BY ALL
""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = label_ratings(
        fx.ratings(spark, sf_dir),
        "single_label_classification",
        rule="<2",
        label_column=rat.MEAN,
        split="split",
    )
    return lab.label_distribution(data.rows, by=["split"])


def _hot_sql(order: list[int], null_at: int | None) -> str:
    cells = []
    for k in order:
        bit = f"((label >> {k}) & 1) = 1"
        if null_at == k:
            bit = f"CASE WHEN label != 5 THEN {bit} END"
        cells.append(f"CASE WHEN {bit} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS k{k}")
    return f"SELECT vec_id AS row_id, {', '.join(cells)} FROM embeddings"


@query(_hot_sql([0, 1, 2, 3], null_at=2))
def multi_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.multi(spark, sf_dir).select(
        "row_id",
        F.col("category")
        .withField("k2", F.when(F.col("label_bits") != 5, F.col("category.k2")))
        .alias("label"),
    )
    hot = lab.multi_hot(rows, "label", name="hot")
    return hot.select("row_id", *[F.element_at("hot", i + 1).alias(f"k{i}") for i in range(4)])


@query(_hot_sql([3, 1, 0], null_at=None))
def ordered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["k3", "k1", "k0"]
    hot = lab.multi_hot(fx.multi(spark, sf_dir), "category", order, strict=True, name="hot")
    return hot.select("row_id", *[F.element_at("hot", i + 1).alias(k) for i, k in enumerate(order)])


@query(f"""
WITH l AS ({fx.LABELLED})
SELECT 'number' AS variant, doc_id, md5(text) AS text_md5, toxic AS label FROM l
UNION ALL SELECT 'words', doc_id, md5(text), toxic FROM l
UNION ALL SELECT 'truth', doc_id, md5(text), toxic FROM l
UNION ALL SELECT 'health', doc_id, md5(text), toxic FROM l WHERE quality = 1
UNION ALL SELECT 'mapping', doc_id, md5(text), 1 - toxic FROM l
UNION ALL SELECT 'partial', doc_id, md5(text), 1 FROM l WHERE toxic = 1
""")
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, toxic = fx.labelled(spark, sf_dir), F.col("toxic")
    variants = {
        "number": (toxic, None),
        "words": (F.when(toxic == 1, "UNSAFE ").otherwise("Safe"), None),
        "truth": (toxic == 1, None),
        "health": (F.when(F.col("quality") == 1, F.when(toxic == 1, "unhealthy").otherwise("Healthy")), None),
        "mapping": (toxic + 1, {"2": 0, "1": 1}),
        "partial": (toxic + 1, {"2": 1}),
    }
    out = None
    for name, (value, mapping) in variants.items():
        part = lab.prepare_labelled(
            rows.withColumn("_value", value), "text", "_value", mapping, keep=["doc_id"]
        ).select(F.lit(name).alias("variant"), "doc_id", F.md5("text").alias("text_md5"), "label")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""
SELECT DISTINCT CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END AS value FROM ({fx.LABELLED})
""")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.labelled(spark, sf_dir).select(
        F.when(F.col("toxic") == 1, "UNSAFE ").otherwise("Safe").alias("label")
    )
    return lab.distinct_labels(rows)


@query(f"""
SELECT md5(text) AS text_md5, target, label FROM (
  SELECT text, target, CAST(CAST(CAST(avg(acceptability) AS FLOAT) AS DOUBLE) < 2 AS INT) AS label
  FROM ({fx.RATINGS}) WHERE acceptability IS NOT NULL GROUP BY text, target, title
  UNION ALL
  SELECT text, NULL, toxic FROM ({fx.LABELLED}))
""")
def train_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = label_ratings(
        fx.ratings(spark, sf_dir).drop("split"),
        "single_label_classification",
        rule="<2",
        label_column=rat.MEAN,
    ).rows.select("text", "target", "label")
    extra = lab.prepare_labelled(fx.labelled(spark, sf_dir), "text", "toxic")
    return lab.append_train(train, extra).select(F.md5("text").alias("text_md5"), "target", "label")


@query(fx.split_sql("documents", "doc_id"))
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_split(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "split")


@query(f"SELECT split, count(*) AS n_rows FROM ({fx.split_sql('events', 'event_id')}) GROUP BY split")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = assign_split(table(spark, sf_dir, "events"), "event_id")
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query(fx.split_sql("documents", "doc_id", 0.0, 0.1, seed=7))
def split_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return assign_split(rows, "doc_id", test_ratio=0.0, seed=7).select("doc_id", "split")


@query("""
SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id FROM conversations
""")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return with_row_id(rows, ["conv_id", "turn"], bucket_rows=200).select("conv_id", "turn", "row_id")
