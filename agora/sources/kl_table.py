"""Stand-in content/topic table over ``documents``: one row per document
with a fixed 4-topic distribution derived from its key, its domains, and
the forum metadata columns the KL table carries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.sources.tables import table

K_TOPICS = 4


def content_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    # every sixth document has one dominant topic, so all divergence bands occur
    sharp = [F.when((k % 6 == 0) & (F.floor(k / 6) % 4 == i), F.lit(1000)).otherwise(F.lit(0)) for i in range(K_TOPICS)]
    raw = F.array(*[(x + s).cast("double") for x, s in zip((1 + k % 3, 1 + k % 5, k % 7, k % 2), sharp)])
    total = (1 + k % 3) + (1 + k % 5) + (k % 7) + (k % 2) + F.when(k % 6 == 0, F.lit(1000)).otherwise(F.lit(0))
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc "), k.cast("string")).alias("title"),
        F.concat(F.lit("s"), (k % 50).cast("string")).alias("user"),
        F.when(k % 4 == 0, F.array(F.col("lang"), F.lit("mixed"))).otherwise(F.array(F.col("lang"))).alias("domains"),
        (F.col("n_chars") % 97 - 20).cast("long").alias("votes"),
        (F.col("n_chars") % 13).cast("long").alias("n_comments"),
        (F.col("n_chars") % 5).cast("long").alias("depth"),
        F.transform(raw, lambda x: x / total.cast("double")).alias("topic_dist"),
    )


CONTENT_TOPICS_SQL = """content_topics AS (
  SELECT doc_id AS id, 'doc ' || CAST(doc_id AS VARCHAR) AS title, 's' || CAST(doc_id % 50 AS VARCHAR) AS "user",
         CASE WHEN doc_id % 4 = 0 THEN [lang, 'mixed'] ELSE [lang] END AS domains,
         CAST(n_chars % 97 - 20 AS BIGINT) AS votes, CAST(n_chars % 13 AS BIGINT) AS n_comments,
         CAST(n_chars % 5 AS BIGINT) AS depth,
         list_transform([CAST(1 + doc_id % 3 + s[1] AS DOUBLE), CAST(1 + doc_id % 5 + s[2] AS DOUBLE),
                         CAST(doc_id % 7 + s[3] AS DOUBLE), CAST(doc_id % 2 + s[4] AS DOUBLE)],
                        lambda x: x / CAST((1 + doc_id % 3) + (1 + doc_id % 5) + (doc_id % 7) + (doc_id % 2) + list_sum(s) AS DOUBLE))
           AS topic_dist
  FROM (SELECT *, [CASE WHEN doc_id % 6 = 0 AND (doc_id // 6) % 4 = i THEN 1000 ELSE 0 END for i in [0, 1, 2, 3]] AS s
        FROM documents))"""
