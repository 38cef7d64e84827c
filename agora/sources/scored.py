"""Stand-in scored table over ``lineitem``: one row per line item with the
20 adapter labels ``<task_k>_ad = (l_partkey*(k+1)+l_linenumber+k) % 4``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions.constants import QUALITY_TASK_WEIGHTS
from agora.sources.tables import EXPERTISE_CYCLE, _cycle, table

TASKS = [t for t, _ in QUALITY_TASK_WEIGHTS]


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    labels = [((F.col("l_partkey") * (k + 1) + F.col("l_linenumber") + k) % 4).cast("long").alias(f"{t}_ad")
              for k, t in enumerate(TASKS)]
    return l.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("user"),
        # a heavy tail: some parts draw hundreds of votes
        (F.col("l_quantity").cast("int") - 5 + F.when(F.col("l_partkey") % 97 == 0, 500).otherwise(0)).cast("long").alias("votes"),
        F.col("l_linenumber").cast("long").alias("n_comments"),
        _cycle(F.col("l_suppkey"), EXPERTISE_CYCLE).cast("string").alias("expertise"),
        F.array(*[(F.col("l_quantity") % 7), (F.col("l_partkey") % 5).cast("double"),
                  (F.col("l_suppkey") % 5).cast("double"), (F.col("l_linenumber") % 4).cast("double")]).alias("logits"),
        *labels,
    )


def weight_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pagerank, kl, llm, target) samples for the weight fit."""
    l = table(spark, sf_dir, "lineitem")
    pr = F.col("l_discount") * 10
    kl = F.col("l_tax") * 10
    llm = (F.col("l_quantity") % 10) / 10
    target = F.lit(0.5) * pr + F.lit(0.3) * kl + F.lit(0.2) * llm + (F.col("l_linenumber") % 3 - 1) * F.lit(0.01)
    return l.select(pr.alias("pagerank"), kl.alias("kl"), llm.alias("llm"), target.alias("target"))
